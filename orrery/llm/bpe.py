"""Byte-level BPE encoding and decoding on length-bucketed numpy matrices.

Each distinct pre-token becomes one row of a padded matrix of byte ids. In a round every row merges its
leftmost pair of minimum rank, found through an open-addressed hash table of pairs; a row so loses one
column, and the matrix is compacted. Rows without a known pair leave.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; ids
depend on nothing but the text, so repeated rows, ties and other columns do not matter. Very long
pre-tokens take another form of the same rule (`_encode_long`).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, text_or_empty

NONE = np.int32(2**31 - 1)
LONG_BYTES = 512
CACHE_WORDS = 300_000


class Codec:
    """Ranks of a byte-level vocabulary as lookup tables."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        keys = np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64)
        ids = np.array(merged, dtype=np.int32)
        self._hash(keys, ids)
        self.cache: dict[str, bytes] = {}

    def _hash(self, keys: np.ndarray, ids: np.ndarray) -> None:
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        self.slot_keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_ids = np.full(1 << self.bits, NONE, dtype=np.int32)
        slots, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):  # a slot takes the first of its keys; the others move on by one
            free = self.slot_keys[slots[todo]] == -1
            at, first = np.unique(slots[todo[free]], return_index=True)
            won = todo[free][first]
            self.slot_keys[at], self.slot_ids[at] = keys[won], ids[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or NONE. Padding is negative and never merges."""
        keys = (left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        slots = self._slots(keys)
        held = self.slot_keys[slots]
        out = np.where(held == keys, self.slot_ids[slots], NONE)
        todo = np.flatnonzero((held != keys) & (held != -1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            held = self.slot_keys[slots[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.slot_ids[slots[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out.reshape(left.shape)

    def _encode_rows(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of about one length, as little-endian unsigned 32-bit integers."""
        width, n = max(map(len, words)), len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        ids = self.byte_ids[raw]
        ids[np.arange(width) >= lengths[:, None]] = -1
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        ranks = self.merged(ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((n, 0), dtype=np.int32)
        while len(rows):
            if ranks.shape[1]:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
                done = best == NONE
            else:
                done = np.ones(len(rows), dtype=bool)
            if done.any():
                for row, line, size in zip(rows[done], ids[done], lengths[done]):
                    out[row] = line[:size].astype("<u4").tobytes()
                keep = ~done
                rows, ids, ranks, lengths = rows[keep], ids[keep], ranks[keep], lengths[keep]
                if not len(rows):
                    break
                at, best = at[keep], best[keep]
            k = np.arange(len(rows))
            ids[k, at] = best
            gone = np.ones(ids.shape, dtype=bool)
            gone[k, at + 1] = False
            ids = ids[gone].reshape(len(rows), -1)
            gone = np.ones(ranks.shape, dtype=bool)
            gone[k, at] = False
            ranks = ranks[gone].reshape(len(rows), -1)
            lengths = lengths - 1
            if ranks.shape[1]:
                has = at < ranks.shape[1]
                ranks[k[has], at[has]] = self.merged(ids[k[has], at[has]], ids[k[has], at[has] + 1])
                has = at > 0
                ranks[k[has], at[has] - 1] = self.merged(ids[k[has], at[has] - 1], ids[k[has], at[has]])
        return out

    def _encode_long(self, word: bytes) -> bytes:
        """One very long word: in a round the pairs of the lowest rank merge, left to right without overlap, up to the first that makes a pair of a lower rank."""
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        while len(ids) > 1:
            ranks = self.merged(ids[:-1], ids[1:])
            best = ranks.min()
            if best == NONE:
                break
            at = np.flatnonzero(ranks == best)
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # in a run of neighbours every second pair merges
            at = at[(at - np.repeat(at[run], np.diff(np.append(run, len(at))))) % 2 == 0]
            after_last = np.diff(at, prepend=-3) == 2
            before = np.where(after_last, best, np.where(at > 0, ids[at - 1], -1))
            behind = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            one = np.full(len(at), best, dtype=np.int32)
            lower = np.flatnonzero((self.merged(before.astype(np.int32), one) < best) | (self.merged(one, behind.astype(np.int32)) < best))
            if len(lower):  # that merge made a pair of a lower rank, which comes next
                at = at[: lower[0] + 1]
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids.astype("<u4").tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Put the ids of words that are not yet known into the cache."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            if word in self.cache:
                continue
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[word] = rank.to_bytes(4, "little")
            elif len(raw) > LONG_BYTES:
                self.cache[word] = self._encode_long(raw)
            else:
                buckets.setdefault((len(raw) + 1) // 2 if len(raw) < 32 else 16 + len(raw) // 32, []).append((word, raw))
        for pairs in buckets.values():
            step = max(1, (1 << 18) // max(len(raw) for _, raw in pairs))
            for i in range(0, len(pairs), step):
                part = pairs[i : i + step]
                self.cache.update(zip((w for w, _ in part), self._encode_rows([raw for _, raw in part])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(x) for x in texts]
        self.learn({w for words in split for w in words})
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def _outputs(kinds: tuple[str, ...], ids: list[bytes], c: Codec) -> list[pa.Array]:
    made = []
    decoded = [c.decode(x) for x in ids] if {"decoded", "decoded_sha256"} & {*kinds} else []
    for kind in kinds:
        if kind == "ids":
            flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
        elif kind == "n_tokens":
            made.append(pa.array([len(x) // 4 for x in ids], pa.int64()))
        elif kind == "ids_sha256":
            made.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
        elif kind == "decoded":
            made.append(pa.array(decoded, pa.binary()))
        else:
            made.append(pa.array([hashlib.sha256(x).hexdigest() for x in decoded]))
    return made


KINDS = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """One row per row of df: its id and the chosen outputs of encoding (and decoding again) its whole text.

    vocabulary: path of a file of base64 tokens and ranks; it is read on the driver and sent to the workers.
    """
    unknown = set(outputs) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown outputs {sorted(unknown)}; there are {sorted(KINDS)}")
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern)
        for batch in slices(batches, "text"):
            ids = c.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_outputs(outputs, ids, c)], names=[id_col, *outputs])

    kind = dict(df.dtypes)[id_col]
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{x} {KINDS[x]}" for x in outputs)])
    return df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of df: its id and the bytes of its ids (null ids: no bytes). Unknown ids raise IndexError."""
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern)
        for batch in batches:
            decoded = [c.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(decoded, pa.binary())], names=[id_col, "decoded"])

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, decoded binary")
