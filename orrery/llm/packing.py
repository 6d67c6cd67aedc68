"""Best-fit packing of token pieces into sequences of a fixed capacity, improved by local search.

A document of more than `capacity` tokens is cut into pieces of exactly `capacity`, the first of which
takes the remainder. Full pieces are sequences by themselves. The others are numbered and dealt by that number to
shards of about SHARD pieces, so equal or hot rows spread and memory is bounded, whatever the number of
partitions. A shard starts from best-fit decreasing; then pieces between underfull bins are exchanged one for one,
two for one, or moved, each step raising the sum of squared fills, until no step helps. Bins that become empty vanish.
What lies in underfull bins is then dealt to fewer shards and packed anew, level by level, until one shard has it all
or the bins no longer get fewer.

Defined results: a null or empty text is one piece that holds the end token alone; very long texts are cut as any
other; rows with a null id are packed as well; repeated rows are packed each for itself; ties go by size, then number;
an empty table gives no rows; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, releasing, scratch, slices, text_or_empty, unused

SHARD = 1 << 12


class Bins:
    """Bins of integer sizes. Fills and contents change together."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.fill, self.items = capacity, [], []

    def best_fit(self, order: list[int], sizes: list[int]) -> None:
        """Put each item into the fullest bin that takes it. Free space is found in a bit set."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms = 0
        for item in order:
            size = sizes[item]
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
                self.items[b].append(item)
                self.fill[b] += size
            else:
                room, b = self.capacity, len(self.fill)
                self.items.append([item])
                self.fill.append(size)
            if left := room - size:
                by_room[left].append(b)
                rooms |= 1 << left


def improve(bins: Bins, sizes: list[int]) -> None:
    """Exchange or move pieces between underfull bins, towards the fuller of two, until a pass changes nothing."""
    while _pass(bins, sizes):
        pass


def _pass(bins: Bins, sizes: list[int]) -> bool:
    """Fill each underfull bin, the fullest first, from those that are left, and tell whether anything changed.

    Bins that are left are no fuller than the current one: it only gains, and they only lose. So whatever has the
    right size will do, and the first of a size, or of a sum of two, is found in one look at a bit set.
    """
    cap, fill, items = bins.capacity, bins.fill, bins.items
    single: dict[int, dict[tuple[int, int], None]] = {}  # size: bins and items
    double: dict[int, dict[int, tuple[int, int]]] = {}  # sum of two sizes: bin and the sizes
    sums: dict[int, set[int]] = {}  # of each bin left
    present = [0, 0]

    def index(b: int) -> None:
        for item in items[b]:
            single.setdefault(sizes[item], {})[b, item] = None
            present[0] |= 1 << sizes[item]
        many = Counter(sizes[item] for item in items[b])
        kinds = sorted(many)
        mine = sums[b] = set()
        for i, one in enumerate(kinds):
            for two in kinds[i + (many[one] == 1) :]:
                if one + two not in mine:
                    mine.add(one + two)
                    double.setdefault(one + two, {})[b] = one, two
                    present[1] |= 1 << one + two

    def forget(b: int) -> None:
        for item in items[b]:
            size = sizes[item]
            del single[size][b, item]
            if not single[size]:
                present[0] &= ~(1 << size)
        for total in sums.pop(b):
            del double[total][b]
            if not double[total]:
                present[1] &= ~(1 << total)

    def largest(kind: int, low: int, high: int) -> int:
        """The largest size (kind 0) or sum of two (1) in low..high, or 0."""
        return max(0, (present[kind] >> low << low & (1 << high + 1) - 1).bit_length() - 1)

    def swap(b: int, give: list[int], mine: int | None) -> None:
        forget(b)
        for item in give:
            items[b].remove(item)
            items[current].append(item)
        if mine is not None:
            items[current].remove(mine)
            items[b].append(mine)
        gained = sum(sizes[x] for x in give) - (0 if mine is None else sizes[mine])
        fill[current] += gained
        fill[b] -= gained
        index(b)
        even.discard(b)
        heapq.heappush(order, (-fill[b], b))

    order = [(-f, b) for b, f in enumerate(fill) if 0 < f < cap]
    heapq.heapify(order)
    for _, b in order:
        index(b)
    changed, level = False, cap
    even: set[int] = set()  # bins done that are as full as the current one, which may take from them
    while order:
        f, current = heapq.heappop(order)
        if current not in sums or current in even or -f != fill[current]:
            continue  # done, or less full by now
        if fill[current] < level:
            level = fill[current]
            for b in even:
                forget(b)
            even.clear()
        if not items[current]:
            del sums[current]
            continue
        forget(current)
        step = True
        while step and fill[current] < cap:
            step, room = False, cap - fill[current]
            if size := largest(0, 1, room):  # move
                b, item = next(iter(single[size]))
                swap(b, [item], None)
                step = changed = True
                continue
            for size, mine in sorted({sizes[x]: x for x in items[current]}.items()):
                if other := largest(0, size + 1, size + room):  # one for one
                    b, item = next(iter(single[other]))
                    swap(b, [item], mine)
                elif total := largest(1, size + 1, size + room):  # two for one
                    b, (one, two) = next(iter(double[total].items()))
                    first = next(x for x in items[b] if sizes[x] == one)
                    swap(b, [first, next(x for x in items[b] if sizes[x] == two and x != first)], mine)
                else:
                    continue
                step = changed = True
                break
        if fill[current] == level:
            index(current)
            even.add(current)
    return changed


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers. Sizes are 1 to capacity."""
    full = [[i] for i, s in enumerate(sizes) if s == capacity]
    bins = Bins(capacity)
    bins.best_fit(sorted((i for i, s in enumerate(sizes) if s < capacity), key=lambda i: (-sizes[i], i)), sizes)
    improve(bins, sizes)
    return full + [x for x in bins.items if x]


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: bytes):
    """The library whose ids count, and a faster one of the same ranks for texts without special tokens."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(vocabulary.decode())
    special = [x.content for x in slow.get_added_tokens_decoder().values()]
    symbols = _byte_symbols()
    ranks = {bytes(symbols[c] for c in token): i for token, i in slow.get_vocab(with_added_tokens=False).items()}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if k.decode("latin1") not in special}, special_tokens={})
    return slow, fast, special


def _byte_symbols() -> dict[str, int]:
    """The printable character by which byte-level BPE files write each byte, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def tokenize(text: str, vocabulary: bytes) -> np.ndarray:
    slow, fast, special = _tokenizer(vocabulary)
    if any(x in text for x in special):
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")


def pieces(df: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document: id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, piece, start, length, crc, flat = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(tokenize(text, sent.value), np.array([end], dtype="<u4"))
                at, n = 0, (len(ids) - 1) % capacity + 1
                k = 0
                while at < len(ids):
                    part = ids[at : at + n]
                    row.append(i), piece.append(k), start.append(at), length.append(n), crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        flat.append(part.astype(np.int32))
                    at, n, k = at + n, capacity, k + 1
            columns = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(flat, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def assign(parts: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity. Sequence ids are unique. The table is written."""
    with scratch(parts.sparkSession):
        return cut(_assign(parts, capacity), keep=True)


def _assign(parts: DataFrame, capacity: int) -> DataFrame:
    if {"sequence_id", "offset"} & {c.lower() for c in parts.columns}:
        raise ValueError("the pieces have a column sequence_id or offset already")
    number, fill, shard = unused(parts, "number", "fill", "shard")
    numbered = cut(parts.withColumn(number, F.monotonically_increasing_id()))
    done = numbered.where(F.col("length") == capacity).select(number, (-1 - F.col(number)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    bins = F.count_if(F.col("offset") == 0)

    def packed(left: DataFrame, shards: int, level: int) -> DataFrame:
        dealt = left.select(number, "length", F.pmod(F.xxhash64(F.col(number), F.lit(level)), F.lit(shards)).cast("int").alias(shard))
        return cut(dealt.groupBy(shard).applyInArrow(_packer(capacity, level, number, fill), f"`{number}` bigint, length bigint, sequence_id bigint, offset bigint, `{fill}` bigint"))

    left, level = numbered.where(F.col("length") < capacity), 0
    shards = -(-left.count() // SHARD)
    if not shards:
        return numbered.join(done, number).select(*parts.columns, "sequence_id", "offset")
    current = packed(left, shards, level)
    while True:
        done = done.union(current.where(F.col(fill) == capacity).select(number, "sequence_id", "offset"))
        current = current.where(F.col(fill) < capacity)
        n, before = current.agg(F.count("*"), bins).first()
        if shards == 1 or not n:
            break
        shards, level = -(-n // SHARD), level + 1
        again = packed(current, shards, level)
        if again.agg(bins).first()[0] >= before:
            break
        current = again
    done = done.union(current.select(number, "sequence_id", "offset"))
    return numbered.join(done, number).select(*parts.columns, "sequence_id", "offset")


def _packer(capacity: int, level: int, number: str, fill: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        base = level << 52 | key[0].as_py() << 20
        table = table.sort_by(number).select([number, "length"])
        sizes = table.column("length").to_pylist()
        sequence, offset, fills = (np.empty(len(sizes), dtype=np.int64) for _ in range(3))
        for i, b in enumerate(pack(sizes, capacity)):
            at = 0
            for item in b:
                sequence[item], offset[item] = base + i, at
                at += sizes[item]
            fills[b] = at
        for name, values in (("sequence_id", sequence), ("offset", offset), (fill, fills)):
            table = table.append_column(name, pa.array(values))
        return table

    return run


def pack_documents(df: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return assign(pieces(df, vocabulary, capacity, end, id_col, text_col), capacity)


__all__ = ["assign", "pack", "pack_documents", "pieces", "tokenize"]
