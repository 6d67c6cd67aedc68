"""Quality rules on repetition: how much of a text lies inside duplicated n-grams and lines.

Words are numbered within a text; rolling hashes of the n-grams of several lengths are made with numpy, and
characters are counted that lie in an n-gram found twice or more (every place of it counts, each character
once per length). Lines are compared as they are.

Defined results: a null text counts as empty, and an empty text has no words and so fails the base rule;
very long texts are taken whole; each row is judged alone, so repeated rows agree; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_or_empty

SYMBOLS = b"#*$%&|<>"
#: Largest part of a text's word characters inside duplicated n-grams of each length.
NGRAM_LIMITS = {5: 0.45, 6: 0.42, 7: 0.40, 8: 0.38, 9: 0.36, 10: 0.35}
#: Largest part of the characters of lines with a word that lie in lines equal to an earlier one.
LINE_LIMIT = 0.30
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside the n-grams that start where `starts` is true."""
    step = np.zeros(words + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(text: str) -> dict[str, float]:
    """Counts of one text. Windows of three words are compared exactly, longer n-grams by 64-bit rolling hashes."""
    raw = text.encode()
    words = raw.split()  # at the ASCII white space that separates words
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    joined = b"".join(words)
    chars = len(joined) - _continuations(joined)
    sizes = np.fromiter((len(w) if w.isascii() else len(w.decode(errors="replace")) for w in number), dtype=np.int64, count=len(number))
    width = sizes[ids] if n else np.zeros(0, np.int64)
    repeat_words = 0
    if n >= 3:
        if len(number) < 1 << 21:
            triples = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        else:
            triples = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), axis=0, return_inverse=True)[1].ravel()
        repeat_words = int(_covered(_repeated(triples), 3, n).sum())
    out = {"n_words": n, "word_chars": chars, "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)), "n_repeat_words": repeat_words}
    seen: set[bytes] = set()
    duplicates = line_chars = duplicate_chars = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            line_chars += len(line)
            if line in seen:
                duplicates += 1
                duplicate_chars += len(line)
            seen.add(line)
    out["n_dup_lines"] = duplicates
    out["dup_line_chars"] = duplicate_chars / line_chars if line_chars else 0.0
    hashed = _mix(ids.astype(np.uint64) + np.uint64(1))
    total = max(1, int(width.sum()))
    for size in NGRAM_LIMITS:
        part = 0.0
        if n >= size:
            with np.errstate(over="ignore"):
                rolling = hashed[: n - size + 1].copy()
                for i in range(1, size):
                    rolling = rolling * _BASE + hashed[i : n - size + 1 + i]
            if (starts := _repeated(rolling)).any():
                part = float(width[_covered(starts, size, n)].sum()) / total
            else:  # no longer n-gram can repeat either
                for longer in NGRAM_LIMITS:
                    if longer >= size:
                        out[f"dup_{longer}gram"] = 0.0
                break
        out[f"dup_{size}gram"] = part
    return out


def _continuations(raw: bytes) -> int:
    """Bytes of UTF-8 that do not begin a code point."""
    return 0 if raw.isascii() else int((np.frombuffer(raw, dtype=np.uint8) & 0xC0 == 0x80).sum())


def verdict(m: dict[str, float]) -> tuple[bool, bool]:
    """base_failed and kept."""
    failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    kept = not failed and m["dup_line_chars"] <= LINE_LIMIT and all(m[f"dup_{n}gram"] <= limit for n, limit in NGRAM_LIMITS.items())
    return failed, kept


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, the counts, base_failed, kept, and the measured coverages."""
    shares = ["dup_line_chars", *(f"dup_{n}gram" for n in NGRAM_LIMITS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [measure(x) for x in batch.column("text").to_pylist()]
            said = [verdict(m) for m in found]
            columns = [batch.column("id"), *(pa.array([m[c] for m in found], pa.int64()) for c in COUNTS), pa.array([x for x, _ in said], pa.bool_()), pa.array([x for _, x in said], pa.bool_()), *(pa.array([float(m[c]) for m in found], pa.float64()) for c in shares)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *COUNTS, "base_failed", "kept", *shares])

    schema = ", ".join([f"`{id_col}` {dict(df.dtypes)[id_col]}", *(f"{c} bigint" for c in COUNTS), "base_failed boolean", "kept boolean", *(f"{c} double" for c in shares)])
    return df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
