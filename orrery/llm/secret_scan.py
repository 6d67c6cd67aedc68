"""Secret scans with a worklist that unwraps nested encodings.

The plain text is scanned first. Then every encoded segment of a layer (URL percent escapes, Unicode
escapes, base64, and the compressed data that base64 may hold) is decoded into a new layer, which is
scanned in its turn, until no layer yields a new one. A layer whose content was met before at the same place
of the original text is not entered again, so cycles end, and a secret that occurs at several places is found
at each. Every layer maps its characters to a span of the original text; what is found there
is reported with that span, under the kind followed by the layers passed, as in `access>base64>gzip`.

Defined results: a null text counts as empty, and an empty text has no findings; texts are taken whole, at
any length; each row is judged alone, so repeated rows agree and ties do not occur; an empty table gives no rows; null
ids stay; other columns, of whatever name, are ignored, or kept by `redact_documents`. Bytes that are no UTF-8 count as
U+FFFD. Compressed data is unwrapped until none is left, all its members taken; content of more than MAX_LAYER bytes is
inflated as a stream and scanned in windows of that size, which overlap by OVERLAP bytes.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import releasing, slices, text_or_empty

# The patterns of the base findings, and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}")
#: Parts of a run that mixes alphabets, or that is a path: of either alphabet, and of letters and digits alone.
PARTS = [re.compile(rf"[A-Za-z0-9{signs}]{{12,}}={{0,2}}") for signs in ("+/", "_-", "")]
MAX_LAYER, OVERLAP, CHUNK = 16 << 20, 64 << 10, 1 << 20
_INVALID = re.compile("[\udc80-\udcff]")
_KEYWORD = re.compile(r"pass|secr|toke|api", re.A | re.I)


def scan(text: str) -> list[tuple[int, int, str]]:
    """start, end and kind of the base findings of one layer, by start, then kind as listed."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


class Layer:
    """A decoded text, and for each of its characters the span of the original text it stems from.

    starts and ends are None for the original text itself, and one number each if all characters share a span.
    """

    __slots__ = ("text", "starts", "ends", "path")

    def __init__(self, text: str, starts: np.ndarray | int | None, ends: np.ndarray | int | None, path: tuple[str, ...]) -> None:
        self.text, self.starts, self.ends, self.path = text, starts, ends, path

    def spans(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the spans of stretches from the character `first` to `last`, which is included."""
        if self.starts is None:
            return first, last + 1
        if isinstance(self.starts, int):
            return np.full(len(first), self.starts), np.full(len(first), self.ends)
        return self.starts[first], self.ends[last]

    def span(self, a: int, b: int) -> tuple[int, int]:
        start, end = self.spans(np.array([a]), np.array([b - 1]))
        return int(start[0]), int(end[0])

    def mark(self) -> bytes:
        """A digest of the text and of the places its characters stem from."""
        out = hashlib.sha256(self.text.encode())
        if isinstance(self.starts, int):
            out.update(b"%d:%d" % (self.starts, self.ends))
        elif self.starts is not None:
            out.update(self.starts.tobytes())
            out.update(self.ends.tobytes())
        return out.digest()


def _sizes(text: str) -> np.ndarray:
    """Bytes of each character in UTF-8; one that stands for an invalid byte has one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    n[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
    return n


def _text_of(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """UTF-8 text of raw, and the span of each character, by those of the bytes. An invalid byte becomes U+FFFD."""
    text = raw.decode(errors="surrogateescape")
    n = _sizes(text)
    behind = np.cumsum(n)
    return _INVALID.sub("\ufffd", text), starts[behind - n], ends[behind - 1]


def _printable(text: str) -> bool:
    return bool(text) and sum(c.isprintable() or c.isspace() for c in text) >= 0.95 * len(text)


def _escapes(layer: Layer, pattern: re.Pattern, name: str, decode) -> Layer | None:
    """The whole layer with its escapes replaced; its other characters keep their own spans."""
    parts: list[tuple[bytes, np.ndarray, np.ndarray]] = []
    last = 0

    def plain(a: int, b: int) -> None:
        if a < b:
            at = np.repeat(np.arange(a, b), _sizes(layer.text[a:b]))
            parts.append((layer.text[a:b].encode(), *layer.spans(at, at)))

    for m in pattern.finditer(layer.text):
        raw = decode(m[0])
        if raw is None:
            continue
        plain(last, m.start())
        at = m.start() + (3 * np.arange(len(raw)) if name == "url" else np.zeros(len(raw), dtype=np.int64))
        parts.append((raw, *layer.spans(at, at + 2 if name == "url" else np.full(len(raw), m.end() - 1))))
        last = m.end()
    if not last:
        return None
    plain(last, len(layer.text))
    return Layer(*_text_of(b"".join(p[0] for p in parts), *(np.concatenate([p[i] for p in parts]) for i in (1, 2))), (*layer.path, name))


def _code_point(escape: str) -> bytes | None:
    body = escape[2:].strip("{};")
    value = int(body, 10) if escape.startswith("&#") and escape[2] not in "xX" else int(body.lstrip("xX"), 16)
    if value > 0x10FFFF or 0xD800 <= value < 0xE000:
        return None
    return chr(value).encode()


def _percent(run: str) -> bytes:
    return bytes.fromhex(run.replace("%", ""))


def _members(raw: bytes) -> tuple[list[bytes], bytes, str, bool]:
    """Content of each gzip or zlib member that raw begins with, the bytes behind them, the name of the first one's format, and whether all end.

    Reading stops beyond MAX_LAYER bytes of content in all.
    """
    out, first, room, whole = [], "", MAX_LAYER + 1, True
    while room > 0:
        if raw[:2] == b"\x1f\x8b":
            bits, name = 31, "gzip"
        elif len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0:
            bits, name = 15, "zlib"
        else:
            break
        try:
            d = zlib.decompressobj(bits)
            part = d.decompress(raw, room)
        except zlib.error:
            break
        out.append(part)
        first, room, raw, whole = first or name, room - len(part), d.unused_data, d.eof
    return out, raw, first, whole


def _contents(raw: bytes) -> Iterator[tuple[bytes, tuple[str, ...]]]:
    """What raw holds, unwrapped until no compressed data is left, with the formats passed; more than MAX_LAYER bytes come in windows."""
    work, seen = [(raw, ())], set()
    while work:
        raw, names = work.pop()
        if (digest := hashlib.sha256(raw).digest()) in seen:
            continue
        seen.add(digest)
        parts, rest, name, whole = _members(raw)
        if sum(map(len, parts)) > MAX_LAYER:
            yield from _windows(raw, names)
            continue
        if parts:
            work.append((b"".join([*parts, rest]), (*names, name)))
            work += [(x, (*names, name)) for x in parts[1:] if _members(x)[0]]  # compressed behind another member's content
        if not parts or not whole or _plain(raw):  # other data may begin like a header
            yield raw, names


def _windows(raw: bytes, names: tuple[str, ...]) -> Iterator[tuple[bytes, tuple[str, ...]]]:
    """The content of large compressed data, every level of it inflated as a stream, in overlapping windows."""
    stream, seen = iter([raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]), set()
    while True:
        head = b""
        while len(head) < OVERLAP and (more := next(stream, None)) is not None:
            head += more
        name = _members(head[:OVERLAP])[2]
        stream = itertools.chain([head], stream)
        if not name or (digest := hashlib.sha256(head[:OVERLAP]).digest()) in seen:
            break
        seen.add(digest)
        stream, names = _inflated(stream), (*names, name)
    held = bytearray()
    for part in stream:
        held += part
        while len(held) > MAX_LAYER:
            yield bytes(held[:MAX_LAYER]), names
            del held[: MAX_LAYER - OVERLAP]
    if held:
        yield bytes(held), names


def _inflated(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The content of all members that a stream begins with, a chunk at a time, and what stands behind them as it is."""
    held, d = b"", None
    for part in stream:
        held += part
        while held:
            if d is None:
                if not _members(held[:OVERLAP])[0] and len(held) > 64:
                    yield held
                    yield from stream
                    return
                d = zlib.decompressobj(47)
            try:
                out, held = d.decompress(held, CHUNK), b""
            except zlib.error:
                return
            if out:
                yield out
            if d.eof:
                held, d = d.unused_data, None
            else:
                held = d.unconsumed_tail


def _plain(raw: bytes) -> bool:
    try:
        return _printable(raw.decode())
    except UnicodeDecodeError:
        return False


def _decoded(run: str) -> bytes | None:
    body = run.rstrip("=")
    url = "-" in body or "_" in body
    if len(body) % 4 == 1 or url and ("+" in body or "/" in body):
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), altchars=b"-_" if url else None)
    except (binascii.Error, ValueError):
        return None


def _base64(layer: Layer) -> Iterator[Layer]:
    for m in BASE64.finditer(layer.text):
        raw = _decoded(m[0])
        spans = [(m.start(), m.end(), raw)] if raw is not None else []
        if re.search("[+/_-]", m[0]) and (raw is None or not (_members(raw)[0] or _plain(raw))):  # a path, or alphabets mixed
            inner = {(m.start() + x.start(), m.start() + x.end()) for pattern in PARTS for x in pattern.finditer(m[0])} - {m.span()}
            spans += [(a, b, part) for a, b in sorted(inner) if (part := _decoded(layer.text[a:b])) is not None]
        for a, b, raw in spans:
            for content, names in _contents(raw):
                path = (*layer.path, "base64", *names)
                if names:
                    yield Layer(content.decode(errors="replace"), *layer.span(a, b), path)
                else:
                    at = a + 4 * (np.arange(len(raw)) // 3)
                    yield Layer(*_text_of(raw, *layer.spans(at, np.minimum(at + 4, b) - 1)), path)


def _next(layer: Layer) -> Iterator[Layer]:
    if "%" in layer.text and (got := _escapes(layer, PERCENT, "url", _percent)):
        yield got
    if ("\\" in layer.text or "&#" in layer.text) and (got := _escapes(layer, UNICODE, "unicode", _code_point)):
        yield got
    yield from _base64(layer)


def find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base findings of the text itself, and all findings with those of the layers beneath."""
    base = scan(text)
    found = set(base)
    taken = [(a, b, k) for a, b, k in base]
    work = [Layer(text, None, None, ())]
    seen = {work[0].mark()}
    while work:
        for inner in _next(work.pop()):
            mark = inner.mark()
            if mark in seen:
                continue
            seen.add(mark)
            for a, b, kind in scan(inner.text):
                start, end = inner.span(a, b)
                if text[start:end] != inner.text[a:b] or not any(s <= start and end <= e and k == kind for s, e, k in taken):  # else plain in the text as well
                    found.add((start, end, ">".join((kind, *inner.path))))
            work.append(inner)
    return base, sorted(found, key=lambda x: (x[0], KINDS.index(k) if (k := x[2].partition(">")[0]) in KINDS else len(KINDS), x[1], x[2]))


def spell(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced."""
    out, last = [], 0
    merged: list[list[int]] = []
    for a, b, _ in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[last:a], mark]
        last = b
    return "".join([*out, text[last:]])


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_assign, n_access, n_hex, base_sha256, spans and redacted text."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, digests, spans, texts = [], [], [], []
            for text in batch.column("text").to_pylist():
                base, found = find(text)
                counts.append([sum(k == kind for _, _, k in base) for kind in KINDS])
                digests.append(hashlib.sha256(spell(base).encode()).hexdigest())
                spans.append(spell(found))
                texts.append(redact(text, found) if found else text)
            columns = [batch.column("id"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"])

    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, redacted string"
    return df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def redact_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its own columns, secrets in the text replaced by a mark; null texts stay null, n_chars follows."""
    names = df.columns

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = [x if x is None or not (found := find(x)[1]) else redact(x, found) for x in batch.column(text_col).to_pylist()]
            columns = [pa.array(texts, pa.string()) if n == text_col else batch.column(n) for n in names]
            if "n_chars" in names:
                kind = batch.schema.field("n_chars").type
                old = batch.column("n_chars").to_pylist()
                changed = [n if a == b else len(b) for n, a, b in zip(old, batch.column(text_col).to_pylist(), texts)]
                columns[names.index("n_chars")] = pa.array(changed, kind)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)
