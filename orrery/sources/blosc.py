"""Reading of Blosc frames (format 1), the usual compressor of Zarr stores of format 2.

A frame is a header of 16 bytes, the places of its blocks, and the blocks; a block holds one stream, or one for each
byte of the element type. Streams are BloscLZ, LZ4, zlib or Zstandard, or stored plainly; bytes or bits may be shuffled.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

# Flags of the header, and the numbers of the compressors.
BYTE_SHUFFLE, STORED, BIT_SHUFFLE, WHOLE_BLOCKS = 0x1, 0x2, 0x4, 0x10
BLOSCLZ, LZ4, SNAPPY, ZLIB, ZSTD = range(5)
HEADER = 16
#: Streams of a block are split only up to this element size, and if they hold this many bytes at least.
MOST_STREAMS, LEAST_STREAM = 16, 128


def decompress(data: bytes) -> bytes:
    """The content of a frame."""
    if len(data) < HEADER:
        raise ValueError("a Blosc frame has a header of 16 bytes")
    _, _, flags, size, total, block, frame = struct.unpack_from("<BBBBIII", data)
    if frame > len(data):
        raise ValueError(f"the Blosc frame has {len(data)} of {frame} bytes")
    if flags & STORED:
        return data[HEADER : HEADER + total]
    if not total:
        return b""
    count = -(-total // block)
    places = struct.unpack_from(f"<{count}i", data, HEADER)
    out = bytearray()
    for i, at in enumerate(places):
        n = min(block, total - i * block)
        short = n < block
        split = not flags & WHOLE_BLOCKS and size <= MOST_STREAMS and block // size >= LEAST_STREAM and not short
        streams = size if split else 1
        part = bytearray()
        for _ in range(streams):
            (length,) = struct.unpack_from("<i", data, at)
            want = n // streams
            raw = data[at + 4 : at + 4 + length]
            part += raw if length == want else _stream(raw, want, flags >> 5)
            at += 4 + length
        if flags & BYTE_SHUFFLE and size > 1:
            out += _unshuffled(bytes(part), size)
        elif flags & BIT_SHUFFLE:
            out += _bits_unshuffled(bytes(part), size)
        else:
            out += part
    return bytes(out)


def _stream(raw: bytes, want: int, kind: int) -> bytes:
    if kind == BLOSCLZ:
        return _blosclz(raw, want)
    if kind == LZ4:
        return pa.Codec("lz4_raw").decompress(raw, decompressed_size=want).to_pybytes()
    if kind == SNAPPY:
        return pa.Codec("snappy").decompress(raw, decompressed_size=want).to_pybytes()
    if kind == ZLIB:
        return zlib.decompress(raw)
    if kind == ZSTD:
        return pa.Codec("zstd").decompress(raw, decompressed_size=want).to_pybytes()
    raise NotImplementedError(f"Blosc frames of compressor number {kind} cannot be read")


def _blosclz(raw: bytes, want: int) -> bytes:
    """A stream of literal runs and of matches, which may overlap what they make."""
    out, i, first = bytearray(), 0, True
    while i < len(raw):
        control = raw[i] & 31 if first else raw[i]
        first = False
        i += 1
        if control < 32:
            out += raw[i : i + control + 1]
            i += control + 1
            continue
        length, far = (control >> 5) - 1, (control & 31) << 8
        if length == 6:
            while True:
                more = raw[i]
                i += 1
                length += more
                if more != 255:
                    break
        low = raw[i]
        i += 1
        distance = far + low
        if low == 255 and far == 31 << 8:
            distance = (raw[i] << 8 | raw[i + 1]) + 8191
            i += 2
        length += 3
        at = len(out) - distance - 1
        if at < 0:
            raise ValueError("a match begins before the stream")
        while length:
            part = out[at : at + length]
            out += part
            at += len(part)
            length -= len(part)
    if len(out) != want:
        raise ValueError(f"the stream has {len(out)} bytes, not {want}")
    return bytes(out)


def _unshuffled(part: bytes, size: int) -> bytes:
    """Bytes that stood by their place in an element, in the order of the elements; a rest stays as it is."""
    n = len(part) // size
    body = np.frombuffer(part, dtype=np.uint8, count=n * size).reshape(size, n)
    return body.T.tobytes() + part[n * size :]


def _bits_unshuffled(part: bytes, size: int) -> bytes:
    """Bits that stood by their place in an element. A block whose elements are no multiple of eight was never shuffled."""
    n = len(part) // size
    if not n or n % 8:
        return part
    planes = np.frombuffer(part, dtype=np.uint8, count=n * size).reshape(size * 8, n // 8)
    bits = np.unpackbits(planes, axis=1, bitorder="little").reshape(size, 8, n)
    return np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").tobytes() + part[n * size :]
