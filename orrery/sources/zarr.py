"""Chunked N-dimensional arrays in Zarr stores, formats 2 and 3: metadata, chunk reading, and a writer.

Stores are reached through pyarrow file systems, so local paths and URIs both work. Chunks may be raw or
compressed with Blosc, LZ4, zlib, gzip or zstd, and lie in shards; other codecs and filters are refused by name.
Checksums are taken off, not verified.
"""

from __future__ import annotations

import itertools
import json
import posixpath
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import schema
from orrery.functions import vectors as V
from orrery.operators.geo import TRANSFORM_FIELDS, GeoTransform, parse_transform
from orrery.operators.manifest import chunk_grid
from orrery.sources import blosc

DIMENSIONS = "_ARRAY_DIMENSIONS"
#: Rows of vectors in one Arrow batch.
BATCH_ROWS = 16_384


class Store:
    """Files below a URL, which may be a local path or a URI. options go to the file system's constructor."""

    def __init__(self, url: str, options: dict[str, Any] | None = None) -> None:
        if "://" not in url:
            self.fs, self.root = pa.fs.LocalFileSystem(), url
        elif options:
            scheme, _, rest = url.partition("://")
            kinds = {"s3": "S3FileSystem", "gs": "GcsFileSystem", "hdfs": "HadoopFileSystem", "abfs": "AzureFileSystem", "file": "LocalFileSystem"}
            if scheme not in kinds:
                raise ValueError(f"no file system for {scheme}://")
            self.fs, self.root = getattr(pa.fs, kinds[scheme])(**options), rest
        else:
            self.fs, self.root = pa.fs.FileSystem.from_uri(url)

    def get(self, name: str) -> bytes | None:
        path = posixpath.join(self.root, name)
        if self.fs.get_file_info(path).type != pa.fs.FileType.File:
            return None
        with self.fs.open_input_stream(path, compression=None) as f:
            return f.read()

    def put(self, name: str, data: bytes) -> None:
        path = posixpath.join(self.root, name)
        self.fs.create_dir(posixpath.dirname(path), recursive=True)
        with self.fs.open_output_stream(path, compression=None) as f:
            f.write(data)


@dataclass
class ArrayMeta:
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    fill: Any
    order: str
    codecs: list[tuple[str, dict]]
    prefix: str
    separator: str
    attributes: dict[str, Any] = field(default_factory=dict)
    names: list[str] | None = None
    shard: Shard | None = None

    @property
    def grid(self) -> tuple[int, ...]:
        """The chunks that are summarised and searched: those within shards, if there are shards."""
        return self.chunks if self.shard is None else self.shard.inner.chunks

    def key(self, index: Sequence[int]) -> str:
        return self.prefix + self.separator.join(map(str, index))

    def decode(self, raw: bytes | None) -> np.ndarray:
        if raw is None:
            return np.full(self.chunks, self.fill, dtype=self.dtype)
        if self.shard is not None:
            return self.shard.assembled(raw, self.chunks)
        for name, options in reversed(self.codecs):
            if name in ("zlib", "gzip"):
                raw = zlib.decompress(raw, 47)
            elif name == "zstd":
                import zstandard

                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            elif name == "crc32c":
                raw = raw[:-4]
            elif name == "blosc":
                raw = blosc.decompress(raw)
            elif name == "lz4":  # its size stands before it
                raw = pa.Codec("lz4_raw").decompress(raw[4:], decompressed_size=int.from_bytes(raw[:4], "little")).to_pybytes()
            else:
                raise NotImplementedError(f"chunks coded with {name!r} cannot be read")
        return np.frombuffer(raw, dtype=self.dtype).reshape(self.chunks, order=self.order)


@dataclass
class Shard:
    """Chunks stored together in one object, found by an index of places and lengths at its end or start."""

    inner: ArrayMeta
    index_codecs: list[str]
    at_end: bool

    def assembled(self, raw: bytes, shape: Sequence[int]) -> np.ndarray:
        counts = [n // c for n, c in zip(shape, self.inner.chunks)]
        size = 16 * int(np.prod(counts)) + 4 * ("crc32c" in self.index_codecs)
        table = raw[-size:] if self.at_end else raw[:size]
        places = np.frombuffer(table, dtype="<u8", count=2 * int(np.prod(counts))).reshape(*counts, 2)
        out = np.empty(tuple(shape), dtype=self.inner.dtype)
        for index in itertools.product(*map(range, counts)):
            at, length = (int(x) for x in places[index])
            block = self.inner.decode(None if at == length == 2**64 - 1 else raw[at : at + length])
            out[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, self.inner.chunks))] = block
        return out


def _codecs_of(listed: list[dict], dims: int) -> tuple[str, str, list[tuple[str, dict]], dict | None]:
    """Byte order, memory order, compressors and the sharding of the codecs of an array of format 3."""
    endian, order, codecs, shard = "<", "C", [], None
    for c in listed:
        kind, options = c["name"], c.get("configuration") or {}
        if kind == "bytes":
            endian = ">" if options.get("endian") == "big" else "<"
        elif kind == "transpose" and list(options["order"]) == list(range(dims))[::-1]:
            order = "F"
        elif kind in ("gzip", "zstd", "crc32c", "blosc"):
            codecs.append((kind, options))
        elif kind == "sharding_indexed" and len(listed) == 1:
            shard = options
        else:
            raise NotImplementedError(f"arrays with the codec {kind!r} cannot be read")
    return endian, order, codecs, shard


def _fill(value: Any, dtype: np.dtype) -> Any:
    special = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}
    return np.array(0 if value is None else special.get(value, value) if isinstance(value, str) else value).astype(dtype)


def _json(store: Store, name: str) -> dict | None:
    raw = store.get(name)
    return None if raw is None else json.loads(raw)


def array_meta(store: Store, name: str) -> ArrayMeta:
    """Metadata of an array of either format; FileNotFoundError if there is none."""
    three = _json(store, posixpath.join(name, "zarr.json"))
    if three is not None:
        if three.get("node_type") != "array":
            raise ValueError(f"{name!r} is not an array")
        dims = len(three["shape"])
        endian, order, codecs, sharding = _codecs_of(three["codecs"], dims)
        encoding = three.get("chunk_key_encoding") or {"name": "default"}
        old = encoding["name"] == "v2"
        separator = (encoding.get("configuration") or {}).get("separator", "." if old else "/")
        chunks, shard = tuple(three["chunk_grid"]["configuration"]["chunk_shape"]), None
        if sharding is not None:
            endian, order, inner, nested = _codecs_of(sharding["codecs"], dims)
            if nested is not None:
                raise NotImplementedError("shards within shards cannot be read")
            dtype = np.dtype(three["data_type"]).newbyteorder(endian)
            shard = Shard(ArrayMeta(chunks, tuple(sharding["chunk_shape"]), dtype, _fill(three.get("fill_value"), dtype), order, inner, "", "/"), [c["name"] for c in sharding.get("index_codecs", ())], sharding.get("index_location", "end") == "end")
        dtype = np.dtype(three["data_type"]).newbyteorder(endian)
        return ArrayMeta(tuple(three["shape"]), chunks, dtype, _fill(three.get("fill_value"), dtype), order, codecs, "" if old else "c" + separator, separator, three.get("attributes") or {}, three.get("dimension_names"), shard)
    two = _json(store, posixpath.join(name, ".zarray"))
    if two is None:
        raise FileNotFoundError(f"no array {name!r} in {store.root}")
    if two.get("filters"):
        raise NotImplementedError("arrays with filters cannot be read")
    codec = two.get("compressor")
    if codec and codec["id"] not in ("zlib", "gzip", "zstd", "blosc", "lz4"):
        raise NotImplementedError(f"arrays compressed with {codec['id']!r} cannot be read")
    dtype = np.dtype(two["dtype"])
    return ArrayMeta(tuple(two["shape"]), tuple(two["chunks"]), dtype, _fill(two.get("fill_value"), dtype), two.get("order", "C"), [(codec["id"], codec)] if codec else [], "", two.get("dimension_separator", "."), _json(store, posixpath.join(name, ".zattrs")) or {})


def axis_names(meta: ArrayMeta) -> list[str]:
    """Names of the axes, from the attribute of that purpose or else the format's own field."""
    names = meta.attributes.get(DIMENSIONS, meta.names)
    if names is None:
        raise ValueError(f"the array has no attribute {DIMENSIONS}")
    if isinstance(names, str) or not isinstance(names, Sequence):
        raise TypeError(f"{DIMENSIONS} must be a sequence of names, not {type(names).__name__}")
    if len(names) != len(meta.shape):
        raise ValueError(f"{DIMENSIONS} has {len(names)} names for {len(meta.shape)} axes")
    return [str(n) for n in names]


def embedding_axis(names: Sequence[str], name: str = "embedding") -> int:
    found = [i for i, n in enumerate(names) if n == name]
    if len(found) != 1:
        raise ValueError(f"one axis must be named {name!r}; there are {len(found)} among {list(names)}")
    return found[0]


def index_axes(names: Sequence[str], embedding: int) -> list[tuple[int, str]]:
    """Position and name of every other axis, in the array's order."""
    return [(i, n) for i, n in enumerate(names) if i != embedding]


def geo_transform(store: Store) -> GeoTransform:
    """The transform in the attributes of the group spatial_ref."""
    three = _json(store, "spatial_ref/zarr.json")
    two = _json(store, "spatial_ref/.zattrs")
    if three is None and two is None and store.get("spatial_ref/.zgroup") is None and store.get("spatial_ref/.zarray") is None:
        raise ValueError("the store has no group spatial_ref")
    value = ((three or {}).get("attributes") or two or {}).get("GeoTransform")
    if value is None:
        raise ValueError("spatial_ref has no attribute GeoTransform")
    return parse_transform(value)


class Reader:
    """Reads chunks of the arrays of one name. Opened arrays are kept by URL."""

    def __init__(self, array_name: str = "embeddings", embedding_dim_name: str = "embedding", store_kwargs: dict[str, Any] | None = None) -> None:
        self.array_name, self.embedding_dim_name, self.store_kwargs = array_name, embedding_dim_name, store_kwargs
        self.opened: dict[str, tuple[Store, ArrayMeta]] = {}

    def open(self, url: str) -> tuple[Store, ArrayMeta]:
        if url not in self.opened:
            store = Store(url, self.store_kwargs)
            self.opened[url] = store, array_meta(store, self.array_name)
        return self.opened[url]

    def layout(self, url: str) -> tuple[ArrayMeta, int, list[tuple[int, str]]]:
        _, meta = self.open(url)
        if len(meta.shape) < 2:
            raise ValueError(f"an array needs an index axis besides the embedding axis; this one has {len(meta.shape)} dimensions")
        names = axis_names(meta)
        axis = embedding_axis(names, self.embedding_dim_name)
        return meta, axis, index_axes(names, axis)

    def read(self, url: str, slice_: Sequence[dict[str, Any]]) -> tuple[np.ndarray, tuple[int, ...]]:
        """Vectors (n, d) of a chunk as 32-bit floats, in row-major order of the index axes, and the shape of those."""
        meta, axis, axes = self.layout(url)
        store, _ = self.open(url)
        given = [p["dim"] for p in slice_]
        if len(set(given)) != len(given):
            raise ValueError(f"the slice names a dimension twice: {given}")
        if set(given) != {n for _, n in axes}:
            raise ValueError(f"the slice has the dimensions {given}, the array {[n for _, n in axes]}")
        part = {p["dim"]: (int(p["start"]), int(p["stop"])) for p in slice_}
        ranges: list[tuple[int, int]] = [(0, n) for n in meta.shape]
        for i, name in axes:
            a, b = part[name]
            if not 0 <= a <= b <= meta.shape[i]:
                raise ValueError(f"the slice {a}:{b} of {name!r} leaves the array")
            ranges[i] = (a, b)
        out = np.empty([b - a for a, b in ranges], dtype=np.float32)
        touched = [range(a // c, -(-b // c)) if b > a else range(0) for (a, b), c in zip(ranges, meta.chunks)]
        for index in itertools.product(*touched):
            block = meta.decode(store.get(posixpath.join(self.array_name, meta.key(index))))
            low = [i * c for i, c in zip(index, meta.chunks)]
            take = [slice(max(a, s) - s, min(b, s + c) - s) for (a, b), s, c in zip(ranges, low, meta.chunks)]
            put = [slice(max(a, s) - a, min(b, s + c) - a) for (a, b), s, c in zip(ranges, low, meta.chunks)]
            out[tuple(put)] = block[tuple(take)].astype(np.float32)
        moved = np.moveaxis(out, axis, -1)
        return moved.reshape(-1, moved.shape[-1]), moved.shape[:-1]


class VectorReader(Protocol):
    """What a reader offers: the vectors (n, d) of a chunk as 32-bit floats, and the shape of its index axes."""

    def read(self, url: str, slice_: Sequence[dict[str, Any]]) -> tuple[np.ndarray, tuple[int, ...]]: ...


#: Readers by name; a caller may add one that makes a VectorReader.
READERS: dict[str, Callable[..., VectorReader]] = {"zarr": Reader}


def make_reader(kind: str, **options: Any) -> VectorReader:
    if kind == "cog":
        raise NotImplementedError("reading cloud-optimised GeoTIFF files is not implemented")
    if kind not in READERS:
        raise ValueError(f"unknown reader {kind!r}; there are {sorted([*READERS, 'cog'])}")
    return READERS[kind](**options)


def chunks_of(spark: SparkSession, url: str, reader: Reader) -> DataFrame:
    """url, slice of every chunk of the array's grid over its index axes."""
    meta, _, axes = reader.layout(url)
    return chunk_grid(spark, [meta.shape[i] for i, _ in axes], [meta.grid[i] for i, _ in axes], [n for _, n in axes], url).select("url", "slice")


def vectors_of(chunks: DataFrame, reader: Reader, partitions: int | None = None, batch_rows: int | None = None) -> DataFrame:
    """The vectors (url, slice, chunk_id, offset, embedding) of chunks (url, slice); each task reads the chunks it has."""
    options = (reader.array_name, reader.embedding_dim_name, reader.store_kwargs)
    names = [f.name for f in schema.VECTORS.fields]
    rows = batch_rows or BATCH_ROWS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Reader(*options)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                vectors, _ = own.read(row.column("url")[0].as_py(), row.column("slice")[0].as_py())
                for a in range(0, len(vectors), rows):
                    v = vectors[a : a + rows]
                    ends = pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32())
                    same = pa.array(np.zeros(len(v), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([*(row.column(n).take(same) for n in ("url", "slice", "chunk_id")), pa.array(np.arange(a, a + len(v)), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=names)

    named = chunks.select("url", "slice", V.chunk_id().alias("chunk_id"))
    return (named.repartition(partitions) if partitions else named).mapInArrow(read, schema.VECTORS)


def transforms_of(spark: SparkSession, urls: Sequence[str], store_kwargs: dict[str, Any] | None = None) -> DataFrame:
    """url and the six numbers of each store's transform."""
    rows = [(u, *geo_transform(Store(u, store_kwargs))) for u in urls]
    return spark.createDataFrame(rows, "url string, ox double, pw double, rr double, oy double, cr double, ph double")


def transforms_in(urls: DataFrame, store_kwargs: dict[str, Any] | None = None) -> DataFrame:
    """url and the six numbers of the transform of each store in a DataFrame of urls, read by the tasks that have them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([geo_transform(Store(u, store_kwargs)) for u in batch.column("url").to_pylist()], dtype=np.float64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column("url"), *map(pa.array, found.T.copy())], names=["url", *TRANSFORM_FIELDS])

    return urls.mapInArrow(read, "url string, ox double, pw double, rr double, oy double, cr double, ph double")


def _write_meta(store: Store, name: str, shape: Sequence[int], chunks: Sequence[int], dims: Sequence[str], dtype: np.dtype, version: int, codec: str | None, spatial: str | Sequence[float] | None, fill: float = 0) -> None:
    if version == 2:
        store.put(".zgroup", json.dumps({"zarr_format": 2}).encode())
        meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype.newbyteorder("<").str, "compressor": {"id": codec} if codec else None, "fill_value": fill if np.isfinite(fill) else "NaN" if np.isnan(fill) else "Infinity" if fill > 0 else "-Infinity", "order": "C", "filters": None}
        store.put(f"{name}/.zarray", json.dumps(meta).encode())
        store.put(f"{name}/.zattrs", json.dumps({DIMENSIONS: list(dims)}).encode())
        if spatial is not None:
            store.put("spatial_ref/.zgroup", json.dumps({"zarr_format": 2}).encode())
            store.put("spatial_ref/.zattrs", json.dumps({"GeoTransform": spatial}).encode())
        return
    group = {"zarr_format": 3, "node_type": "group", "attributes": {}}
    store.put("zarr.json", json.dumps(group).encode())
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": codec, "configuration": {}}] if codec else [])
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill if np.isfinite(fill) else "NaN" if np.isnan(fill) else "Infinity" if fill > 0 else "-Infinity", "codecs": codecs, "attributes": {DIMENSIONS: list(dims)}}
    store.put(f"{name}/zarr.json", json.dumps(meta).encode())
    if spatial is not None:
        store.put("spatial_ref/zarr.json", json.dumps(group | {"attributes": {"GeoTransform": spatial}}).encode())


def _write_chunk(store: Store, name: str, index: Sequence[int], block: np.ndarray, version: int, codec: str | None) -> None:
    raw = block.astype(block.dtype.newbyteorder("<")).tobytes()
    if codec == "zstd":
        import zstandard

        raw = zstandard.ZstdCompressor().compress(raw)
    elif codec in ("zlib", "gzip"):
        c = zlib.compressobj(wbits=31 if codec == "gzip" else 15)
        raw = c.compress(raw) + c.flush()
    store.put(f"{name}/" + ("c/" + "/".join(map(str, index)) if version == 3 else ".".join(map(str, index))), raw)


def write_array(url: str, name: str, data: np.ndarray, chunks: Sequence[int], dims: Sequence[str], version: int = 2, codec: str | None = "zstd", spatial: str | Sequence[float] | None = None) -> None:
    """Write an array that the caller holds, with named axes, and a transform if given, as a store of format 2 or 3."""
    store = Store(url)
    _write_meta(store, name, data.shape, chunks, dims, data.dtype, version, codec, spatial)
    for index in itertools.product(*(range(-(-n // c)) for n, c in zip(data.shape, chunks))):
        block = np.zeros(tuple(chunks), dtype=data.dtype)
        part = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunks))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        _write_chunk(store, name, index, block, version, codec)


def write_vectors(df: DataFrame, url: str, name: str, shape: Sequence[int], chunks: Sequence[int], dims: Sequence[str], size: int, version: int = 3, codec: str | None = "zstd", spatial: str | Sequence[float] | None = None, embedding_dim_name: str = "embedding", fill: float = 0) -> int:
    """Write a DataFrame (one column for each index axis, and embedding of `size` numbers) as 32-bit floats; each task writes whole chunks.

    The embedding axis comes last, in one chunk. Cells without a row hold `fill`. Returns the chunks written.
    """
    _write_meta(Store(url), name, [*shape, size], [*chunks, size], [*dims, embedding_dim_name], np.dtype("float32"), version, codec, spatial, fill)
    cells = [f"_{d}" for d in dims]

    def write(table: pa.Table) -> pa.Table:
        index = [table.column(c)[0].as_py() for c in cells]
        block = np.full((*chunks, size), fill, dtype=np.float32)
        at = tuple(table.column(d).to_numpy() - i * c for d, i, c in zip(dims, index, chunks))
        block[at] = np.stack(table.column("embedding").to_pylist()).astype(np.float32)
        _write_chunk(Store(url), name, [*index, 0], block, version, codec)
        return pa.table({"written": pa.array([1], pa.int64())})

    placed = df.select(*dims, "embedding", *[F.floor(F.col(d) / c).alias(x) for d, c, x in zip(dims, chunks, cells)])
    return placed.groupBy(*cells).applyInArrow(write, "written bigint").count()
