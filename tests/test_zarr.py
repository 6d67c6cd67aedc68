import json
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from orrery import registry
from orrery.operators import manifest as M
from orrery.operators.geo import Area
from orrery.plans import search
from orrery.sources import blosc, zarr


def store(tmp_path, data, chunks, dims, **options):
    url = str(tmp_path / "source.zarr")
    zarr.write_array(url, "embeddings", data, chunks, dims, **options)
    return url


def part(**dims):
    return [{"dim": d, "start": a, "stop": b} for d, (a, b) in dims.items()]


@pytest.mark.parametrize("version", [2, 3])
@pytest.mark.parametrize("codec", [None, "zstd", "gzip", "zlib"])
def test_reads_what_it_writes(tmp_path, version, codec):
    if version == 3 and codec == "zlib":
        pytest.skip("no codec of that format")
    data = np.arange(4 * 5 * 3, dtype=np.float32).reshape(4, 5, 3)
    url = store(tmp_path, data, (2, 2, 3), ("y", "x", "embedding"), version=version, codec=codec)
    got, shape = zarr.Reader().read(url, part(y=(2, 4), x=(4, 5)))
    assert shape == (2, 1)
    np.testing.assert_array_equal(got, data[2:4, 4:5].reshape(-1, 3))


def test_embedding_axis_first_and_split(tmp_path):
    data = np.arange(3 * 4 * 5, dtype=np.float64).reshape(3, 4, 5)
    url = store(tmp_path, data, (2, 2, 2), ("feature", "y", "x"))
    got, shape = zarr.Reader(embedding_dim_name="feature").read(url, part(y=(0, 2), x=(2, 4)))
    assert got.dtype == np.float32 and shape == (2, 2)
    np.testing.assert_array_equal(got, np.moveaxis(data[:, 0:2, 2:4], 0, -1).reshape(-1, 3))


def test_missing_chunk_is_fill(tmp_path):
    url = store(tmp_path, np.ones((2, 2, 2), dtype=np.float32), (1, 2, 2), ("y", "x", "embedding"))
    (tmp_path / "source.zarr" / "embeddings" / "1.0.0").unlink()
    got, _ = zarr.Reader().read(url, part(y=(0, 2), x=(0, 2)))
    assert got.sum() == 4


def test_slice_validation(tmp_path):
    url = store(tmp_path, np.ones((2, 2, 2), dtype=np.float32), (1, 2, 2), ("y", "x", "embedding"))
    reader = zarr.Reader()
    for bad in (part(y=(0, 1)), part(y=(0, 1), x=(0, 1), z=(0, 1)), [*part(y=(0, 1), x=(0, 1)), *part(y=(0, 1))], part(y=(0, 3), x=(0, 1))):
        with pytest.raises(ValueError):
            reader.read(url, bad)


def test_metadata_errors(tmp_path):
    meta = zarr.ArrayMeta((2, 2), (1, 1), np.dtype("f4"), 0, "C", [], "", ".")
    with pytest.raises(ValueError):
        zarr.axis_names(meta)
    meta.attributes = {zarr.DIMENSIONS: "xy"}
    with pytest.raises(TypeError):
        zarr.axis_names(meta)
    meta.attributes = {zarr.DIMENSIONS: ["x"]}
    with pytest.raises(ValueError):
        zarr.axis_names(meta)
    meta.attributes, meta.names = {}, ["x", "embedding"]
    assert zarr.axis_names(meta) == ["x", "embedding"]
    for names in (["x", "y"], ["embedding", "embedding"]):
        with pytest.raises(ValueError):
            zarr.embedding_axis(names)
    url = store(tmp_path, np.ones(3, dtype=np.float32), (3,), ("embedding",))
    with pytest.raises(ValueError):
        zarr.Reader().layout(url)
    with pytest.raises(ValueError):
        zarr.geo_transform(zarr.Store(url))
    path = tmp_path / "source.zarr" / "embeddings" / ".zarray"
    path.write_text(json.dumps(json.loads(path.read_text()) | {"compressor": {"id": "zfpy"}}))
    with pytest.raises(NotImplementedError):
        zarr.Reader().layout(url)


def test_make_reader():
    assert isinstance(zarr.make_reader("zarr"), zarr.Reader)
    with pytest.raises(NotImplementedError):
        zarr.make_reader("cog")
    with pytest.raises(ValueError):
        zarr.make_reader("hdf")


def test_manifest_of_an_array(spark, tmp_path):
    data = np.arange(3 * 4 * 4, dtype=np.float32).reshape(1, 3, 4, 4)
    url = store(tmp_path, data, (1, 3, 2, 2), ("time", "feature", "y", "x"))
    search.build_manifest(spark, url, str(tmp_path / "m"), embedding_dim_name="feature", n_blocks=2)
    rows = {tuple((p["dim"], p["start"], p["stop"]) for p in r["slice"]): r for r in M.read_manifest(spark, str(tmp_path / "m")).collect()}
    assert len(rows) == 4
    for (_, (_, y0, y1), (_, x0, x1)), r in rows.items():
        v = np.moveaxis(data[0, :, y0:y1, x0:x1], 0, -1).reshape(-1, 3)
        assert r["count"] == 4
        np.testing.assert_allclose(r["centroid"], v.mean(axis=0), rtol=1e-6)
        assert r["radius"] == pytest.approx(np.linalg.norm(v - v.mean(axis=0), axis=1).max(), rel=1e-6)


def test_empty_array_has_an_empty_manifest(spark, tmp_path):
    url = store(tmp_path, np.empty((0, 2, 3), dtype=np.float32), (1, 2, 3), ("y", "x", "embedding"))
    search.build_manifest(spark, url, str(tmp_path / "m"))
    assert M.read_manifest(spark, str(tmp_path / "m")).count() == 0
    assert search.knn_zarr_search(spark, str(tmp_path / "m"), np.zeros((1, 3)), 2).count() == 0


@pytest.mark.parametrize("backend", ["numpy", "native", "faiss_cpu"])
def test_search_matches_brute_force(spark, tmp_path, backend):
    rng = np.random.default_rng(42)
    data = rng.standard_normal((1, 11, 12, 8)).astype(np.float32)
    queries = rng.standard_normal((3, 8)).astype(np.float32)
    url = store(tmp_path, data, (1, 5, 5, 8), ("time", "y", "x", "embedding"))
    search.build_manifest(spark, url, str(tmp_path / "m"))
    rows = search.to_rows(search.knn_zarr_search(spark, str(tmp_path / "m"), queries, 4, backend=backend))
    assert list(rows[0]) == ["query_id", "chunk_id", "url", "slice", "offset", "distance"]
    flat = data.reshape(-1, 8)
    want = np.sort(((queries[:, None] - flat[None]) ** 2).sum(-1), axis=1)[:, :4]
    got = np.array([r["distance"] for r in rows]).reshape(3, 4)
    np.testing.assert_allclose(got, want, rtol=1e-5)
    for r in rows:  # the place leads back to the vector
        (_, t), (_, y), (_, x) = [(p["dim"], p) for p in r["slice"]]
        dy, dx = divmod(r["offset"], x["stop"] - x["start"])
        v = data[0, y["start"] + dy, x["start"] + dx]
        assert ((v - queries[r["query_id"]]) ** 2).sum() == pytest.approx(r["distance"], rel=1e-5)


def test_area_and_filter_together(spark, tmp_path):
    data = np.arange(4 * 4 * 3, dtype=np.float32).reshape(1, 4, 4, 3)
    url = store(tmp_path, data, (1, 2, 2, 3), ("time", "y", "x", "embedding"), spatial="0 1 0 4 0 -1")
    search.build_manifest(spark, url, str(tmp_path / "m"))
    area = Area.box(0.5, 2.5, 1.5, 3.5)
    rows = search.to_rows(search.knn_zarr_search(spark, str(tmp_path / "m"), np.zeros((1, 3)), 9, aoi=area))
    assert {r["chunk_id"].partition("#")[2] for r in rows} == {"time=0:1/y=0:2/x=0:2"} and len(rows) == 4
    assert search.knn_zarr_search(spark, str(tmp_path / "m"), np.zeros((1, 3)), 9, aoi=area, filter_expr="count > 99").count() == 0


def test_written_by_tasks(spark, tmp_path):
    rows = [(y, x, [float(y), float(x)]) for y in range(3) for x in range(5)]
    url = str(tmp_path / "w.zarr")
    assert zarr.write_vectors(spark.createDataFrame(rows, "y long, x long, embedding array<float>"), url, "embeddings", [3, 5], [2, 2], ["y", "x"], 2) == 6
    got, _ = zarr.Reader().read(url, part(y=(0, 3), x=(0, 5)))
    assert got.tolist() == [v for _, _, v in rows]


@pytest.mark.parametrize("ids", [list(range(37)), [*range(260), 300, 401, 1003], [7], []])
def test_registered_stores_hold_every_row(spark, tmp_path, ids):
    rng = np.random.default_rng(len(ids))
    vectors = {i: rng.standard_normal(4).astype(np.float32) for i in ids}
    rows = [(i, v.tolist(), 0) for i, v in vectors.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    cells = Counter((i // 25 // 10 * 10, i % 25 // 10 * 10) for i in ids)
    want = sorted((f"y={y}:{y + 10}/x={x}:{min(x + 10, 25)}", n) for (y, x), n in cells.items())
    assert sorted((r["chunk"], r["count"]) for r in registry.zarr_manifest(spark, str(tmp_path)).collect()) == want
    got = registry.zarr_roundtrip_knn(spark, str(tmp_path)).collect()
    for q in (i for i in ids if i % 50 == 0):
        near = sorted(float(((v.astype(float) - vectors[q].astype(float)) ** 2).sum()) for v in vectors.values())[:10]
        np.testing.assert_allclose([r["distance"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])], near, atol=1e-3)


@pytest.mark.parametrize("version", [2, 3])
def test_cells_without_a_row_hold_the_fill(spark, tmp_path, version):
    url = str(tmp_path / "f.zarr")
    zarr.write_vectors(spark.createDataFrame([(0, 0, [1.0, 2.0])], "y long, x long, embedding array<float>"), url, "embeddings", [2, 1], [1, 1], ["y", "x"], 2, version=version, fill=float("nan"))
    got, _ = zarr.Reader().read(url, part(y=(0, 2), x=(0, 1)))
    assert got[0].tolist() == [1.0, 2.0] and np.isnan(got[1]).all()


def frame(data: bytes, size: int, block: int, kind: int, flags: int, pack) -> bytes:
    """A Blosc frame made by hand, of blocks in one stream or one for each byte of an element."""
    blocks = [data[i : i + block] for i in range(0, len(data), block)]
    body, places, at = b"", [], 16 + 4 * len(blocks)
    for b in blocks:
        n = len(b) // size
        if flags & 1:
            b = np.frombuffer(b, dtype=np.uint8, count=n * size).reshape(n, size).T.tobytes() + b[n * size :]
        elif flags & 4 and n % 8 == 0:
            bits = np.unpackbits(np.frombuffer(b, dtype=np.uint8).reshape(n, size), axis=1, bitorder="little")
            b = np.packbits(bits.T, axis=1, bitorder="little").tobytes()
        streams = size if not flags & 16 and block // size >= 128 and len(b) == block else 1
        part = b""
        for i in range(streams):
            raw = b[i * len(b) // streams : (i + 1) * len(b) // streams]
            packed = pack(raw)
            packed = raw if len(packed) >= len(raw) else packed
            part += struct.pack("<i", len(packed)) + packed
        places.append(at + len(body))
        body += part
    head = struct.pack("<BBBBIII", 2, 1, flags | kind << 5, size, len(data), block, at + len(body))
    return head + struct.pack(f"<{len(places)}i", *places) + body


@pytest.mark.parametrize(("kind", "codec"), [(1, "lz4_raw"), (3, None), (4, "zstd")])
@pytest.mark.parametrize("flags", [0, 1, 4, 16, 17, 20])
def test_blosc_frames(kind, codec, flags):
    import zlib

    data = np.arange(1000, dtype="<f4").tobytes()
    pack = zlib.compress if codec is None else lambda raw: pa.Codec(codec).compress(raw).to_pybytes()
    assert blosc.decompress(frame(data, 4, 1024, kind, flags, pack)) == data


def test_blosc_by_hand():
    # Four literals, then a match of nine bytes that begins four back, then a literal.
    stream = bytes([3]) + b"abcd" + bytes([7 << 5, 0, 3]) + bytes([0]) + b"!"
    raw = struct.pack("<BBBBIII", 2, 1, 16, 1, 14, 14, 0) + struct.pack("<i", 20) + struct.pack("<i", len(stream)) + stream
    raw = raw[:12] + struct.pack("<I", len(raw)) + raw[16:]
    assert blosc.decompress(raw) == b"abcdabcdabcda!"
    assert blosc.decompress(struct.pack("<BBBBIII", 2, 1, 2, 1, 3, 3, 19) + b"xyz") == b"xyz"
    assert blosc.decompress(struct.pack("<BBBBIII", 2, 1, 0, 1, 0, 0, 16)) == b""
    with pytest.raises(ValueError):
        blosc.decompress(b"short")


def test_blosc_store(tmp_path):
    data = np.random.default_rng(3).standard_normal((4, 4, 8)).astype(np.float32)
    url = store(tmp_path, data, (2, 2, 8), ("y", "x", "embedding"), codec=None)
    folder = tmp_path / "source.zarr" / "embeddings"
    (folder / ".zarray").write_text(json.dumps(json.loads((folder / ".zarray").read_text()) | {"compressor": {"id": "blosc", "cname": "zstd", "shuffle": 1}}))
    for chunk in folder.glob("[0-9]*"):
        chunk.write_bytes(frame(chunk.read_bytes(), 4, 128, 4, 17, lambda raw: pa.Codec("zstd").compress(raw).to_pybytes()))
    got, _ = zarr.Reader().read(url, part(y=(0, 4), x=(0, 4)))
    np.testing.assert_array_equal(got, data.reshape(-1, 8))


@pytest.mark.parametrize("end", [True, False])
def test_shards(tmp_path, spark, end):
    data = np.arange(4 * 4 * 2, dtype=np.float32).reshape(4, 4, 2)
    url = store(tmp_path, data, (4, 4, 2), ("y", "x", "embedding"), version=3, codec=None)
    folder = tmp_path / "source.zarr" / "embeddings"
    meta = json.loads((folder / "zarr.json").read_text())
    index_codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
    meta["codecs"] = [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 2, 2], "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}], "index_codecs": index_codecs, "index_location": "end" if end else "start"}}]
    (folder / "zarr.json").write_text(json.dumps(meta))
    blocks = [data[y : y + 2, x : x + 2].tobytes() for y in (0, 2) for x in (0, 2)]
    blocks[3] = b""  # a chunk that the shard lacks
    at, places = 0 if end else 16 * 4 + 4, []
    for b in blocks:
        places += [at, len(b)] if b else [2**64 - 1, 2**64 - 1]
        at += len(b)
    index = struct.pack("<8Q", *places) + b"\0" * 4
    (folder / "c" / "0" / "0" / "0").write_bytes(b"".join([*blocks, index] if end else [index, *blocks]))
    want = data.copy()
    want[2:, 2:] = 0
    got, _ = zarr.Reader().read(url, part(y=(0, 4), x=(0, 4)))
    np.testing.assert_array_equal(got, want.reshape(-1, 2))
    assert zarr.chunks_of(spark, url, zarr.Reader()).count() == 4


def test_a_chunk_without_vectors_is_an_error(tmp_path, spark):
    data = np.ones((4, 2, 2), dtype=np.float32)
    data[2:] = np.nan
    url = store(tmp_path, data, (2, 2, 2), ("y", "x", "embedding"))
    with pytest.raises(ValueError, match="no vectors"):
        search.build_manifest(spark, url, url + "/m")
    search.build_manifest(spark, url, url + "/m", skip_empty=True)
    assert M.read_manifest(spark, url + "/m").count() == 1


def test_manifest_types_are_fixed(tmp_path, spark):
    spark.range(1).selectExpr("'u' AS url", "id AS count").write.parquet(str(tmp_path / "m"))
    with pytest.raises(ValueError, match="manifest"):
        M.read_manifest(spark, str(tmp_path / "m"))


def test_result_table(tmp_path, spark):
    url = store(tmp_path, np.arange(16, dtype=np.float32).reshape(2, 4, 2), (1, 2, 2), ("y", "x", "embedding"))
    search.build_manifest(spark, url, url + "/m")
    table = search.to_table(search.knn_zarr_search(spark, url + "/m", [[0, 0]], 2, batch_size=1))
    assert table.column_names == ["query_id", "chunk_id", "url", "slice", "offset", "distance"]
    assert table.column("distance").to_pylist() == [1.0, 13.0]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
