"""Near-duplicate documents by BagMinHash over shingles of five words, banding and exact verification.

A text is the multiset of its shingles. Each shingle owns Poisson processes on the axis of its weight, cut
into the dyadic intervals [0,1), [1,2), [2,4), ...; a point has a time, a place on the axis and a component
of the signature. A text with weight w sees the points below w, and a component's value is the smallest time
it sees. Two texts agree in a component with a probability of exactly their weighted Jaccard similarity. Only
points before a time limit are made, and the limit is doubled for the few texts with an empty component.

Signatures are cut into bands; texts that share a band are candidates. In each band group every member is
held against one member, its pivot; what is similar on the exact multisets becomes a link, and links make
components. Members that end outside the component of their group's pivot are then held against all members of
other components: in small groups as pairs, each in the first band that it shares and if enough one-bit samples of
the signatures agree; in groups of more than HOT pairs tile by tile, in matrix products of their exact multisets,
so that no pair becomes a row. So no link between different texts is lost but by an unlucky signature (fewer than
one in 100,000 at a similarity of 0.8). Equal texts are one from the start, so copies cost no pairs.

Defined results: texts without words (null and empty ones too) are each a class of their own; texts of one to
four words are a single shingle; rows with a null id get a null class; rows that share an id count as one
document, with links by any of their texts, and a class is named after its smallest id; texts are taken
whole; an empty table gives no rows; other columns are ignored, or kept by `keep_first`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, releasing, scratch, slices, text_or_empty
from .graph import components

WORDS, BANDS, ROWS = 5, 42, 6
COMPONENTS = BANDS * ROWS
#: One-bit samples of the components that must agree: 4.7 standard deviations below their mean (90 %) at 0.8.
LEAST_BITS = 205
#: Pairs of a band group beyond which it is worked in tiles of TILE by TILE texts, COLUMNS shingles at a time.
HOT, TILE, COLUMNS = 512, 256, 8_192
#: Rows of one id up to which a table is broadcast (16 MB); larger ones are joined by shuffling.
BROADCAST_ROWS = 1_000_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """64-bit hashes of a text's shingles, one for each place."""
    words = text.encode().split()
    if not words:
        return np.empty(0, dtype=_U)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=_U)
    known: dict[bytes, int] = {}
    for w in set(words):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), dtype=_U, count=len(words))
    n = len(h) - size + 1
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, size):
            out = _mix(out) * _U(0x9E3779B97F4A7C15) + h[i : n + i]
        return _mix(out)


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = COMPONENTS) -> np.ndarray:
    """A row of m times for each bag (elements, weights 1, 2, ...). Bags must not be empty."""
    owner, element, low, width, weight = [], [], [], [], []
    for i, (e, w) in enumerate(bags):
        start, step = 0, 1
        while len(e):  # one stream for each dyadic interval that begins below the weight
            owner.append(np.full(len(e), i)), element.append(e ^ _U(start * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            low.append(np.full(len(e), start)), width.append(np.full(len(e), step)), weight.append(w)
            start, step = (1, 1) if start == 0 else (start * 2, start * 2)
            more = w > start
            e, w = e[more], w[more]
    owner, element, low, width, weight = map(np.concatenate, (owner, element, low, width, weight))
    out = np.full(len(bags) * m, np.inf)
    limit = m * (np.log(m) + 3) / np.array([w.sum() for _, w in bags], dtype=np.float64)
    with np.errstate(over="ignore"):
        seed = _mix(element)
        state = seed.copy()
        time = np.zeros(len(owner))

        def draw(at: np.ndarray) -> None:
            state[at] = state[at] + _U(0x9E3779B97F4A7C15)
            time[at] -= np.log(_uniform(_mix(state[at]))) / width[at]

        draw(np.arange(len(owner)))
        pending = np.arange(len(owner))
        while len(pending):
            active = pending[time[pending] <= limit[owner[pending]]]
            while len(active):
                point = _mix(state[active] ^ _U(0xD1B54A32D192ED03))
                place = low[active] + width[active] * (1 - _uniform(_mix(point + _U(1))))
                seen = place < weight[active]
                np.minimum.at(out, owner[active][seen] * m + (point[seen] % _U(m)).astype(np.int64), time[active][seen])
                draw(active)
                active = active[time[active] <= limit[owner[active]]]
            short = np.isinf(out.reshape(-1, m)).any(axis=1)
            limit[short] *= 2
            pending = pending[short[owner[pending]]]
    return out.reshape(-1, m)


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of each signature, different from band to band."""
    bits = signature.view(_U).reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), (len(signature), BANDS)).copy()
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + bits[:, :, i])
    return out.view(np.int64)


def one_bits(signature: np.ndarray) -> np.ndarray:
    """One bit of each component of each signature, as four numbers of 64 bits."""
    with np.errstate(over="ignore"):
        odd = (_mix(signature.view(_U)) & _U(1)).astype(np.uint8)
    return np.packbits(np.pad(odd, ((0, 0), (0, 256 - odd.shape[1]))), axis=1).view(np.int64)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    values, counts = np.unique(shingles(text), return_counts=True)
    return values, counts, int(counts.sum())


def similar(a: str, b: str, bag=_bag) -> bool:
    """Whether the weighted Jaccard similarity of two texts' shingles is 4/5 or more, by exact counts."""
    (x, xc, xn), (y, yc, yn) = bag(a), bag(b)
    if not len(x) or not len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int(np.minimum(xc, yc[at])[y[at] == x].sum())
    return 9 * common >= 4 * (xn + yn)


def _occurrences(text: str) -> np.ndarray:
    """Different hashes for the first, second, ... occurrence of each shingle, so that sets stand for multisets."""
    values, counts, total = _bag(text)
    nth = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        return _mix(np.repeat(values, counts) + nth.astype(_U) * _U(0xD6E8FEB86659FD93))


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(shared, flat)
        hit = (at < len(shared)) & (shared[np.minimum(at, max(0, len(shared) - 1))] == flat) if len(shared) else np.zeros(len(flat), dtype=bool)
        return who[hit], at[hit]

    (lw, lc), (rw, rc) = cells(left), cells(right)
    for start in range(0, len(shared), COLUMNS):
        a, b = (np.zeros((n, COLUMNS), dtype=np.float32) for n in out.shape)
        for m, w, c in ((a, lw, lc), (b, rw, rc)):
            part = (c >= start) & (c < start + COLUMNS)
            m[w[part], c[part] - start] = 1
        out += a @ b.T
    return out


def _tile_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links (a, b) between the texts of one tile that belong to different components."""
    found: tuple[list, list] = ([], [])
    if left.num_rows and right.num_rows:
        sets = [[_occurrences(t) for t in side.column("text").to_pylist()] for side in (left, right)]
        n, m = (np.array([len(x) for x in s]) for s in sets)
        close = 9 * common_counts(*sets) >= 4 * (n[:, None] + m[None, :])
        ids, parts = zip(*((side.column("rep").to_pylist(), side.column("x").to_pylist()) for side in (left, right)))
        for i, j in zip(*np.nonzero(close)):
            if parts[0][i] != parts[1][j]:
                a, b = sorted((ids[0][i], ids[1][j]))
                found[0].append(a), found[1].append(b)
    kind = left.schema.field("rep").type
    return pa.table({"a": pa.array(found[0], kind), "b": pa.array(found[1], kind)})


def _hot_links(docs: DataFrame, hot: DataFrame) -> DataFrame:
    """Links between members outside (x <> y) and all others of the band groups in hot."""
    texts = docs.join(_small(cut(hot.select(F.col("rep").alias("id")).distinct())), "id", "left_semi").select(F.col("id").alias("rep"), "text")
    blocks = lambda count: F.ceil(F.col(count) / TILE).cast("int")
    own = lambda count: F.pmod(F.xxhash64("rep"), blocks(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), blocks(count) - 1))
    outside = hot.where("x <> y").select("h", "rep", "x", own("lefts").alias("i"), every("others").alias("j")).join(texts, "rep")
    others = hot.where("rep <> f_rep").select("h", "rep", "x", own("others").alias("j"), every("lefts").alias("i")).join(texts, "rep")
    others = others.select(*(F.col(c).alias(c) for c in others.columns))  # columns of their own beside those of outside
    kind = dict(hot.dtypes)["rep"]
    return outside.groupBy("h", "i", "j").cogroup(others.groupBy("h", "i", "j")).applyInArrow(_tile_links, f"a {kind}, b {kind}").distinct()


@releasing
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        bags = [np.unique(shingles(t), return_counts=True) for t in texts]
        full = [i for i, b in enumerate(bags) if len(b[0])]
        hashed: list[list[int] | None] = [None] * len(texts)
        bits: list[list[int] | None] = [None] * len(texts)
        if full:
            made = signatures([bags[i] for i in full])
            for i, row, four in zip(full, bands(made), one_bits(made)):
                hashed[i], bits[i] = row, four
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary()), pa.array([int(b[1].sum()) for b in bags], pa.int64()), pa.array(hashed, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["id", "key", "n", "bands", "bits"])


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows are few. df must be cheap to count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of written pairs (a, b) those whose texts are similar, as a written table."""

    @releasing
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = lru_cache(maxsize=512)(_bag)  # rows of a text stand together, and its partners recur
        for batch in batches:
            keep = [similar(x, y, bag) for x, y in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = cut(pairs.select("a").union(pairs.select("b")).distinct())
    texts = docs.join(_small(ids.withColumnRenamed("a", "id")), "id", "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")
    return cut(both.select("a", "b", "s", "t").mapInArrow(check, pairs.select("a", "b").schema).distinct())


def _sizes(a: Column, b: Column) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id and class_id, the smallest id of the documents linked to it. The table is written."""
    with scratch(df.sparkSession):
        return cut(_classes(df, id_col, text_col), keep=True)


def _classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    kind = dict(docs.dtypes)["id"]
    signed = cut(docs.mapInArrow(_sign, f"id {kind}, key binary, n bigint, bands array<bigint>, bits array<bigint>"))
    usable = signed.where(F.col("id").isNotNull() & (F.col("n") > 0))
    different = cut(usable.groupBy("key").agg(F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits")))
    rows = different.select("rep", "n", F.posexplode("bands").alias("p", "h"))
    # Each band takes another member of a group for its pivot, so that a text meets many of its group.
    first = rows.groupBy("h").agg(F.min(F.struct(F.xxhash64("rep", "p").alias("o"), "rep", "n")).alias("f"), F.count("*").alias("c")).where("c > 1").select("h", F.col("f.rep").alias("f_rep"), F.col("f.n").alias("f_n"))
    shared = cut(rows.join(first, "h"))
    pairs = cut(shared.where((F.col("rep") != F.col("f_rep")) & _sizes(F.col("n"), F.col("f_n"))).select(F.least("rep", "f_rep").alias("a"), F.greatest("rep", "f_rep").alias("b")).distinct())
    links = _verified(docs, pairs)
    # Ids that stand for several texts, or texts for several ids, join here as well.
    links = links.union(usable.join(different.select("key", "rep"), "key").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct())
    found = components(links)
    label = _small(found)
    near = shared.join(label.select(F.col("node").alias("rep"), F.col("label").alias("x")), "rep", "left").join(label.select(F.col("node").alias("f_rep"), F.col("label").alias("y")), "f_rep", "left")
    near = near.select("h", "p", "rep", "n", "f_rep", F.coalesce("x", "rep").alias("x"), F.coalesce("y", "f_rep").alias("y"))
    sizes = near.groupBy("h").agg(F.count_if(F.col("x") != F.col("y")).alias("lefts"), F.count_if(F.col("rep") != F.col("f_rep")).alias("others")).where("lefts > 0")
    near = cut(near.join(sizes, "h"))
    is_hot = F.col("lefts") * F.col("others") > HOT
    cold = near.where(~is_hot).join(different.select("rep", "bands", "bits"), "rep")
    left, others = cold.where("x <> y").alias("l"), cold.where("rep <> f_rep").alias("o")
    agree = COMPONENTS - sum((F.bit_count(F.col("l.bits")[i].bitwiseXOR(F.col("o.bits")[i])) for i in range(4)), F.lit(0))
    before = F.exists(F.zip_with(F.slice("l.bands", 1, F.col("l.p")), F.slice("o.bands", 1, F.col("l.p")), lambda x, y: x == y), lambda same: same)
    # Two members outside would meet twice, once from either side.
    once = (F.col("o.x") == F.col("o.y")) | (F.col("l.rep") < F.col("o.rep"))
    met = (F.col("l.h") == F.col("o.h")) & (F.col("l.x") != F.col("o.x")) & once & _sizes(F.col("l.n"), F.col("o.n")) & (agree >= LEAST_BITS) & ~before
    more = others.join(left, met).select(F.least("l.rep", "o.rep").alias("a"), F.greatest("l.rep", "o.rep").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    late = _verified(docs, cut(more))
    hot = cut(near.where(is_hot))
    if not hot.isEmpty():
        late = late.union(cut(_hot_links(docs, hot)))
    # Late links join components, so their graph is one of labels.
    of = lambda side: late.select(F.col(side).alias("node")).distinct().join(found, "node", "left").select(F.col("node").alias(side), F.coalesce("label", "node").alias(f"{side}_label"))
    merged = components(late.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    names = signed.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("label", "id").alias("label"))
    names = names.join(merged.select(F.col("node").alias("label"), F.col("label").alias("other")), "label", "left")
    return names.select(F.col("id").alias(id_col), F.coalesce("other", "label").alias("class_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose id names its class; one row of each id. Rows with a null id stay."""
    found = classes(df, id_col, text_col)
    kept = cut(found.where(F.col(id_col) == F.col("class_id")).select(id_col))
    once = kept.distinct()
    rest = df.join(_small(cut(once)), id_col, "left_semi")
    if kept.count() != once.count():
        rest = rest.dropDuplicates([id_col])
    return rest.select(*df.columns).union(df.where(F.col(id_col).isNull()))
