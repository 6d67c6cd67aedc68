"""Language-model scoring by class-based bigrams whose classes come from exchange clustering.

Words are counted over all training texts. The CORE most frequent ones are clustered first: on their bigrams, counted over
all training texts, the exchange algorithm moves words between classes, each time to the class that raises the likelihood
of a class bigram model most, until nothing moves. Then every other training word, however rare, makes one exchange
step: the classes of its neighbours are counted over all training texts, and it joins the class that makes
its occurrences likeliest. Those counts grow with the corpus and never leave the tasks; what does is a table of classes
by classes. A token's probability is

    P(class | class before) * P(word | class)

with absolute discounting towards class frequencies in the first and towards unknown words in the second factor, so
the model gives every word a probability. The end token has a class of its own and stands before a text's first word.
Bigrams of classes are counted over all training texts, once every word has its class (`counted`, as the query has it). By default, and
in train(), those of two words beyond the core are instead spread by the margins that are known of them: how often words of each class stand
before and behind a word beyond the core.

No vocabulary is broadcast but the core. Texts are split into words once and written as blocks of bounded size, of
numbers into the block's own list of words; a block gets the counts and classes of just the words it holds.

Defined results: a null text counts as empty, and an empty text is one end token; a null id counts as the
empty text in the fold; very long texts are taken whole; without training rows known counts are 0, and score is
base_score; repeated rows count and score each for itself; ties go to the smaller class; a table without rows gives none;
other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, slices, text_or_empty

#: Words clustered by full exchange, and classes, the end token's among them.
CORE, CLASSES = 1_536, 64
DISCOUNT = 0.6
#: Bytes of text from which a block is full, and bits of its number below its task's.
BLOCK_BYTES, TASK_BITS = 16 << 20, 13
#: Words beyond the core whose neighbours are counted at a time; less than 2 ** 23, so that counts fit in three bytes.
CONTEXTS = 4 << 20
SUMMING_TASKS = 16
#: A neighbour's class, or CLASSES for words beyond the core, on the left and on the right.
SIDE = CLASSES + 1
END = b""  # never a word
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(id_col: str, folds: int, held: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == held


def _blocks(docs: DataFrame) -> DataFrame:
    """Texts as numbers, written. docs has id, text and trains. A row is a block of texts as they lie, bounded but for a longer text:
    its different words, END first, how often each stands in training texts, and of its texts the words' places with END last."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        texts: list[np.ndarray] = []
        ids: list[pa.Array] = []
        trains: list[np.ndarray] = []
        size = number[END]

        def flush() -> pa.RecordBatch:
            nonlocal made, size
            places, lengths, learnt = np.concatenate(texts), np.array([len(x) for x in texts], dtype=np.int32), np.concatenate(trains)
            times = np.bincount(places[np.repeat(learnt, lengths)], minlength=len(number))
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [pa.array([(task << TASK_BITS) + made], pa.int64()), listed(pa.array(list(number), pa.binary())), listed(pa.array(times, pa.int32())), *(pa.array([x.tobytes()], pa.binary()) for x in (places, lengths, learnt)), listed(pa.concat_arrays(ids))]
            made, size = made + 1, 0
            for x in (number, texts, ids, trains):
                x.clear()
            number.default_factory = count().__next__
            number[END]
            return pa.RecordBatch.from_arrays(columns, names=["block", "words", "times", "places", "lengths", "trains", "ids"])

        for batch in slices(batches, "text"):
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = text.translate(_LOWER).split()  # at ASCII white space
                words.append(END)
                texts.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)))
                size += len(text)
            ids.append(batch.column("id"))
            trains.append(batch.column("trains").to_numpy(zero_copy_only=False).astype(bool))
            if size > BLOCK_BYTES:
                yield flush()
        if texts:
            yield flush()

    kind = docs.schema["id"].dataType.simpleString()
    return cut(docs.select("id", "text", "trains").mapInArrow(encode, f"block bigint, words array<binary>, times array<int>, places binary, lengths binary, trains binary, ids array<{kind}>"))


def _arrays(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and training flags of the texts of a block."""
    return tuple(np.frombuffer(batch.column(c)[row].as_py(), dtype=t) for c, t in (("places", np.int32), ("lengths", np.int32), ("trains", bool)))


def _learnt(places: np.ndarray, lengths: np.ndarray, trains: np.ndarray) -> np.ndarray:
    """The places of all training texts in a row, END before the first; so neighbours in the row are the bigrams."""
    return np.concatenate([np.zeros(1, np.int32), places[np.repeat(trains, lengths)]])


def _units(words: pa.Array, core: pa.Array) -> np.ndarray:
    """Of each word its place in the core, or the size of the core."""
    return pc.fill_null(pc.index_in(words, value_set=core), len(core)).to_numpy()


@dataclass
class Model:
    core: dict[bytes, tuple[int, int]]  # word: class, count; the end token is class 0
    tokens: int  # N
    distinct: int  # V
    class_tokens: np.ndarray
    class_words: np.ndarray
    step: np.ndarray  # log10 P(class | class before); the last row stands for an unknown word before
    unknown: np.ndarray  # log10 P(any unknown word | class before)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(pairs: np.ndarray, classes: int = CLASSES, fixed: tuple[tuple[int, int], ...] = ((0, 0),)) -> np.ndarray:
    """Classes of units by the exchange algorithm on their bigram counts, until nothing moves. Each fixed (unit, class) has its class for itself."""
    n = len(pairs)
    total = pairs.sum(axis=1) + pairs.sum(axis=0)
    order = np.argsort(-total, kind="stable")
    order = order[~np.isin(order, [u for u, _ in fixed])]
    own = [k for _, k in fixed]
    free = np.setdiff1d(np.arange(classes), own)
    group = np.zeros(n, dtype=np.int64)
    group[order] = free[np.arange(len(order)) % len(free)]
    for u, k in fixed:
        group[u] = k
    member = np.zeros((n, classes))
    member[np.arange(n), group] = 1
    out, into = pairs @ member, pairs.T @ member  # of a unit: to and from each class
    g = member.T @ out
    left, right = pairs.sum(axis=1), pairs.sum(axis=0)
    rows, cols = g.sum(axis=1), g.sum(axis=0)
    k = np.arange(classes)
    moved = len(order)
    while moved:  # each move raises the likelihood, so this ends
        moved = 0
        for u in order:
            if not total[u]:
                continue
            a, same = group[u], pairs[u, u]
            r, q = out[u], into[u]
            g[a] -= r
            g[:, a] -= q
            g[a, a] += same  # taken off twice
            r, q = r.copy(), q.copy()
            r[a] -= same
            q[a] -= same
            rows[a] -= left[u]
            cols[a] -= right[u]
            f = _xlogx(g)
            gain = (_xlogx(g + r) - f).sum(axis=1) + (_xlogx(g + q[:, None]) - f).sum(axis=0)
            d, fd = g[k, k], f[k, k]
            gain += _xlogx(d + r + q + same) - _xlogx(d + r) - _xlogx(d + q) + fd
            gain -= _xlogx(rows + left[u]) - _xlogx(rows) + _xlogx(cols + right[u]) - _xlogx(cols)
            gain[own] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-6:
                b = a
            r[b] += same
            q[b] += same
            g[b] += r
            g[:, b] += q
            g[b, b] -= same
            rows[b] += left[u]
            cols[b] += right[u]
            if b != a:
                moved += 1
                group[u] = b
                out[:, a] -= pairs[:, u]
                out[:, b] += pairs[:, u]
                into[:, a] -= pairs[u]
                into[:, b] += pairs[u]
    return group


def transitions(counts: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), discounted towards the frequency of the class; each row sums to one, and the last, behind an unknown word, is those frequencies."""
    base = counts.sum(axis=0)
    base = np.where(base > 0, base + 1, 0)  # a class without words takes nothing
    base = base / max(1, base.sum())
    total = counts.sum(axis=1, keepdims=True)
    taken = np.minimum(counts, DISCOUNT).sum(axis=1, keepdims=True)
    p = (np.maximum(counts - DISCOUNT, 0) + taken * base) / np.where(total > 0, total, 1)
    return np.log10(np.maximum(np.vstack([np.where(total > 0, p, base), base]), 1e-300))


def train(docs: DataFrame) -> tuple[Model | None, DataFrame]:
    """The model, with bigrams of two words beyond the core spread by their margins, and the training words beyond its core
    (word, c, k) as a written table. docs has text, without nulls. score() with counted has the bigrams counted instead."""
    model, found = _train(_blocks(docs.select(F.lit(0).alias("id"), "text", F.lit(True).alias("trains"))))
    return model, found.select("word", "c", "k")


def _train(blocks: DataFrame) -> tuple[Model | None, DataFrame]:
    """The model of train(), and its words beyond the core with the places (block, number) where they stand in blocks, written."""
    words = blocks.select("times", F.posexplode("words").alias("i", "word")).select("word", F.get("times", F.col("i")).alias("c")).where("c > 0")
    counts = cut(words.groupBy("word").agg(F.sum("c").alias("c")))
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    if not tokens:
        return None, counts.select("word", "c", F.lit(CLASSES).alias("k"), F.array().cast("array<bigint>").alias("at"))
    top = counts.where(F.length("word") > 0).orderBy(F.col("c").desc(), "word").limit(CORE).collect()
    count = {END: counts.where(F.length("word") == 0).first()["c"]} | {bytes(r["word"]): r["c"] for r in top}
    discard(counts)
    pairs = _unit_bigrams(blocks, list(count))
    group = exchange(pairs, CLASSES + 1, ((0, 0), (len(count), CLASSES)))
    core = {w: (int(k), c) for (w, c), k in zip(count.items(), group)}
    member = np.zeros((len(group), CLASSES + 1))
    member[np.arange(len(group)), group] = 1
    between = member.T @ pairs @ member
    mass = member[:-1].T @ np.array(list(count.values()), dtype=np.float64)
    words = member[:-1].sum(axis=0)
    rest, table = _join_classes(blocks, core, between, mass)
    left, right = table[:SIDE], table[SIDE:]  # of each class of neighbour and class of word beyond the core
    full = between[:CLASSES, :CLASSES] + left[:CLASSES] + right[:CLASSES].T
    if (both := left[CLASSES].sum()) > 0:
        full += np.outer(right[CLASSES], left[CLASSES]) / both
    for r in rest.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # a row for each class
        mass[r["k"]] += r["c"]
        words[r["k"]] += r["v"]
    return _model(core, int(tokens), int(distinct), mass[:CLASSES], words[:CLASSES], full), rest


def _model(core: dict[bytes, tuple[int, int]], tokens: int, distinct: int, mass: np.ndarray, words: np.ndarray, bigrams: np.ndarray) -> Model:
    """The model of class bigrams."""
    step = transitions(bigrams)
    freed = np.where(np.arange(CLASSES) > 0, DISCOUNT * words / np.maximum(mass, 1), 0.0)
    return Model(core, tokens, distinct, mass, words, step, np.log10(np.maximum((10**step) @ freed, 1e-300)))


def _unit_bigrams(blocks: DataFrame, core: list[bytes]) -> np.ndarray:
    """Bigram counts of the core words; the last unit stands for all others."""
    units = len(core) + 1
    sent = blocks.sparkSession.sparkContext.broadcast(core)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(sent.value, pa.binary())
        held = np.zeros(units * units, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                ids = _units(batch.column("words")[row].values, names)[_learnt(*_arrays(batch, row))]
                for i in range(0, len(ids) - 1, 1 << 22):
                    part = ids[i : i + (1 << 22) + 1]
                    held += np.bincount(part[:-1] * units + part[1:], minlength=units * units)
        at = np.flatnonzero(held)
        for i in range(0, len(at), 200_000):
            part = at[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[part])], names=["pair", "n"])

    found = blocks.select("words", "places", "lengths", "trains").mapInArrow(bigrams, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most units * units rows
    pairs = np.zeros(units * units)
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    return pairs.reshape(units, units)


def neighbour_gains(between: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each neighbour (class on the left, then class on the right) adds to the log likelihood of a word in each class, and what each occurrence takes from it."""
    into = between[:, 1:CLASSES] + 0.5
    into = np.log(into / into.sum(axis=1, keepdims=True))  # (class before, class)
    out = between[1:CLASSES] + 0.5
    out = np.log(out / out.sum(axis=1, keepdims=True)).T  # (class behind, class)
    return np.vstack([into, out]), np.log(mass[1:CLASSES] + 1)


def _join_classes(blocks: DataFrame, core: dict[bytes, tuple[int, int]], between: np.ndarray, mass: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """The training words beyond the core with their counts, classes and places in blocks (word, c, k, at), written, and counts of (neighbour's class, class)."""
    sent = blocks.sparkSession.sparkContext.broadcast((list(core), np.array([k for k, _ in core.values()] + [CLASSES], dtype=np.int32)))
    gains, cost = neighbour_gains(between, mass)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each word beyond the core and block: its place there, and 4 bytes for each neighbour's class, how often it is met above its code."""
        names, classes = pa.array(sent.value[0], pa.binary()), sent.value[1]
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column("words")[row].values
                unit = _units(words, names)
                beyond = unit == len(names)
                wide = np.int32 if len(unit) * 2 * SIDE < 1 << 31 else np.int64
                ids = _learnt(*_arrays(batch, row))
                side = classes[unit][ids]
                every = np.flatnonzero(beyond[ids])
                block = batch.column("block")[row].as_py() << 32
                for i in range(0, max(1, len(every)), CONTEXTS):
                    at = every[i : i + CONTEXTS]
                    key = ids[at].astype(wide) * (2 * SIDE)
                    keys, times = np.unique(np.concatenate([key + side[at - 1], key + SIDE + side[at + 1]]), return_counts=True)
                    size = np.bincount(keys // (2 * SIDE), minlength=len(unit))
                    which = np.flatnonzero(size if i else beyond)  # words without a neighbour in training texts as well, once
                    ends = np.append(0, np.cumsum(size[which])).astype(np.int32) * 4
                    packed = (times << 8 | keys % (2 * SIDE)).astype(np.uint32)
                    seen = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
                    rows = pa.RecordBatch.from_arrays([words.take(pa.array(which)), pa.array(block + which), seen], names=["word", "at", "seen"])
                    for j in range(0, len(which), 20_000):
                        yield rows.slice(j, 20_000)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a word stand together; those of the last word of a batch wait for the next one."""
        table = np.zeros((2 * SIDE, CLASSES), dtype=np.int64)

        def judged(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            lists = rows.column("seen").to_pylist()
            row = np.repeat(np.arange(len(starts)), np.diff(starts, append=rows.num_rows))
            values = np.frombuffer(b"".join(lists), dtype=np.uint32).astype(np.int64)
            cell = np.repeat(row, np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)) // 4) * (2 * SIDE) + (values & 255)
            seen = np.bincount(cell, weights=values >> 8, minlength=len(starts) * 2 * SIDE).reshape(len(starts), -1)
            c = seen[:, :SIDE].sum(axis=1)
            k = 1 + (seen @ gains - c[:, None] * cost).argmax(axis=1)
            order = np.argsort(k, kind="stable")
            first = np.flatnonzero(np.diff(k[order], prepend=-1))
            table[:, k[order][first]] += np.add.reduceat(seen[order], first, axis=0).T.astype(np.int64)
            at = pa.ListArray.from_arrays(pa.array(np.append(starts, rows.num_rows), pa.int32()), rows.column("at"))
            found = [rows.column("word").take(pa.array(starts)), pa.array(c.astype(np.int64)), pa.array(k, pa.int32()), at, pa.nulls(len(starts), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(found, names=["word", "c", "k", "at", "table"]).filter(pa.array(c > 0))

        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if waiting is None else pa.concat_batches([waiting, batch])
            words = rows.column("word")
            starts = np.append(0, 1 + np.flatnonzero(pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)))
            waiting = rows.slice(starts[-1])
            if len(starts) > 1:
                yield judged(rows.slice(0, starts[-1]), starts[:-1])
        if waiting is not None:
            yield judged(waiting, np.zeros(1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int64())), pa.array([table.ravel().tolist()], pa.list_(pa.int64()))], names=["word", "c", "k", "at", "table"])

    rows = blocks.select("block", "words", "places", "lengths", "trains").mapInArrow(contexts, "word binary, at bigint, seen binary")
    made = cut(rows.repartition("word").sortWithinPartitions("word").mapInArrow(assign, "word binary, c bigint, k int, at array<bigint>, table array<bigint>"))
    table = _sum_of_tables(made.where("table IS NOT NULL"), 2 * SIDE * CLASSES)
    rest = made.where("word IS NOT NULL").select("word", "c", "k", "at")
    rest._written = made._written
    return rest, table.reshape(2 * SIDE, CLASSES)


def _sum_of_tables(df: DataFrame, size: int) -> np.ndarray:
    """The tables of all tasks are added up by a few, which read nothing else."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += batch.column("table").flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["table"])

    total = np.zeros(size)
    for found in df.select("table").coalesce(SUMMING_TASKS).mapInArrow(summed, "table array<bigint>").toArrow().column("table").to_pylist():
        total += found
    return total


def score(df: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", counted: bool = False) -> DataFrame:
    """One row per row of df: id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    counted: bigrams of two words beyond the core are counted by their classes like all others, instead of spread by their margins.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]
    blocks = _blocks(df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text")).withColumn("trains", ~held_out("id", folds, held)))
    model, rest = _train(blocks)
    sent = spark.sparkContext.broadcast(model)

    def classed(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's texts as bytes of classes, with all of their scores but the steps between classes, and the class bigrams of its training texts."""
        model = sent.value
        out = {x: [] for x in ("classes", "known", "base", "emit", "table")}
        batch = left.combine_chunks().to_batches()[0] if left.num_rows else left
        for row in range(batch.num_rows):
            words = batch.column("words")[row].values
            c, k = np.zeros(len(words)), np.full(len(words), CLASSES, dtype=np.int64)
            if model:
                where = right.column("number").to_numpy()
                c[where], k[where] = right.column("c").to_numpy(), right.column("k").to_numpy()
                unit = _units(words, pa.array(list(model.core), pa.binary()))
                core = np.flatnonzero(unit < len(model.core))
                k[core], c[core] = np.array(list(model.core.values())).T[:, unit[core]]
            total, distinct = (model.tokens, model.distinct) if model else (0, 0)
            base = np.log10((c + 1) / (total + distinct + 1))
            emit = np.zeros(len(words))
            if model:
                free = (k > 0) & (k < CLASSES)
                emit[free] = np.log10(np.maximum(c[free] - DISCOUNT, 1e-12) / np.maximum(model.class_tokens[k[free]], 1))
            places, lengths, trains = _arrays(batch, row)
            starts = np.cumsum(lengths, dtype=np.int64) - lengths
            small = k.astype(np.int8)
            learnt = small[_learnt(places, lengths, trains)].astype(np.int32) if model else np.zeros(0, np.int32)
            out["classes"].append(small[places].tobytes())
            out["known"].append(np.add.reduceat((c > 0).astype(np.int32)[places], starts, dtype=np.int64).tobytes())
            out["base"].append(np.add.reduceat(base[places], starts).tobytes())
            out["emit"].append(np.add.reduceat(emit[places], starts).tobytes())
            out["table"].append(np.bincount(learnt[:-1] * CLASSES + learnt[1:], minlength=CLASSES * CLASSES).tolist())
        same = {c: left.column(c) for c in ("ids", "lengths", "trains")}
        return pa.table(same | {c: pa.array(v, pa.list_(pa.int64()) if c == "table" else pa.binary()) for c, v in out.items()})

    needed = rest.select("c", "k", F.explode("at").alias("at")).select(F.shiftright("at", 32).alias("block"), F.col("at").bitwiseAND((1 << 32) - 1).alias("number"), "c", "k")
    texts = blocks.select("block", "words", "places", "lengths", "trains", "ids").groupBy("block").cogroup(needed.groupBy("block"))
    done = cut(texts.applyInArrow(classed, f"ids array<{kind}>, lengths binary, trains binary, classes binary, known binary, base binary, emit binary, table array<bigint>"))
    if model is not None:
        discard(rest)
        if counted:
            model = _model(model.core, model.tokens, model.distinct, model.class_tokens, model.class_words, _sum_of_tables(done, CLASSES * CLASSES).reshape(CLASSES, CLASSES))
    discard(blocks)
    tokens = model.tokens if model else 0
    steps = np.column_stack([model.step, model.unknown]) if model else None  # of a class before, and a class or an unknown word

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[row].as_py(), dtype=t)  # noqa: B023, E731
                n, base, s = get("lengths", np.int32).astype(np.int64), get("base", np.float64), get("emit", np.float64)
                if steps is None:
                    s = base
                else:
                    now = get("classes", np.int8).astype(np.int32)
                    s = s + np.add.reduceat(steps.ravel()[np.append(0, now[:-1]) * (CLASSES + 1) + now], np.cumsum(n) - n)
                columns = [batch.column("ids")[row].values, pa.array(~get("trains", bool)), pa.array(n), pa.array(get("known", np.int64)), pa.array(np.full(len(n), tokens)), pa.array(base), pa.array(s), pa.array(10 ** np.minimum(300.0, -s / n))]
                made = pa.RecordBatch.from_arrays(columns, names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
                for i in range(0, len(n), 10_000):
                    yield made.slice(i, 10_000)

    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return done.drop("table").mapInArrow(scores, schema)
