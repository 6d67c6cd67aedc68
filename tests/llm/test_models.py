import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from orrery.llm import common, lm, queries, topk, toxicity
from pyspark.sql import functions as F

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]


def test_base_scores_match_brute_force(sample, edges):
    for df in (sample, edges):
        docs = [(r["doc_id"], r["text"]) for r in df.collect()]
        fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
        counts = Counter(x for i, t in docs if not fold(i) for x in tokens(t))
        n, v = sum(counts.values()), len(counts)
        rows = lm.score(df).collect()
        want = sorted((i is None, i or 0, len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 4)) for i, t in docs)
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in rows) == want
        assert {r["train_tokens"] for r in rows} == {n} and all(r["held_out"] == fold(r["doc_id"]) and math.isfinite(r["score"]) for r in rows)


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_no_training_rows(docs_of, empty):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = lm.score(docs_of([(held, "a b")])).collect()
    assert rows[0]["n_known"] == 0 and rows[0]["train_tokens"] == 0 and rows[0]["score"] == rows[0]["base_score"]
    assert lm.score(empty).count() == 0


def test_exchange_finds_the_blocks():
    rng = np.random.default_rng(0)
    groups = np.array([0, *rng.integers(1, 4, 60)])
    pairs = np.zeros((61, 61))
    for i in range(61):
        for j in range(61):
            pairs[i, j] = 0 if 0 in (i, j) else rng.poisson(12 if groups[j] == groups[i] % 3 + 1 else 0.05)
    found = lm.exchange(pairs, classes=4)
    assert len({(a, b) for a, b in zip(groups, found)}) == 4

    def likelihood(g):
        m = np.eye(4)[g]
        c = m.T @ pairs @ m
        return lm._xlogx(c).sum() - lm._xlogx(c.sum(0)).sum() - lm._xlogx(c.sum(1)).sum()

    assert likelihood(found) >= likelihood(groups) - 1e-6


def test_transitions_sum_to_one():
    counts = np.array([[0, 5, 1, 0], [2, 0, 0.3, 0], [0, 0, 0.0, 0], [0, 0, 0, 0]])
    np.testing.assert_allclose((10 ** lm.transitions(counts)).sum(axis=1), 1)


def test_model_matches_brute_force(docs_of, monkeypatch):
    """Classes of words beyond the core, bigrams of classes and scores, against plain loops; every row of the model sums to one."""
    monkeypatch.setattr(lm, "CORE", 12)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randrange(0, 40))) for _ in range(80)]
    df = docs_of(list(enumerate(texts)))
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    model, rest = lm.train(docs_of(list(enumerate(train))).select("text"))
    known = {w.decode(): kc for w, kc in model.core.items()} | {bytes(r["word"]).decode(): (r["k"], r["c"]) for r in rest.collect()}
    count = Counter(w for t in train for w in [*t.split(), ""])
    assert {w: c for w, (_, c) in known.items()} == count and len(model.core) == 13
    rare = set(known) - {w.decode() for w in model.core}
    k_ = lm.CLASSES
    core_side = lambda w: k_ if w in rare else known[w][0]
    between, mass = np.zeros((k_ + 1, k_ + 1)), np.zeros(k_ + 1)
    for w, (k, c) in known.items():
        if w not in rare:
            mass[k] += c
    lines = [["", *t.split(), ""] for t in train]
    for line in lines:
        for a, b in zip(line, line[1:]):
            between[core_side(a), core_side(b)] += 1
    gains, cost = lm.neighbour_gains(between, mass)
    value = {w: np.zeros(k_ - 1) for w in rare}
    for line in lines:
        for a, w, b in zip(line, line[1:], line[2:]):
            if w in rare:
                value[w] += gains[core_side(a)] + gains[lm.SIDE + core_side(b)] - cost
    for w in rare:
        assert value[w][known[w][0] - 1] == pytest.approx(value[w].max())
    full, behind, before = np.zeros((k_, k_)), np.zeros(k_), np.zeros(k_)
    for line in lines:
        for a, b in zip(line, line[1:]):
            if a in rare and b in rare:
                behind[known[a][0]] += 1
                before[known[b][0]] += 1
            else:
                full[known[a][0], known[b][0]] += 1
    full += np.outer(behind, before) / max(1, before.sum())
    np.testing.assert_allclose(model.step, lm.transitions(full))
    total = Counter()
    for k, c in known.values():
        total[k] += c
    emit = {w: 1.0 if w == "" else (c - lm.DISCOUNT) / total[k] for w, (k, c) in known.items()}
    for h in range(k_ + 1):
        assert sum(10 ** model.step[h, k] * emit[w] for w, (k, _) in known.items()) + 10 ** model.unknown[h] == pytest.approx(1, abs=1e-6)
    for r in lm.score(df).collect():
        at, s = 0, 0.0
        for w in [*texts[r["doc_id"]].split(), ""]:
            k = known[w][0] if w in known else k_
            s += model.unknown[at] if k == k_ else model.step[at, k] + math.log10(emit[w])
            at = k
        assert r["score"] == pytest.approx(s, abs=1e-6)


def test_query_counts_bigrams_of_rare_words(docs_of, monkeypatch, tmp_path):
    """Bigrams of two words beyond the core have their own counts, over blocks of texts, and neighbours of one class more than another's."""
    monkeypatch.setattr(lm, "CORE", 6)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 300, raising=False)
    monkeypatch.setattr(lm, "CONTEXTS", 7, raising=False)
    rng = random.Random(5)
    # After a frequent word come a rare one of its group and one of the next group, which margins cannot say.
    phrase = lambda g: f"w{g} r{g}{rng.randrange(9)} r{(g + 1) % 6}{rng.randrange(9)}"
    texts = [" ".join(phrase(rng.randrange(6)) for _ in range(rng.randrange(7))) for i in range(90)]
    docs_of(list(enumerate([*texts, "", None, "r31 r42 r53 new r31"]))).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    texts += ["", "", "r31 r42 r53 new r31"]
    learnt = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    model, rest = lm.train(docs_of(list(enumerate(learnt))).select("text"))
    known = {w.decode(): k for w, (k, _) in model.core.items()} | {bytes(r["word"]).decode(): r["k"] for r in rest.collect()}
    count = Counter(w for t in learnt for w in [*t.split(), ""])
    full, total = np.zeros((lm.CLASSES, lm.CLASSES)), Counter()
    for t in learnt:
        for a, b in zip(["", *t.split()], [*t.split(), ""]):
            full[known[a], known[b]] += 1
    for w, c in count.items():
        total[known[w]] += c
    step, words = lm.transitions(full), Counter(known.values())
    unknown = np.log10((10**step) @ np.array([lm.DISCOUNT * words[k] / total[k] if k and total[k] else 0 for k in range(lm.CLASSES)]))
    found = queries.op7_lm(docs_of([]).sparkSession, str(tmp_path)).collect()
    assert len(found) == len(texts) and not np.allclose(step, model.step)
    for r in found:
        at, s = 0, 0.0
        for w in [*texts[r["doc_id"]].split(), ""]:
            k = known.get(w, lm.CLASSES)
            s += unknown[at] if k == lm.CLASSES else step[at, k] + (math.log10((count[w] - lm.DISCOUNT) / total[k]) if k else 0)
            at = k
        assert r["score"] == pytest.approx(s, abs=1e-6)
        assert (r["n_tokens"], r["n_known"]) == (len(texts[r["doc_id"]].split()) + 1, sum(count[w] > 0 for w in [*texts[r["doc_id"]].split(), ""]))


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    said = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    right = Counter((r["toxic"], r["predicted"]) for r in said)
    assert right[1, 1] >= 0.9 * (right[1, 1] + right[1, 0])
    assert right[0, 0] >= 0.98 * (right[0, 0] + right[0, 1])
    assert all(0 <= r["score"] <= 1 for r in said)


def test_training_holds_no_copies_of_its_largest_tables():
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((6_000, 60)), np.where(rng.random(6_000) < 0.3, 1.0, -1.0)
    marks = [bytes(rng.integers(1, 27, 6).tolist()) for _ in range(5)]
    for run, most in ((lambda: toxicity._machine(x, y, np.ones(6_000)), 0.9 * x.nbytes), (lambda: toxicity._kernel(marks, marks), 6 * toxicity.LETTERS**4)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most


def test_workers_release_memory_once_a_task_is_through(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "release", lambda: seen.append("released"))
    assert list(common.releasing(lambda batches: (seen.append(b) or b for b in batches))(iter([1, 2]))) == [1, 2]
    assert seen == [1, 2, "released"]


@pytest.fixture(scope="module")
def tiny():
    rng = random.Random(1)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 3))) for _ in range(200)]
    text = lambda extra="": " ".join(rng.choices(words, k=30)) + " " + extra + " " + " ".join(rng.choices(words, k=10))
    bad = ["scoundrel", "blockhead", "numbskull"]
    texts = [text(rng.choice(bad)) for _ in range(60)] + [text() for _ in range(120)]
    return toxicity.train(texts, [1] * 60 + [0] * 120)


def test_gapped_insults_are_found(tiny):
    s = toxicity.Scorer(tiny)
    p = lambda t: float(s.probabilities([t])[0])
    for t in ("you scoundrel", "you sco.undrel", "SC0UNDREL!", "scouxndrel", "b l o c k h e a d", "blo-ck-head", "x" * 200 + "numbskull" + "y" * 200):
        assert p(t) >= 0.5, t
    for t in ("", "there inon heed", "the of and"):
        assert p(t) < 0.5, t


def test_toxicity_edges(spark, edges, empty, tiny):
    rows = toxicity.score(edges, tiny).collect()
    assert len(rows) == edges.count() and all(r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert toxicity.score(empty, tiny).count() == 0
    assert {r["score"] for r in toxicity.score(edges, None).collect()} == {0.0}
    labels = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(edges, labels) is None and toxicity.train([], []) is None
    kept = toxicity.keep_clean(edges, tiny)
    assert kept.columns == edges.columns and kept.count() == edges.count()


def brute_top(rows, is_query, k, scale=1024):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(good):
        if is_query(q):
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(good) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(4), 1)]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0, 0.0]), (3, [9.0, 9.0, 9.0, 9.0])]
    rows += [(20, [9.0, 9.0, 9.0, 9.0]), (20, [9.0, 9.0, 9.0, 9.0]), (30, rows[30][1]), *[(40, [0.5, -0.5, 0.5, 0.0])] * 8]  # ids that repeat, with equal and other vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, 5).collect())
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute_top(floats, lambda i: i % 10 == 0, 5)


def test_top_k_edges(spark):
    df = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 1, 10, scale=1).collect())
    assert got == [(1, 1, 0, 10**17 + 2), (1, 2, 2, 5)]
    assert topk.top_k(df.limit(0), F.lit(True), 3).count() == 0
    with pytest.raises(ValueError):
        topk.top_k(df, F.lit(True), 0)
    bad = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="lengths"):
        topk.top_k(bad, F.lit(True), 1).collect()
