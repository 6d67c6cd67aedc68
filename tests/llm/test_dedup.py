import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from orrery.llm import graph, line_dedup, minhash


def bag(t, size=5):
    w = (t or "").encode().split()
    return Counter([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def jaccard(a, b):
    common = sum((a & b).values())
    return Fraction(common, max(1, sum(a.values()) + sum(b.values()) - common))


def find_root(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


def brute_classes(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}
    bags = [(i, bag(t)) for i, t in rows if i is not None]
    seen = defaultdict(list)
    for n, (_, b) in enumerate(bags):
        for s in b:
            seen[s].append(n)
    pairs = {(x, y) for group in seen.values() if len(group) < 400 for k, x in enumerate(group) for y in group[k + 1 :]}
    for x, y in pairs:
        (i, a), (j, b) = bags[x], bags[y]
        if jaccard(a, b) >= Fraction(4, 5):
            p, q = sorted((find_root(parent, i), find_root(parent, j)))
            parent[q] = p
    return {i: find_root(parent, i) for i in ids}


def test_classes_match_brute_force(spark, edges):
    for df in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), edges):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = minhash.classes(df).collect()
        assert len(got) == len(rows)
        want = brute_classes(rows)
        for r in got:
            assert r["class_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [0, minhash.HOT])
def test_large_groups_and_chains(docs_of, monkeypatch, hot):
    monkeypatch.setattr(minhash, "HOT", hot)  # from 0 on every group is worked in tiles
    rng = random.Random(4)
    base = [f"word{i}" for i in range(200)]
    texts = variants(rng, base, 40, 1) + variants(rng, base, 25, 4) + variants(rng, base, 30, 7) + ["same copy of one text that is repeated"] * 60
    w = [f"chain{i}" for i in range(120)]
    for step in range(12):  # each is near the one before, the ends are far apart
        texts.append(" ".join(w[step * 4 : step * 4 + 70]))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs_of(rows)).collect()}
    assert got == brute_classes(rows)


def test_common_counts():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    got = minhash.common_counts([minhash._occurrences(t) for t in texts[:12]], [minhash._occurrences(t) for t in texts[12:]])
    assert all(got[i, j] == sum((bag(texts[i]) & bag(texts[12 + j])).values()) for i in range(12) for j in range(18))


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    error = []
    for _ in range(30):
        e = rng.integers(0, 2**63, size=60).astype(np.uint64)
        x, y = rng.integers(1, 9, size=60), rng.integers(1, 9, size=60)
        s = minhash.signatures([(e, x), (e, y)])
        error.append((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06


def test_keep_first(edges, empty):
    kept = minhash.keep_first(edges)
    assert kept.columns == edges.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 7), (True, 0)]
    assert minhash.keep_first(empty).count() == 0 and minhash.classes(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    lines = sorted({(i, n, frozenset(line.split())) for i, t in rows if i is not None for n, line in enumerate((t or "").split("\n")) if line.encode().split()}, key=lambda x: x[:2])
    gone = defaultdict(set)
    for k, (i, n, s) in enumerate(lines):
        if any(9 * len(s & o) >= 4 * (len(s) + len(o)) and (j, m) < (i, n) for j, m, o in lines[:k]):
            gone[i].add(n)
    return gone


def line_rows():
    rng = random.Random(6)
    common = [f"w{i}" for i in range(30)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choices(common, k=rng.randrange(1, 25))
            lines.append(rng.choice([" ", "  ", "\t"]).join(w) + rng.choice(["", " ", "\r"]))
        rows.append((d, "\n".join(lines)))
    base = [f"long{i}" for i in range(40)]
    for k in range(40):
        w = list(base)
        for _ in range(k % 6):
            w[rng.randrange(40)] = f"new{rng.randrange(1000)}"
        rows.append((1000 + k, "head\n" + " ".join(w) + f"\nown line number {k} of this document alone"))
    return rows


@pytest.mark.parametrize("frequent", [1, line_dedup.FREQUENT])
def test_removed_lines_match_brute_force(docs_of, monkeypatch, frequent):
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)  # from 1 on every word counts as frequent
    rows = line_rows()
    want = brute_lines(rows)
    got = {r["doc_id"]: r for r in line_dedup.report(docs_of(rows)).collect()}
    for i, t in rows:
        assert got[i]["removed"] == ",".join(map(str, sorted(want[i]))), i
        assert got[i]["n_lines"] == sum(bool(x.encode().split()) for x in t.split("\n"))
        assert got[i]["n_removed"] == len(want[i])


@pytest.mark.parametrize("tallied", [1, 4, 1 << 40])
def test_removed_lines_do_not_hang_on_the_order_of_words(docs_of, monkeypatch, tallied):
    monkeypatch.setattr(line_dedup, "TALLIED", tallied)  # all lines, some, and none
    rows = line_rows()
    want = brute_lines(rows)
    lines = line_dedup.lines_of(docs_of(rows), "doc_id", "text")
    classes = set(line_dedup.rarity(lines))
    assert (len(classes) > 1) == (tallied < 1 << 40)
    got = {r["doc_id"]: r["removed"] for r in line_dedup.report(docs_of(rows)).collect()}
    assert got == {i: ",".join(map(str, sorted(want[i]))) for i, _ in rows}


def test_rarity_counts_some_lines_and_is_read_by_bucket(docs_of):
    rows = docs_of([(i, f"often rare{i}") for i in range(400)])
    lines = line_dedup.lines_of(rows, "doc_id", "text")
    counted = lines.where(line_dedup.F.pmod(line_dedup.F.xxhash64("line"), line_dedup.F.lit(line_dedup.TALLIED)) == 0).count()
    table = line_dedup.rarity(lines)
    often = lines.select(line_dedup.F.xxhash64(line_dedup.F.lit("often")).bitwiseAND(line_dedup.BUCKETS - 1).alias("b")).first()["b"]
    assert 0 < counted < 400 and len(table) == line_dedup.BUCKETS
    assert line_dedup.BY_CHECKSUM.index(table[often - 1]) == 1 + int(5.6 * np.log2(counted))
    keys = line_dedup.keyed_lines(lines, table).collect()
    assert {r["n"] for r in keys} == {2} and len({tuple(r["prefix"]) for r in keys}) == 400  # the rarer word of the two is each line's prefix


def brute_line_classes(rows):
    lines = sorted({(i, n, line) for i, t in rows if i is not None for n, line in enumerate((t or "").split("\n")) if line.encode().split()})
    first = {}
    for i, n, line in lines:
        first.setdefault(line, (i, n, line))
    nodes = sorted(first.values())
    sets, parent, links = {x: frozenset(x[2].split()) for x in nodes}, {x: x for x in nodes}, Counter()
    for k, x in enumerate(nodes):
        for y in nodes[:k]:
            if 9 * len(sets[x] & sets[y]) >= 4 * (len(sets[x]) + len(sets[y])):
                links[x] += 1
                links[y] += 1
                p, q = sorted((find_root(parent, x), find_root(parent, y)))
                parent[q] = p
    return sorted((i, n, *find_root(parent, first[line])[:2], links[first[line]]) for i, n, line in lines)


def test_line_classes_match_brute_force(docs_of, edges, empty):
    words = [f"v{i}" for i in range(20)]
    two = [" ".join([*words[:16], "a", "b"]), " ".join([*words[:16], "c", "d"]), " ".join(words[:16])]  # the last is similar to both
    rows = [*line_rows(), (5000, "\n".join(two)), (5001, two[2]), (None, two[2]), (5002, None)]
    got = [tuple(r) for r in line_dedup.classes(docs_of(rows)).collect()]
    assert sorted(got) == brute_line_classes(rows)
    assert {r[4] for r in got if r[0] == 5001} == {2}
    assert line_dedup.classes(edges).where("doc_id = 6").count() == 2 and line_dedup.classes(empty).count() == 0


def test_matches_name_an_earlier_similar_line(docs_of):
    rows = line_rows()
    texts = {i: t.split("\n") for i, t in rows}
    for r in line_dedup.matches(docs_of(rows)).collect():
        a, b = set(texts[r["doc"]][r["no"]].split()), set(texts[r["to_doc"]][r["to_no"]].split())
        assert 9 * len(a & b) >= 4 * (len(a) + len(b)) and (r["to_doc"], r["to_no"]) < (r["doc"], r["no"])


def test_dedup_keeps_columns_and_clean_texts(docs_of, edges, empty):
    df = docs_of([(1, "one line of its own\nshared line of two documents"), (2, "shared line of two documents\nanother line stays here"), (3, "shared line of two documents"), (4, "clean \n\n text "), (5, None)])
    out = line_dedup.dedup(df)
    assert out.schema == df.schema
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[2]["text"] == "another line stays here" and rows[2]["n_chars"] == 23
    assert 3 not in rows and rows[4]["text"] == "clean \n\n text " and rows[5]["text"] is None
    kept = line_dedup.dedup(edges).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 3, 4, 5, 7]
    assert line_dedup.dedup(empty).count() == 0 and line_dedup.report(empty).count() == 0


def test_clashing_columns(spark):
    names = ("_no", "_id", "_kept", "doc", "no", "kept", "key", "n_lines", "rid", "text_", "class_id", "id", "label", "rep", "h", "a", "b")
    rows = [(i, t, f"x{i}") for i, t in enumerate(["a line that stands twice\nown line", "a line that stands twice", "something else here"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string").select("doc_id", "text", *(line_dedup.F.col("extra").alias(n) for n in names))
    out = {r["doc_id"]: r for r in line_dedup.dedup(df).collect()}
    assert set(out) == {0, 2} and all(out[i][n] == f"x{i}" for i in out for n in names)
    assert {r["doc_id"]: (r["n_lines"], r["removed"]) for r in line_dedup.report(df).collect()} == {0: (2, ""), 1: (1, "0"), 2: (1, "")}
    kept = {r["doc_id"]: r for r in minhash.keep_first(df).collect()}
    assert set(kept) == {0, 1, 2} and all(kept[i][n] == f"x{i}" for i in kept for n in names)
    assert line_dedup.classes(df).count() == 4 and minhash.classes(df).count() == 3


def test_sketch_bounds_the_difference(docs_of):
    rows = docs_of([(0, " ".join(f"s{i}" for i in range(300))), (1, " ".join(f"s{i}" for i in range(40, 330)))])
    lines = line_dedup.lines_of(rows, "doc_id", "text")
    a, b = line_dedup.keyed_lines(lines, line_dedup.rarity(lines)).orderBy("doc").collect()
    differ = sum(bin((a[c] ^ b[c]) & (1 << 64) - 1).count("1") for c in ("par", "odd"))
    assert 0 < differ <= 70


@pytest.mark.parametrize("n", range(1, 60))
def test_prefix_lengths(n):
    """The stored prefix is long enough for every partner's size."""
    prefix = n - (4 * n + 4) // 5 + 1
    for m in range(1, n + 1):
        needed = (4 * (n + m) + 8) // 9
        if needed <= m:  # else no pair of these sizes is similar
            assert prefix >= n - needed + 1
