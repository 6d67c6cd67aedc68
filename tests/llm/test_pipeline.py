import corpus_pipeline
from orrery.llm import minhash, secret_scan, toxicity
from orrery.llm.common import read_table
from test_dedup import brute_classes, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = read_table(spark, SF, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "secret_scan", "packing"]
    clean = corpus_pipeline.toxic(spark, docs, SF)
    model = toxicity.fit(docs, read_table(spark, SF, "labels"))
    said = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i in before if not said[i])
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    gone = brute_lines(rows)
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in rows}
    lines = corpus_pipeline.lines(spark, clean, SF)
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert got == {i: t for i, t in want.items() if t.strip() or not gone[i]}
    once = corpus_pipeline.near_copies(spark, lines, SF)
    classes = brute_classes(list(got.items()))
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(i for i, c in classes.items() if i == c)
    safe = corpus_pipeline.secrets(spark, once, SF)
    for df in (clean, lines, once, safe):
        assert df.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert texts == {r["doc_id"]: secret_scan.redact(r["text"], secret_scan.find(r["text"])[1]) for r in once.collect()}
    assert not any(secret_scan.scan(t) for t in texts.values())


def test_run_packs_every_kept_document(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    fill = {}
    for r in out:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 1024 and len({(r["doc_id"], r["piece"]) for r in out}) == len(out)
    assert corpus_pipeline.ORACLE_SQL is None and minhash.WORDS == 5


def test_entry_registers_everything():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] == ["op1_bpe", "op2_packing", "op3_pii", "op4_minhash", "op5_line_dedup", "op6_topk", "op7_lm", "op8_toxicity", "op9_quality", "op10_secrets"]
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def test_line_classes_is_a_query_beside_the_ten():
    import __spark_entry__

    assert "line_classes" in __spark_entry__.queries() and "line_classes" not in __spark_entry__.oracle_sql()
