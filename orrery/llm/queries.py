"""The registered queries of the text operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_dedup, lm, minhash, packing, pii, quality, secret_scan, topk, toxicity
from .common import read_table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(read_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read_table(spark, sf_dir, "documents"))


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.classes(read_table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH l AS (
  SELECT doc_id, i - 1 AS no, list_distinct(regexp_extract_all(lines[i], '[^ \t\n\x0B\f\r]+')) AS s
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i)
), f AS (SELECT doc_id, no, s, len(s) AS n FROM l WHERE len(s) > 0),
d AS (SELECT min((doc_id, no)) AS pl, list_sort(s) AS k, n FROM f GROUP BY list_sort(s), n),
o AS (SELECT doc_id, no, list_sort(s) AS k FROM f),
t AS (SELECT pl, n, unnest(k) AS w FROM d),
p AS (
  SELECT b.pl AS pl FROM t a JOIN t b ON a.w = b.w AND a.pl < b.pl
  GROUP BY b.pl, a.pl, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)
), gone AS (
  SELECT o.doc_id, o.no FROM o JOIN d USING (k)
  WHERE (o.doc_id, o.no) <> d.pl OR d.pl IN (SELECT pl FROM p)
), g AS (SELECT doc_id, count(*) AS c, string_agg(no, ',' ORDER BY no) AS r FROM gone GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS c FROM f GROUP BY doc_id)
SELECT x.doc_id, coalesce(n.c, 0) AS n_lines, coalesce(g.c, 0) AS n_removed, coalesce(g.c, 0) AS n_links, coalesce(g.r, '') AS removed
FROM documents x LEFT JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


OP6_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row_no AS row_no, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.row_no <> c.row_no
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_table(spark, sf_dir, "documents"), folds=7, held=2, counted=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), folds=5, held=0)
    return toxicity.score(docs, model, folds=5, held=0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(read_table(spark, sf_dir, "documents")).drop("redacted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_packing": op2_packing, "op3_pii": op3_pii, "op4_minhash": op4_minhash, "op5_line_dedup": op5_line_dedup, "op6_topk": op6_topk, "op7_lm": op7_lm, "op8_toxicity": op8_toxicity, "op9_quality": op9_quality, "op10_secrets": op10_secrets, "line_classes": line_classes}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op6_topk": OP6_SQL}
