"""Personal data by fixed patterns and bootstrapped contextual extraction, in DataFrame operations alone.

Base findings come from four regular expressions and checks on what they match. Their surroundings then teach
patterns: a candidate is a run of tokens with digits or an @, a pattern is the word before or behind it.
Candidates that hold a base finding are the seeds, with a score of 1. In each round a pattern's confidence is
the score of its candidates over all occurrences of its word in the corpus, and another candidate's score
is that at least one of its patterns is right. A pattern counts once LEAST_SEEDS different candidates support it,
which are seeds or candidates accepted in the rounds before. Candidates that end with a score of ACCEPT or more become
findings of kind `context`; base findings stay as they are.

Defined results: a null text counts as empty, and an empty text has no findings; texts are taken whole;
rows count each for itself even if ids repeat or are null; ties do not matter; an empty table gives no rows;
other columns are ignored. A card or address in several overlapping kinds is reported for each kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# The patterns, written so that a match begins where the plain form begins it, without backtracking.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SIGNS = {"email": "@", "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_WORD, _MARKED = r"[^\s0-9@]++", r"[^\s0-9@]*+[0-9@]\S*+"
CONTEXT = rf"(?<!\S)(?:({_WORD})\s++)?+({_MARKED}(?:\x20{_MARKED})*+)(?:(?=\s++({_WORD})(?!\S)))?"
ROUNDS, LEAST_SEEDS, ACCEPT, LEAST_DIGITS = 3, 3, 0.8, 4
#: Patterns up to which their table is broadcast (about 32 MB); larger ones are joined by shuffling.
BROADCAST_ROWS = 500_000


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check. The last digit counts once, the one before doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 % 10 + F.floor(x.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    """Whether a match of a kind stands."""
    digits = _digits(m)
    n = F.length(digits)
    ip = F.regexp_like(m, F.lit(rf"\A{BYTE}(?:\.{BYTE}){{3}}\z"))
    card = F.when((n >= 16) & (n <= 19), _luhn(digits)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", (n >= 8) & (n <= 15)).otherwise(False)


def _holds_base(m: Column) -> Column:
    """Whether a text holds a finding of any kind."""
    out = F.lit(False)
    for kind in KINDS:
        out = out | F.exists(F.regexp_extract_all(m, F.lit(PATTERNS[kind]), 0), _checker(kind))
    return out


def _checker(kind: str):
    return lambda x: _valid(F.lit(kind), x)


def _match(kind: str):
    """Makes the struct of a match of a kind from the whole match and its number."""
    context = kind == "context"
    part = lambda column, i: F.get(F.col(column), i) if context else F.lit(None).cast("string")
    return lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), (F.get(F.col(f"g_{kind}"), i) + F.length(x)).alias("step"),
        F.get(F.col("c2" if context else kind), i).alias("m"), part("c1", i).alias("before"), part("c3", i).alias("behind"),
    )


def _found(docs: DataFrame) -> DataFrame:
    """rid, id and found: each match with its kind, number, distance from the one before, and for candidates the words around it. Written."""
    spec = {k: (PATTERNS[k], 0) for k in KINDS} | {"context": (CONTEXT, 2)}
    none = F.array().cast("array<string>")
    step = docs.select(F.monotonically_increasing_id().alias("rid"), "id", "text")
    marked = F.regexp_like("text", F.lit("[0-9@]"))
    step = step.withColumn("marked", marked)
    for kind, (pattern, _) in spec.items():
        sign = F.contains("text", F.lit(SIGNS[kind])) if kind in SIGNS else F.col("marked")
        step = step.withColumn(kind, F.when(sign, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(none))
    some = lambda kind, value: F.when(F.size(kind) > 0, value).otherwise(none)
    step = step.withColumn("c2", some("context", F.regexp_extract_all("text", F.lit(CONTEXT), 2))).withColumn("c1", some("context", F.regexp_extract_all("text", F.lit(CONTEXT), 1))).withColumn("c3", some("context", F.regexp_extract_all("text", F.lit(CONTEXT), 3)))
    lists = []
    for kind, (pattern, _) in spec.items():
        gaps = F.when(F.size(kind) > 0, F.transform(F.split("text", pattern), lambda x: F.length(x))).otherwise(F.array().cast("array<int>"))
        step = step.withColumn(f"g_{kind}", gaps)
        lists.append(F.transform(F.col(kind), _match(kind)))
    return cut(step.select("rid", "id", F.concat(*lists).alias("found")))


def _lexical(word: Column) -> Column:
    """A word of the context without case and the signs around it."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}]+|[^\p{L}]+$", "")


def _stands(m: Column) -> Column:
    """Whether an accepted candidate can be a finding."""
    return F.contains(m, F.lit("@")) | (F.length(_digits(m)) >= LEAST_DIGITS)


def _accepted(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts (m) of candidates that the graph of patterns and candidates accepts, beside the seeds."""
    sides = F.array(F.struct(F.lit("before").alias("side"), _lexical(F.col("before")).alias("word")), F.struct(F.lit("behind").alias("side"), _lexical(F.col("behind")).alias("word")))
    edges = candidates.select("m", "seed", F.explode(sides).alias("p")).select("m", "seed", "p.side", "p.word").where("word <> ''")
    edges = cut(edges.groupBy("m", "side", "word").agg(F.max("seed").alias("seed"), F.count("*").alias("times")))
    # Support is told anew in each round; patterns of fewer candidates, whether seeds or not, cannot have it in any.
    possible = cut(edges.groupBy("side", "word").count().where(F.col("count") >= LEAST_SEEDS).select("side", "word"))
    words = possible.select("word").distinct()
    words = F.broadcast(words) if words.count() <= BROADCAST_ROWS else words
    tokens = docs.select(F.explode(F.split("text", r"\s+")).alias("w")).where(F.regexp_like("w", F.lit(r"\A[^0-9@]+\z")))
    totals = tokens.groupBy("w").agg(F.count("*").alias("c")).select(_lexical(F.col("w")).alias("word"), "c").join(words, "word").groupBy("word").agg(F.sum("c").alias("total"))
    edges = cut(edges.join(possible, ["side", "word"]).join(totals, "word"))
    score = edges.select("m", F.col("seed").cast("double").alias("s")).groupBy("m").agg(F.max("s").alias("s"))
    for _ in range(ROUNDS):
        supports = F.col("seed") | (F.col("s") >= ACCEPT) & _stands(F.col("m"))
        pattern = edges.join(score, "m").groupBy("side", "word").agg((F.sum(F.col("s") * F.col("times")) / F.max("total")).alias("sure"), F.count_if(supports).alias("support"))
        pattern = pattern.where(F.col("support") >= LEAST_SEEDS).drop("support")
        again = edges.join(pattern, ["side", "word"], "left").withColumn("sure", F.coalesce("sure", F.lit(0.0))).groupBy("m").agg(F.max(F.col("seed").cast("double")).alias("seed"), (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.least(F.lit(1.0), F.col("sure"))))))).alias("s"))
        score = cut(again.select("m", F.greatest("seed", "s").alias("s")))
    return score.where(F.col("s") >= ACCEPT).join(edges.where(~F.col("seed")).select("m").distinct(), "m", "left_semi").select("m")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (rid, id, spans) for each row of df; spans is an array of (kind, start, end), base kinds first, by start."""
    docs = df.select(df[id_col].alias("id"), text_or_empty(text_col).alias("text"))
    table = _found(docs)
    each = table.where(F.size("found") > 0).select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    until = F.sum("step").over(Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    each = cut(each.withColumn("stop", until).select("rid", "kind", "m", "before", "behind", (F.col("stop") - F.length("m")).alias("start"), F.col("stop").alias("end")))
    base = each.where(F.col("kind") != "context").where(_valid(F.col("kind"), F.col("m"))).select("rid", "kind", "start", "end")
    candidates = cut(each.where(F.col("kind") == "context").withColumn("seed", _holds_base(F.col("m"))))
    new = _accepted(candidates, docs)
    new = new.where(_stands(F.col("m")))
    extra = candidates.where(~F.col("seed")).join(new, "m", "left_semi").select("rid", "kind", "start", "end")
    order = F.array_position(F.array(*map(F.lit, (*KINDS, "context"))), F.col("kind"))
    spans = base.union(extra).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "start", "end", "kind"))).alias("spans"))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    spans = spans.select("rid", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    return table.select("rid", "id").join(spans, "rid", "left").select("rid", "id", F.coalesce("spans", none).alias("spans"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, counts of the base kinds, base_sha256 and spans."""
    found = find(df, id_col, text_col)
    spell = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "context")
    return found.select(F.col("id").alias(id_col), *map(count, KINDS), F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"))
