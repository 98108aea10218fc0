"""How much a compression kept: recall of facts and entities, answers, ratios, aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.similarity import overlap_share, synonym_group
from palimpsest.functions.text import word_set


def _containing(left: DataFrame, right: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows (keys, text) of left that some row of right has the keys of and a text that contains theirs or is contained in it.

    The longer text is taken to pieces of the lengths that the others have, and pieces meet by equality: no group is crossed with itself.
    """
    def inside(longer: DataFrame, shorter: DataFrame) -> DataFrame:
        lengths = shorter.groupBy(*keys).agg(F.collect_set(F.length(text)).alias("__ns"))
        pieces = longer.join(lengths, keys).select(*keys, F.col(text).alias("__long"), F.explode("__ns").alias("__n")).filter(F.col("__n") <= F.length("__long"))
        return pieces.select(*keys, "__long", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length("__long") - F.col("__n") + 1), lambda k: F.substring("__long", k, F.col("__n"))))).alias(text))

    contained = left.join(inside(right, left), [*keys, text], "left_semi")
    containing = inside(left, right).join(right, [*keys, text], "left_semi").select(*keys, F.col("__long").alias(text))
    return contained.unionByName(containing).distinct()


def fact_recall(original: DataFrame, kept: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(conv_id, recall, missed): the share of original facts that some kept one is similar to; 1 where there are none.

    At 0.8 or more two of the three parts are equal, and the third is equal, contained or a synonym: different triples
    meet by equality, whatever a predicate and object have in common, so no conversation is crossed with itself.
    """
    if threshold < 0.8:
        raise ValueError("pairs are found for thresholds from 0.8")
    parts = ["conv_id", "s", "p", "o"]
    lowered = lambda df, *also: df.select(*also, "conv_id", F.lower("subject").alias("s"), F.lower("predicate").alias("p"), F.lower("object").alias("o"))
    a, b = lowered(original).distinct(), lowered(kept).distinct()
    hits = a.join(b, parts, "left_semi")
    if 0.2 + 0.3 + 0.3 >= threshold:
        hits = hits.unionByName(_containing(a, b, ["conv_id", "p", "o"], "s").select(*parts))
    if 0.4 + 0.15 + 0.3 >= threshold:
        group = synonym_group(F.col("p"))
        hits = hits.unionByName(a.withColumn("g", group).join(b.withColumn("g", group), ["conv_id", "s", "o", "g"], "left_semi").select(*parts))
    if 0.4 + 0.3 + 0.15 >= threshold:
        hits = hits.unionByName(_containing(a, b, ["conv_id", "s", "p"], "o").select(*parts))
    hit = lowered(original, "fact_id").join(hits.distinct(), parts, "left_semi").select("conv_id", "fact_id").distinct()
    flagged = original.select("conv_id", "fact_id").join(hit.withColumn("hit", F.lit(1)), ["conv_id", "fact_id"], "left")
    return flagged.groupBy("conv_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("missed"))


def entity_recall(original: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, recall) over different lower-cased names."""
    a = original.select("conv_id", F.lower("name").alias("n")).distinct()
    b = kept.select("conv_id", F.lower("name").alias("n")).distinct().withColumn("hit", F.lit(1))
    return a.join(b, ["conv_id", "n"], "left").groupBy("conv_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def key_entity_recall(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(conv_id, recall) of asked names among names and aliases."""
    known = entities.select("conv_id", F.explode(F.array_union(F.array("name"), "aliases")).alias("n")).select("conv_id", F.lower("n").alias("n")).distinct().withColumn("hit", F.lit(1))
    return asked.select("conv_id", F.lower("name").alias("n")).join(known, ["conv_id", "n"], "left").groupBy("conv_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def answered(answer: Column, context: Column, share: float = 0.5) -> Column:
    """Whether the context has that share of the answer's words."""
    x = word_set(answer)
    return F.size(F.array_intersect(x, word_set(context))) / F.greatest(F.size(x), F.lit(1)) >= share


def fuzzy_match(a: Column, b: Column, share: float = 0.6) -> Column:
    return overlap_share(a, b) >= share


def contains_either(a: Column, b: Column) -> Column:
    return F.lower(a).contains(F.lower(b)) | F.lower(b).contains(F.lower(a))


def kept_ratio(compressed: Column, original: Column) -> Column:
    """Compressed over original, 1 for nothing."""
    return F.when(original > 0, compressed / original).otherwise(1.0)


def times_smaller(original: Column, compressed: Column) -> Column:
    """Original over compressed, infinite for nothing."""
    return F.when(compressed == 0, F.lit(float("inf"))).otherwise(original / compressed)


def aggregate(samples: DataFrame, *by: str) -> DataFrame:
    """Means, and the spread of the ratio; means of recalls leave zeros out."""
    positive = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)).alias(f"mean_{c}")
    return samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("mean_ratio"), F.stddev_pop("ratio").alias("std_ratio"), positive("fact_recall"), positive("entity_recall"),
                                    F.floor(F.avg("tokens_saved")).cast("long").alias("mean_tokens_saved"))


# Questions, and expressions of their answers.
QA_PATTERNS = (
    ("What is the user's name?", r"(?i)my name is ([\p{L}\p{N}_]+)"),
    ("Where does the user work?", r"(?i)I work (?:at|for) ([^.]+)"),
    ("What does the user like?", r"(?i)I (?:like|love|enjoy) ([^.]+)"),
)


def qa_pairs(turns: DataFrame, personas: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, question, answer): the first answer that each turn gives to each question.

    personas (conv_id, traits) add a question for each of the first three traits, with a null turn.
    """
    found = F.array(*[F.struct(F.lit(q).alias("question"), F.trim(F.regexp_extract("content", e, 1)).alias("answer")) for q, e in QA_PATTERNS])
    out = turns.select("conv_id", F.col("turn").cast("int").alias("turn"), F.explode(F.filter(found, lambda x: x["answer"] != "")).alias("x")).select("conv_id", "turn", "x.*")
    if personas is not None:
        asked = personas.select("conv_id", F.lit(None).cast("int").alias("turn"), F.explode(F.slice("traits", 1, 3)).alias("t"))
        out = out.unionByName(asked.select("conv_id", "turn", F.concat(F.lit("Is it true that: "), "t", F.lit("?")).alias("question"), F.lit("yes").alias("answer")))
    return out


def rouge_l(pairs: DataFrame, a: str = "reference", b: str = "candidate") -> DataFrame:
    """pairs with rouge_l: the F-measure of the longest common subsequence of words."""
    def one(x: list[str], y: list[str]) -> float:
        row = [0] * (len(y) + 1)
        for w in x:
            last = 0
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
        n = row[-1]
        return 2 * n / (len(x) + len(y)) if n else 0.0

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one((p or "").lower().split(), (q or "").lower().split()) for p, q in zip(x, y)])

    return pairs.withColumn("rouge_l", score(a, b))


def histogram(values: DataFrame, column: str, *by: str) -> DataFrame:
    """count, sum, avg, min, max and percentiles by rank; exact, from distributed ranks rather than gathered values."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    keys = list(by)
    n = values.groupBy(*keys).agg(F.count(column).alias("count"), F.sum(column).alias("sum"), F.avg(column).alias("avg"), F.min(column).alias("min"), F.max(column).alias("max"))
    per = values.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(w.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)))
    joined = per.join(n, keys) if keys else per.crossJoin(n)
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("count") * F.lit(p)), F.col(column))).alias(f"p{int(p * 100)}")
    return joined.groupBy(*keys, "count", "sum", "avg", "min", "max").agg(at(0.5), at(0.95), at(0.99))


def health(checks: DataFrame) -> DataFrame:
    """One row (status): healthy if all are; else unhealthy, degraded or unknown."""
    s = F.col("status")
    return checks.agg(F.when(F.coalesce(F.every(s == "healthy"), F.lit(True)), "healthy").when(F.some(s == "unhealthy"), "unhealthy").when(F.some(s == "degraded"), "degraded").otherwise("unknown").alias("status"))
