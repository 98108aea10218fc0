"""Similar facts: pairs, components, merges; contradictions, superseded facts."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.fixed import FUNCTIONAL_PREDICATES
from palimpsest.functions import similarity as sim
from palimpsest.functions.text import word_set
from palimpsest.ir import conform



def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (base or "file:///tmp/checkpoints").rstrip("/")


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if not spark.sparkContext._jsc.sc().isStopped():
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may have gone first
            return


def materialised(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share and read again: what an iteration hands to the next."""
    path = f"{shared_folder(df.sparkSession)}/palimpsest-step-{uuid.uuid4().hex[:12]}"
    _made.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def similar_pairs(facts: DataFrame, threshold: float = 0.85, key: str = "fact_id") -> DataFrame:
    """(conv_id, a, b, similarity) of facts of one conversation, the earlier one first.

    Pairs meet on a shared word, so those with nothing in common are never formed. For thresholds over 0.3: the two
    bonuses cannot carry a pair without a common word that far.
    """
    if threshold <= 0.3:
        raise ValueError("the threshold must be over 0.3")
    base = facts.select("conv_id", "ord", key, "subject", "predicate", "object", word_set(F.concat_ws(" ", "subject", "predicate", "object")).alias("ws"))
    n = F.size("ws")
    # Overlap of t needs ceil((t - 0.3) * n) shared words; with words in one order, one of the first n - that + 1 is shared.
    prefix = F.greatest(F.lit(1), n - F.ceil(F.lit(threshold - 0.3) * n).cast("int") + 1)
    df = base.select("conv_id", F.explode("ws").alias("w")).groupBy("conv_id", "w").agg(F.count(F.lit(1)).alias("df"))
    ranked = base.select("conv_id", key, F.explode("ws").alias("w")).join(df, ["conv_id", "w"]).groupBy("conv_id", key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("rare"))
    posts = base.join(ranked, ["conv_id", key]).select("conv_id", key, "ord", F.explode(F.slice("rare", F.lit(1), prefix)).alias("w"))
    a, b = posts.alias("a"), posts.alias("b")
    met = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.w") == F.col("b.w")) & (F.col("a.ord") < F.col("b.ord"))).select(
        F.col("a.conv_id").alias("conv_id"), F.col(f"a.{key}").alias("ka"), F.col(f"b.{key}").alias("kb")).distinct()
    full = facts.select("conv_id", key, "subject", "predicate", "object")
    both = met.join(full.alias("a"), (met["conv_id"] == F.col("a.conv_id")) & (F.col("ka") == F.col(f"a.{key}"))).drop(F.col("a.conv_id")).join(
        full.alias("b"), (met["conv_id"] == F.col("b.conv_id")) & (F.col("kb") == F.col(f"b.{key}")))
    return both.select(met["conv_id"], F.col("ka").alias("a"), F.col("kb").alias("b"), sim.triple_similarity("a", "b").alias("similarity")).filter(F.col("similarity") >= threshold)


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex that each vertex of edges (a, b) reaches. Large and small stars, a table each round."""
    tidy = lambda e: e.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    size = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = materialised(tidy(edges))
    before = size(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = materialised(tidy(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        now = materialised(tidy(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))))
        was, before = before, size(now)
        if was == before:
            break
    return now.select(F.col("a").alias("v"), F.col("b").alias("root"))


def fold_groups(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(conv_id, fact_id, root) of facts in groups of similar ones; the root is the group's first fact."""
    number = facts.select("conv_id", "fact_id", F.struct("conv_id", "ord", "fact_id").alias("v"))
    end = lambda x: number.select("conv_id", F.col("fact_id").alias(x), F.col("v").alias(f"v{x}"))
    edges = pairs.join(end("a"), ["conv_id", "a"]).join(end("b"), ["conv_id", "b"]).select(F.col("va").alias("a"), F.col("vb").alias("b"))
    found = components(edges)
    roots = found.select("root").distinct().select(F.col("root").alias("v"), "root")
    every = found.unionByName(roots).distinct()
    return every.select(F.col("v.conv_id").alias("conv_id"), F.col("v.fact_id").alias("fact_id"), F.col("root.fact_id").alias("root"))


def merge_groups(facts: DataFrame, groups: DataFrame, strategy: str = "highest_confidence") -> DataFrame:
    """One fact a group: the most confident or the first; combine also unites source turns and takes the largest scores."""
    best = {"highest_confidence": F.struct(F.col("confidence"), -F.col("ord")), "combine": F.struct(F.col("confidence"), -F.col("ord")), "first": F.struct(-F.col("ord"))}[strategy]
    names = facts.columns
    chosen = facts.join(groups, ["conv_id", "fact_id"]).groupBy("conv_id", "root").agg(
        F.max_by(F.struct(*names), best).alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_turns")))).alias("turns"), F.max("importance").alias("imp"))
    out = chosen.select("f.*", "turns", "imp")
    if strategy == "combine":
        out = out.withColumns({"source_turns": F.col("turns"), "importance": F.col("imp")})
    return conform(out, "facts")


def entailed(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """(conv_id, by, fact_id): facts that an earlier equal one or a relation entails."""
    a, b = facts.alias("a"), facts.alias("b")
    same = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.subject") == F.col("b.subject")) & (F.col("a.predicate") == F.col("b.predicate"))
                  & (F.col("a.object") == F.col("b.object")) & (F.col("a.ord") < F.col("b.ord"))).select(F.col("a.conv_id").alias("conv_id"), F.col("a.fact_id").alias("by"), F.col("b.fact_id").alias("fact_id"))
    said = relations.filter("rtype = 'entails'").select("conv_id", F.col("src").alias("by"), F.col("dst").alias("fact_id"))
    return same.unionByName(said).distinct()


def droppable_entailed(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(conv_id, fact_id): entailed facts that are not much surer than what entails them and add no source turn."""
    by = facts.select("conv_id", F.col("fact_id").alias("by"), F.col("confidence").alias("by_conf"), F.col("source_turns").alias("by_turns"))
    both = pairs.join(by, ["conv_id", "by"]).join(facts.select("conv_id", "fact_id", "confidence", "source_turns"), ["conv_id", "fact_id"])
    return both.filter((F.col("confidence") <= F.col("by_conf") + 0.3) & (F.size(F.array_except("source_turns", "by_turns")) == 0)).select("conv_id", "fact_id").distinct()


def contradictions(facts: DataFrame) -> DataFrame:
    """(conv_id, a, b): contradicting facts, the earlier first."""
    a, b = facts.alias("a"), facts.alias("b")
    keys = (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.subject") == F.col("b.subject")) & (F.col("a.predicate") == F.col("b.predicate"))
    return a.join(b, keys & (F.col("a.ord") < F.col("b.ord")) & sim.contradicts("a", "b")).select(
        F.col("a.conv_id").alias("conv_id"), F.col("a.fact_id").alias("a"), F.col("b.fact_id").alias("b"))


def superseded(facts: DataFrame, predicates=FUNCTIONAL_PREDICATES) -> DataFrame:
    """(conv_id, fact_id): facts of a functional predicate that a later one of the subject replaces.

    The latest by last source turn stays, of equals the first. A partial aggregate finds it; a hot subject is no window.
    """
    own = facts.filter(F.lower("predicate").isin(*predicates)).select(
        "conv_id", "fact_id", F.lower("subject").alias("s"), F.lower("predicate").alias("p"),
        F.struct(F.coalesce(F.array_max("source_turns"), F.lit(0)).alias("t"), (-F.col("ord")).alias("o"), "fact_id").alias("rank"))
    latest = own.groupBy("conv_id", "s", "p").agg(F.max("rank").alias("top"))
    return own.join(latest, ["conv_id", "s", "p"]).filter("rank != top").select("conv_id", "fact_id")
