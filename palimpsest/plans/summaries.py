"""Summaries of conversations by templates, for where no model writes them; and what is read from a written summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import sentence, tokens_thirds
from palimpsest.ir import Memory
from palimpsest.operators.selection import top_k

# How names are introduced, what a topic looks like, bullets and names of a written summary.
NAME = r"(?i)(?:I'm|my name is|I am) ([\p{L}\p{N}_]+)"
TOPIC = r"((?U:\b)[A-Z][a-z]+(?:\s+[a-z]+)*(?U:\b))"
BULLET = r"(?s)[-•*]\s*(.+?)(?=\n[-•*]|\n\n|\z)"
CAPITALISED = r"((?U:\b)[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?U:\b))"


def _ordered(df: DataFrame, value: str, order: Column, most: int, name: str) -> DataFrame:
    """(conv_id, name): the first different values of each conversation."""
    first = df.groupBy("conv_id", value).agg(F.min(order).alias("o"))
    kept = top_k(first, most, [F.col("o")], "conv_id")
    return kept.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]).alias(name))


def parts(turns: DataFrame, memory: Memory | None = None) -> DataFrame:
    """(conv_id, turns, tokens, names, topics, points): what summaries are made of."""
    n = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(tokens_thirds(F.concat("role", F.lit(": "), "content"))).alias("tokens"))
    said = turns.select("conv_id", "turn", F.regexp_extract("content", NAME, 1).alias("name")).filter("name != ''").select("conv_id", "name", F.struct(F.lit(0).alias("s"), F.col("turn").cast("bigint").alias("k")).alias("o"))
    topics = turns.select("conv_id", "turn", F.posexplode(F.slice(F.regexp_extract_all("content", F.lit(TOPIC), F.lit(1)), 1, 2)).alias("pos", "topic"))
    points = None
    if memory is not None:
        known = top_k(memory.entities, 5, [F.col("ord")], "conv_id")
        said = said.unionByName(known.select("conv_id", "name", F.struct(F.lit(1).alias("s"), F.col("rank").cast("bigint").alias("k")).alias("o")))
        points = memory.facts.withColumn("point", sentence(F.col("subject"), F.col("predicate"), F.col("object"), F.col("negated")))
        points = _ordered(points, "point", F.col("ord"), 5, "points")
    out = n.join(_ordered(said, "name", F.col("o"), 5, "names"), "conv_id", "left").join(_ordered(topics, "topic", F.struct("turn", "pos"), 3, "topics"), "conv_id", "left")
    none = F.array().cast("array<string>")
    out = out.join(points, "conv_id", "left") if points is not None else out.withColumn("points", none)
    return out.withColumns({c: F.coalesce(c, none) for c in ("names", "topics", "points")})


def summarise(turns: DataFrame, memory: Memory | None = None, style: str = "detailed") -> DataFrame:
    """(conv_id, summary, original_tokens, summary_tokens): executive, bullet, narrative or detailed."""
    p = parts(turns, memory)
    names = F.when(F.size("names") > 0, F.array_join("names", ", ")).otherwise("participants")
    topics = F.when(F.size("topics") > 0, F.array_join("topics", ", ")).otherwise("various topics")
    n = F.col("turns").cast("string")
    line = lambda k: F.transform(F.slice("points", 1, k), lambda x: F.concat(F.lit("- "), x))
    text = {
        "executive": F.concat(F.lit("A "), n, F.lit("-turn conversation involving "), names, F.lit(" discussing "), topics, F.lit(".")),
        "bullet": F.array_join(F.concat(F.array(F.concat(F.lit("- Participants: "), names), F.concat(F.lit("- Topics: "), topics), F.concat(F.lit("- Duration: "), n, F.lit(" exchanges"))), line(3)), "\n"),
        "narrative": F.concat(F.lit("In this conversation, "), names, F.lit(" engaged in a discussion about "), topics, F.lit(". Over the course of "), n, F.lit(" exchanges, they covered various aspects of the topic."),
                              F.when(F.size("points") > 0, F.concat(F.lit(" Key information shared includes: "), F.element_at("points", 1), F.lit("."))).otherwise("")),
        "detailed": F.concat(F.lit("Summary of conversation ("), n, F.lit(" turns):\nParticipants: "), names, F.lit("\nMain topics: "), topics, F.lit("\n"),
                             F.when(F.size("points") > 0, F.concat(F.lit("Key points:\n"), F.array_join(line(5), "\n"))).otherwise("")),
    }[style]
    return p.select("conv_id", text.alias("summary"), F.col("tokens").alias("original_tokens")).withColumn("summary_tokens", tokens_thirds(F.col("summary")))


def continued(summaries: DataFrame, new_turns: DataFrame) -> DataFrame:
    """Summaries that say how many more turns there were; a conversation without new ones keeps its own."""
    more = new_turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("more"))
    text = F.concat("summary", F.lit(" The conversation continued with "), F.col("more").cast("string"), F.lit(" more exchanges."))
    out = summaries.join(more, "conv_id", "left").withColumn("summary", F.coalesce(text, "summary"))
    return out.select("conv_id", "summary", (F.col("original_tokens") + F.coalesce(F.col("more"), F.lit(0)) * 20).alias("original_tokens")).withColumn("summary_tokens", tokens_thirds(F.col("summary")))


def read_summary(text: Column) -> Column:
    """struct(points, names) of a written summary: at most ten bullets and fifteen different names."""
    points = F.filter(F.transform(F.regexp_extract_all(text, F.lit(BULLET), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(1)))
    return F.struct(F.slice(points, 1, 10).alias("points"), F.slice(names, 1, 15).alias("names"))
