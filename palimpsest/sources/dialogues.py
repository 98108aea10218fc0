"""Dialogues of several layouts as turns (conv_id, turn, role, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def turns(df: DataFrame, text: str = "text") -> DataFrame:
    """Turns numbered from 0 in each conversation; a missing role is the user's, a missing text empty."""
    n = F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1").cast("int")
    return df.select("conv_id", n.alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Turns of {"dialogue": [{role, content}]} documents, one a file or line; conv_id is a hash of the document."""
    raw = spark.read.schema("dialogue array<struct<role:string,content:string>>, conv_id bigint").option("multiLine", True).json(path)
    own = F.coalesce("conv_id", F.xxhash64(F.to_json("dialogue")))
    return turns(raw.select(own.alias("conv_id"), F.posexplode("dialogue").alias("turn", "d")).select("conv_id", "turn", "d.role", F.col("d.content").alias("text")))


def alternating(df: DataFrame, history: str = "history") -> DataFrame:
    """Turns of lists of texts by two speakers in turn."""
    return turns(df.select("conv_id", F.posexplode(history).alias("turn", "text")).withColumn("role", F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")))


def by_speaker(df: DataFrame, texts: str = "utterance", speakers: str = "speaker") -> DataFrame:
    both = F.arrays_zip(F.col(texts).alias("t"), F.col(speakers).alias("s"))
    return turns(df.select("conv_id", F.posexplode(both).alias("turn", "x")).select("conv_id", "turn", F.when(F.col("x.s") == 0, "user").otherwise("assistant").alias("role"), F.col("x.t").alias("text")))


def sessions(df: DataFrame, least: int = 2) -> DataFrame:
    """(conv_id, text) of (conv_id, sessions array<array<struct<speaker,text>>>): the first sessions as lines; shorter ones go."""
    block = lambda s, k: F.concat(F.lit("[Session "), (k + 1).cast("string"), F.lit("]\n"), F.array_join(F.transform(s, lambda x: F.concat(x["speaker"], F.lit(": "), x["text"])), "\n"))
    return df.filter(F.size("sessions") >= least).select("conv_id", F.array_join(F.transform(F.slice("sessions", 1, least), block), "\n").alias("text"))


def from_buffer(df: DataFrame, text: str = "buffer") -> DataFrame:
    """Turns of one string of `Human: …` and `AI: …` parts."""
    e = r"(?s)(Human|AI|User|Assistant):\s*(.+?)(?=\s*(?:Human|AI|User|Assistant):|\z)"
    both = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(e), F.lit(k)).alias(n) for k, n in ((1, "who"), (2, "said"))])
    each = df.select("conv_id", F.posexplode(both).alias("turn", "x"))
    return turns(each.select("conv_id", "turn", role(F.col("x.who")).alias("role"), F.trim("x.said").alias("text")))


def role(said: Column) -> Column:
    low = F.lower(said)
    return F.when(low.contains("human") | low.contains("user"), "user").when(low.contains("ai") | low.contains("assistant"), "assistant").when(low.contains("system"), "system").otherwise("user")


def last(turns_: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    from palimpsest.operators.selection import top_k

    return top_k(turns_, n, [F.desc("turn")], "conv_id").drop("rank")


def chat_window(turns_: DataFrame, summaries: DataFrame, budget: int, n: int = 4) -> DataFrame:
    """All turns of conversations within the budget; else their summary, as turn -1, and the last n turns."""
    from palimpsest.functions.text import tokens_thirds

    size = turns_.groupBy("conv_id").agg(F.sum(tokens_thirds(F.col("content"))).alias("tokens"))
    small = turns_.join(size.filter(F.col("tokens") <= budget), "conv_id", "left_semi")
    large = size.filter(F.col("tokens") > budget)
    head = summaries.join(large, "conv_id", "left_semi").select("conv_id", F.lit(-1).alias("turn"), F.lit("system").alias("role"), F.col("text").alias("content"))
    return small.unionByName(head).unionByName(last(turns_.join(large, "conv_id", "left_semi"), n))


def of_length(turns_: DataFrame, least: int, most: int) -> DataFrame:
    """The turns of conversations with that many turns."""
    n = turns_.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least, most))
    return turns_.join(n.select("conv_id"), "conv_id", "left_semi")


_QUESTIONS = "array<struct<question:string,answer:string,entities:array<string>>>"


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, dialogue, key_entities, key_facts, questions) of a JSON list of {context, questions, key_facts}."""
    raw = spark.read.schema(f"context string, key_facts array<string>, questions {_QUESTIONS}").option("multiLine", True).json(path)
    return probes(raw)


def probes(raw: DataFrame) -> DataFrame:
    none = lambda t: F.array().cast(t)
    asked = F.coalesce("questions", none(_QUESTIONS))
    names = F.flatten(F.transform(asked, lambda q: F.coalesce(q["entities"], none("array<string>"))))
    text = F.coalesce("context", F.lit(""))
    return raw.select(F.concat(F.lit("probe_"), F.substring(F.md5(F.concat(text, F.to_json(asked))), 1, 12)).alias("sample_id"), text.alias("dialogue"), F.array_sort(F.array_distinct(names)).alias("key_entities"),
                      F.coalesce("key_facts", none("array<string>")).alias("key_facts"), asked.alias("questions"))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, dialogue, reference_summary, key_entities, key_facts, questions) of JSON lines of long-context tasks."""
    return tasks(spark.read.schema(f"context string, input string, query string, answer string, summary string, entities array<string>, questions {_QUESTIONS}").json(path))


def tasks(raw: DataFrame) -> DataFrame:
    none = lambda t: F.array().cast(t)
    one = F.array(F.struct(F.col("query").alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), none("array<string>").alias("entities"))).cast(_QUESTIONS)
    asked = F.coalesce("questions", F.when(F.col("query").isNotNull(), one), none(_QUESTIONS))
    text = F.coalesce("context", "input", F.lit(""))
    return raw.select(F.concat(F.lit("task_"), F.substring(F.md5(F.concat(text, F.to_json(asked))), 1, 12)).alias("sample_id"), text.alias("dialogue"), F.col("summary").alias("reference_summary"),
                      F.coalesce("entities", none("array<string>")).alias("key_entities"), F.filter(F.transform(asked, lambda q: q["answer"]), lambda a: a != "").alias("key_facts"), asked.alias("questions"))
