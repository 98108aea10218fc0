"""Turns to entities, facts and events, by expressions that Spark runs itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import ir
from palimpsest.fixed import FACT_TYPES, NOT_NAMES
from palimpsest.functions import scores
from palimpsest.functions.text import IS_FACT, NAME_FACT, WORKS_FACT, W, ident
from palimpsest.ir import MENTIONS, Memory, conform

BATCH = 10


def _ord(rank: int, pos: Column) -> Column:
    """By turn, then rule, then place in the turn."""
    return F.col("turn").cast("bigint") * (1 << 32) + F.lit(rank << 28) + pos


def entities(turns: DataFrame, batch: int = BATCH, whole: bool = False) -> DataFrame:
    """Capitalised words as entities: the first of a name in each batch of turns; with whole, in the conversation.

    The first of equal names is found by a partial aggregate, so no conversation is sorted.
    """
    words = turns.select("conv_id", "turn", "role", F.posexplode(F.filter(F.split("content", r"\s+"), lambda w: w != "")).alias("pos", "w"))
    clean = F.regexp_replace("w", f"[^{W[1:-1]}]", "")
    named = words.withColumn("name", clean).filter(
        F.col("name").rlike(r"^\p{Lu}") & (F.length("name") > 1) & ~F.lower("name").isin(*NOT_NAMES))
    named = named.withColumns({"batch": F.lit(0) if whole else F.floor(F.col("turn") / batch).cast("int"), "ord": _ord(0, F.col("pos"))})
    first = named.groupBy("conv_id", "batch", "name").agg(F.min("ord").alias("ord"), F.min_by("role", "ord").alias("role"))
    return conform(first.select(
        "conv_id", ident("ent_", F.col("conv_id"), F.col("batch"), F.col("name")).alias("ent_id"), "ord", "name",
        F.when(F.col("role") == "user", "person").otherwise("other").alias("type"), F.array().cast("array<string>").alias("aliases"),
        F.expr("map()").cast("map<string,string>").alias("attributes"), F.array().cast(MENTIONS).alias("mentions"), F.lit(0.0).alias("importance")), "entities")


def _fact(df: DataFrame, predicate: str, kind: str, confidence: float) -> DataFrame:
    return conform(df.select(
        "conv_id", ident("fact_", F.col("conv_id"), F.col("ord"), F.lit(predicate)).alias("fact_id"), "ord", "subject", F.lit(predicate).alias("predicate"), "object",
        F.lit(kind).alias("fact_type"), F.lit(confidence).alias("confidence"), F.array("turn").alias("source_turns"), F.lit(False).alias("negated"),
        F.lit("present").alias("temporal_scope"), F.lit(0.0).alias("importance")), "facts")


def _pairs(turns: DataFrame, pattern: str, rank: int) -> DataFrame:
    both = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "subject"), (2, "object"))])
    return turns.select("conv_id", "turn", F.posexplode(both).alias("pos", "m")).select("conv_id", "turn", _ord(rank, F.col("pos")).alias("ord"), "m.subject", "m.object")


def is_facts(turns: DataFrame) -> DataFrame:
    """Facts of the form X is Y."""
    return _fact(_pairs(turns, IS_FACT, 1), "is", "attribute", 0.8)


def works_facts(turns: DataFrame) -> DataFrame:
    """Facts of the form X works at Y."""
    return _fact(_pairs(turns, WORKS_FACT, 2), "works at", "membership", 0.9)


def name_facts(turns: DataFrame) -> DataFrame:
    """The first name that a turn gives; the subject is who speaks."""
    found = turns.select("conv_id", "turn", "role", F.regexp_extract("content", NAME_FACT, 1).alias("object")).filter("object != ''")
    subject = F.when(F.col("role") == "user", "User").otherwise("Assistant").alias("subject")
    return _fact(found.select("conv_id", "turn", _ord(3, F.lit(0)).alias("ord"), subject, "object"), "has name", "attribute", 1.0)


def facts(turns: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (f(turns) for f in (is_facts, works_facts, name_facts)))


def events(turns: DataFrame) -> DataFrame:
    """A question for each turn with a question mark; an answer for each other turn of the assistant but the first."""
    asks = F.col("content").contains("?")
    kind = F.when(asks, "question").when((F.col("role") == "assistant") & (F.col("turn") > 0), "answer")
    said = F.when(asks, F.concat(F.lit("Question asked: "), F.substring("content", 1, 100))).otherwise(
        F.concat(F.lit("Response provided about: "), F.substring("content", 1, 50), F.lit("...")))
    found = turns.select("conv_id", "turn", "role", kind.alias("event_type"), said.alias("description")).filter("event_type is not null")
    return conform(found.select(
        "conv_id", ident("evt_", F.col("conv_id"), F.col("turn")).alias("evt_id"), _ord(0, F.lit(0)).alias("ord"), "description", "event_type", "turn",
        F.array("role").alias("participants"), F.array().cast("array<string>").alias("related_facts"), F.lit(0.0).alias("importance")), "events")


def mentions(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(conv_id, ent_id, turn, start, end): for each fact, source turn and end that names an entity."""
    ends = found.select("conv_id", "source_turns", F.explode(F.array("subject", "object")).alias("n")).select("conv_id", "n", F.explode("source_turns").alias("turn"))
    index = ir.name_index(entities)
    return ends.withColumn("lname", F.lower("n")).join(index, ["conv_id", "lname"]).select(
        "conv_id", "ent_id", "turn", F.lit(0).alias("start"), F.length("n").alias("end"))


def link(memory: Memory) -> Memory:
    """Mentions of entities by all facts, afresh, and first importances."""
    found = mentions(memory.facts, memory.entities).groupBy("conv_id", "ent_id").agg(F.array_sort(F.collect_list(F.struct("turn", "start", "end"))).alias("m"))
    ents = memory.entities.join(found, ["conv_id", "ent_id"], "left").withColumn("mentions", F.coalesce("m", F.array().cast(MENTIONS))).withColumn(
        "importance", scores.initial_entity(ir.refs(F.col("mentions"))))
    ents = conform(ents, "entities")
    index = ir.name_index(ents).join(ents.select("conv_id", "ent_id", F.col("importance").alias("of_subject")), ["conv_id", "ent_id"])
    facts_ = memory.facts.withColumn("lname", F.lower("subject")).join(index.select("conv_id", "lname", "of_subject"), ["conv_id", "lname"], "left").withColumn(
        "importance", scores.initial_fact(F.col("confidence"), F.col("of_subject"), F.col("source_turns")))
    evts = memory.events.withColumn("importance", scores.initial_event(F.col("participants")))
    return memory.with_(entities=ents, facts=conform(facts_, "facts"), events=conform(evts, "events"))


def extract(turns: DataFrame, batch: int = BATCH, whole: bool = False) -> Memory:
    """The memory of all conversations in turns."""
    base = ir.empty(turns.sparkSession)
    return link(base.with_(turns=turns, entities=entities(turns, batch, whole), facts=facts(turns), events=events(turns)))


def extract_incremental(memory: Memory, new_turns: DataFrame) -> Memory:
    """new_turns, numbered on from what is there, as one batch; mentions of all facts are made afresh, none twice."""
    start = ir.turn_counts(memory.turns).select("conv_id", F.col("num_turns").alias("past"))
    place = F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1")
    more = new_turns.withColumn("n", place).join(start, "conv_id", "left").select(
        "conv_id", (F.col("n") + F.coalesce("past", F.lit(0))).cast("int").alias("turn"), "role", "content")
    fresh = entities(more, whole=True)
    return link(memory.with_(turns=memory.turns.unionByName(more), entities=ir.find_or_create(memory.entities, fresh),
                             facts=memory.facts.unionByName(facts(more)), events=memory.events.unionByName(events(more))))


def parse_model_answer(said: Column, schema: str) -> Column:
    """The JSON of a model's answer: a fenced block, else the outermost braces; null where neither parses."""
    fenced = F.regexp_extract(said, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(said, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(braces), schema)


def from_rows(turns: DataFrame, raw: DataFrame) -> DataFrame:
    """Facts of parsed answers (conv_id, ord, subject, predicate, object, fact_type, confidence, turn); unknown types become other."""
    named = raw.withColumns({"fact_type": F.when(F.lower("fact_type").isin(*FACT_TYPES), F.lower("fact_type")).otherwise("other"), "source_turns": F.array("turn"),
                             "fact_id": ident("fact_", F.col("conv_id"), F.col("ord"), F.col("predicate")), "negated": F.lit(False), "temporal_scope": F.lit("present"), "importance": F.lit(0.0)})
    return conform(named.join(turns.select("conv_id").distinct(), "conv_id", "left_semi"), "facts")
