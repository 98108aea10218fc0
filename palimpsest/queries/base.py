"""Memories made of the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import ir
from palimpsest.functions.text import IS_FACT, NAME_FACT, WORKS_FACT, ident
from palimpsest.ir import MENTIONS, Memory, conform
from palimpsest.operators import extraction
from palimpsest.sources import dialogues


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def turns(spark: SparkSession, d: str) -> DataFrame:
    return dialogues.turns(table(spark, d, "conversations"))


def talk(spark: SparkSession, d: str) -> DataFrame:
    """Turns that customers might say: what the conversations do not have, names, work and questions."""
    c = table(spark, d, "customer")
    said = F.concat(F.lit("My name is "), F.replace("c_name", F.lit("#"), F.lit("")), F.lit(" and Dana works at "), F.initcap("c_mktsegment"), F.lit(". Balance is "),
                    F.floor("c_acctbal").cast("string"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" now? Who knows?")).otherwise(F.lit(" now.")))
    role = F.when(F.col("c_custkey") % 2 == 0, "user").otherwise("assistant")
    return dialogues.turns(c.select(F.col("c_nationkey").cast("bigint").alias("conv_id"), F.col("c_custkey").alias("turn"), role.alias("role"), said.alias("text")))


def memory(spark: SparkSession, d: str) -> Memory:
    return extraction.extract(turns(spark, d))


def talked(spark: SparkSession, d: str) -> Memory:
    return extraction.extract(talk(spark, d))


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Facts (customer, has status, status) in order of date."""
    o = table(spark, d, "orders")
    n = F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
    return conform(o.withColumn("n", n).select(
        F.col("o_custkey").cast("bigint").alias("conv_id"), ident("fact_", F.col("o_orderkey")).alias("fact_id"), (-F.col("o_orderkey")).cast("bigint").alias("ord"),
        F.col("o_custkey").cast("string").alias("subject"), F.lit("has status").alias("predicate"), F.col("o_orderstatus").alias("object"), F.lit("state").alias("fact_type"),
        (F.lit(0.5) + F.col("o_orderkey") % 5 / 10).alias("confidence"), F.array(F.col("n").cast("int")).alias("source_turns"), F.lit(False).alias("negated"), F.lit("present").alias("temporal_scope"),
        (F.col("o_orderkey") % 100 / 100).alias("importance")), "facts")


def people(spark: SparkSession, d: str) -> Memory:
    """A memory a region: customers and nations are entities, where customers live is a fact; 40 turns each."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    both = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.array().cast("array<string>")
    attrs = F.expr("map()").cast("map<string,string>")
    at = (F.col("c_custkey") % 40).cast("int")
    imp = F.col("c_custkey") % 97 / 97
    ents = conform(both.select(F.col("n_regionkey").cast("bigint").alias("conv_id"), F.concat(F.lit("ent_c"), F.col("c_custkey").cast("string")).alias("ent_id"), F.col("c_custkey").cast("bigint").alias("ord"), F.col("c_name").alias("name"),
                               F.when(F.col("c_custkey") % 2 == 0, "person").otherwise("other").alias("type"), none.alias("aliases"), attrs.alias("attributes"),
                               F.when(F.col("c_custkey") % 3 > 0, F.array(F.struct(at.alias("turn"), F.lit(0).alias("start"), F.length("c_name").alias("end")))).otherwise(F.array().cast(MENTIONS)).alias("mentions"), imp.alias("importance")), "entities")
    places = conform(n.select(F.col("n_regionkey").cast("bigint").alias("conv_id"), F.concat(F.lit("ent_n"), F.col("n_nationkey").cast("string")).alias("ent_id"), (F.col("n_nationkey") + (1 << 40)).cast("bigint").alias("ord"), F.col("n_name").alias("name"),
                              F.lit("location").alias("type"), none.alias("aliases"), attrs.alias("attributes"), F.array().cast(MENTIONS).alias("mentions"), (F.col("n_nationkey") / 25).alias("importance")), "entities")
    facts = conform(both.select(F.col("n_regionkey").cast("bigint").alias("conv_id"), F.concat(F.lit("fact_"), F.col("c_custkey").cast("string")).alias("fact_id"), F.col("c_custkey").cast("bigint").alias("ord"), F.col("c_name").alias("subject"),
                                F.lit("lives in").alias("predicate"), F.col("n_name").alias("object"), F.when(F.col("c_custkey") % 2 == 0, "attribute").otherwise("state").alias("fact_type"), (F.col("c_custkey") % 10 / 10).alias("confidence"),
                                F.array(at).alias("source_turns"), (F.col("c_custkey") % 7 == 0).alias("negated"), F.lit("present").alias("temporal_scope"), imp.alias("importance")), "facts")
    said = spark.range(40).select(F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("content"))
    talk_ = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("conv_id"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("turn")).join(F.broadcast(said), "turn")
    return ir.empty(spark).with_(turns=conform(talk_, "turns"), entities=ents.unionByName(places), facts=facts)


def stream_events(spark: SparkSession, d: str) -> Memory:
    """A memory a user: what they clicked and bought, a turn an event."""
    e = table(spark, d, "events")
    n = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1").cast("int")
    e = e.withColumn("turn", n)
    evts = conform(e.select(F.col("user_id").cast("bigint").alias("conv_id"), F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("evt_id"), F.col("event_id").cast("bigint").alias("ord"), F.concat_ws(" ", "event_type", F.lit("number"), (F.col("event_id") % 3).cast("string")).alias("description"),
                            F.when(F.col("event_type") == "view", "question").when(F.col("event_type") == "click", "answer").when(F.col("event_type") == "purchase", "completion").when(F.col("event_type") == "error", "error").otherwise("action").alias("event_type"),
                            "turn", F.array(F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string"))).alias("participants"), F.array().cast("array<string>").alias("related_facts"), (F.col("event_id") % 10 / 10).alias("importance")), "events")
    talk_ = e.select(F.col("user_id").cast("bigint").alias("conv_id"), "turn", F.lit("user").alias("role"), F.col("event_type").alias("content"))
    return ir.empty(spark).with_(turns=conform(talk_, "turns"), events=evts)


# ---- the same as SQL

TURNS = "turns AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS content FROM conversations)"
TALK = """said AS (
  SELECT c_nationkey::BIGINT AS conv_id, c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
         'My name is ' || replace(c_name, '#', '') || ' and Dana works at ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || '. Balance is ' || floor(c_acctbal)::BIGINT::VARCHAR
         || CASE WHEN c_custkey % 3 = 0 THEN ' now? Who knows?' ELSE ' now.' END AS content FROM customer),
turns AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1)::INT AS turn, role, content FROM said)"""


def words_sql(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '\s+'), lambda w: w <> '')"


_IS, _WORKS, _NAME = (p.replace("'", "''") for p in (IS_FACT, WORKS_FACT, NAME_FACT))
EXTRACTED = rf"""raw AS (
  SELECT conv_id, turn, role, unnest(ws) AS w, unnest(range(len(ws))) AS pos
  FROM (SELECT *, list_filter(string_split_regex(content, '\s+'), lambda x: x <> '') AS ws FROM turns)),
named AS (
  SELECT conv_id, turn, role, regexp_replace(w, '[^\p{{L}}\p{{N}}_]', '', 'g') AS name, turn // 10 AS batch, turn::BIGINT * 4294967296 + pos AS ord FROM raw),
ents AS (
  SELECT conv_id, batch, name, min(ord) AS ord, CASE WHEN arg_min(role, ord) = 'user' THEN 'person' ELSE 'other' END AS type FROM named
  WHERE regexp_matches(name, '^\p{{Lu}}') AND length(name) > 1 AND lower(name) NOT IN ('i', 'the', 'a', 'an', 'my', 'your') GROUP BY conv_id, batch, name),
facts AS (
  SELECT conv_id, turn, turn::BIGINT * 4294967296 + 268435456 + unnest(range(len(regexp_extract_all(content, '{_IS}', 0)))) AS ord, unnest(regexp_extract_all(content, '{_IS}', 1)) AS subject, 'is' AS predicate,
         unnest(regexp_extract_all(content, '{_IS}', 2)) AS object, 'attribute' AS fact_type, 0.8::DOUBLE AS confidence FROM turns
  UNION ALL
  SELECT conv_id, turn, turn::BIGINT * 4294967296 + 536870912 + unnest(range(len(regexp_extract_all(content, '{_WORKS}', 0)))), unnest(regexp_extract_all(content, '{_WORKS}', 1)), 'works at',
         unnest(regexp_extract_all(content, '{_WORKS}', 2)), 'membership', 0.9::DOUBLE FROM turns
  UNION ALL
  SELECT conv_id, turn, turn::BIGINT * 4294967296 + 805306368, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END, 'has name', regexp_extract(content, '{_NAME}', 1), 'attribute', 1.0::DOUBLE
  FROM turns WHERE regexp_extract(content, '{_NAME}', 1) <> ''),
evts AS (
  SELECT * FROM (SELECT conv_id, turn, role, CASE WHEN contains(content, '?') THEN 'question' WHEN role = 'assistant' AND turn > 0 THEN 'answer' END AS event_type,
    CASE WHEN contains(content, '?') THEN 'Question asked: ' || content[1:100] ELSE 'Response provided about: ' || content[1:50] || '...' END AS description FROM turns) WHERE event_type IS NOT NULL),
idx AS (SELECT conv_id, lower(name) AS lname, max(ord) AS ent FROM ents GROUP BY conv_id, lower(name)),
mentions AS (
  SELECT f.conv_id, i.ent, f.turn, length(f.n) AS stop FROM (SELECT conv_id, turn, subject AS n FROM facts UNION ALL SELECT conv_id, turn, object FROM facts) f
  JOIN idx i ON i.conv_id = f.conv_id AND i.lname = lower(f.n)),
linked AS (
  SELECT e.*, coalesce(m.refs, 0) AS refs, m.last_turn, least(1.0, coalesce(m.refs, 0) * 0.1) AS importance
  FROM ents e LEFT JOIN (SELECT conv_id, ent, count(*) AS refs, max(turn) AS last_turn FROM mentions GROUP BY conv_id, ent) m ON m.conv_id = e.conv_id AND m.ent = e.ord),
scored AS (
  SELECT f.*, f.confidence * 0.5 + coalesce(l.importance, 0.0) * 0.3 + 0.05 AS importance FROM facts f
  LEFT JOIN idx i ON i.conv_id = f.conv_id AND i.lname = lower(f.subject) LEFT JOIN linked l ON l.conv_id = i.conv_id AND l.ord = i.ent)"""

LEDGER = """ledger AS (
  SELECT o_custkey::BIGINT AS conv_id, -o_orderkey AS ord, o_custkey::VARCHAR AS subject, 'has status' AS predicate, o_orderstatus AS object, 0.5 + (o_orderkey % 5) / 10 AS confidence,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn, (o_orderkey % 100) / 100 AS importance FROM orders)"""

PEOPLE = """pents AS (
  SELECT n_regionkey::BIGINT AS conv_id, 'ent_c' || c_custkey AS ent_id, c_custkey AS ord, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'person' ELSE 'other' END AS type,
         CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 40 END AS last_turn, CASE WHEN c_custkey % 3 > 0 THEN 1 ELSE 0 END AS refs, (c_custkey % 97) / 97 AS importance FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_regionkey::BIGINT, 'ent_n' || n_nationkey, n_nationkey + 1099511627776, n_name, 'location', NULL, 0, n_nationkey / 25 FROM nation),
pfacts AS (
  SELECT n_regionkey::BIGINT AS conv_id, 'fact_' || c_custkey AS fact_id, c_custkey AS ord, c_name AS subject, 'lives in' AS predicate, n_name AS object,
         CASE WHEN c_custkey % 2 = 0 THEN 'attribute' ELSE 'state' END AS fact_type, (c_custkey % 10) / 10 AS confidence, c_custkey % 40 AS turn, c_custkey % 7 = 0 AS negated, (c_custkey % 97) / 97 AS importance
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

EVENTS = """sevents AS (
  SELECT user_id::BIGINT AS conv_id, event_id AS ord, 'evt_' || event_id AS evt_id, event_type || ' number ' || (event_id % 3) AS description,
         CASE event_type WHEN 'view' THEN 'question' WHEN 'click' THEN 'answer' WHEN 'purchase' THEN 'completion' WHEN 'error' THEN 'error' ELSE 'action' END AS event_type,
         (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS turn, 'p' || (event_id % 4) AS participant, (event_id % 10) / 10 AS importance FROM events)"""
