"""Queries of summaries, metrics, stores, names across languages and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import ir, telemetry
from palimpsest.fixed import QUERY_WORDS, TOPIC_STOPWORDS
from palimpsest.functions import lang
from palimpsest.operators import context, evaluation, merging, multilang, selection
from palimpsest.plans import passes, summaries
from palimpsest.queries import base
from palimpsest.queries.base import EVENTS, PEOPLE, TURNS, words_sql
from palimpsest.queries.memory_queries import _GRAPH, _customer_relations, _REL
from palimpsest.sources import dialogues, stores
from palimpsest.streaming import buffers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


P, E = f"WITH {PEOPLE}", f"WITH {EVENTS}"


@query(f"WITH {TURNS}, n AS (SELECT conv_id FROM turns GROUP BY conv_id HAVING count(*) BETWEEN 4 AND 6) SELECT t.* FROM turns t JOIN n USING (conv_id)")
def flt_conversation_length(spark, d):
    return dialogues.of_length(base.turns(spark, d), 4, 6)


@query(f"WITH {_REL} SELECT conv_id, src AS fact_id, dst AS other FROM rel WHERE rtype = 'equivalent' UNION SELECT conv_id, dst, src FROM rel WHERE rtype = 'equivalent' UNION SELECT conv_id, src, src FROM rel")
def join_equivalents(spark, d):
    r = _customer_relations(spark, d)
    return ir.equivalents(r, r.select("conv_id", F.col("src").alias("fact_id")).distinct())


@query(f"""{P}, i AS (SELECT conv_id, lower(name) AS n, arg_max(ent_id, ord) AS e FROM pents GROUP BY 1, 2)
SELECT f.conv_id, f.fact_id AS a, i.e AS b, 'subject' AS label FROM pfacts f JOIN i ON i.conv_id = f.conv_id AND i.n = lower(f.subject) UNION ALL
SELECT f.conv_id, f.fact_id, i.e, 'object' FROM pfacts f JOIN i ON i.conv_id = f.conv_id AND i.n = lower(f.object)""")
def src_graph_edges(spark, d):
    return stores.graph_edges(base.people(spark, d))


@query(f"""{_GRAPH}, n AS (SELECT conv_id, to_json(list(struct_pack(id := id, label := label, kind := kind) ORDER BY id, label, kind))::VARCHAR AS n FROM nd GROUP BY conv_id),
e AS (SELECT conv_id, to_json(list(struct_pack(source := a, target := b, label := label) ORDER BY a, b, label))::VARCHAR AS e FROM ed GROUP BY conv_id)
SELECT conv_id, '{{"nodes":' || n || ',"edges":' || coalesce(e, '[]') || '}}' AS text FROM n LEFT JOIN e USING (conv_id)""")
def src_graph_json(spark, d):
    return stores.graph_json(base.people(spark, d))


@query(f"""{P}, c AS (SELECT r_regionkey::BIGINT AS conv_id, (SELECT count(*) FROM pents e WHERE e.conv_id = r_regionkey) AS e, (SELECT count(*) FROM pfacts f WHERE f.conv_id = r_regionkey) AS f FROM region),
l AS (SELECT conv_id, 0 AS s, 0 AS k, chr(10) || 'Entities: ' || e AS line FROM c UNION ALL SELECT conv_id, 1, ord, '  - ' || name || ' (' || type || ')' FROM pents UNION ALL SELECT conv_id, 10, 0, chr(10) || 'Facts: ' || f FROM c
  UNION ALL SELECT * FROM (SELECT conv_id, 11, ord, '  - ' || subject || CASE WHEN negated THEN ' not ' ELSE ' ' END || predicate || ' ' || object FROM pfacts QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY ord) <= 10) t
  UNION ALL SELECT conv_id, 12, 0, '  ... and ' || (f - 10) || ' more' FROM c WHERE f > 10 UNION ALL SELECT conv_id, 20, 0, chr(10) || 'Relations: 0' FROM c UNION ALL SELECT conv_id, 30, 0, chr(10) || 'Events: 0' FROM c)
SELECT conv_id, repeat('=', 50) || chr(10) || 'MEMORY SUMMARY' || chr(10) || repeat('=', 50) || chr(10) || string_agg(line, chr(10) ORDER BY s, k) || chr(10) || chr(10) || repeat('=', 50) AS text FROM l GROUP BY conv_id""")
def src_outline(spark, d):
    return stores.outline(base.people(spark, d))


@query(f"{P} SELECT conv_id, 'facts' AS part, count(*) AS n FROM pfacts GROUP BY conv_id UNION ALL SELECT conv_id, 'entities', count(*) FROM pents GROUP BY conv_id")
def src_json_round_trip(spark, d):
    m = stores.from_json(stores.as_json(base.people(spark, d)))
    one = lambda df, p: df.groupBy("conv_id").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n"))
    return one(m.facts, "facts").unionByName(one(m.entities, "entities"))


@query("SELECT n_regionkey::VARCHAR AS key, lower(n_name) AS term FROM nation UNION SELECT n_regionkey::VARCHAR, lower('of ' || n_name) FROM nation")
def src_term_index(spark, d):
    n = base.table(spark, d, "nation")
    return stores.name_terms(n.select(F.col("n_regionkey").cast("string").alias("key"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("of "), "n_name")).alias("aliases")))


@query("SELECT event_type AS name, sum(value) AS value FROM events GROUP BY 1")
def agg_counters(spark, d):
    e = base.table(spark, d, "events")
    return telemetry.counters(e.select(F.col("event_type").alias("name"), F.lit("counter").alias("kind"), "ts", "value")).select("name", "value")


@query("SELECT event_type AS name, arg_max(value, [epoch_us(ts)::DOUBLE, value]) AS value FROM events GROUP BY 1")
def agg_gauges(spark, d):
    e = base.table(spark, d, "events")
    return telemetry.gauges(e.select(F.col("event_type").alias("name"), F.lit("gauge").alias("kind"), "ts", "value"))


@query("SELECT count(*) AS count, round(sum(l_extendedprice), 2) AS total_time_ms, round(avg(l_extendedprice), 6) AS avg_time_ms, sum(l_quantity) AS total_memory_mb, arg_max(l_orderkey, [l_extendedprice, l_orderkey]) AS slowest FROM lineitem")
def agg_profile(spark, d):
    p = telemetry.profile_summary(base.table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice", "l_quantity")
    return p.select("count", F.round("total_time_ms", 2).alias("total_time_ms"), F.round("avg_time_ms", 6).alias("avg_time_ms"), "total_memory_mb", "slowest")


@query("SELECT CASE WHEN bool_or(event_type = 'error') THEN 'unhealthy' ELSE 'healthy' END AS status FROM events")
def agg_health(spark, d):
    return evaluation.health(base.table(spark, d, "events").select(F.when(F.col("event_type") == "error", "unhealthy").otherwise("healthy").alias("status")))


_KIND = " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}'" for k, ws in QUERY_WORDS)


@query(f"SELECT item_id, CASE {_KIND} ELSE 'general' END AS kind FROM benchmark")
def flt_query_kind(spark, d):
    return base.table(spark, d, "benchmark").select("item_id", selection.query_kind(F.col("text")).alias("kind"))


@query("SELECT item_id, CASE WHEN length(text) > 60 THEN text[1:57] || '...' ELSE text END AS content FROM benchmark")
def fn_truncate(spark, d):
    b = base.table(spark, d, "benchmark").select("item_id", F.col("text").alias("content"), F.lit(0).alias("tokens"))
    return context.truncate(b, 60).select("item_id", "content")


@query(rf"SELECT item_id, len(list_intersect(list_distinct({words_sql('text')}), ['the', 'of', 'is'])) AS hits FROM benchmark WHERE len(list_intersect(list_distinct({words_sql('text')}), ['the', 'of', 'is'])) >= 1")
def flt_query_overlap(spark, d):
    from palimpsest.functions.text import word_set

    b = base.table(spark, d, "benchmark").withColumn("content", F.col("text"))
    hits = F.size(F.array_intersect(word_set(F.col("content")), F.array(F.lit("the"), F.lit("of"), F.lit("is")))).cast("bigint")
    return context.overlap(b, "the of is", 1).select("item_id", hits.alias("hits"))


@query(f"""{P}, asked AS (SELECT DISTINCT conv_id, lower(object) AS n FROM pfacts UNION SELECT DISTINCT conv_id, 'nobody' FROM pfacts)
SELECT a.conv_id, count(e.n) / count(*) AS recall FROM asked a LEFT JOIN (SELECT DISTINCT conv_id, lower(name) AS n FROM pents) e ON e.conv_id = a.conv_id AND e.n = a.n GROUP BY a.conv_id""")
def join_key_entity_recall(spark, d):
    m = base.people(spark, d)
    asked = m.facts.select("conv_id", F.col("object").alias("name")).unionByName(m.facts.select("conv_id", F.lit("nobody").alias("name"))).distinct()
    return evaluation.key_entity_recall(asked, m.entities)


@query("SELECT c_nationkey::VARCHAR AS cluster, arg_max(c_mktsegment, [n, -o]) AS name, max(i) AS importance FROM (SELECT c_nationkey, c_mktsegment, sum(c_custkey % 3) AS n, min(c_custkey) AS o, max(c_custkey % 7) / 7 AS i FROM customer GROUP BY 1, 2) GROUP BY 1")
def agg_canonical(spark, d):
    c = base.table(spark, d, "customer")
    mentions = F.transform(F.sequence(F.lit(1), F.greatest(F.col("c_custkey") % 3, F.lit(1)).cast("int")), lambda k: k)
    rows = c.select(F.col("c_nationkey").cast("string").alias("cluster"), F.col("c_custkey").cast("string").alias("ent_id"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("name"), F.array().cast("array<string>").alias("aliases"),
                    F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<int>")).otherwise(mentions).alias("mentions"), (F.col("c_custkey") % 7 / 7).alias("importance"))
    return merging.canonical(rows).select("cluster", "name", "importance")


_TOK = f"len({words_sql('content')}) * 13 // 10"


@query(f"""WITH {TURNS}, b AS (SELECT conv_id, turn, {_TOK} AS tokens, sum({_TOK}) OVER w AS used, row_number() OVER w AS k FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn FROM b WHERE (used <= 200 OR k = 1) AND used <= 150""")
def str_slid_buffer(spark, d):
    return buffers.slid(base.turns(spark, d), 200, 50).select("conv_id", "turn")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN 'tokyo' WHEN n_nationkey % 3 = 1 THEN lower(n_name) ELSE 'beijing' END AS cluster FROM nation")
def join_cross_lingual(spark, d):
    n = base.table(spark, d, "nation")
    name = F.when(F.col("n_nationkey") % 3 == 0, "北京").when(F.col("n_nationkey") % 3 == 1, F.col("n_name")).otherwise("Tokyo")
    got = multilang.cross_lingual(n.select(F.col("n_nationkey").alias("ent_id"), name.alias("name")), multilang.known_names(spark))
    return got.select(F.explode("ent_ids").alias("n_nationkey"), "cluster")


@query("SELECT doc_id, lower(lang)[1:2] AS code FROM documents")
def fn_language_code(spark, d):
    return base.table(spark, d, "documents").select("doc_id", lang.from_code(F.col("lang")).alias("code"))


@query(rf"""WITH {base.TALK}, {base.EXTRACTED}, n AS (SELECT conv_id, count(*) AS turns, sum(len({words_sql("role || ': ' || content")}) * 4 // 3)::BIGINT AS tokens FROM turns GROUP BY conv_id),
first AS (SELECT conv_id, name, ord, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS k FROM ents QUALIFY k <= 5),
called AS (SELECT conv_id, regexp_extract(content, '(?i)(?:I''m|my name is|I am) ([\p{{L}}\p{{N}}_]+)', 1) AS v, [0, turn] AS o FROM turns UNION ALL SELECT conv_id, name, [1, k] FROM first),
tops AS (SELECT conv_id, turn, regexp_extract_all(content, '(\b[A-Z][a-z]+(?:\s+[a-z]+)*\b)', 1)[1:2] AS l FROM turns),
topic AS (SELECT conv_id, unnest(l) AS v, [turn, unnest(range(len(l)))] AS o FROM tops),
point AS (SELECT conv_id, concat_ws(' ', subject, predicate, object) AS v, [ord] AS o FROM facts),
every AS (SELECT 'names' AS what, 5 AS most, * FROM called WHERE v <> '' UNION ALL SELECT 'topics', 3, * FROM topic UNION ALL SELECT 'points', 5, * FROM point),
kept AS (SELECT what, conv_id, v, min(o) AS o FROM every GROUP BY what, most, conv_id, v QUALIFY row_number() OVER (PARTITION BY what, conv_id ORDER BY min(o)) <= most),
l AS (SELECT n.*, coalesce(string_agg(v, ', ' ORDER BY o) FILTER (WHERE what = 'names'), 'participants') AS names, coalesce(string_agg(v, ', ' ORDER BY o) FILTER (WHERE what = 'topics'), 'various topics') AS topics,
  list('- ' || v ORDER BY o) FILTER (WHERE what = 'points') AS points FROM n LEFT JOIN kept USING (conv_id) GROUP BY ALL),
s AS (SELECT conv_id, tokens, 'executive' AS style, 'A ' || turns || '-turn conversation involving ' || names || ' discussing ' || topics || '.' AS summary FROM l
  UNION ALL SELECT conv_id, tokens, 'bullet', concat_ws(chr(10), '- Participants: ' || names, '- Topics: ' || topics, '- Duration: ' || turns || ' exchanges', array_to_string(points[1:3], chr(10))) FROM l
  UNION ALL SELECT conv_id, tokens, 'narrative', 'In this conversation, ' || names || ' engaged in a discussion about ' || topics || '. Over the course of ' || turns || ' exchanges, they covered various aspects of the topic.' || coalesce(' Key information shared includes: ' || points[1][3:] || '.', '') FROM l
  UNION ALL SELECT conv_id, tokens, 'detailed', 'Summary of conversation (' || turns || ' turns):' || chr(10) || 'Participants: ' || names || chr(10) || 'Main topics: ' || topics || chr(10) || coalesce('Key points:' || chr(10) || array_to_string(points[1:5], chr(10)), '') FROM l)
SELECT conv_id, style, summary, tokens AS original_tokens, len({words_sql('summary')}) * 4 // 3 AS summary_tokens FROM s""")
def fn_summaries(spark, d):
    t = base.talk(spark, d)
    out = None
    for style in ("executive", "bullet", "narrative", "detailed"):
        part = summaries.summarise(t, base.talked(spark, d), style).withColumn("style", F.lit(style))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{E} SELECT conv_id, count(*) AS n FROM sevents WHERE event_type = 'error' GROUP BY conv_id")
def agg_errors(spark, d):
    return base.stream_events(spark, d).events.filter("event_type = 'error'").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


# ---- topics, orders, hashes


_COMMON = ", ".join("'" + w.replace("'", "''") + "'" for w in TOPIC_STOPWORDS)


@query(rf"""WITH {TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns), e AS (SELECT conv_id, turn, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') AS ws FROM r WHERE back <= 5),
w AS (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM e), c AS (SELECT conv_id, word, count(*) AS n, min([turn, pos]) AS first FROM w WHERE length(word) > 2 AND word NOT IN ({_COMMON}) GROUP BY conv_id, word)
SELECT conv_id, word, n, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS rank FROM c QUALIFY rank <= 5""")
def agg_topics(spark, d):
    return passes.topics(base.turns(spark, d))


@query(f"{E} SELECT conv_id, evt_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, ord) AS at FROM sevents")
def win_events_in_order(spark, d):
    return base.stream_events(spark, d).events.select("conv_id", "evt_id", F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn, ord)").cast("bigint").alias("at"))


@query("SELECT p_partkey, md5(p_name) AS md5, sha256(p_name) AS sha256, substring(sha256(p_name), 1, 16) AS short FROM part")
def fn_hashes(spark, d):
    return base.table(spark, d, "part").select("p_partkey", F.md5("p_name").alias("md5"), F.sha2("p_name", 256).alias("sha256"), F.substring(F.sha2("p_name", 256), 1, 16).alias("short"))


@query("""SELECT DISTINCT md5(name) AS key, name FROM (SELECT p_name AS name FROM part UNION ALL SELECT s_name FROM supplier) WHERE md5(name) NOT IN (SELECT md5(p_name) FROM part WHERE p_partkey % 3 = 0)""")
def join_uncached(spark, d):
    """Different texts that a table of embeddings by hash lacks, each once."""
    part = base.table(spark, d, "part")
    asked = part.select(F.col("p_name").alias("name")).unionByName(base.table(spark, d, "supplier").select(F.col("s_name").alias("name"))).distinct().withColumn("key", F.md5("name"))
    return asked.join(part.filter("p_partkey % 3 = 0").select(F.md5("p_name").alias("key")).distinct(), "key", "left_anti").select("key", "name")


@query(f"""{E} SELECT o.conv_id, o.ord FROM sevents o LEFT JOIN (SELECT DISTINCT conv_id, lower(description) AS said FROM sevents WHERE turn % 2 = 0) k ON k.conv_id = o.conv_id AND k.said = lower(o.description) WHERE o.turn % 2 = 1 AND k.said IS NULL""")
def str_unseen(spark, d):
    """What a buffer's new half says that the old half did not, without regard to case."""
    e = base.stream_events(spark, d).events.withColumn("said", F.lower("description"))
    return e.filter("turn % 2 = 1").join(e.filter("turn % 2 = 0").select("conv_id", "said").distinct(), ["conv_id", "said"], "left_anti").select("conv_id", "ord")
