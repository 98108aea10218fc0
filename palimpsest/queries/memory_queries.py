"""Queries of extraction, passes, selection, merging, buffers and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import ir, plugins
from palimpsest.fixed import MARKDOWN_HEADERS, STRUCTURED_HEADERS, TOPIC_STOPWORDS
from palimpsest.functions import scores, similarity as sim
from palimpsest.functions.text import sentence
from palimpsest.operators import context, evaluation, extraction, folding, graph, merging, selection, temporal, versioning
from palimpsest.plans import compress, generation, passes
from palimpsest.queries import base
from palimpsest.queries.base import EVENTS, EXTRACTED, LEDGER, PEOPLE, TALK, TURNS, words_sql
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


C, T, P, E, L = f"WITH {TURNS}, {EXTRACTED}", f"WITH {TALK}, {EXTRACTED}", f"WITH {PEOPLE}", f"WITH {EVENTS}", f"WITH {LEDGER}"


# ---- the flagship: facts said in conversations and facts of the ledger, the latest of each


@query(f"""{C}, {LEDGER},
every AS (SELECT 'said' AS scope, conv_id, ord, subject, predicate, object, turn FROM facts UNION ALL SELECT 'ledger', conv_id, ord, subject, predicate, object, turn FROM ledger)
SELECT scope, conv_id, subject, predicate, object, turn FROM (
  SELECT *, row_number() OVER (PARTITION BY scope, conv_id, lower(subject), lower(predicate) ORDER BY turn DESC, ord) AS k FROM every) WHERE k = 1""")
def current_facts(spark: SparkSession, d: str) -> DataFrame:
    said, owed = extraction.facts(base.turns(spark, d)), base.ledger(spark, d)
    one = lambda f, scope: f.join(folding.superseded(f), ["conv_id", "fact_id"], "left_anti").select(
        F.lit(scope).alias("scope"), "conv_id", "subject", "predicate", "object", F.array_max("source_turns").cast("bigint").alias("turn"))
    return one(said, "said").unionByName(one(owed, "ledger"))


# ---- sources and extraction


@query(f"WITH {TURNS} SELECT * FROM turns")
def src_turns(spark, d):
    return base.turns(spark, d)


@query(f"WITH {TURNS} SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def src_last_turns(spark, d):
    return dialogues.last(base.turns(spark, d), 6)


@query(rf"""WITH {TURNS}, size AS (SELECT conv_id, sum(len({words_sql('content')}) * 4 // 3) AS tokens FROM turns GROUP BY conv_id)
SELECT t.conv_id, t.turn, t.role, t.content FROM turns t JOIN size USING (conv_id) WHERE tokens <= 300
UNION ALL SELECT conv_id, -1, 'system', 'summary of ' || conv_id FROM size WHERE tokens > 300
UNION ALL SELECT conv_id, turn, role, content FROM (SELECT t.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM turns t JOIN size USING (conv_id) WHERE tokens > 300) WHERE k <= 4""")
def src_chat_window(spark, d):
    t = base.turns(spark, d)
    summaries = t.select("conv_id").distinct().select("conv_id", F.concat(F.lit("summary of "), F.col("conv_id").cast("string")).alias("text"))
    return dialogues.chat_window(t, summaries, 300)


@query("""SELECT c_nationkey::BIGINT AS conv_id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, side) - 1)::INT AS turn, CASE side WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
  CASE side WHEN 0 THEN 'ask ' || c_custkey ELSE 'say ' || c_name END AS content FROM customer, (SELECT unnest([0, 1]) AS side)""")
def src_string_buffer(spark, d):
    c = base.table(spark, d, "customer")
    part = F.concat(F.lit("Human: ask "), F.col("c_custkey").cast("string"), F.lit("\nAI: say "), "c_name")
    buffer = c.groupBy(F.col("c_nationkey").cast("bigint").alias("conv_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", part.alias("p")))), lambda x: x["p"]), "\n").alias("buffer"))
    return dialogues.from_buffer(buffer)


@query(f"{C} SELECT conv_id, ord, name, type FROM ents")
def ext_entities(spark, d):
    return extraction.entities(base.turns(spark, d)).select("conv_id", "ord", "name", "type")


_FACTS = "SELECT conv_id, ord, subject, predicate, object, fact_type, confidence, turn FROM facts"


def _facts(f: DataFrame) -> DataFrame:
    return f.select("conv_id", "ord", "subject", "predicate", "object", "fact_type", "confidence", F.element_at("source_turns", 1).alias("turn"))


@query(f"{C} {_FACTS}")
def ext_facts(spark, d):
    return _facts(extraction.facts(base.turns(spark, d)))


@query(f"{T} {_FACTS}")
def ext_facts_of_talk(spark, d):
    return _facts(extraction.facts(base.talk(spark, d)))


@query(f"{C} SELECT conv_id, turn, event_type, description, [role] AS participants FROM evts")
def ext_events(spark, d):
    return extraction.events(base.turns(spark, d)).select("conv_id", "turn", "event_type", "description", "participants")


@query(f"{T} SELECT conv_id, turn, event_type, description, [role] AS participants FROM evts")
def ext_events_of_talk(spark, d):
    return extraction.events(base.talk(spark, d)).select("conv_id", "turn", "event_type", "description", "participants")


@query(f"{C} SELECT conv_id, ent, turn, stop FROM mentions")
def ext_mentions(spark, d):
    t = base.turns(spark, d)
    ents = extraction.entities(t)
    return extraction.mentions(extraction.facts(t), ents).join(ents.select("conv_id", "ent_id", F.col("ord").alias("ent")), ["conv_id", "ent_id"]).select("conv_id", "ent", "turn", F.col("end").alias("stop"))


@query(f"{T} SELECT conv_id, ord, 'entity' AS kind, round(importance, 9) AS importance FROM linked UNION ALL SELECT conv_id, ord, 'fact', round(importance, 9) FROM scored")
def ext_importance(spark, d):
    m = base.talked(spark, d)
    one = lambda df, kind: df.select("conv_id", "ord", F.lit(kind).alias("kind"), F.round("importance", 9).alias("importance"))
    return one(m.entities, "entity").unionByName(one(m.facts, "fact"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name FROM customer")
def ext_model_answers(spark, d):
    c = base.table(spark, d, "customer")
    said = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('Sure. ```json\n{"name": "'), "c_name", F.lit('"}\n``` done'))).otherwise("no json")
    return c.select(F.col("c_custkey").alias("id"), extraction.parse_model_answer(said, "name string")["name"].alias("name"))


# ---- filters and joins


@query(f"{P} SELECT conv_id, fact_id, trim(subject || CASE WHEN negated THEN ' not ' ELSE ' ' END || predicate || ' ' || object) AS said FROM pfacts WHERE lower(subject) = 'france' OR lower(object) = 'france' OR lower(object) = 'nation_3'")
def flt_facts_about(spark, d):
    f = base.people(spark, d).facts
    hit = ir.facts_about(f, "FRANCE").unionByName(ir.facts_about(f, "NATION_3"))
    return hit.select("conv_id", "fact_id", sentence(F.col("subject"), F.col("predicate"), F.col("object"), F.col("negated")).alias("said"))


@query(f"{E} SELECT conv_id, ord, turn, event_type FROM sevents WHERE turn BETWEEN 3 AND 7 AND event_type = 'error'")
def flt_events_in_range(spark, d):
    return base.stream_events(spark, d).events.filter(F.col("turn").between(3, 7) & (F.col("event_type") == "error")).select("conv_id", "ord", "turn", "event_type")


_DEAD = """best AS (SELECT conv_id, n, max(importance) AS best FROM (SELECT conv_id, lower(subject) AS n, importance FROM pfacts UNION ALL SELECT conv_id, lower(object), importance FROM pfacts) GROUP BY conv_id, n),
dead AS (SELECT e.conv_id, e.ent_id, e.name FROM pents e LEFT JOIN best b ON b.conv_id = e.conv_id AND b.n = lower(e.name)
  WHERE NOT (e.refs > 1 OR coalesce(40 - e.last_turn <= 10, false) OR coalesce(b.best > 0.7, false) OR (e.type IN ('person', 'organization', 'project') AND e.refs >= 1))),
dead_facts AS (SELECT f.conv_id, f.fact_id FROM pfacts f WHERE EXISTS (SELECT 1 FROM dead d WHERE d.conv_id = f.conv_id AND lower(d.name) IN (lower(f.subject), lower(f.object)))
  OR (f.confidence < 0.5 AND 40 - f.turn > 10))"""


@query(f"{P}, {_DEAD} SELECT conv_id, ent_id FROM dead")
def flt_dead_entities(spark, d):
    return passes.dead_entities(base.people(spark, d))


@query(f"{P}, {_DEAD} SELECT conv_id, fact_id FROM dead_facts")
def flt_dead_facts(spark, d):
    m = base.people(spark, d)
    return passes.dead_facts(m, passes.dead_entities(m))


@query(f"{P}, {_DEAD} SELECT f.conv_id, f.fact_id FROM pfacts f LEFT JOIN dead_facts x USING (conv_id, fact_id) WHERE x.fact_id IS NULL")
def pass_dead_memory(spark, d):
    return passes.dead_memory(base.people(spark, d)).facts.select("conv_id", "fact_id")


@query(f"{L} SELECT conv_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, ord) AS k FROM ledger) WHERE k > 1")
def agg_superseded(spark, d):
    f = base.ledger(spark, d)
    return folding.superseded(f).join(f.select("conv_id", "fact_id", "ord"), ["conv_id", "fact_id"]).select("conv_id", "ord")


@query(f"{L} SELECT a.conv_id, a.ord AS a, b.ord AS b FROM ledger a JOIN ledger b ON a.conv_id = b.conv_id AND a.ord < b.ord AND a.object <> b.object")
def join_contradictions(spark, d):
    f = base.ledger(spark, d).withColumn("predicate", F.lit("is"))
    o = lambda n: f.select("conv_id", F.col("fact_id").alias(n), F.col("ord").alias(f"o{n}"))
    return folding.contradictions(f).join(o("a"), ["conv_id", "a"]).join(o("b"), ["conv_id", "b"]).select("conv_id", F.col("oa").alias("a"), F.col("ob").alias("b"))


@query(f"{P}, i AS (SELECT conv_id, lower(name) AS n, arg_max(ent_id, ord) AS e FROM pents GROUP BY conv_id, lower(name)) SELECT f.conv_id, least(a.e, b.e) AS a, greatest(a.e, b.e) AS b, count(*) AS weight FROM pfacts f JOIN i a ON a.conv_id = f.conv_id AND a.n = lower(f.subject) JOIN i b ON b.conv_id = f.conv_id AND b.n = lower(f.object) GROUP BY 1, 2, 3")
def join_entity_graph(spark, d):
    m = base.people(spark, d)
    return graph.edges(m.facts, m.entities)


@query(f"{P}, {_DEAD}, i AS (SELECT e.* FROM pents e JOIN dead USING (conv_id, ent_id)) SELECT conv_id, fact_id FROM pfacts f WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.conv_id = f.conv_id AND i.name IN (f.subject, f.object))")
def join_cascade_delete(spark, d):
    m = base.people(spark, d)
    return ir.remove_entities(m, passes.dead_entities(m)).facts.select("conv_id", "fact_id")


def _customer_relations(spark, d) -> DataFrame:
    li = base.table(spark, d, "lineitem")
    kinds = F.element_at(F.array(*map(F.lit, ("before", "causes", "equivalent", "elaborates", "similar"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return ir.conform(li.select((F.col("l_orderkey") % 100).cast("bigint").alias("conv_id"), F.concat_ws("_", F.lit("rel"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("rel_id"), F.col("l_partkey").cast("string").alias("src"),
                                F.col("l_suppkey").cast("string").alias("dst"), kinds.alias("rtype"), F.lit(1.0).alias("confidence"), (F.col("l_linenumber") % 2 == 0).alias("bidirectional")), "relations")


_REL = "rel AS (SELECT (l_orderkey % 100)::BIGINT AS conv_id, 'rel_' || l_orderkey || '_' || l_linenumber AS rel_id, l_partkey::VARCHAR AS src, l_suppkey::VARCHAR AS dst, ['before', 'causes', 'equivalent', 'elaborates', 'similar'][(l_linenumber % 5 + 1)::INT] AS rtype, l_linenumber % 2 = 0 AS bidirectional FROM lineitem)"


@query(f"WITH {_REL} SELECT conv_id, src AS fact_id, dst AS other FROM rel UNION SELECT conv_id, dst, src FROM rel")
def join_neighbours(spark, d):
    return ir.neighbours(_customer_relations(spark, d))


@query(f"WITH {_REL} SELECT conv_id, src, dst, rtype, count(*) AS n FROM (SELECT conv_id, src, dst, rtype FROM rel UNION ALL SELECT conv_id, dst, src, rtype FROM rel WHERE bidirectional) GROUP BY ALL")
def join_both_ways(spark, d):
    return ir.both_ways(_customer_relations(spark, d)).groupBy("conv_id", "src", "dst", "rtype").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_REL} SELECT conv_id, rel_id || '_inv' AS rel_id, dst AS src, src AS dst, CASE rtype WHEN 'before' THEN 'after' WHEN 'causes' THEN 'caused_by' WHEN 'elaborates' THEN 'summarizes' ELSE 'related' END AS rtype,
  CASE WHEN rtype = 'before' THEN 'temporal' WHEN rtype = 'causes' THEN 'causal' ELSE 'semantic' END AS family FROM rel""")
def fn_inverse_relation(spark, d):
    return ir.inverse(_customer_relations(spark, d)).select("conv_id", "rel_id", "src", "dst", "rtype", ir.family(F.col("was")).alias("family"))


_SIM = f"""w AS (SELECT conv_id, ord, subject, predicate, object, list_distinct({words_sql("concat_ws(' ', subject, predicate, object)")}) AS ws FROM facts),
pairs AS (SELECT a.conv_id, a.ord AS a, b.ord AS b, CASE WHEN lower(a.subject) = lower(b.subject) AND lower(a.predicate) = lower(b.predicate) AND lower(a.object) = lower(b.object) THEN 1.0
    ELSE least(1.0, len(list_intersect(a.ws, b.ws))::DOUBLE / len(list_distinct(list_concat(a.ws, b.ws))) + CASE WHEN lower(a.subject) = lower(b.subject) THEN 0.2 ELSE 0 END + CASE WHEN lower(a.predicate) = lower(b.predicate) THEN 0.1 ELSE 0 END) END AS similarity
  FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.ord < b.ord)"""


def _ords(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    o = lambda n: facts.select("conv_id", F.col("fact_id").alias(n), F.col("ord").alias(f"o{n}"))
    return pairs.join(o("a"), ["conv_id", "a"]).join(o("b"), ["conv_id", "b"]).select("conv_id", F.col("oa").alias("a"), F.col("ob").alias("b"), F.round("similarity", 9).alias("similarity"))


@query(f"{C}, {_SIM} SELECT conv_id, a, b, round(similarity, 9) AS similarity FROM pairs WHERE similarity >= 0.4")
def join_similar_facts(spark, d):
    f = extraction.facts(base.turns(spark, d))
    return _ords(folding.similar_pairs(f, 0.4), f)


@query(f"""WITH RECURSIVE {TURNS}, {EXTRACTED}, {_SIM}, e AS (SELECT conv_id, a, b FROM pairs WHERE similarity >= 0.4 UNION SELECT conv_id, b, a FROM pairs WHERE similarity >= 0.4),
reach AS (SELECT conv_id, a, a AS r FROM e UNION SELECT reach.conv_id, e.b, reach.r FROM reach JOIN e ON e.conv_id = reach.conv_id AND e.a = reach.a)
SELECT conv_id, a AS ord, min(r) AS root FROM reach GROUP BY conv_id, a""")
def agg_similar_groups(spark, d):
    f = folding.materialised(extraction.facts(base.turns(spark, d)))
    got = folding.fold_groups(f, folding.similar_pairs(f, 0.4))
    o = lambda n, to: f.select("conv_id", F.col("fact_id").alias(n), F.col("ord").alias(to))
    return got.join(o("fact_id", "ord"), ["conv_id", "fact_id"]).join(o("root", "rord"), ["conv_id", "root"]).select("conv_id", "ord", F.col("rord").alias("root"))


@query(f"""WITH RECURSIVE {TURNS}, {EXTRACTED}, {_SIM}, e AS (SELECT conv_id, a, b FROM pairs WHERE similarity >= 0.5 UNION SELECT conv_id, b, a FROM pairs WHERE similarity >= 0.5),
reach AS (SELECT conv_id, a, a AS r FROM e UNION SELECT reach.conv_id, e.b, reach.r FROM reach JOIN e ON e.conv_id = reach.conv_id AND e.a = reach.a), roots AS (SELECT conv_id, a AS ord, min(r) AS root FROM reach GROUP BY conv_id, a)
SELECT conv_id, subject, predicate, object FROM facts f LEFT JOIN roots USING (conv_id, ord) QUALIFY root IS NULL OR row_number() OVER (PARTITION BY conv_id, root ORDER BY confidence DESC, ord) = 1""")
def pass_fold_facts(spark, d):
    return passes.fold_facts(passes.checkpointed(base.memory(spark, d)), 0.5).facts.select("conv_id", "subject", "predicate", "object")


@query("""WITH l AS (SELECT o_custkey::BIGINT AS conv_id, o_orderkey, o_orderstatus, o_orderpriority AS p, 0.5 + (o_orderkey % 5) / 10 AS confidence FROM orders)
SELECT conv_id, o_orderstatus AS object, max(confidence) AS confidence, arg_max(o_orderkey, [confidence, o_orderkey]) AS winner FROM l GROUP BY conv_id, o_orderstatus""")
def agg_surest_facts(spark, d):
    f = base.ledger(spark, d).withColumn("memory", F.lit(0))
    return merging.surest_facts(f).select("conv_id", "object", "confidence", (-F.col("ord")).alias("winner"))


@query(f"{P} SELECT conv_id, count(*) AS entities, (SELECT count(*) FROM pfacts f WHERE f.conv_id = e.conv_id) AS facts, 0 AS relations, 0 AS events, 0 AS sequences FROM pents e GROUP BY conv_id")
def agg_stats(spark, d):
    return generation.summary_table(base.people(spark, d)).select("conv_id", *[F.col(c).cast("bigint").alias(c) for c in ("entities", "facts", "relations", "events", "sequences")])


@query(f"{P} SELECT conv_id, type, count(*) AS n FROM pents GROUP BY ROLLUP (conv_id, type)")
def agg_types(spark, d):
    return base.people(spark, d).entities.rollup("conv_id", "type").agg(F.count(F.lit(1)).alias("n"))


@query(f"{C} SELECT conv_id, ent AS ord, count(*) AS refs, min(turn) AS first_turn, max(turn) AS last_turn FROM mentions GROUP BY conv_id, ent")
def agg_mentions(spark, d):
    m = F.col("mentions")
    return base.memory(spark, d).entities.filter(F.size("mentions") > 0).select("conv_id", "ord", ir.refs(m).cast("bigint").alias("refs"), ir.first_turn(m).alias("first_turn"), ir.last_turn(m).alias("last_turn"))


# ---- events


_RUNS = f"""prev AS (SELECT *, lag(turn) OVER w AS pt, lag(event_type) OVER w AS pe, lag(participant) OVER w AS pp, lag(description) OVER w AS pd FROM sevents WINDOW w AS (PARTITION BY conv_id ORDER BY turn, ord)),
bags AS (SELECT *, list_filter(list_distinct({words_sql('description')}), lambda x: x NOT IN ('the', 'a', 'an', 'is', 'was', 'were', 'are', 'been', 'be', 'to')) AS x, list_filter(list_distinct({words_sql("coalesce(pd, '')")}), lambda x: x NOT IN ('the', 'a', 'an', 'is', 'was', 'were', 'are', 'been', 'be', 'to')) AS y FROM prev),
cut AS (SELECT *, CASE WHEN coalesce(turn - pt <= 5 AND (pp = participant OR (pe = event_type AND len(list_intersect(x, y)) * 2 >= len(list_distinct(list_concat(x, y))))
  OR (least(pe, event_type), greatest(pe, event_type)) IN (('answer', 'question'), ('error', 'resolution'), ('completion', 'request'), ('action', 'state_change'))), false) THEN 0 ELSE 1 END AS c FROM bags),
runs AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM cut)"""


@query(f"{E}, {_RUNS} SELECT conv_id, ord, run FROM runs")
def win_event_runs(spark, d):
    return temporal.event_runs(base.stream_events(spark, d).events).select("conv_id", "ord", "run")


@query(f"{E}, {_RUNS} SELECT conv_id, run, count(*) AS n, min(turn) AS start_turn, max(turn) AS end_turn, max(turn) - min(turn) AS duration, round(sum(importance), 6) AS total_importance, list_sort(list(DISTINCT participant)) AS participants FROM runs GROUP BY conv_id, run HAVING count(*) >= 3")
def agg_sequences(spark, d):
    s = temporal.compress(base.stream_events(spark, d)).sequences
    return temporal.sequence_facts(s).join(s.select("conv_id", "seq_id", F.col("ord").alias("run")), ["conv_id", "seq_id"]).select(
        "conv_id", "run", F.col("n").cast("bigint").alias("n"), "start_turn", "end_turn", "duration", F.round("total_importance", 6).alias("total_importance"), "participants")


@query(f"""{E}, {_RUNS}, per AS (SELECT conv_id, run, event_type, count(*) AS n, min(turn) AS first FROM runs GROUP BY ALL)
SELECT conv_id, run, arg_max(event_type, [n, -first]) AS dominant FROM per GROUP BY conv_id, run HAVING sum(n) >= 3""")
def agg_dominant_type(spark, d):
    s = temporal.compress(base.stream_events(spark, d)).sequences
    return s.select("conv_id", F.col("ord").alias("run"), temporal.dominant(F.transform("events", lambda e: e["event_type"])).alias("dominant"))


@query(f"{E}, {_RUNS} SELECT conv_id, ord FROM runs QUALIFY count(*) OVER (PARTITION BY conv_id, run) < 3")
def pass_temporal_compression(spark, d):
    return temporal.compress(base.stream_events(spark, d)).events.select("conv_id", "ord")


@query(f"""{E}, {_RUNS}, per AS (SELECT conv_id, run, event_type, count(*) AS n, min(turn) AS first FROM runs GROUP BY ALL),
g AS (SELECT conv_id, run, sum(n)::BIGINT AS n, arg_max(event_type, [n, -first]) AS top, coalesce(sum(n) FILTER (WHERE event_type = 'question'), 0)::BIGINT AS asked, coalesce(sum(n) FILTER (WHERE event_type = 'answer'), 0) AS answers FROM per GROUP BY conv_id, run HAVING sum(n) >= 3),
w AS (SELECT conv_id, run, min(turn) AS a, max(turn) AS z, array_to_string(list_sort(list(DISTINCT participant))[1:3], ', ') AS who FROM runs GROUP BY conv_id, run)
SELECT conv_id, run AS ord, CASE WHEN top = 'question' AND answers > 0 THEN 'Q&A exchange with ' || asked || ' questions answered' WHEN top = 'question' THEN 'Discussion with ' || asked || ' questions'
  WHEN top = 'error' THEN 'Encountered ' || (SELECT sum(p.n)::BIGINT FROM per p WHERE p.conv_id = g.conv_id AND p.run = g.run AND p.event_type = 'error') || ' issues' WHEN top = 'action' THEN 'Series of ' || n || ' actions involving ' || who
  WHEN top = 'completion' THEN 'Completed ' || n || ' tasks' ELSE 'Sequence of ' || n || ' ' || top || ' events (turns ' || a || '-' || z || ')' END AS summary,
  CASE WHEN top IN ('question', 'answer') THEN 'qa_exchange' ELSE top || '_sequence' END AS sequence_type FROM g JOIN w USING (conv_id, run)""")
def fn_sequence_summaries(spark, d):
    return temporal.compress(base.stream_events(spark, d)).sequences.select("conv_id", "ord", "summary", "sequence_type")


_PHASES = f"""size AS (SELECT conv_id, count(*) AS n, greatest(5, count(*) // 5) AS size FROM sevents GROUP BY conv_id),
ph AS (SELECT conv_id, n, size, unnest(range(((n - 1) // size + 1)::BIGINT)) AS phase FROM size)"""


@query(f"""{E}, {_PHASES} SELECT ph.conv_id, ph.phase, count(s.ord) AS n_events, round(0.4 * coalesce(sum(importance), 0) + 0.4 * (ph.phase + 1) / max((n - 1) // ph.size + 1), 6) AS score
FROM ph LEFT JOIN sevents s ON s.conv_id = ph.conv_id AND s.turn // ph.size = ph.phase GROUP BY ph.conv_id, ph.phase""")
def agg_phase_scores(spark, d):
    return temporal.phase_scores(base.stream_events(spark, d)).select("conv_id", F.col("phase").cast("bigint").alias("phase"), "n_events", F.round("score", 6).alias("score"))


@query(f"""{E}, {_PHASES}, s AS (SELECT ph.conv_id, ph.phase, ph.n, ph.phase * ph.size AS start, count(s.ord) AS k, coalesce(max(s.turn), 0) AS last, coalesce(sum(importance), 0) * 0.4::DOUBLE + (ph.phase + 1) / ((ph.n - 1) // ph.size + 1) * 0.4::DOUBLE AS score
  FROM ph LEFT JOIN sevents s ON s.conv_id = ph.conv_id AND s.turn // ph.size = ph.phase GROUP BY ph.conv_id, ph.phase, ph.n, ph.size),
b AS (SELECT *, sum(k) OVER (PARTITION BY conv_id) AS total, coalesce(sum(greatest(k - 1, 0)) OVER (PARTITION BY conv_id ORDER BY round(score, 12), phase ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
c AS (SELECT *, n >= 10 AND k >= 2 AND total - before > floor(total * 0.7::DOUBLE) AS picked FROM b)
SELECT conv_id, sum(CASE WHEN picked THEN 1 ELSE k END)::BIGINT AS n, max(CASE WHEN picked THEN start ELSE last END)::INT AS last FROM c WHERE k > 0 GROUP BY conv_id""")
def pass_phase_compression(spark, d):
    return temporal.compress_phases(base.stream_events(spark, d)).events.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))


# ---- importance and budgets


@query(f"""{E}, n AS (SELECT conv_id, count(*) AS n FROM sevents GROUP BY conv_id)
SELECT conv_id, ord, round(turn / n * 0.3 + 0.1 + CASE event_type WHEN 'question' THEN 0.5 WHEN 'answer' THEN 0.6 WHEN 'completion' THEN 0.8 WHEN 'error' THEN 0.7 ELSE 0.7 END * 0.2, 9) AS importance FROM sevents JOIN n USING (conv_id)""")
def fn_event_importance(spark, d):
    m = base.stream_events(spark, d)
    e = m.events.join(ir.turn_counts(m.turns), "conv_id")
    return e.select("conv_id", "ord", F.round(scores.event_importance(F.col("turn"), F.col("num_turns"), F.col("participants"), F.col("event_type")), 9).alias("importance"))


@query(f"""{T} SELECT conv_id, sum(15 + len({words_sql('name')})) AS entities, (SELECT sum(20 + len({words_sql("concat_ws(' ', subject, predicate, object)")})) FROM facts f WHERE f.conv_id = e.conv_id) AS facts,
  (SELECT sum(25 + len({words_sql('description')})) FROM evts v WHERE v.conv_id = e.conv_id) AS events FROM ents e GROUP BY conv_id""")
def agg_token_costs(spark, d):
    u = passes.units(base.talked(spark, d))
    pick = lambda k: F.sum(F.when(F.col("kind") == k, F.col("weight")))
    return u.groupBy("conv_id").agg(pick(0).alias("entities"), pick(1).alias("facts"), pick(2).alias("events"))


@query(f"""{T}, n AS (SELECT conv_id, (SELECT count(*) FROM ents e WHERE e.conv_id = t.conv_id) AS e, (SELECT count(DISTINCT type) FROM ents e WHERE e.conv_id = t.conv_id) AS ty,
  (SELECT count(*) FROM facts f WHERE f.conv_id = t.conv_id) AS f, (SELECT count(*) FROM evts v WHERE v.conv_id = t.conv_id) AS v FROM (SELECT DISTINCT conv_id FROM turns) t),
c AS (SELECT conv_id, least(1.0, least(1.0, e / 20) * 0.25 + least(1.0, f / 50) * 0.3 + least(1.0, v / 40) * 0.15 + ty / 10 * 0.1) AS complexity FROM n)
SELECT conv_id, round(complexity, 9) AS complexity, floor(round(CASE WHEN complexity > 0.7 THEN least(1.5, 1 + complexity - 0.7) ELSE greatest(0.5, complexity / 0.7) END * 2048, 6))::INT AS budget FROM c""")
def agg_complexity(spark, d):
    return passes.complexity(base.talked(spark, d)).select("conv_id", F.round("complexity", 9).alias("complexity"), "budget")


@query(f"""{P.replace("WITH ", "WITH RECURSIVE ", 1)}, i AS (SELECT conv_id, lower(name) AS n, arg_max(ent_id, ord) AS e FROM pents GROUP BY 1, 2),
g AS (SELECT f.conv_id, least(a.e, b.e) AS a, greatest(a.e, b.e) AS b, count(*) AS w FROM pfacts f JOIN i a ON a.conv_id = f.conv_id AND a.n = lower(f.subject) JOIN i b ON b.conv_id = f.conv_id AND b.n = lower(f.object) WHERE a.e <> b.e GROUP BY ALL),
linkd AS (SELECT conv_id, a AS src, b AS dst, w FROM g UNION ALL SELECT conv_id, b, a, w FROM g),
share AS (SELECT conv_id, src, dst, w / sum(w) OVER (PARTITION BY conv_id, src) AS p FROM linkd),
nodes AS (SELECT conv_id, ent_id AS node, count(*) OVER (PARTITION BY conv_id) AS n, (conv_id, ent_id) NOT IN (SELECT (conv_id, src) FROM linkd) AS loose FROM (SELECT DISTINCT conv_id, ent_id FROM pents)),
ranks AS (SELECT 0 AS k, conv_id, node, 1.0::DOUBLE / n AS r FROM nodes
  UNION ALL SELECT m.k + 1, n.conv_id, n.node, 0.85::DOUBLE * (coalesce(s.got, 0) + m.lost / n.n) + 0.15::DOUBLE / n.n FROM nodes n
  JOIN (SELECT k, conv_id, sum(CASE WHEN loose THEN r ELSE 0 END) AS lost FROM ranks JOIN nodes USING (conv_id, node) WHERE k < 30 GROUP BY k, conv_id) m ON m.conv_id = n.conv_id
  LEFT JOIN (SELECT r.conv_id, h.dst AS node, sum(r.r * h.p) AS got FROM ranks r JOIN share h ON h.conv_id = r.conv_id AND h.src = r.node GROUP BY 1, 2) s ON s.conv_id = n.conv_id AND s.node = n.node)
SELECT conv_id, node, round(r, 6) AS centrality FROM ranks WHERE k = 30""")
def agg_pagerank(spark, d):
    m = base.people(spark, d)
    return graph.centrality(m.facts, m.entities, 30).select("conv_id", "node", F.round("centrality", 6).alias("centrality"))


@query(f"""{P}, i AS (SELECT conv_id, lower(name) AS n, arg_max(ent_id, ord) AS e FROM pents GROUP BY 1, 2), g AS (SELECT DISTINCT f.conv_id, least(a.e, b.e) AS a, greatest(a.e, b.e) AS b FROM pfacts f JOIN i a ON a.conv_id = f.conv_id AND a.n = lower(f.subject) JOIN i b ON b.conv_id = f.conv_id AND b.n = lower(f.object)),
n AS (SELECT conv_id, count(*) AS n FROM pents GROUP BY 1), dg AS (SELECT conv_id, node, count(*) AS k FROM (SELECT conv_id, a AS node FROM g UNION ALL SELECT conv_id, b FROM g) GROUP BY ALL)
SELECT conv_id, ent_id AS node, round(coalesce(k, 0) / (n - 1), 9) AS centrality FROM pents JOIN n USING (conv_id) LEFT JOIN dg ON dg.conv_id = pents.conv_id AND dg.node = ent_id""".replace("SELECT conv_id, ent_id AS node", "SELECT pents.conv_id, ent_id AS node"))
def agg_degree_centrality(spark, d):
    m = base.people(spark, d)
    nodes = m.entities.select("conv_id", F.col("ent_id").alias("node"))
    return graph.degree_centrality(nodes, graph.edges(m.facts, m.entities)).select("conv_id", "node", F.round("centrality", 9).alias("centrality"))


def _parts(spark, d) -> DataFrame:
    p = base.table(spark, d, "part")
    return p.select("p_brand", F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").cast("bigint").alias("ord"), F.col("p_retailprice").alias("value"), F.col("p_size").alias("weight"), F.col("p_partkey").alias("k"))


_FOLD = """s AS (SELECT p_brand, list(struct_pack(id := p_partkey, cost := p_size) ORDER BY {order}) AS items FROM part GROUP BY p_brand),
r AS (SELECT p_brand, list_reduce(list_prepend(struct_pack(used := 0::BIGINT, ids := []::BIGINT[], id := 0::BIGINT, cost := 0::BIGINT), list_transform(items, lambda i: struct_pack(used := 0::BIGINT, ids := []::BIGINT[], id := i.id::BIGINT, cost := i.cost::BIGINT))),
  lambda a, x: CASE WHEN a.used + x.cost <= 100 THEN struct_pack(used := a.used + x.cost, ids := list_append(a.ids, x.id), id := 0::BIGINT, cost := 0::BIGINT) ELSE a END) AS acc FROM s)
SELECT p_brand, unnest(acc.ids)::VARCHAR AS id FROM r"""


@query("WITH " + _FOLD.format(order="p_retailprice DESC, p_partkey"))
def win_greedy(spark, d):
    return selection.greedy(_parts(spark, d), "p_brand", "id", "weight", [-F.col("value"), F.col("ord")], F.lit(100))


@query("WITH " + _FOLD.format(order="p_retailprice / greatest(1, p_size) DESC, p_partkey"))
def win_greedy_by_ratio(spark, d):
    return selection.greedy(_parts(spark, d), "p_brand", "id", "weight", [selection.by_ratio("value", "weight"), F.col("ord")], F.lit(100))


def _knapsack_sql(items: str, out: str) -> str:
    """The best choices for each budget up to 100, item by item; an item is taken where it improves."""
    start, keep = "struct_pack(v := 0::BIGINT, w := 0::BIGINT, n := 0::BIGINT, value := 0::DOUBLE)", "own[b - i.w + 1]"
    return f"""WITH RECURSIVE {items}, best AS (SELECT p_brand, 0::BIGINT AS k, list_transform(range(101), lambda b: {start}) AS own FROM (SELECT DISTINCT p_brand FROM it)
  UNION ALL SELECT i.p_brand, i.k, list_transform(range(101), lambda b: CASE WHEN b >= i.w AND {keep}.v + i.v > own[b + 1].v
    THEN struct_pack(v := {keep}.v + i.v, w := {keep}.w + i.w, n := {keep}.n + 1, value := {keep}.value + i.value) ELSE own[b + 1] END) FROM best JOIN it i ON i.p_brand = best.p_brand AND i.k = best.k + 1)
SELECT p_brand, {out} FROM best QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY k DESC) = 1"""


@query(_knapsack_sql("it AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, p_size::BIGINT AS w, trunc(p_retailprice * 1000::DOUBLE)::BIGINT AS v, p_retailprice AS value FROM part)",
                     "own[101].w AS weight, round(own[101].value, 2) AS value"))
def win_knapsack(spark, d):
    p = _parts(spark, d)
    kept = selection.knapsack_by_group(p.withColumn("budget", F.lit(100)), "p_brand")
    return kept.join(p, ["p_brand", "id"]).groupBy("p_brand").agg(F.sum("weight").alias("weight"), F.round(F.sum("value"), 2).alias("value"))


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def win_top_k(spark, d):
    return selection.top_k(_parts(spark, d), 3, [F.desc("value"), F.col("ord")], "p_brand").select("p_brand", F.col("k").alias("p_partkey"))


def _items(spark, d) -> DataFrame:
    p = base.table(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, ("fact", "entity", "summary", "event"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_brand", F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").cast("bigint").alias("ord"), F.col("p_name").alias("content"), F.col("p_size").alias("tokens"), (F.col("p_partkey") * 7 % 101 / 101).alias("importance"),
                    (F.col("p_partkey") * 11 % 103 / 103).alias("recency"), (F.col("p_partkey") * 13 % 107 / 107).alias("relevance"), kind.alias("item_type"))


_ITEMS = "items AS (SELECT p_brand, p_partkey::VARCHAR AS id, p_partkey AS ord, p_name AS content, p_size AS tokens, (p_partkey * 7 % 101) / 101 AS importance, (p_partkey * 11 % 103) / 103 AS recency, (p_partkey * 13 % 107) / 107 AS relevance, ['fact', 'entity', 'summary', 'event'][(p_partkey % 4 + 1)::INT] AS item_type FROM part)"


@query(f"""WITH {_ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, item_type ORDER BY importance DESC, ord) AS round, min(ord) OVER (PARTITION BY p_brand, item_type) AS first FROM items)
SELECT p_brand, id FROM r QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round, first) <= 6""")
def win_diverse(spark, d):
    return selection.diverse(_items(spark, d), 6, "p_brand").select("p_brand", "id")


@query(f"""WITH {_ITEMS}, b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY importance DESC, ord) - 1 AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM items)
SELECT p_brand, id, CASE WHEN r < n // 2 THEN r * 2 ELSE (n - 1 - r) * 2 + 1 END::INT AS place FROM b WHERE r < n // 2 OR r >= n - n // 2""")
def win_interleaved(spark, d):
    return selection.reorder(_items(spark, d), "interleaved", "p_brand").select("p_brand", "id", "place")


@query(f"WITH {_ITEMS} SELECT p_brand, id, sum(tokens) OVER (PARTITION BY p_brand ORDER BY importance DESC, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM items QUALIFY used <= 60")
def win_prefix(spark, d):
    return selection.prefix_within(_items(spark, d), F.col("tokens"), [F.desc("importance"), F.col("ord")], 60, "p_brand").select("p_brand", "id", F.col("used").cast("bigint").alias("used"))


@query(f"WITH {_ITEMS} SELECT p_brand, id, id = '7' AS must FROM items WHERE id = '7' OR (importance >= 0.2 AND recency >= 0.3 AND item_type IN ('fact', 'entity'))")
def flt_select(spark, d):
    return selection.select(_items(spark, d), must=("7",), importance=0.2, recency=0.3, include=("fact", "entity")).select("p_brand", "id", "must")


def _pack_sql(order: str) -> str:
    return f"WITH {_ITEMS}, " + _FOLD.format(order=order).replace("p_partkey, cost := p_size", "id, cost := tokens").replace("FROM part", "FROM items")


@query(_pack_sql("importance * 0.4 + recency * 0.3 + relevance * 0.3 DESC, ord"))
def ctx_pack_balanced(spark, d):
    return context.pack(_items(spark, d), "balanced", 100, "p_brand").select("p_brand", "id")


@query(_pack_sql("relevance DESC, importance DESC, ord"))
def ctx_pack_query_focused(spark, d):
    return context.pack(_items(spark, d), "query_focused", 100, "p_brand").select("p_brand", "id")


@query(_pack_sql("CASE item_type WHEN 'summary' THEN 1 WHEN 'entity' THEN 2 WHEN 'fact' THEN 3 ELSE 4 END, importance DESC, ord"))
def ctx_pack_hierarchical(spark, d):
    return context.pack(_items(spark, d), "hierarchical", 100, "p_brand").select("p_brand", "id")


@query(_knapsack_sql(f"{_ITEMS}, it AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY ord) AS k, tokens::BIGINT AS w, trunc((importance + recency + relevance) / 3 * 1000)::BIGINT AS v, importance AS value FROM items)",
                     "own[101].w AS tokens, own[101].n AS n"))
def ctx_pack_knapsack(spark, d):
    return context.pack(_items(spark, d), "knapsack", 100, "p_brand").groupBy("p_brand").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))


@query(rf"""{P}, top AS (SELECT conv_id, coalesce(nullif(max(t), 0), 1) AS top FROM (SELECT conv_id, last_turn AS t FROM pents UNION ALL SELECT conv_id, turn FROM pfacts) GROUP BY conv_id)
SELECT conv_id, 'entity:' || ent_id AS id, name || ' (' || type || ')' AS content, len({words_sql("name || ' (' || type || ')'")}) * 13 // 10 AS tokens, round(coalesce(last_turn / top, 0.5), 9) AS recency, 'entity' AS item_type FROM pents JOIN top USING (conv_id)
UNION ALL SELECT conv_id, 'fact:' || fact_id, concat_ws(' ', subject, predicate, object), len({words_sql("concat_ws(' ', subject, predicate, object)")}) * 13 // 10, round(coalesce(nullif(turn, 0) / top, 0.5), 9), 'fact' FROM pfacts JOIN top USING (conv_id)""")
def ctx_items(spark, d):
    return context.items(base.people(spark, d)).select("conv_id", "id", "content", "tokens", F.round("recency", 9).alias("recency"), "item_type")


def _header_sql(table: dict[str, str]) -> str:
    return "CASE item_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@query(f"""WITH {_ITEMS}, best AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY importance DESC, ord) <= 8),
kinds AS (SELECT p_brand, item_type, min(ord) AS first, string_agg('• ' || content, chr(10) ORDER BY ord) AS dots, string_agg('- ' || content, chr(10) ORDER BY ord) AS dashes,
  string_agg('    <' || item_type || '>' || replace(replace(content, '<', '&lt;'), '>', '&gt;') || '</' || item_type || '>', chr(10) ORDER BY ord) AS tags FROM best GROUP BY p_brand, item_type)
SELECT p_brand, 'plain' AS form, string_agg(content, chr(10) ORDER BY ord) AS text FROM best GROUP BY p_brand
UNION ALL SELECT p_brand, 'json', '{{"context":{{"additional":"","items":' || to_json(list(struct_pack(type := item_type, content := content, importance := importance) ORDER BY ord))::VARCHAR || '}}}}' FROM best GROUP BY p_brand
UNION ALL SELECT p_brand, 'structured', '=== Relevant Context ===' || chr(10) || string_agg(chr(10) || '--- ' || {_header_sql(STRUCTURED_HEADERS)} || ' ---' || chr(10) || dots, chr(10) ORDER BY first) || chr(10) || chr(10) || '=== End Context ===' FROM kinds GROUP BY p_brand
UNION ALL SELECT p_brand, 'xml', '<context>' || chr(10) || string_agg('  <' || item_type || 's>' || chr(10) || tags || chr(10) || '  </' || item_type || 's>', chr(10) ORDER BY first) || chr(10) || '</context>' FROM kinds GROUP BY p_brand
UNION ALL SELECT p_brand, 'markdown', '## Relevant Context' || chr(10) || chr(10) || string_agg({_header_sql(MARKDOWN_HEADERS)} || chr(10) || dashes || chr(10), chr(10) ORDER BY first) FROM kinds GROUP BY p_brand""")
def ctx_render(spark, d):
    things = selection.top_k(_items(spark, d), 8, [F.desc("importance"), F.col("ord")], "p_brand")
    out = None
    for form in ("plain", "structured", "xml", "markdown", "json"):
        part = context.render(things, form, "p_brand").withColumn("form", F.lit(form))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {_ITEMS}, l AS (SELECT p_brand, list([struct_pack(id := id, words := list_distinct({words_sql('content')}), score := importance)] ORDER BY ord) AS l FROM items GROUP BY p_brand),
r AS (SELECT p_brand, list_reduce(l, lambda a, x: list_transform([list_filter(range(1, len(a) + 1), lambda k: len(list_intersect(a[k].words, x[1].words)) * 2 >= len(list_distinct(list_concat(a[k].words, x[1].words))))[1]],
  lambda k: CASE WHEN k IS NULL THEN list_concat(a, x) WHEN x[1].score > a[k].score THEN list_concat(list_concat(list_filter(a, lambda y, j: j < k), list_filter(a, lambda y, j: j > k)), x) ELSE a END)[1]) AS r FROM l)
SELECT p_brand, unnest(list_transform(r, lambda x: x.id)) AS id, unnest(range(len(r)))::INT AS place FROM r""")
def win_near_duplicates(spark, d):
    return selection.near_duplicates(_items(spark, d), "p_brand", 0.5)


@query()
def pass_importance_pruning(spark, d):
    m = passes.checkpointed(base.memory(spark, d))
    return passes.counts(passes.prune(m, 400, rounds=20)).filter("part in ('entities', 'facts', 'events')")


@query()
def pass_adaptive_pruning(spark, d):
    m = passes.checkpointed(base.talked(spark, d))
    return passes.counts(passes.prune_adaptive(m, rounds=10)).filter("part in ('entities', 'facts', 'events')")


_COMMON = ", ".join("'" + w.replace("'", "''") + "'" for w in TOPIC_STOPWORDS)
_PREDICTED = rf"""{T}, best AS (SELECT conv_id, name, least(1::DOUBLE, refs * 0.1::DOUBLE) AS importance, row_number() OVER (PARTITION BY conv_id ORDER BY importance DESC, ord) AS rank FROM linked QUALIFY rank <= 5),
ends AS (SELECT DISTINCT conv_id, unnest([lower(subject), lower(object)]) AS n FROM facts),
recent AS (SELECT conv_id, turn, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') AS ws FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5),
met AS (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM recent),
tops AS (SELECT conv_id, word, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min([turn, pos])) AS rank FROM met WHERE length(word) > 2 AND word NOT IN ({_COMMON}) GROUP BY conv_id, word QUALIFY rank <= 5),
asked AS (SELECT conv_id, turn, unnest(l) AS q, unnest(range(len(l))) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(content, '([^.!?]*\?)', 1)[1:2] AS l FROM turns WHERE role = 'user' AND contains(content, '?')) t),
likely AS (SELECT conv_id, 'What is ' || name || '?' AS query, importance * 0.8::DOUBLE AS relevance, 'entity_info' AS query_type, name AS target, [0, rank, 0] AS seq FROM best
  UNION ALL SELECT conv_id, 'What do we know about ' || name || '?', importance * 0.7::DOUBLE, 'entity_facts', name, [0, rank, 1] FROM best WHERE (conv_id, lower(name)) IN (SELECT (conv_id, n) FROM ends)
  UNION ALL SELECT conv_id, 'What about ' || word || '?', least(1::DOUBLE, n * 0.15::DOUBLE), 'topic', NULL, [1, rank, 0] FROM tops
  UNION ALL SELECT conv_id, trim(q), 0.6::DOUBLE, 'follow_up', NULL, [2, turn, pos] FROM asked),
once AS (SELECT * FROM likely QUALIFY row_number() OVER (PARTITION BY conv_id, lower(query) ORDER BY seq) = 1),
predicted AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY relevance DESC, seq) <= 10)"""


@query(f"{_PREDICTED} SELECT conv_id, query, round(relevance, 9) AS relevance, query_type FROM predicted")
def pass_query_prediction(spark, d):
    return passes.predict(base.talked(spark, d)).select("conv_id", "query", F.round("relevance", 9).alias("relevance"), "query_type")


@query(f"""{_PREDICTED}, we AS (SELECT e.conv_id, e.ord, CASE WHEN lower(q.target) = lower(e.name) THEN 1::DOUBLE ELSE least(1::DOUBLE, CASE WHEN contains(lower(q.query), lower(e.name)) THEN 0.8::DOUBLE ELSE 0 END
    + CASE WHEN len(list_intersect({words_sql('e.name')}, {words_sql('q.query')})) > 0 THEN 0.5::DOUBLE ELSE 0 END) END * q.relevance AS r FROM ents e JOIN predicted q USING (conv_id)),
ge AS (SELECT conv_id, ord FROM we GROUP BY conv_id, ord HAVING max(r) < 0.3),
wf AS (SELECT f.conv_id, f.ord, least(1::DOUBLE, CASE WHEN contains(lower(f.subject), lower(q.target)) THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN contains(lower(f.object), lower(q.target)) THEN 0.3::DOUBLE ELSE 0 END
    + least(0.4::DOUBLE, len(list_intersect(list_distinct({words_sql("concat_ws(' ', f.subject, f.predicate, f.object)")}), list_distinct({words_sql('q.query')}))) * 0.1::DOUBLE)) * q.relevance AS r FROM facts f JOIN predicted q USING (conv_id)),
dead AS (SELECT conv_id, name AS n FROM ents JOIN ge USING (conv_id, ord)),
gf AS (SELECT conv_id, ord FROM wf GROUP BY conv_id, ord HAVING max(r) < 0.3 UNION SELECT f.conv_id, f.ord FROM facts f JOIN dead d ON d.conv_id = f.conv_id AND d.n IN (f.subject, f.object))
SELECT conv_id, 'entities' AS part, count(*) AS n FROM ents e ANTI JOIN ge USING (conv_id, ord) GROUP BY conv_id UNION ALL SELECT conv_id, 'facts', count(*) FROM facts f ANTI JOIN gf USING (conv_id, ord) GROUP BY conv_id""")
def pass_query_pruning(spark, d):
    return passes.counts(passes.prune_by_queries(passes.checkpointed(base.talked(spark, d)))).filter("part in ('entities', 'facts')")


@query()
def plan_compress(spark, d):
    return compress.compress(base.turns(spark, d), {"budget": 400, "rounds": 10})


_STRUCTURED = f"""{P}, ends AS (SELECT conv_id, lower(subject) AS n, importance, ord, predicate || ' ' || object AS said FROM pfacts UNION ALL SELECT conv_id, lower(object), importance, ord, predicate || ' ' || object FROM pfacts),
tops AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY conv_id, n ORDER BY importance DESC, ord) = 1),
r AS (SELECT e.*, coalesce(nullif(concat_ws('; ', nullif(e.type, 'other'), said), ''), 'mentioned in conversation') AS said, list_position([{", ".join(f"'{t}'" for t in generation.SHOWN_TYPES)}], e.type) AS place,
  row_number() OVER (PARTITION BY e.conv_id, e.type ORDER BY e.importance DESC, e.ord) AS k FROM pents e LEFT JOIN tops t ON t.conv_id = e.conv_id AND t.n = lower(e.name)),
el AS (SELECT conv_id, 0 AS place, 0 AS k, '## Key Entities' AS line FROM pents GROUP BY conv_id UNION ALL SELECT DISTINCT conv_id, place, 0, chr(10) || '### ' || upper(type[1]) || type[2:] || 's' FROM r UNION ALL SELECT conv_id, place, k, '- **' || name || '**: ' || said FROM r WHERE k <= 10),
subjects AS (SELECT conv_id, subject, row_number() OVER (PARTITION BY conv_id ORDER BY sum(importance) DESC, -max(importance), min(ord)) AS place FROM pfacts GROUP BY conv_id, subject QUALIFY place <= 15),
fr AS (SELECT *, row_number() OVER (PARTITION BY conv_id, subject ORDER BY importance DESC, ord) AS k FROM pfacts),
fl AS (SELECT conv_id, 0 AS place, 0 AS k, '## Key Information' AS line FROM pfacts GROUP BY conv_id UNION ALL SELECT conv_id, place, 0, chr(10) || '**' || subject || ':**' FROM subjects
  UNION ALL SELECT conv_id, place, k, '- ' || predicate || ' ' || object FROM fr JOIN subjects USING (conv_id, subject) WHERE k <= 5),
parts AS (SELECT conv_id, 0 AS p, string_agg(line, chr(10) ORDER BY place, k) AS text FROM el GROUP BY conv_id UNION ALL SELECT conv_id, 1, string_agg(line, chr(10) ORDER BY place, k) FROM fl GROUP BY conv_id),
whole AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY p) AS text FROM parts GROUP BY conv_id)"""


@query(f"{_STRUCTURED} SELECT conv_id, text FROM whole")
def gen_structured(spark, d):
    return generation.structured(base.people(spark, d))


@query(f"""{P}, e AS (SELECT conv_id, name, row_number() OVER (PARTITION BY conv_id ORDER BY importance DESC, ord) AS k FROM pents),
f AS (SELECT conv_id, importance, ord, CASE WHEN negated THEN subject || ' does not ' || predicate || ' ' || object || '.' WHEN fact_type = 'attribute' THEN subject || ' has ' || predicate || ' of ' || object || '.' ELSE subject || ' ' || predicate || ' ' || object || '.' END AS said FROM pfacts),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY importance DESC, ord) AS k FROM f WHERE importance >= 0.4 AND importance < 0.7),
names AS (SELECT conv_id, list(name ORDER BY k) AS l FROM e WHERE k <= 5 GROUP BY conv_id),
l AS (SELECT conv_id, 0 AS s, 'This conversation involves ' || CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[-1] END || '.' AS line FROM names
  UNION ALL SELECT conv_id, 1, string_agg(said, ' ' ORDER BY importance DESC, ord) FROM f WHERE importance >= 0.7 GROUP BY conv_id
  UNION ALL SELECT conv_id, 2, 'Additionally, ' || string_agg(said, ' ' ORDER BY k) FROM m WHERE k <= 10 GROUP BY conv_id)
SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY s) AS text FROM l GROUP BY conv_id""")
def gen_narrative(spark, d):
    return generation.narrative(base.people(spark, d))


@query(f"""{P}, e AS (SELECT conv_id, name, row_number() OVER (PARTITION BY conv_id ORDER BY importance DESC, ord) AS k FROM pents), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY importance DESC, ord) AS k FROM pfacts),
l AS (SELECT conv_id, 0 AS s, 0 AS k, '• Participants: ' || string_agg(name, ', ' ORDER BY k) AS line FROM e WHERE k <= 5 GROUP BY conv_id
  UNION ALL SELECT conv_id, 1, k, '• ' || subject || CASE WHEN negated THEN ' not ' ELSE ' ' END || predicate || ' ' || object FROM f WHERE k <= 15)
SELECT conv_id, string_agg(line, chr(10) ORDER BY s, k) AS text FROM l GROUP BY conv_id""")
def gen_bullets(spark, d):
    return generation.bullets(base.people(spark, d))


@query(f"""{P}, e AS (SELECT conv_id, to_json(list(struct_pack(name := name, type := type, importance := round(importance, 3)) ORDER BY ord))::VARCHAR AS e FROM pents GROUP BY conv_id),
f AS (SELECT conv_id, to_json(list(struct_pack(subject := subject, predicate := predicate, object := object, confidence := confidence, importance := round(importance, 3)) ORDER BY ord))::VARCHAR AS f FROM pfacts GROUP BY conv_id)
SELECT conv_id, '{{' || concat_ws(',', '"entities":' || e, '"facts":' || f) || '}}' AS text FROM e FULL JOIN f USING (conv_id)""")
def gen_json(spark, d):
    return generation.as_json(base.people(spark, d))


@query(f"""{_STRUCTURED.replace("WITH ", "WITH RECURSIVE ", 1)}, en AS (SELECT conv_id, list('- **' || name || '**' ORDER BY importance DESC, ord) AS e FROM pents GROUP BY conv_id),
fn AS (SELECT conv_id, list('- ' || subject || CASE WHEN negated THEN ' not ' ELSE ' ' END || predicate || ' ' || object ORDER BY importance DESC, ord) AS f FROM pfacts GROUP BY conv_id),
tries AS (SELECT conv_id, 0 AS k, text, length(text) // 4 AS tokens FROM whole
  UNION ALL SELECT conv_id, k + 1, said, length(said) // 4 FROM (SELECT conv_id, k, tokens, concat_ws(chr(10) || chr(10), '## Key Entities' || chr(10) || array_to_string(e[1:greatest(3, floor(200::DOUBLE / tokens * 10))::BIGINT], chr(10)),
    '## Key Information' || chr(10) || array_to_string(f[1:greatest(5, floor(200::DOUBLE / tokens * 20))::BIGINT], chr(10))) AS said FROM tries LEFT JOIN en USING (conv_id) LEFT JOIN fn USING (conv_id)) t
  WHERE k < 5 AND tokens > CASE WHEN k = 0 THEN 200 ELSE 220 END)
SELECT conv_id, text, tokens FROM tries QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1""")
def gen_adaptive(spark, d):
    return generation.adaptive(base.people(spark, d), budget=200)


# ---- merging, versions


def _two(spark, d) -> DataFrame:
    f = base.ledger(spark, d)
    return f.withColumn("memory", (F.col("ord") % 2 == 0).cast("int"))


@query(f"{L} SELECT conv_id, object, min(ord) AS ord FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END AS memory FROM ledger) GROUP BY conv_id, object, memory QUALIFY row_number() OVER (PARTITION BY conv_id, object ORDER BY memory) = 1")
def set_union_facts(spark, d):
    return merging.union_facts(_two(spark, d)).select("conv_id", "object", "ord")


@query(f"{L} SELECT conv_id, object, min(ord) AS ord FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END AS memory FROM ledger) GROUP BY conv_id, object, memory QUALIFY row_number() OVER (PARTITION BY conv_id, object ORDER BY memory DESC) = 1")
def set_latest_facts(spark, d):
    return merging.union_facts(_two(spark, d), latest=True).select("conv_id", "object", "ord")


@query(f"{L} SELECT conv_id, object FROM (SELECT *, ord % 2 AS memory FROM ledger) GROUP BY conv_id, object HAVING count(DISTINCT memory) = 2")
def set_intersection_facts(spark, d):
    return merging.in_all(_two(spark, d), 2).select("conv_id", "object")


@query(f"""{L}, f AS (SELECT *, CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END AS memory FROM ledger)
SELECT a.conv_id, a.ord AS a, b.ord AS b, CASE WHEN a.object = b.object THEN 'duplicate_fact' ELSE 'contradictory_facts' END AS conflict, a.memory <> b.memory AS "cross" FROM f a JOIN f b ON a.conv_id = b.conv_id AND (a.memory, a.ord) < (b.memory, b.ord)""")
def join_fact_conflicts(spark, d):
    f = _two(spark, d).withColumn("predicate", F.lit("has name"))
    o = lambda n: f.select("conv_id", F.col("fact_id").alias(n), F.col("ord").alias(f"o{n}"))
    return merging.fact_conflicts(f).join(o("a"), ["conv_id", "a"]).join(o("b"), ["conv_id", "b"]).select("conv_id", F.col("oa").alias("a"), F.col("ob").alias("b"), "conflict", "cross")


@query(f"{T} SELECT conv_id, lower(name) AS lname, list_sort(list(DISTINCT type)) AS types FROM ents GROUP BY 1, 2 HAVING count(DISTINCT type) > 1")
def join_type_conflicts(spark, d):
    return merging.type_conflicts(base.talked(spark, d).entities)


@query("""SELECT s_nationkey::BIGINT AS conv_id, a.s_suppkey::VARCHAR AS a, b.c_custkey::VARCHAR AS b FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey AND right(a.s_name, 4) = right(b.c_name, 4)""")
def join_resolve_entities(spark, d):
    none = F.array().cast("array<string>")
    s = base.table(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("conv_id"), F.col("s_suppkey").cast("string").alias("ent_id"), F.col("s_suppkey").cast("bigint").alias("ord"), F.substring("s_name", -4, 4).alias("name"), F.lit("person").alias("type"), none.alias("aliases"))
    c = base.table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("conv_id"), F.col("c_custkey").cast("string").alias("ent_id"), F.col("c_custkey").cast("bigint").alias("ord"), F.substring("c_name", -4, 4).alias("name"), F.lit("person").alias("type"), none.alias("aliases"))
    return _exact(s, c)


def _exact(s: DataFrame, c: DataFrame) -> DataFrame:
    pairs = merging.candidates(s, c, 0.999, equal=True).join(s.select("conv_id", F.col("ent_id").alias("a"), F.col("name").alias("na")), ["conv_id", "a"]).join(c.select("conv_id", F.col("ent_id").alias("b"), F.col("name").alias("nb")), ["conv_id", "b"])
    return pairs.filter("na = nb").select("conv_id", "a", "b")


@query(f"{P} SELECT conv_id, 'entities' AS part, count(DISTINCT lower(name)) AS n FROM pents GROUP BY conv_id UNION ALL SELECT conv_id, 'facts', count(DISTINCT lower(concat_ws('|', subject, predicate, object))) FROM pfacts GROUP BY conv_id")
def set_union_merge(spark, d):
    m = base.people(spark, d)
    half = lambda k: m.with_(entities=m.entities.filter(F.col("ord") % 3 != k), facts=m.facts.filter(F.col("ord") % 3 != k))
    return passes.counts(merging.merge([half(0), half(1)], "union")).filter("part in ('entities', 'facts')")


@query(f"""{P}, a AS (SELECT * FROM pents WHERE type = 'location' AND ord % 3 <> 0), b AS (SELECT * FROM pents WHERE type = 'location' AND ord % 3 <> 1), fb AS (SELECT * FROM pfacts WHERE ord % 3 <> 1)
SELECT conv_id, 'entity' AS part, coalesce(a.name, lower(b.name)) AS name, CASE WHEN a.name IS NOT NULL AND b.name IS NOT NULL THEN lower(b.name) ELSE '' END AS aliases, round(greatest(coalesce(a.importance, 0), coalesce(b.importance + 0.01, 0)), 9) AS importance FROM a FULL JOIN b USING (conv_id, ent_id)
UNION ALL SELECT conv_id, 'fact', subject, '', round(CASE WHEN ord % 3 = 1 THEN confidence ELSE confidence + 0.05 END, 9) FROM pfacts""")
def set_smart_merge(spark, d):
    m = base.people(spark, d)
    places = m.entities.filter("type = 'location'")
    one = m.with_(entities=places.filter("ord % 3 != 0"), facts=m.facts.filter("ord % 3 != 0"))
    two = m.with_(entities=places.filter("ord % 3 != 1").withColumns({"name": F.lower("name"), "type": F.lit("concept"), "importance": F.col("importance") + 0.01}),
                  facts=m.facts.filter("ord % 3 != 1").withColumn("confidence", F.col("confidence") + 0.05))
    got = merging.merge([one, two], "smart")
    row = lambda df, part, name, aliases, score: df.select("conv_id", F.lit(part).alias("part"), F.col(name).alias("name"), aliases.alias("aliases"), F.round(score, 9).alias("importance"))
    return row(got.entities, "entity", "name", F.array_join("aliases", ","), "importance").unionByName(row(got.facts, "fact", "subject", F.lit(""), "confidence"))


def _edited(spark, d) -> ir.Memory:
    m = base.people(spark, d)
    f = m.facts.filter(F.col("ord") % 10 != 0).withColumn("object", F.when(F.col("ord") % 10 == 1, "ELSEWHERE").otherwise(F.col("object")))
    return m.with_(facts=f)


@query(f"{P} SELECT conv_id, 'facts' AS item_type, fact_id AS item_id, CASE WHEN ord % 10 = 0 THEN 'remove' ELSE 'modify' END AS operation FROM pfacts WHERE ord % 10 IN (0, 1)")
def set_diff(spark, d):
    return versioning.diff(base.people(spark, d), _edited(spark, d))


@query(f"{P} SELECT 'facts' AS item_type, 0::BIGINT AS \"add\", count(*) FILTER (WHERE ord % 10 = 0) AS remove, count(*) FILTER (WHERE ord % 10 = 1) AS modify FROM pfacts")
def agg_diff_summary(spark, d):
    return versioning.diff_summary(versioning.diff(base.people(spark, d), _edited(spark, d)))


@query(f"{P} SELECT conv_id, fact_id, CASE WHEN ord % 10 = 1 THEN 'ELSEWHERE' ELSE object END AS object FROM pfacts WHERE ord % 10 <> 0")
def set_patch(spark, d):
    old, new = base.people(spark, d), _edited(spark, d)
    return versioning.patch(old, versioning.diff(old, new), new).facts.select("conv_id", "fact_id", "object")


@query(f"{P} SELECT 'entity' AS type, ent_id AS id, name AS content, importance FROM pents UNION ALL SELECT 'fact', fact_id, concat_ws(' ', subject, predicate, object), importance FROM pfacts")
def src_export_rows(spark, d):
    return stores.export_rows(base.people(spark, d))


@query("SELECT o_custkey AS key, max(o_orderdate) AS updated_at FROM orders GROUP BY o_custkey")
def src_upsert(spark, d):
    o = base.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("updated_at"), "o_orderkey")
    return stores.latest(o).select("key", "updated_at")


_GRAPH = f"""{P}, i AS (SELECT conv_id, lower(name) AS n, arg_max(ent_id, ord) AS e FROM pents GROUP BY 1, 2),
ed AS (SELECT f.conv_id, f.fact_id AS a, i.e AS b, 'subject' AS label FROM pfacts f JOIN i ON i.conv_id = f.conv_id AND i.n = lower(f.subject) UNION ALL SELECT f.conv_id, f.fact_id, i.e, 'object' FROM pfacts f JOIN i ON i.conv_id = f.conv_id AND i.n = lower(f.object)),
nd AS (SELECT conv_id, ent_id AS id, name AS label, 'entity' AS kind FROM pents UNION ALL SELECT conv_id, fact_id, concat_ws(' ', subject, predicate, object), 'fact' FROM pfacts)"""


@query(f"""{_GRAPH}, l AS (SELECT conv_id, 0 AS s, id AS a, '' AS b, '  "' || id || '" [label="' || replace(label, '"', '\\"') || '"];' AS line FROM nd UNION ALL SELECT conv_id, 1, a, b, '  "' || a || '" -> "' || b || '" [label="' || label || '"];' FROM ed)
SELECT conv_id, 'digraph memory {{' || chr(10) || string_agg(line, chr(10) ORDER BY s, a, b, line) || chr(10) || '}}' AS text FROM l GROUP BY conv_id""")
def src_graph_dot(spark, d):
    return stores.dot(base.people(spark, d))


# ---- evaluation


@query(f"{P} SELECT conv_id, count(*) FILTER (WHERE ord % 4 <> 0) / count(*) AS recall, count(*) FILTER (WHERE ord % 4 = 0) AS missed FROM pfacts GROUP BY conv_id")
def join_fact_recall(spark, d):
    f = base.people(spark, d).facts
    return evaluation.fact_recall(f, f.filter(F.col("ord") % 4 != 0), 0.95).select("conv_id", "recall", "missed")


@query(f"{P} SELECT conv_id, count(DISTINCT lower(name)) FILTER (WHERE type = 'person') / count(DISTINCT lower(name)) AS recall FROM pents GROUP BY conv_id")
def join_entity_recall(spark, d):
    e = base.people(spark, d).entities
    return evaluation.entity_recall(e, e.filter("type = 'person'"))


@query("""SELECT o_orderpriority AS config, count(*) AS n, round(avg(o_totalprice / 1000), 6) AS mean_ratio, round(stddev_pop(o_totalprice / 1000), 6) AS std_ratio, round(coalesce(avg(CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 3) / 3 END), 0), 6) AS mean_fact_recall,
  floor(avg(o_orderkey % 50))::BIGINT AS mean_tokens_saved FROM orders GROUP BY o_orderpriority""")
def agg_evaluation(spark, d):
    o = base.table(spark, d, "orders").select(F.col("o_orderpriority").alias("config"), (F.col("o_totalprice") / 1000).alias("ratio"), (F.col("o_orderkey") % 3 / 3).alias("fact_recall"), F.lit(1.0).alias("entity_recall"), (F.col("o_orderkey") % 50).alias("tokens_saved"))
    a = evaluation.aggregate(o, "config")
    return a.select("config", "n", F.round("mean_ratio", 6).alias("mean_ratio"), F.round("std_ratio", 6).alias("std_ratio"), F.round("mean_fact_recall", 6).alias("mean_fact_recall"), "mean_tokens_saved")


@query("""WITH s AS (SELECT l_shipmode AS k, 1 AS x FROM (SELECT l_returnflag AS l_shipmode FROM lineitem)), v AS (SELECT l_returnflag AS k, list_sort(list(l_quantity)) AS v, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k AS l_returnflag, n AS "count", v[(floor(n * 0.5) + 1)::BIGINT] AS p50, v[(floor(n * 0.95) + 1)::BIGINT] AS p95, v[(floor(n * 0.99) + 1)::BIGINT] AS p99 FROM v""".replace("s AS (SELECT l_shipmode AS k, 1 AS x FROM (SELECT l_returnflag AS l_shipmode FROM lineitem)), ", ""))
def agg_histogram(spark, d):
    return evaluation.histogram(base.table(spark, d, "lineitem"), "l_quantity", "l_returnflag").select("l_returnflag", "count", "p50", "p95", "p99")


@query(f"""{T} SELECT conv_id, turn, 'What is the user''s name?' AS question, regexp_extract(content, '(?i)my name is ([\\p{{L}}\\p{{N}}_]+)', 1) AS answer FROM turns WHERE regexp_extract(content, '(?i)my name is ([\\p{{L}}\\p{{N}}_]+)', 1) <> ''
UNION ALL SELECT conv_id, turn, 'Where does the user work?', trim(regexp_extract(content, '(?i)I work (?:at|for) ([^.]+)', 1)) FROM turns WHERE regexp_extract(content, '(?i)I work (?:at|for) ([^.]+)', 1) <> ''""")
def fn_qa_pairs(spark, d):
    return evaluation.qa_pairs(base.talk(spark, d))


@query("""WITH RECURSIVE p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS x, list_reverse(string_split(lower(p_name), ' ')) AS y FROM part),
lcs AS (SELECT p_partkey, 0 AS i, list_transform(range(len(y) + 1), lambda j: 0::BIGINT) AS own FROM p
  UNION ALL SELECT p.p_partkey, i + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda j: [j]), lambda acc, j: list_append(acc, CASE WHEN x[i + 1] = y[j[1]] THEN own[j[1]] + 1 ELSE greatest(own[j[1] + 1], acc[j[1]]) END), [0::BIGINT])
  FROM lcs JOIN p USING (p_partkey) WHERE i < len(x))
SELECT p.p_partkey, 2.0::DOUBLE * own[-1] / (len(x) + len(y)) AS rouge_l FROM lcs JOIN p USING (p_partkey) WHERE i = len(x)""")
def fn_rouge(spark, d):
    p = base.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("reference"), F.reverse(F.split("p_name", " ")).alias("r"))
    return evaluation.rouge_l(p.withColumn("candidate", F.array_join("r", " "))).select("p_partkey", "rouge_l")


# ---- buffers


_TOK = f"len({words_sql('content')}) * 13 // 10"


@query(f"WITH {TURNS} SELECT conv_id, turn FROM (SELECT *, sum({_TOK}) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM turns) WHERE used <= 200 OR k = 1")
def str_token_buffer(spark, d):
    return buffers.within_tokens(base.turns(spark, d), 200).select("conv_id", "turn")


@query(f"""WITH {TURNS}, k AS (SELECT conv_id, {_TOK} AS tokens, sum({_TOK}) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM turns)
SELECT conv_id, sum(tokens)::BIGINT AS tokens, round(least(1.0, sum(tokens) / 200), 6) AS utilisation, greatest(0, 200 - sum(tokens))::BIGINT AS remaining FROM k WHERE used <= 200 OR k = 1 GROUP BY conv_id""")
def str_utilisation(spark, d):
    used = buffers.utilisation(base.turns(spark, d), 200)
    return used.select("conv_id", F.col("tokens").cast("bigint").alias("tokens"), F.round("utilisation", 6).alias("utilisation"), F.greatest(F.lit(0), 200 - F.col("tokens")).cast("bigint").alias("remaining"))


@query(f"WITH {TURNS} SELECT conv_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS text FROM (SELECT *, sum({_TOK}) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM turns) WHERE used <= 300 GROUP BY conv_id")
def str_recent_context(spark, d):
    return buffers.recent_context(base.turns(spark, d), 300)


@query(f"WITH {TURNS}, b AS (SELECT conv_id, turn // 5 AS batch, count(*) AS turns, sum({_TOK})::BIGINT AS tokens FROM turns GROUP BY 1, 2), u AS (SELECT *, floor(sum(tokens) OVER (PARTITION BY conv_id ORDER BY batch) / 200) AS step FROM b) SELECT conv_id, batch, turns, tokens, step > coalesce(lag(step) OVER (PARTITION BY conv_id ORDER BY batch), 0) AS compress FROM u")
def str_micro_batches(spark, d):
    return buffers.micro_batches(base.turns(spark, d), 5, 200)


@query(f"""{E}, l AS (SELECT conv_id, list([struct_pack(priority := importance, ord := ord, id := evt_id)] ORDER BY ord) AS l FROM sevents GROUP BY conv_id),
r AS (SELECT conv_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(a) < 5 THEN list_sort(list_concat(a, x)) WHEN x[1].priority > a[1].priority THEN list_sort(list_concat(a[2:], x)) ELSE a END)) AS e FROM l)
SELECT conv_id, e.id AS id, e.priority AS priority FROM r""")
def str_priority_buffer(spark, d):
    e = base.stream_events(spark, d).events
    return buffers.by_priority(e.select("conv_id", "ord", F.col("evt_id").alias("id"), F.col("importance").alias("priority")), 5)


@query(f"""{C}, e AS (SELECT conv_id, (ord // 4294967296)::INT AS turn, CASE WHEN row_number() OVER (PARTITION BY conv_id, lower(name) ORDER BY ord) = 1 THEN 'entity_added' ELSE 'entity_updated' END AS event, name AS item FROM ents)
SELECT * FROM e UNION ALL SELECT conv_id, min(turn), 'fact_added', lower(concat_ws('|', subject, predicate, object)) FROM facts GROUP BY conv_id, lower(concat_ws('|', subject, predicate, object))""")
def str_changes(spark, d):
    t = base.turns(spark, d)
    return buffers.changes(extraction.entities(t), extraction.facts(t))


@query(f"WITH {TURNS}, n AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1), s AS (SELECT conv_id, unnest(list_distinct(list_append(range(3, n + 1, 3), n))) AS upto FROM n) SELECT conv_id, upto, turn FROM turns JOIN s USING (conv_id) WHERE turn < upto")
def str_prefixes(spark, d):
    return compress.prefixes(base.turns(spark, d), 3).select("conv_id", "upto", "turn")


@query(rf"""WITH {TURNS}, w AS (SELECT conv_id, turn, len({words_sql('content')}) AS n, len(regexp_extract_all(content, '\b[0-9]{{1,2}}[/-][0-9]{{1,2}}\b')) AS dates, regexp_extract_all(content, '([\p{{L}}\p{{N}}_]+)', 1) AS ws FROM turns),
d AS (SELECT conv_id, turn, CASE WHEN n = 0 THEN 0 ELSE (dates + len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Z][a-z]+$'))) + len(list_filter(ws, lambda w: regexp_matches(w, '^[0-9]+$')))) / n END AS density FROM w),
m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, avg(density) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean FROM d)
SELECT conv_id, turn, round(CASE WHEN n < 5 THEN 0.5 WHEN mean > 0.15 THEN 0.3 WHEN mean < 0.05 THEN 0.7 ELSE 0.7 - (mean - 0.05) * 4 END, 6) AS ratio FROM m""")
def str_adaptive_ratio(spark, d):
    return buffers.adaptive_ratio(base.turns(spark, d)).select("conv_id", "turn", F.round("ratio", 6).alias("ratio"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str_windowed_counts(spark, d):
    e = base.table(spark, d, "events")
    got = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return got.select(F.col("window.start").alias("day"), "event_type", "n", "total")


# ---- plugins


@query(f"{P} SELECT conv_id, fact_id FROM pfacts WHERE confidence >= 0.5")
def udf_filter_low_confidence(spark, d):
    return plugins.filter_low_confidence(base.people(spark, d)).facts.select("conv_id", "fact_id")


@query(f"{P}, t AS (SELECT conv_id, lower(name) AS n FROM pents QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY importance DESC, ord) <= 10) SELECT conv_id, fact_id FROM pfacts f WHERE EXISTS (SELECT 1 FROM t WHERE t.conv_id = f.conv_id AND t.n IN (lower(f.subject), lower(f.object)))")
def udf_entity_centric(spark, d):
    return plugins.entity_centric(base.people(spark, d)).facts.select("conv_id", "fact_id")


@query("SELECT s_suppkey, round(CASE WHEN s_suppkey % 2 = 0 THEN 0.4 ELSE 0.2 END + 0.3 + CASE WHEN s_suppkey % 3 = 0 THEN 0.3 ELSE 0.0 END, 6) AS similarity FROM supplier")
def fn_recall_similarity(spark, d):
    s = base.table(spark, d, "supplier")
    a = F.struct(F.col("s_name").alias("subject"), F.lit("works at").alias("predicate"), F.lit("Acme").alias("object")).alias("a")
    b = F.struct(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit(" Jr"))).alias("subject"), F.lit("works at").alias("predicate"), F.when(F.col("s_suppkey") % 3 == 0, "acme").otherwise("Other").alias("object")).alias("b")
    return s.select("s_suppkey", a, b).select("s_suppkey", F.round(sim.recall_similarity("a", "b"), 6).alias("similarity"))
