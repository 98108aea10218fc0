"""Queries of retrieval, languages and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.fixed import LANGUAGE_MARKERS, STOPWORDS
from palimpsest.functions import lang, scores, similarity as sim
from palimpsest.operators import multilang, retrieval
from palimpsest.queries import base
from palimpsest.queries.base import EXTRACTED, TALK, TURNS, words_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_KEYS = r"list_filter(regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}_]+)', 1), lambda w: regexp_matches(w, '^[a-z0-9]+$') AND length(w) > 1 AND w NOT IN ({1}))"


def _keys(x: str) -> str:
    return _KEYS.format(x, _STOP)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return base.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_BM25 = rf"""toks AS (SELECT doc_id, {_keys("coalesce(text, '')")} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
post AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM toks), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM post GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_keys('text')}) AS term FROM benchmark) GROUP BY ALL),
kw AS (SELECT query_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (avgdl + 1e-10)))) AS score FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY ALL)"""


@query(f"WITH {_BM25} SELECT query_id, round(score, 6) AS score, rank FROM (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kw WHERE score > 0) WHERE rank <= 10")
def ret_bm25(spark, d):
    docs = base.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return retrieval.bm25(docs, _asked(spark, d), 10).select("query_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_BM25} SELECT st.n AS documents, (SELECT count(*) FROM df) AS terms, round(avgdl, 6) AS avgdl FROM st")
def agg_corpus_stats(spark, d):
    docs = base.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return retrieval.index_stats(docs).select("documents", "terms", F.round("avgdl", 6).alias("avgdl"))


_COS = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))"


@query(f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND {_COS} >= 0) WHERE rank <= 5")
def ret_nearest(spark, d):
    v = base.table(spark, d, "embeddings")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest(v, asked, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.label = 1) WHERE rank <= 5")
def ret_nearest_with_filter(spark, d):
    v = base.table(spark, d, "embeddings")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest(v, asked, 5, least=None, where=F.col("label") == 1).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_RRF = """a AS (SELECT c_nationkey AS query_id, c_custkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
b AS (SELECT c_nationkey AS query_id, c_custkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer),
u AS (SELECT query_id, doc_id, sum(s) AS score FROM (SELECT query_id, doc_id, 0.6::DOUBLE / (60 + rank) AS s FROM a WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 0.4::DOUBLE / (60 + rank) FROM b WHERE rank <= 10) GROUP BY ALL)"""


def _lists(spark, d) -> tuple[DataFrame, DataFrame]:
    from palimpsest.operators.selection import top_k

    c = base.table(spark, d, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("doc_id"), "c_acctbal")
    return top_k(c, 10, [F.desc("c_acctbal"), F.col("doc_id")], "query_id"), top_k(c, 10, [F.col("doc_id")], "query_id")


@query(f"WITH {_RRF} SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM u QUALIFY rank <= 5")
def ret_fusion(spark, d):
    return retrieval.fuse(*_lists(spark, d), "doc_id", 5).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query("""WITH h AS (SELECT s_nationkey AS query_id, s_suppkey AS chunk_id, (s_suppkey * 7 % 11) / 11 AS s, (s_suppkey * 5 % 13) / 13 AS r, (s_suppkey % 10) / 10 AS i FROM supplier), x AS (SELECT query_id, chunk_id, s * 0.5 + r * 0.2 + i * 0.3 AS score FROM h)
SELECT query_id, chunk_id, round(score, 9) AS score FROM x WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5""")
def ret_hybrid_strategy(spark, d):
    s = base.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    hits = s.select(F.col("s_nationkey").alias("query_id"), k.alias("chunk_id"), (k * 7 % 11 / 11).alias("semantic"), (k * 5 % 13 / 13).alias("recent"), (k % 10 / 10).alias("importance"))
    return retrieval.retrieve(hits).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query("""WITH r AS (SELECT c_nationkey AS query_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank, c_name, c_mktsegment FROM customer),
l AS (SELECT *, rank || '. [' || c_mktsegment || '] ' || c_name AS line FROM r), u AS (SELECT *, 17 + sum(length(line)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM l)
SELECT query_id, 'Relevant Context:' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS text FROM u WHERE used <= 400 GROUP BY query_id""")
def ret_context_lines(spark, d):
    c = base.table(spark, d, "customer")
    n = F.expr("row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)")
    return retrieval.context_lines(c.select(F.col("c_nationkey").alias("query_id"), n.alias("rank"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("text")), 100)


@query(f"WITH {TALK}, {EXTRACTED} SELECT conv_id, 'entity' AS item_type, count(*) AS n FROM ents GROUP BY 1 UNION ALL SELECT conv_id, 'fact', count(*) FROM facts GROUP BY 1 UNION ALL SELECT conv_id, 'event', count(*) FROM evts GROUP BY 1")
def ret_chunks(spark, d):
    return retrieval.chunks(base.talked(spark, d)).groupBy("conv_id", "item_type").agg(F.count(F.lit(1)).alias("n"))


@query()
def ret_hybrid(spark, d):
    docs = base.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("embedding", retrieval.hashed_embedding(F.col("text"), 32))
    asked = _asked(spark, d).withColumn("embedding", retrieval.hashed_embedding(F.col("query"), 32))
    return retrieval.hybrid(docs, asked, 5)


# ---- languages


_MARK = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in LANGUAGE_MARKERS.items()}
_HITS = ", ".join(f"(len(list_intersect(ws, {m})), {-k}, '{c}')" for k, (c, m) in enumerate(_MARK.items()))


@query(rf"""WITH w AS (SELECT doc_id, list_distinct({words_sql("coalesce(text, '')")}) AS ws FROM documents), h AS (SELECT doc_id, unnest([{", ".join(f"struct_pack(n := len(list_intersect(ws, {m})), k := {-k}, c := '{c}')" for k, (c, m) in enumerate(_MARK.items()))}]) AS h, len(ws) AS size FROM w)
SELECT doc_id, CASE WHEN max(h.n) = 0 THEN 'en' ELSE arg_max(h.c, h.n * 100 + h.k) END AS language, round(CASE WHEN max(size) = 0 THEN 0.0 WHEN max(h.n) = 0 THEN 0.3 ELSE least(1.0, max(h.n) / 5) END, 6) AS confidence FROM h GROUP BY doc_id""")
def fn_detect_language(spark, d):
    docs = base.table(spark, d, "documents").withColumn("d", lang.detect(F.col("text")))
    return docs.select("doc_id", "d.language", F.round("d.confidence", 6).alias("confidence"))


@query()
def fn_segments(spark, d):
    return multilang.segments(base.table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id", "language").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])', 1)) AS n FROM documents")
def fn_tokens(spark, d):
    return base.table(spark, d, "documents").select("doc_id", F.size(lang.tokens(F.coalesce("text", F.lit("")))).cast("bigint").alias("n"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'sakura' WHEN 1 THEN 'konnichiha ' || n_name ELSE 'tsushimi' END AS romaji FROM nation")
def fn_romaji(spark, d):
    n = base.table(spark, d, "nation")
    text = F.when(F.col("n_nationkey") % 3 == 0, "さくら").when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("こんにちは "), "n_name")).otherwise("つしみ")
    return n.select("n_nationkey", lang.romaji(text).alias("romaji"))


@query()
def ext_multilingual(spark, d):
    t = multilang.detected(base.talk(spark, d))
    return multilang.entities(t).select("conv_id", "name", "type")


@query()
def ext_multilingual_facts(spark, d):
    t = multilang.detected(base.talk(spark, d))
    ents = t.select("conv_id").distinct().withColumn("name", F.lit("Dana"))
    return multilang.relation_facts(t, ents).select("conv_id", "subject", "predicate", "object")


# ---- functions


@query(rf"""WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, list_distinct({words_sql('a.p_name')}) AS x, list_distinct({words_sql('b.p_name')}) AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT a, b, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 9) AS jaccard, round(len(list_intersect(x, y)) / len(x), 9) AS share FROM p""")
def fn_jaccard(spark, d):
    p = base.table(spark, d, "part").select("p_partkey", "p_name")
    both = p.alias("a").join(p.alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 1)
    return both.select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), F.round(sim.text_jaccard(F.col("a.p_name"), F.col("b.p_name")), 9).alias("jaccard"), F.round(sim.overlap_share(F.col("a.p_name"), F.col("b.p_name")), 9).alias("share"))


@query("""SELECT s_suppkey, round((SELECT count(*) FROM unnest(string_split(lower(s_name), '')) AS t(c) WHERE c <> '' AND contains('supplier12', c)) / greatest(length(s_name), 10), 9) AS score FROM supplier""")
def fn_fuzzy_name(spark, d):
    return base.table(spark, d, "supplier").select("s_suppkey", F.round(sim.fuzzy_name(F.col("s_name"), F.lit("Supplier12")), 9).alias("score"))


@query("SELECT o_orderkey, round(greatest(0.0, 1 - (epoch(TIMESTAMP '1998-08-02 00:00:00') - epoch(o_orderdate)) / 2592000), 9) AS recency FROM orders")
def fn_recency(spark, d):
    age = F.unix_timestamp(F.lit("1998-08-02 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return base.table(spark, d, "orders").select("o_orderkey", F.round(scores.recency(age), 9).alias("recency"))


@query(rf"""WITH {TURNS} SELECT conv_id, turn, round(CASE WHEN n = 0 THEN 0 ELSE (c + m + dates) / n END, 9) AS density FROM (SELECT conv_id, turn, len({words_sql('content')}) AS n, len(regexp_extract_all(content, '\b[0-9]{{1,2}}[/-][0-9]{{1,2}}\b')) AS dates,
  len(list_filter(regexp_extract_all(content, '([\p{{L}}\p{{N}}_]+)', 1), lambda w: regexp_matches(w, '^[A-Z][a-z]+$'))) AS c, len(list_filter(regexp_extract_all(content, '([\p{{L}}\p{{N}}_]+)', 1), lambda w: regexp_matches(w, '^[0-9]+$'))) AS m FROM turns)""")
def fn_density(spark, d):
    return base.turns(spark, d).select("conv_id", "turn", F.round(scores.density(F.col("content")), 9).alias("density"))
