"""What must not grow faster than its input, against the plain definition on small memories."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import ir
from palimpsest.functions import similarity as sim
from palimpsest.functions.text import ident
from palimpsest.operators import evaluation, merging, retrieval, temporal


def joins_on_more_than_keys(df) -> list[str]:
    """Joins of a plan that compare rows by more than equal keys."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [x for x in lines if "Join" in x and any(w in x for w in ("CASE WHEN", "Contains", "Cross", " < ", " >= "))]


def some_facts(spark, n, seed, conv=2):
    r = random.Random(seed)
    pick = lambda *of: r.choice(of)
    rows = [(k % conv, f"fact_{k}", k, pick("Ann", "ann lee", "Lee", "Bo", ""), pick("works at", "is employed by", "likes", "loves", "is"), pick("tea", "Green tea", "a", "Acme", None),
             "attribute", r.randint(1, 9) / 10, [k % 5], False, "present", 0.5) for k in range(n)]
    return spark.createDataFrame(rows, ir.SCHEMAS["facts"])


@pytest.mark.parametrize("threshold", (0.8, 0.85, 0.95))
def test_fact_recall_is_that_of_all_pairs(spark, threshold):
    a, b = some_facts(spark, 60, 1), some_facts(spark, 25, 2)
    near = a.alias("a").join(b.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (sim.recall_similarity("a", "b") >= threshold), "left_semi").select("fact_id")
    hit = {r[0] for r in near.collect()}
    got = evaluation.fact_recall(a, b, threshold)
    want = {c: sum(f"fact_{k}" not in hit for k in range(60) if k % 2 == c) for c in (0, 1)}
    assert {r["conv_id"]: r["missed"] for r in got.collect()} == want and 0 < sum(want.values()) < 60
    assert joins_on_more_than_keys(got) == []


def all_pairs(v, q, k, least):
    """The nearest by the plain definition: every query with every row; vectors of different lengths have no score."""
    from palimpsest.operators.selection import top_k

    score = F.when(F.size("q") == F.size("embedding"), sim.cosine(F.col("q"), F.col("embedding")))
    both = v.crossJoin(F.broadcast(q.select("query_id", F.col("embedding").alias("q")))).select("query_id", "vec_id", score.alias("score"))
    both = both if least is None else both.filter(F.col("score") >= least)
    return top_k(both, k, [F.desc("score"), F.col("vec_id")], "query_id")


@pytest.mark.parametrize("least", (0.0, None))
def test_nearest_is_that_of_all_pairs(spark, least):
    r = np.random.default_rng(5)
    vs = [r.normal(size=6).tolist() for _ in range(60)]
    odd = [vs[3], vs[3], [2 * x for x in vs[3]], [0.0] * 6, [0.0] * 6, [1e-9] * 6, None, [1.0, None, 2.0, 1.0, 1.0, 1.0], [1.0, 2.0], [3.0, 1.0], [], [float("nan")] * 6, [1e-6] * 6, [1e160] * 6]
    rows = [(k, x) for k, x in enumerate([*vs, *odd])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    q = spark.createDataFrame([x for x in rows if x[0] % 4 == 0 or x[0] > 55], "query_id bigint, embedding array<double>")
    out = lambda df: sorted(((r["query_id"], r["rank"], r["vec_id"], repr(r["score"])) for r in df.collect()))
    got = retrieval.nearest(v, q, 4, least=least)
    assert out(got) == out(all_pairs(v, q, 4, least)) and joins_on_more_than_keys(got) == []
    names = lambda df: df.withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    assert out(retrieval.nearest(names(v), q, 4, least=least)) == out(all_pairs(names(v), q, 4, least))


def test_nearest_behind_a_filter_takes_each_query_once(spark, monkeypatch):
    v = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("embedding"), (F.col("id") % 3).alias("label"))
    q = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    got = retrieval.nearest(v, q, 3, least=None, where=F.col("label") == 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, all_pairs(v.filter("label = 1"), q, 3, None).collect())) and got.count() == 90
    assert joins_on_more_than_keys(got) == []


def test_phases_of_equal_scores_go_in_order(spark):
    # 0.4 * 1.1 + 0.4 * 1 / 2 and 0.4 * 0.6 + 0.4 * 2 / 2 are 0.64 both, and the first is larger in the last bit.
    event = lambda k, turn, imp: (1, f"evt_{k}", k, "x", "action", turn, ["p"], [], imp)
    events = spark.createDataFrame([event(0, 0, 0.2), event(1, 1, 0.9), event(2, 5, 0.3), event(3, 6, 0.3)], ir.SCHEMAS["events"])
    talk = spark.createDataFrame([(1, k, "user", "x") for k in range(10)], ir.SCHEMAS["turns"])
    m = ir.empty(spark).with_(turns=talk, events=events)
    assert len({r["score"] for r in temporal.phase_scores(m).collect()}) == 2
    assert sorted(r["turn"] for r in temporal.compress_phases(m, cut=0.25).events.collect()) == [0, 5, 6]


def test_ids_of_many_rows_differ(spark):
    ids = spark.range(300_000).select(ident("ent_", F.lit(1), F.col("id")).alias("k"))
    assert ids.agg(F.countDistinct("k")).first()[0] == 300_000


@pytest.mark.parametrize("threshold", (0.3, 0.8, 0.999))
def test_candidates_are_those_of_all_pairs(spark, threshold):
    r = random.Random(3)
    words = ["Ann", "nan", "ANN", "Bo", "Anna Lee", "lee", "", " ", "Customer 12", "customer 21", "x", "aab", "abb"]
    rows = lambda n: [(k % 2, f"e{k}", k, r.choice(words), r.choice(("person", "other")), r.sample(["Lee", "ann", "B."], r.randint(0, 1)), {}, [], 0.1) for k in range(n)]
    a, b = (spark.createDataFrame(rows(n), ir.SCHEMAS["entities"]) for n in (40, 50))
    text = lambda s: F.lower(F.regexp_replace(F.concat_ws("", F.col(f"{s}.name"), F.concat_ws("", f"{s}.aliases")), " ", ""))
    shared = F.exists(F.split(text("a"), ""), lambda c: (c != "") & (F.instr(text("b"), c) > 0))
    both = a.alias("a").join(b.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & shared).select(F.col("a.ent_id").alias("x"), F.col("b.ent_id").alias("y"), "a.name", F.col("b.name").alias("other"), merging.match_score().alias("score"))
    want = {(x["x"], x["y"], x["score"]): x["name"].lower() == x["other"].lower() for x in both.filter(F.col("score") >= threshold).collect()}
    out = lambda df: {(x["a"], x["b"], x["score"]) for x in df.collect()}
    got = merging.candidates(a, b, threshold)
    assert out(got) == set(want) and want
    assert out(merging.candidates(a, b, threshold, equal=True)) == {k for k, v in want.items() if v}
