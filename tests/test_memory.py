"""Small memories with exact expectations."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest import ir, plugins, telemetry
from palimpsest.functions import lang
from palimpsest.operators import context, evaluation, extraction, folding, graph, merging, multilang, retrieval, selection, temporal, versioning
from palimpsest.plans import compress, passes, summaries
from palimpsest.sources import dialogues, stores
from palimpsest.streaming import buffers


def turns(spark, *said, conv=1):
    return spark.createDataFrame([(conv, k, r, c) for k, (r, c) in enumerate(said)], ir.SCHEMAS["turns"])


def entity(name, kind="person", at=(), imp=0.5, ord=0, conv=1, aliases=()):
    return (conv, f"ent_{name}", ord, name, kind, list(aliases), {}, [(t, 0, len(name)) for t in at], imp)


def fact(k, s, p, o, at=(0,), conf=0.9, imp=0.3, kind="attribute", conv=1, negated=False):
    return (conv, f"fact_{k}", k, s, p, o, kind, conf, list(at), negated, "present", imp)


def event(k, kind, turn, who=("user",), text="x", conv=1):
    return (conv, f"evt_{k}", k, text, kind, turn, list(who), [], 0.5)


def memory(spark, n=10, **parts):
    m = ir.empty(spark).with_(turns=turns(spark, *[("user", "x")] * n))
    return m.with_(**{k: spark.createDataFrame(v, ir.SCHEMAS[k]) for k, v in parts.items()})


def ids(df, col):
    return sorted(r[0] for r in df.select(col).collect())


def test_extraction(spark):
    m = extraction.extract(turns(spark, ("user", "My name is Alice and I work at TechCorp. Bob works at Acme Inc"), ("assistant", "Nice to meet you, Alice!")))
    assert {(r["name"], r["type"]) for r in m.entities.collect()} == {("Alice", "person"), ("TechCorp", "person"), ("Bob", "person"), ("Acme", "person"), ("Inc", "person"), ("Nice", "other")}
    got = {(r["subject"], r["predicate"], r["object"], r["confidence"]) for r in m.facts.collect()}
    assert got == {("My name", "is", "Alice and", 0.8), ("I", "works at", "TechCorp", 0.9), ("Bob", "works at", "Acme Inc", 0.9), ("User", "has name", "Alice", 1.0)}
    assert [(r["event_type"], r["turn"]) for r in m.events.collect()] == [("answer", 1)]
    more = extraction.extract_incremental(m, turns(spark, ("user", "What now?")))
    assert ids(more.turns, "turn") == [0, 1, 2] and "question" in ids(more.events, "event_type")


def test_dead_memory(spark):
    m = memory(spark, 20, entities=[entity("Alice", at=(0, 5)), entity("RandomPerson", "other")],
               facts=[fact(1, "Alice", "lives in", "Boston"), fact(2, "Alice", "lives in", "New York", (5,)), fact(3, "Alice", "said", "hello", (19,)), fact(4, "RandomPerson", "is", "gone")])
    out = passes.dead_memory(m)
    assert ids(out.entities, "name") == ["Alice"] and ids(out.facts, "fact_id") == ["fact_2", "fact_3"]


def test_cascade(spark):
    m = memory(spark, entities=[entity("A"), entity("B")], facts=[fact(1, "A", "is", "x"), fact(2, "B", "is", "y")], relations=[(1, "rel_1", "fact_1", "fact_2", "causes", 1.0, False)])
    out = ir.remove_entities(m, m.entities.filter("name = 'A'").select("conv_id", "ent_id"))
    assert ids(out.facts, "fact_id") == ["fact_2"] and out.relations.count() == 0


def test_folding(spark):
    m = memory(spark, facts=[fact(1, "Alice", "is", "engineer", conf=0.9), fact(2, "Alice", "is", "engineer", conf=0.8), fact(3, "Bob", "is", "designer")])
    out = passes.fold_facts(m, 0.9).facts
    assert {(r["subject"], r["confidence"]) for r in out.collect()} == {("Alice", 0.9), ("Bob", 0.9)}


def test_contradictions_need_equal_letters(spark):
    f = memory(spark, facts=[fact(1, "A", "is", "x"), fact(2, "A", "is", "y"), fact(3, "a", "is", "z"), fact(4, "A", "said", "x"), fact(5, "A", "said", "x", negated=True)]).facts
    assert {(r["a"], r["b"]) for r in folding.contradictions(f).collect()} == {("fact_1", "fact_2"), ("fact_4", "fact_5")}


def test_temporal(spark):
    five = memory(spark, events=[event(k, "question", k) for k in range(5)])
    out = temporal.compress(five, gap=2)
    assert out.events.count() == 0 and [(r["summary"], r["sequence_type"]) for r in out.sequences.collect()] == [("Discussion with 5 questions", "qa_exchange")]
    two = memory(spark, events=[event(k, "action", k) for k in range(2)])
    assert temporal.compress(two).events.count() == 2


def test_pruning(spark):
    many = memory(spark, 1, facts=[fact(k, f"Subject{k}", "predicate", f"Object{k}", at=(), kind="other", conf=0.5) for k in range(50)])
    assert passes.prune(many, 500).facts.count() == 21
    ten = memory(spark, 1, facts=[fact(1, "Alice", "is", "CEO", at=(), kind="other", conf=0.5)] + [fact(k, f"Random{k}", "said", "something", at=(), kind="other", conf=0.5) for k in range(2, 12)])
    assert passes.prune(ten, 100).facts.count() == 4


def test_both_ways_of_ranking_graphs_agree(spark):
    m = memory(spark, entities=[entity(x, ord=k) for k, x in enumerate("abcde")], facts=[fact(k, s, "p", o) for k, (s, o) in enumerate(["ab", "bc", "ca", "ad", "ad"])])
    nodes, edges = m.entities.select("conv_id", F.col("ent_id").alias("node")), folding.materialised(graph.edges(m.facts, m.entities))
    a, b = ({r["node"]: r["centrality"] for r in graph.pagerank(nodes, edges, 10, tolerance=0.0, small=s).collect()} for s in (200_000, 1))
    assert sum(a.values()) == pytest.approx(1) and max(a, key=a.get) == "ent_a" and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_search(spark):
    v = spark.createDataFrame([("doc1", [1.0, 0.0, 0.0], "entity"), ("doc2", [0.0, 1.0, 0.0], "fact")], "vec_id string, embedding array<double>, type string")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in retrieval.nearest(v, q, 1).collect()] == [("doc1", pytest.approx(1))]
    assert ids(retrieval.nearest(v, q, 5, where=F.col("type") == "entity"), "vec_id") == ["doc1"]
    d = spark.createDataFrame([("doc1", "Python is a great programming language"), ("doc2", "Java is also a popular language")], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "Python programming")], "query_id int, query string")
    assert [(r["doc_id"], r["score"]) for r in retrieval.bm25(d, asked).collect()] == [("doc1", pytest.approx(2 * np.log(2)))]


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    v = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    want = sorted(map(tuple, retrieval.nearest(v, q, 2).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    assert sorted(map(tuple, retrieval.nearest(v, q, 2).collect())) == want


def test_merge_and_versions(spark, tmp_path):
    a = memory(spark, entities=[entity("Alice Smith"), entity("TechCorp", "organization", ord=1)], facts=[fact(1, "Alice Smith", "works at", "TechCorp")])
    b = memory(spark, entities=[entity("Alice", aliases=["A. Smith"]), entity("Bob", ord=1)], facts=[fact(2, "Alice", "knows", "Bob"), fact(3, "Bob", "likes", "tea")])
    both = merging.merge([a, b])
    assert both.entities.count() == 4 and both.facts.count() == 3
    changes = versioning.diff(a, b)
    assert {(r["item_type"], r["operation"], r["n"]) for r in changes.groupBy("item_type", "operation").agg(F.count("*").alias("n")).collect()} == {
        ("entities", "add", 2), ("entities", "remove", 2), ("facts", "add", 2), ("facts", "remove", 1)}
    assert ids(versioning.patch(a, changes, b).facts, "fact_id") == ["fact_2", "fact_3"]
    h = versioning.History(spark, str(tmp_path / "h"))
    one, two = h.commit(a, "first", 1), h.commit(b, "second", 2)
    h.rollback(one, 3)
    assert h.head() == one and h.load().facts.count() == 1 and h.load(two).facts.count() == 2


def test_store(spark, tmp_path):
    s = stores.TableStore(spark, str(tmp_path / "s"))
    m = memory(spark, entities=[entity("Alice")], facts=[fact(1, "Alice", "is", "here")])
    s.save("k/1", m, at=10.0, ttl=5.0)
    assert s.exists("k/1", 12.0) and not s.exists("k/1", 16.0) and s.ttl("k/1", 12.0) == 3.0 and ids(s.search_entities("lic"), "key") == ["k_1"]
    s.set_ttl("k/1", 12.0, None)
    assert s.ttl("k/1", 99.0) is None and s.exists("k/1", 99.0)
    s.copy_to(str(tmp_path / "copy"))
    assert stores.TableStore(spark, str(tmp_path / "copy")).load("k/1").facts.count() == 1
    assert stores.from_json(stores.as_json(m)).facts.select("object").first()[0] == "here"
    assert '"label":"Alice"' in stores.graph_json(m).first()["text"] and "Facts: 1" in stores.outline(m).first()["text"]


def test_packing_and_rendering(spark):
    rows = [(1, f"i{k}", k, f"text {k} <b>", 40, imp, 0.5, 0.5, t) for k, (imp, t) in enumerate([(0.9, "entity"), (0.7, "entity"), (0.6, "fact"), (0.1, "event")])]
    items = spark.createDataFrame(rows, "conv_id bigint, id string, ord bigint, content string, tokens int, importance double, recency double, relevance double, item_type string")
    assert ids(context.pack(items, "greedy", 100), "id") == ["i0", "i1"] and ids(context.pack(items, "knapsack", 80), "id") == ["i0", "i1"]
    text = {f: context.render(items, f).first()["text"] for f in ("plain", "structured", "xml", "markdown", "json")}
    assert text["plain"].startswith("text 0 <b>\ntext 1") and text["structured"].startswith("=== Relevant Context ===\n\n--- Key People and Things ---\n• text 0")
    assert "<entity>text 0 &lt;b&gt;</entity>" in text["xml"] and text["markdown"].startswith("## Relevant Context\n\n### Key Entities\n- text 0") and '"additional":""' in text["json"]


def test_buffers_and_streams(spark, tmp_path):
    t = turns(spark, *[("user", "one two three")] * 5)
    assert ids(buffers.last_turns(t, 3), "turn") == [2, 3, 4] and ids(buffers.within_tokens(t, 7), "turn") == [3, 4]
    p = spark.createDataFrame([(1, k, f"p{k}", x) for k, x in enumerate([0.3, 0.9, 0.5])], "conv_id bigint, ord bigint, id string, priority double")
    assert [r["priority"] for r in buffers.by_priority(p, 2).collect()] == [0.9, 0.5]
    t.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ir.SCHEMAS["turns"]).parquet(str(tmp_path / "in"))
    q = buffers.stream_batches(stream, 2).writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert sorted((r["batch"], r["turns"]) for r in spark.table("batches").collect()) == [(0, 2), (1, 2)]


def test_languages(spark):
    said = {"Hello, how are you today?": ("en", 0.2), "你好，今天天气怎么样？": ("zh", 9 / 11), "Hola, ¿cómo estás hoy?": ("en", 0.3), "こんにちは、元気ですか？": ("ja", 8 / 12), "안녕하세요, 오늘 기분이 어떠세요?": ("ko", 14 / 16), "": ("en", 0.0)}
    got = {r["t"]: (r["d"]["language"], r["d"]["confidence"]) for r in spark.createDataFrame([(k,) for k in said], "t string").select("t", lang.detect(F.col("t")).alias("d")).collect()}
    assert {k: (a, pytest.approx(b)) for k, (a, b) in got.items()} == said
    t = multilang.detected(turns(spark, ("user", "Dr. Jane Doe moved from Paris. Jane has blue eyes"), ("user", "王小明住在北京市")))
    e = multilang.entities(t)
    assert {"Dr. Jane Doe", "Paris"} <= set(ids(e, "name"))
    facts = multilang.attribute_facts(t, spark.createDataFrame([(1, "Jane")], "conv_id bigint, name string"))
    assert [(r["subject"], r["predicate"], r["object"]) for r in facts.collect()] == [("Jane", "has_blue", "eyes")]


def test_evaluation_and_summaries(spark):
    t = turns(spark, ("user", "My name is Ann. I work at Big Corp. I like tea"))
    assert {(r["question"], r["answer"]) for r in evaluation.qa_pairs(t).collect()} == {("What is the user's name?", "Ann"), ("Where does the user work?", "Big Corp"), ("What does the user like?", "tea")}
    s = summaries.summarise(t, style="executive")
    assert s.first()["summary"].startswith("A 1-turn conversation involving Ann discussing ")
    assert summaries.continued(s, t).first()["summary"].endswith("continued with 1 more exchanges.")
    read = spark.createDataFrame([("- one\n- two by Ann Lee\n\nrest",)], "t string").select(summaries.read_summary(F.col("t")).alias("x")).first()["x"]
    assert read["points"] == ["one", "two by Ann Lee"] and read["names"] == ["Ann Lee"]


def test_probes(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"context": "c", "questions": [{"question": "q", "answer": "a", "entities": ["B", "A", "B"]}]}, {}]')
    got = sorted((r["dialogue"], r["key_entities"]) for r in dialogues.read_probes(spark, str(tmp_path / "p.json")).collect())
    assert got == [("", []), ("c", ["A", "B"])]
    (tmp_path / "t.jsonl").write_text('{"input": "i", "query": "q", "answer": "a"}\n')
    assert dialogues.read_tasks(spark, str(tmp_path / "t.jsonl")).first()["key_facts"] == ["a"]


def test_compression(spark):
    said = [("user" if k % 2 == 0 else "assistant", f"My name is Person{k} and topic number {k} is interesting to discuss at length here") for k in range(20)]
    out = compress.compress(turns(spark, *said), {"budget": 60, "rounds": 5}).first()
    assert 0 < out["ratio"] < 1 and out["compressed_tokens"] <= 66
    with pytest.raises(ValueError):
        compress.config("nothing")


def test_plugins_and_metrics(spark):
    hooks, seen = plugins.Hooks(), []
    for name, p in (("low", 1), ("high", 9)):
        hooks.register("on_complete", name, lambda v, n=name: seen.append(n), p)
    hooks.register("on_complete", "bad", lambda v: 1 / 0)
    assert hooks.execute("on_complete", 5) == 5 and seen == ["high", "low"] and hooks.errors[0][1] == "bad"
    m = memory(spark, facts=[fact(1, "A", "is", "x", conf=0.4), fact(2, "A", "is", "y")])
    assert ids(plugins.Pipeline([plugins.filter_low_confidence])(m).facts, "fact_id") == ["fact_2"]
    rows = spark.createDataFrame([("n", "counter", 1.0, 2.0), ("n", "counter", 2.0, 3.0), ("g", "gauge", 1.0, 7.0), ("g", "gauge", 2.0, 4.0)], "name string, kind string, ts double, value double")
    assert telemetry.counters(rows).first()["value"] == 5.0 and telemetry.gauges(rows).first()["value"] == 4.0
    assert "palimpsest_n 5.0" in telemetry.prometheus(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 20)), max_size=8), st.integers(0, 40))
def test_knapsack_is_optimal(items, budget):
    from itertools import combinations

    v, w = np.array([x for x, _ in items], np.int64), np.array([y for _, y in items], np.int64)
    took = selection.knapsack(v, w, budget)
    best = max(sum(v[list(c)]) for n in range(len(items) + 1) for c in combinations(range(len(items)), n) if sum(w[list(c)]) <= budget) if items else 0
    assert sum(w[took]) <= budget and sum(v[took]) == best
