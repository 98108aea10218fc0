"""Passes: each takes a Memory and returns a smaller one. All conversations go through at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import ir
from palimpsest.fixed import TOPIC_STOPWORDS
from palimpsest.functions import scores
from palimpsest.functions.text import W, sentence, word_set, words
from palimpsest.ir import Memory
from palimpsest.operators import folding, graph, selection, temporal

Pass = Callable[[Memory], Memory]


# ---- dead memory


def dead_entities(memory: Memory, recency: int = 10, min_mentions: int = 1) -> DataFrame:
    """(conv_id, ent_id) of entities that are mentioned too little, too long ago, in no important fact, and of no lasting type."""
    n = ir.turn_counts(memory.turns)
    top = memory.facts.select("conv_id", "importance", F.explode(F.array_distinct(F.array(F.lower("subject"), F.lower("object")))).alias("lname")).groupBy("conv_id", "lname").agg(F.max("importance").alias("best"))
    e = memory.entities.withColumn("lname", F.lower("name")).join(n, "conv_id", "left").join(top, ["conv_id", "lname"], "left")
    count, last = ir.refs(F.col("mentions")), ir.last_turn(F.col("mentions"))
    alive = ((count > min_mentions) | F.coalesce(F.coalesce("num_turns", F.lit(0)) - last <= recency, F.lit(False))
             | F.coalesce(F.col("best") > 0.7, F.lit(False)) | (F.col("type").isin("person", "organization", "project") & (count >= 1)))
    return e.filter(~alive).select("conv_id", "ent_id")


def dead_facts(memory: Memory, dead: DataFrame, recency: int = 10, min_confidence: float = 0.5) -> DataFrame:
    """(conv_id, fact_id) of facts about dead entities, and of unsure ones that are old or have no source."""
    index = ir.name_index(memory.entities).join(dead, ["conv_id", "ent_id"], "left_semi").select("conv_id", "lname").distinct()
    ends = memory.facts.select("conv_id", "fact_id", F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("lname"))
    by_entity = ends.join(index, ["conv_id", "lname"], "left_semi").select("conv_id", "fact_id")
    old = F.coalesce(F.coalesce("num_turns", F.lit(0)) - F.array_max("source_turns") > recency, F.lit(True))
    unsure = memory.facts.join(ir.turn_counts(memory.turns), "conv_id", "left").filter((F.col("confidence") < min_confidence) & old).select("conv_id", "fact_id")
    return by_entity.unionByName(unsure).distinct()


def dead_events(memory: Memory, dead: DataFrame, recency: int = 10) -> DataFrame:
    """(conv_id, evt_id) of events all of whose facts are dead, and of slight ones twice as old as recency."""
    rel = memory.events.select("conv_id", "evt_id", F.explode("related_facts").alias("fact_id"))
    gone = rel.join(dead.withColumn("dead", F.lit(True)), ["conv_id", "fact_id"], "left").groupBy("conv_id", "evt_id").agg(F.every(F.coalesce("dead", F.lit(False))).alias("all")).filter("all")
    old = memory.events.join(ir.turn_counts(memory.turns), "conv_id", "left").filter((F.col("importance") < 0.3) & (F.col("num_turns") - F.col("turn") > 2 * recency))
    return gone.select("conv_id", "evt_id").unionByName(old.select("conv_id", "evt_id")).distinct()


def dead_memory(memory: Memory, recency: int = 10, min_mentions: int = 1, min_confidence: float = 0.5, superseded: bool = True) -> Memory:
    """What is dead is found on the memory as it comes, then all of it goes at once."""
    ents = dead_entities(memory, recency, min_mentions)
    facts = dead_facts(memory, ents, recency, min_confidence)
    if superseded:
        facts = facts.unionByName(folding.superseded(memory.facts)).distinct()
    evts = dead_events(memory, facts, recency)
    return ir.remove_events(ir.remove_facts(ir.remove_entities(memory, ents), facts), evts)


def irrelevant_facts(memory: Memory, queries: list[str], least: float = 0.3) -> Memory:
    """Facts go that share too few of each query's words; no queries, no change."""
    if not queries:
        return memory
    ws = word_set(F.concat_ws(" ", "subject", "predicate", "object"))
    share = lambda q: F.size(F.array_intersect(ws, F.array(*map(F.lit, q)))) / len(q)
    asked = [sorted(set(q.lower().split())) for q in queries if q.strip()]
    best = F.greatest(*map(share, asked), F.lit(0.0)) if asked else F.lit(0.0)
    return ir.remove_facts(memory, memory.facts.filter(best < least).select("conv_id", "fact_id"))


# ---- folding


def fold_facts(memory: Memory, threshold: float = 0.85, entailment: bool = True, strategy: str = "highest_confidence") -> Memory:
    """Groups of similar facts become one; then entailed facts that add nothing go. Relations follow what they linked."""
    pairs = folding.similar_pairs(memory.facts, threshold)
    said = folding.entailed(memory.facts, memory.relations)
    groups = folding.materialised(folding.fold_groups(memory.facts, pairs))
    merged = folding.materialised(folding.merge_groups(memory.facts, groups, strategy))
    kept = merged.join(groups, ["conv_id", "fact_id"]).select("conv_id", "root", F.col("fact_id").alias("to"))
    moved = groups.join(kept, ["conv_id", "root"]).select("conv_id", "fact_id", "to")
    rel = memory.relations
    for side in ("src", "dst"):
        rel = rel.join(moved.select("conv_id", F.col("fact_id").alias(side), "to"), ["conv_id", side], "left").withColumn(side, F.coalesce("to", side)).drop("to")
    facts = memory.facts.join(groups, ["conv_id", "fact_id"], "left_anti").unionByName(merged)
    out = memory.with_(facts=facts, relations=ir.conform(rel, "relations").filter("src != dst"))
    if not entailment:
        return out
    alive = out.facts.select("conv_id", "fact_id")
    said = said.join(alive, ["conv_id", "fact_id"], "left_semi").join(alive.withColumnRenamed("fact_id", "by"), ["conv_id", "by"], "left_semi")
    return ir.remove_facts(out, folding.droppable_entailed(out.facts, said))


def dedup_semantic(memory: Memory, vectors: DataFrame) -> Memory:
    """Average-linkage clusters of facts by (conv_id, fact_id, embedding), a third as many; the most important of each stays."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        x = np.array(pdf["embedding"].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = 1 - x @ x.T
        groups = [[k] for k in range(len(x))]
        while len(groups) > max(1, len(x) // 3):
            best = min(((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[i + 1:], i + 1)))
            groups[best[1]] += groups.pop(best[2])
        keep = [max(g, key=lambda k: (pdf["importance"].iloc[k], -k)) for g in groups]
        return pdf.iloc[sorted(set(range(len(x))) - set(keep))][["conv_id", "fact_id"]]

    got = memory.facts.select("conv_id", "fact_id", "ord", "importance").join(vectors, ["conv_id", "fact_id"])
    return ir.remove_facts(memory, got.groupBy("conv_id").applyInPandas(run, "conv_id bigint, fact_id string"))


# ---- importance


def score(memory: Memory, rounds: int = 100) -> Memory:
    """All importances afresh: entities by mentions and centrality, facts by those of their ends, events by turn."""
    n = ir.turn_counts(memory.turns)
    central = graph.centrality(memory.facts, memory.entities, rounds).withColumnRenamed("node", "ent_id")
    ents = memory.entities.join(n, "conv_id", "left").join(central, ["conv_id", "ent_id"], "left").withColumn("importance", scores.entity_importance(
        ir.refs(F.col("mentions")), ir.last_turn(F.col("mentions")), F.col("num_turns"), F.col("centrality"), F.col("type")))
    ents = folding.materialised(ir.conform(ents, "entities"))
    by = ir.name_index(ents).join(ents.select("conv_id", "ent_id", "importance"), ["conv_id", "ent_id"])
    end = lambda side: by.select("conv_id", F.col("lname").alias(f"l{side}"), F.col("importance").alias(f"i{side}"))
    facts = memory.facts.withColumns({"ls": F.lower("subject"), "lo": F.lower("object")}).join(end("s"), ["conv_id", "ls"], "left").join(end("o"), ["conv_id", "lo"], "left").join(n, "conv_id", "left")
    ends = F.greatest(F.coalesce("is", F.lit(0.0)), F.coalesce("io", F.lit(0.0)))
    facts = facts.withColumn("importance", scores.fact_importance(F.col("confidence"), F.col("source_turns"), F.col("num_turns"), ends, F.col("fact_type")))
    evts = memory.events.join(n, "conv_id", "left").withColumn("importance", scores.event_importance(F.col("turn"), F.col("num_turns"), F.col("participants"), F.col("event_type")))
    return memory.with_(entities=ents, facts=ir.conform(facts, "facts"), events=ir.conform(evts, "events"))


def units(memory: Memory) -> DataFrame:
    """(conv_id, id, kind, ord, value, weight): everything that costs tokens."""
    n = lambda *cols: sum((F.size(words(F.col(c))) for c in cols), F.lit(0))
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    e = memory.entities.select("conv_id", F.col("ent_id").alias("id"), F.lit(0).alias("kind"), "ord", F.col("importance").alias("value"), (n("name") + 15 + size("aliases") * 2 + size("attributes") * 3).alias("weight"))
    f = memory.facts.select("conv_id", F.col("fact_id").alias("id"), F.lit(1).alias("kind"), "ord", F.col("importance").alias("value"), (n("subject", "predicate", "object") + 20).alias("weight"))
    v = memory.events.select("conv_id", F.col("evt_id").alias("id"), F.lit(2).alias("kind"), "ord", F.col("importance").alias("value"), (n("description") + 25).alias("weight"))
    return e.unionByName(f).unionByName(v)


def prune(memory: Memory, budget: int | DataFrame = 2048, least: float = 0.1, knapsack: bool = True, rounds: int = 100) -> Memory:
    """Keep the most valuable units that fit the budget, a number or (conv_id, budget); below it nothing goes."""
    memory = score(memory, rounds)
    every = folding.materialised(units(memory))
    total = every.groupBy("conv_id").agg(F.sum("weight").alias("total"))
    over = (total.withColumn("budget", F.lit(budget)) if isinstance(budget, int) else total.join(budget, "conv_id")).filter(F.col("total") > F.col("budget"))
    items = every.join(over, "conv_id").filter(F.col("value") >= least)
    if knapsack:
        kept = selection.knapsack_by_group(items.withColumn("ord", F.col("kind").cast("bigint") * (1 << 56) + F.col("ord")), "conv_id")
    else:
        kept = selection.greedy(items, "conv_id", "id", "weight", [-F.col("value"), F.col("kind"), F.col("ord")], F.col("budget"))
    gone = folding.materialised(every.join(over.select("conv_id"), "conv_id", "left_semi").join(kept, ["conv_id", "id"], "left_anti").select("conv_id", "id", "kind"))
    of = lambda k, name: gone.filter(F.col("kind") == k).select("conv_id", F.col("id").alias(name))
    return ir.remove_events(ir.remove_facts(ir.remove_entities(memory, of(0, "ent_id")), of(1, "fact_id")), of(2, "evt_id"))


def complexity(memory: Memory) -> DataFrame:
    """(conv_id, complexity, budget): how rich a conversation is, and the budget that suits it."""
    count = lambda df, name: df.groupBy("conv_id").agg(F.count(F.lit(1)).alias(name))
    types = memory.entities.groupBy("conv_id").agg(F.count(F.lit(1)).alias("e"), F.countDistinct("type").alias("t"))
    got = ir.turn_counts(memory.turns).select("conv_id").join(types, "conv_id", "left")
    for part, name in (("facts", "f"), ("relations", "r"), ("events", "v")):
        got = got.join(count(getattr(memory, part), name), "conv_id", "left")
    got = got.fillna(0, ["e", "t", "f", "r", "v"])
    c = scores.complexity(*(F.col(x) for x in ("e", "f", "r", "v", "t")))
    return got.select("conv_id", c.alias("complexity"), scores.adaptive_budget(c).alias("budget"))


def prune_adaptive(memory: Memory, rounds: int = 100) -> Memory:
    return prune(memory, folding.materialised(complexity(memory).select("conv_id", "budget")), rounds=rounds)


# ---- predicted queries


def topics(turns: DataFrame, last: int = 5, k: int = 5) -> DataFrame:
    """(conv_id, word, n, rank): the commonest words of the last turns; of equals the first met."""
    recent = selection.top_k(turns, last, [F.desc("turn")], "conv_id").drop("rank")
    each = recent.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("content"), F.lit(f"({W}+)"), F.lit(1))).alias("pos", "word"))
    counted = each.filter((F.length("word") > 2) & ~F.col("word").isin(*TOPIC_STOPWORDS)).groupBy("conv_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "pos")).alias("first"))
    return selection.top_k(counted, k, [F.desc("n"), F.col("first")], "conv_id").select("conv_id", "word", "n", "rank")


def predict(memory: Memory, k: int = 10) -> DataFrame:
    """(conv_id, query, relevance, query_type, targets, keywords): what may be asked next, at most k a conversation."""
    top = selection.top_k(memory.entities, 5, [F.desc("importance"), F.col("ord")], "conv_id")
    named = memory.facts.select("conv_id", F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("lname")).distinct()
    none = F.array().cast("array<string>")
    row = lambda query, rel, kind, targets, keys, seq: [F.col("conv_id"), query.alias("query"), rel.alias("relevance"), F.lit(kind).alias("query_type"), targets.alias("targets"), keys.alias("keywords"), seq.alias("seq")]
    seq = lambda group, *x: F.struct(F.lit(group).alias("g"), *[c.cast("bigint").alias(f"s{k}") for k, c in enumerate(x)])
    info = top.select(*row(F.concat(F.lit("What is "), "name", F.lit("?")), F.col("importance") * 0.8, "entity_info", F.array("name"), none, seq(0, F.col("rank"), F.lit(0))))
    about = top.withColumn("lname", F.lower("name")).join(named, ["conv_id", "lname"], "left_semi").select(
        *row(F.concat(F.lit("What do we know about "), "name", F.lit("?")), F.col("importance") * 0.7, "entity_facts", F.array("name"), none, seq(0, F.col("rank"), F.lit(1))))
    words_ = topics(memory.turns)
    topic = words_.select(*row(F.concat(F.lit("What about "), "word", F.lit("?")), F.least(F.lit(1.0), F.col("n") * 0.15), "topic", none, F.array("word"), seq(1, F.col("rank"), F.lit(0))))
    asked = memory.turns.filter((F.col("role") == "user") & F.col("content").contains("?")).select("conv_id", "turn", F.posexplode(F.slice(F.regexp_extract_all("content", F.lit(r"([^.!?]*\?)"), F.lit(1)), 1, 2)).alias("pos", "q"))
    follow = asked.select(*row(F.trim("q"), F.lit(0.6), "follow_up", none, none, seq(2, F.col("turn"), F.col("pos"))))
    every = reduce(DataFrame.unionByName, (info, about, topic, follow))
    first = every.groupBy("conv_id", F.lower("query").alias("lq")).agg(F.min_by(F.struct(*every.columns[1:]), "seq").alias("q")).select("conv_id", "q.*")
    return selection.top_k(first, k, [F.desc("relevance"), F.col("seq")], "conv_id").drop("rank", "seq")


def fact_query_relevance() -> Column:
    """Of a fact's columns and a query's (query, targets)."""
    s, o = F.lower("subject"), F.lower("object")
    hits = F.aggregate("targets", F.lit(0.0), lambda a, t: a + F.when(s.contains(F.lower(t)), 0.5).otherwise(0.0) + F.when(o.contains(F.lower(t)), 0.3).otherwise(0.0))
    text = sentence(F.col("subject"), F.col("predicate"), F.col("object"), F.col("negated"))
    shared = F.size(F.array_intersect(word_set(text), word_set(F.col("query"))))
    return F.least(F.lit(1.0), hits + F.least(F.lit(0.4), shared * F.lit(0.1)))


def entity_query_relevance() -> Column:
    """Of an entity's columns and a query's: a target has 1; else its name, aliases and words in the query count."""
    q, name = F.lower("query"), F.lower("name")
    aliases = F.coalesce(F.aggregate("aliases", F.lit(0.0), lambda a, x: a + F.when(q.contains(F.lower(x)), 0.6).otherwise(0.0)), F.lit(0.0))
    word = F.when(F.size(F.array_intersect(word_set(name), word_set(q))) > 0, 0.5).otherwise(0.0)
    return F.when(F.exists("targets", lambda t: F.lower(t) == name), 1.0).otherwise(F.least(F.lit(1.0), F.when(q.contains(name), 0.8).otherwise(0.0) + aliases + word))


def relevance(units_: DataFrame, queries: DataFrame, key: str, of: Column) -> DataFrame:
    """(conv_id, key, relevance): the best over the conversation's queries, an equality join: few queries meet each unit."""
    return units_.join(queries, "conv_id").groupBy("conv_id", key).agg(F.max(of * F.col("q_relevance")).alias("relevance"))


def prune_by_queries(memory: Memory, queries: DataFrame | None = None, least: float = 0.3) -> Memory:
    """Entities, then facts, go that no predicted query makes relevant; conversations without queries stay."""
    q = (predict(memory) if queries is None else queries).withColumnRenamed("relevance", "q_relevance").select("conv_id", "query", "targets", "q_relevance")
    q = folding.materialised(q)
    ents = relevance(memory.entities, q, "ent_id", entity_query_relevance()).filter(F.col("relevance") < least).select("conv_id", "ent_id")
    facts = relevance(memory.facts, q, "fact_id", fact_query_relevance()).filter(F.col("relevance") < least).select("conv_id", "fact_id")
    return ir.remove_facts(ir.remove_entities(memory, ents), facts)


# ---- driving passes


def counts(memory: Memory) -> DataFrame:
    """(conv_id, part, n) of each component."""
    return reduce(DataFrame.unionByName, (df.groupBy("conv_id").agg(F.lit(k).alias("part"), F.count(F.lit(1)).alias("n")) for k, df in memory.parts().items()))


def effect(before: Memory, after: Memory, name: str) -> DataFrame:
    """(conv_id, pass, part, before, after): what a pass removed."""
    b, a = counts(before).withColumnRenamed("n", "before"), counts(after).withColumnRenamed("n", "after")
    return b.join(a, ["conv_id", "part"], "full_outer").fillna(0, ["before", "after"]).select("conv_id", F.lit(name).alias("pass"), "part", "before", "after")


def combine(effects: DataFrame) -> DataFrame:
    """(conv_id, part, removed, modified) over all passes."""
    return effects.groupBy("conv_id", "part").agg(F.sum(F.col("before") - F.col("after")).alias("removed"), F.bool_or(F.col("before") != F.col("after")).alias("modified"))


def checkpointed(memory: Memory) -> Memory:
    """Each component written and read again: the plan of the next pass starts from tables."""
    return Memory(**{k: folding.materialised(df) for k, df in memory.parts().items()})


def chain(*passes: Pass) -> Pass:
    return lambda memory: reduce(lambda m, p: p(m), passes, memory)


def fixed_point(memory: Memory, passes: list[Pass], rounds: int = 10) -> tuple[Memory, int]:
    """All passes again and again until one round removes nothing. Returns the memory and the rounds it took."""
    size = lambda m: {r["part"]: r["n"] for r in counts(m).groupBy("part").agg(F.sum("n").alias("n")).collect()}
    memory = checkpointed(memory)
    before = size(memory)
    for k in range(1, rounds + 1):
        memory = checkpointed(chain(*passes)(memory))
        now = size(memory)
        if now == before:
            return memory, k
        before = now
    return memory, rounds


def temporal_compression(least: int = 3, gap: int = 5, similarity: float = 0.5) -> Pass:
    return lambda memory: temporal.compress(memory, least, gap, similarity)
