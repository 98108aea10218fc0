"""Scores: importance, relevance, recency, BM25, complexity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.fixed import ENTITY_WEIGHTS, EVENT_WEIGHTS, FACT_WEIGHTS


def weight_of(kind: Column, table: dict[str, float], default: float) -> Column:
    keys = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(keys, kind), F.lit(default))


def initial_entity(refs: Column) -> Column:
    return F.least(F.lit(1.0), refs * F.lit(0.1))


def initial_fact(confidence: Column, subject_importance: Column, turns: Column) -> Column:
    return confidence * 0.5 + F.coalesce(subject_importance, F.lit(0.0)) * 0.3 + F.least(F.lit(0.2), F.size(turns) * F.lit(0.05))


def initial_event(participants: Column) -> Column:
    return F.lit(0.5) + F.least(F.lit(0.3), F.size(participants) * F.lit(0.1))


def entity_importance(refs: Column, last_turn: Column, turns: Column, centrality: Column, kind: Column) -> Column:
    return (F.least(F.lit(1.0), refs / 10) * 0.3 + F.coalesce(last_turn / turns, F.lit(0.0)) * 0.3
            + F.coalesce(centrality, F.lit(0.0)) * 0.2 + weight_of(kind, ENTITY_WEIGHTS, 0.5) * 0.2)


def fact_importance(confidence: Column, sources: Column, turns: Column, ends: Column, kind: Column) -> Column:
    recency = F.when(F.size(sources) > 0, F.array_max(sources) / turns).otherwise(0.0)
    return (confidence * 0.2 + F.least(F.lit(1.0), F.size(sources) / 5) * 0.3 + recency * 0.3
            + F.coalesce(ends, F.lit(0.0)) * 0.2 + weight_of(kind, FACT_WEIGHTS, 0.5) * 0.2)


def event_importance(turn: Column, turns: Column, participants: Column, kind: Column) -> Column:
    return turn / turns * 0.3 + F.least(F.lit(1.0), F.size(participants) / 3) * 0.3 + weight_of(kind, EVENT_WEIGHTS, 0.5) * 0.2


def bm25(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * (tf * (k1 + 1)) / (tf + (F.lit(1 - b) + dl * b / (avgdl + 1e-10)) * k1)


def recency(age_seconds: Column, days: int = 30) -> Column:
    """1 now, 0 at that many days and before."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - age_seconds / F.lit(86400.0 * days))


def strategy(name: str, semantic: Column, recent: Column, importance: Column) -> Column:
    """The score of a retrieval strategy; unknown importance counts as a half."""
    i = F.coalesce(importance, F.lit(0.5))
    return {"semantic": semantic, "recency": recent * 0.7 + semantic * 0.3, "importance": i * 0.6 + semantic * 0.4,
            "hybrid": semantic * 0.5 + recent * 0.2 + i * 0.3}[name]


def rerank(score: Column, text_words: Column, query_words: Column) -> Column:
    return score * (F.lit(1.0) + F.size(F.array_intersect(text_words, query_words)) * F.lit(0.2) / (F.size(query_words) + 1))


def context_relevance(text_words: Column, query_words: Column) -> Column:
    return F.size(F.array_intersect(text_words, query_words)) / (F.size(query_words) + 1)


def combined(importance: Column, recent: Column, relevance: Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    return importance * weights[0] + recent * weights[1] + relevance * weights[2]


def complexity(entities: Column, facts: Column, relations: Column, events: Column, types: Column) -> Column:
    part = lambda n, top, w: F.least(F.lit(1.0), n / top) * w
    return F.least(F.lit(1.0), part(entities, 20, 0.25) + part(facts, 50, 0.3) + part(relations, 30, 0.2) + part(events, 40, 0.15) + types / 10 * 0.1)


def adaptive_budget(score: Column, base: int = 2048, least: float = 0.5, most: float = 1.5, target: float = 0.7) -> Column:
    ratio = F.when(score > target, F.least(F.lit(most), score - target + 1)).otherwise(F.greatest(F.lit(least), score / target))
    return F.floor(ratio * base).cast("int")


def density(text: Column) -> Column:
    """Capitalised words, numbers and dates, over words; 0 without words."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    edge = "(?U:\\b)"
    marks = (rf"{edge}[A-Z][a-z]+{edge}", rf"{edge}[0-9]+{edge}", rf"{edge}[0-9]{{1,2}}[/\-][0-9]{{1,2}}{edge}")
    hits = sum((F.regexp_count(text, F.lit(m)) for m in marks), F.lit(0))
    return F.when(n == 0, 0.0).otherwise(hits / n)
