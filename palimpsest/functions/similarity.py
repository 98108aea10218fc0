"""Similarities of triples, texts, names and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.fixed import CONTRADICTING_PREDICATES, EVENT_STOPWORDS, PREDICATE_SYNONYMS
from palimpsest.functions.text import literals, word_set

def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def text_jaccard(a: Column, b: Column) -> Column:
    return jaccard(word_set(a), word_set(b))


def event_jaccard(a: Column, b: Column) -> Column:
    """Without stopwords; 0 where either is empty then."""
    stop = literals(EVENT_STOPWORDS)
    x, y = F.array_except(word_set(a), stop), F.array_except(word_set(b), stop)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(jaccard(x, y))


def triple_similarity(a: str, b: str) -> Column:
    """String similarity of two facts in columns a.*, b.*: word overlap, more for equal subjects and predicates."""
    col = lambda side, f: F.col(f"{side}.{f}")
    same = lambda f: F.lower(col(a, f)) == F.lower(col(b, f))
    text = lambda s: F.concat_ws(" ", col(s, "subject"), col(s, "predicate"), col(s, "object"))
    wa, wb = word_set(text(a)), word_set(text(b))
    extra = F.when(same("subject"), 0.2).otherwise(0.0) + F.when(same("predicate"), 0.1).otherwise(0.0)
    return (F.when(same("subject") & same("predicate") & same("object"), 1.0)
            .when(F.size(F.array_union(wa, wb)) == 0, 0.0).otherwise(F.least(F.lit(1.0), jaccard(wa, wb) + extra)))


def weighted_equality(a: str, b: str) -> Column:
    """0.4, 0.3 and 0.3 for equal subject, predicate, object: where facts have no vectors."""
    same = lambda f, w: F.when(F.lower(F.col(f"{a}.{f}")) == F.lower(F.col(f"{b}.{f}")), w).otherwise(0.0)
    return same("subject", 0.4) + same("predicate", 0.3) + same("object", 0.3)


def synonym_group(predicate: Column) -> Column:
    """The group a predicate is in, or null."""
    out = None
    for name, members in ((m[0], m) for m in PREDICATE_SYNONYMS):
        hit = F.lower(predicate).isin(*members)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def recall_similarity(a: str, b: str) -> Column:
    """What evaluation compares facts by: equality, then containment or synonyms for half."""
    col = lambda s, f: F.lower(F.col(f"{s}.{f}"))

    def part(f: str, full: float, half: float) -> Column:
        x, y = col(a, f), col(b, f)
        near = synonym_group(x) == synonym_group(y) if f == "predicate" else x.contains(y) | y.contains(x)
        return F.when(x == y, full).when(near, half).otherwise(0.0)

    return part("subject", 0.4, 0.2) + part("predicate", 0.3, 0.15) + part("object", 0.3, 0.15)


def contradicts(a: str, b: str) -> Column:
    """Same subject and predicate, and either the same object negated once, or another object of a functional predicate."""
    col = lambda s, f: F.col(f"{s}.{f}")
    eq = lambda f: col(a, f) == col(b, f)
    return eq("subject") & eq("predicate") & (
        (eq("object") & (col(a, "negated") != col(b, "negated"))) | (~eq("object") & col(a, "predicate").isin(*CONTRADICTING_PREDICATES)))


def entails(a: str, b: str) -> Column:
    eq = lambda f: F.col(f"{a}.{f}") == F.col(f"{b}.{f}")
    return eq("subject") & eq("predicate") & eq("object")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm < 1e-10, 0.0).otherwise(dot(a, b) / norm)


def fuzzy_name(a: Column, b: Column) -> Column:
    """Share of a's characters that b has, over the longer length; spaces do not count, and order of arguments does."""
    x, y = (F.lower(F.regexp_replace(c, " ", "")) for c in (a, b))
    hits = F.size(F.filter(F.split(x, ""), lambda c: (c != "") & (F.instr(y, c) > 0)))
    return F.when(F.greatest(F.length(x), F.length(y)) == 0, 0.0).otherwise(hits / F.greatest(F.length(x), F.length(y)))


def overlap_share(a: Column, b: Column) -> Column:
    """Share of a's words that b has; 0 where a has none."""
    x, y = word_set(a), word_set(b)
    return F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))
