"""Words, identifiers, token estimates and the expressions that extraction uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.fixed import STOPWORDS

#: A word character in any script: what \w alone is not in Java.
W = r"[\p{L}\p{N}_]"
IS_FACT = rf"(?i)({W}+(?:\s+{W}+)?)\s+(?:is|am|are)\s+(?:a\s+)?({W}+(?:\s+{W}+)?)"
WORKS_FACT = rf"(?i)({W}+)\s+works?\s+(?:at|for)\s+({W}+(?:\s+{W}+)?)"
NAME_FACT = rf"(?i)(?:my|the)\s+name\s+is\s+({W}+)"
QUESTION = r"[^.!?]*\?"


def literals(values) -> Column:
    """An array of string literals."""
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def words(c: Column) -> Column:
    """Lower-cased words between white space; none of them is empty."""
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def keywords(c: Column, stopwords=STOPWORDS) -> Column:
    """Lower-cased ASCII words of two characters or more that no stopword is; a word in part non-ASCII counts as none."""
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"({W}+)"), F.lit(1))
    return F.filter(found, lambda w: w.rlike("^[a-z0-9]+$") & (F.length(w) > 1) & ~w.isin(*stopwords))


def ident(prefix: str, *parts: Column) -> Column:
    """A deterministic id of natural keys: 64 bits of a hash, as with 32 two rows of a conversation of some 100,000 have one id."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 16))


def tokens_quarter(c: Column) -> Column:
    """A token for every four characters: what generation counts by."""
    return F.floor(F.length(c) / 4).cast("long")


def tokens_scaled(c: Column) -> Column:
    """1.3 tokens a word, truncated: what packing counts by."""
    return F.floor(F.size(words(c)) * F.lit(13) / F.lit(10)).cast("long")


def tokens_thirds(c: Column) -> Column:
    """Four tokens for three words: what chat buffers count by."""
    return F.floor(F.size(words(c)) * F.lit(4) / F.lit(3)).cast("long")


def tokens_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def sentence(subject: Column, predicate: Column, obj: Column, negated: Column) -> Column:
    """A triple as natural language."""
    return F.concat_ws(" ", subject, F.when(negated, F.lit("not")), predicate, obj)


def clip(text: Column, most: int) -> Column:
    """Text cut to most characters, an ellipsis at the cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
