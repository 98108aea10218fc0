"""Languages by script and marker words, tokens, sentences, romaji."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.fixed import HIRAGANA, LANGUAGE_MARKERS, LANGUAGES, SCRIPT_LANGUAGES, SCRIPT_RANGES
from palimpsest.functions.text import W, literals

def script_count(text: Column, name: str) -> Column:
    a, z = SCRIPT_RANGES[name]
    return F.length(F.regexp_replace(text, f"[^\\x{{{a:x}}}-\\x{{{z:x}}}]", ""))


def scripts(text: Column) -> Column:
    """The scripts that occur, sorted."""
    return F.array_compact(F.array(*[F.when(script_count(text, s) > 0, s) for s in sorted(SCRIPT_RANGES)]))


def detect(text: Column, default: str = "en") -> Column:
    """struct(language, confidence): a script of 0.3 of what is no blank; else marker words; else the default at 0.3.

    Null and blank texts are the default's with confidence 0.
    """
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    others = list(SCRIPT_LANGUAGES)
    # scripts are counted only where one of them occurs, and markers only among the words that are markers
    any_script = text.rlike("[" + "".join("\\x{%x}-\\x{%x}" % SCRIPT_RANGES[s] for s in others) + "]")
    best = F.array_max(F.array(*[F.struct((script_count(text, s) / solid).alias("share"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(others)]))
    kana = script_count(text, "hiragana") + script_count(text, "katakana")
    lang = F.create_map(*[F.lit(x) for s in others for x in (s, SCRIPT_LANGUAGES[s])])
    by_script = F.when((best["s"] == "cjk") & (kana > F.length(text) * 0.1), "ja").otherwise(F.element_at(lang, best["s"]))
    ws = F.array_intersect(F.split(F.lower(text), r"\s+"), literals(sorted({w for m in LANGUAGE_MARKERS.values() for w in m})))
    hits = F.array_max(F.transform(F.array(ws), lambda own: F.array(*[F.struct(F.size(F.array_intersect(own, literals(m))).alias("n"), F.lit(-k).alias("k"), F.lit(c).alias("c")) for k, (c, m) in enumerate(LANGUAGE_MARKERS.items())]))[0])
    out = lambda c, p: F.struct(c.alias("language"), p.cast("double").alias("confidence"))
    by_words = F.transform(F.array(hits), lambda h: F.when(h["n"] == 0, out(F.lit(default), F.lit(0.3))).otherwise(out(h["c"], F.least(F.lit(1.0), h["n"] / F.lit(10.0) * 2))))[0]
    scripted = F.when(any_script, F.when(best["share"] >= 0.3, out(by_script, best["share"])))
    return F.when(text.isNull() | ~text.rlike(r"\S"), out(F.lit(default), F.lit(0.0))).otherwise(F.coalesce(scripted, by_words))


def from_code(code: Column) -> Column:
    two = F.substring(F.lower(code), 1, 2)
    return F.when(two.isin(*LANGUAGES), two).otherwise("unknown")


def sentences(text: Column, lang: str = "en") -> Column:
    parts = F.split(text, "[。！？\n]+" if lang == "zh" else r"(?<=[.!?。！？])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def tokens(text: Column, lang: str = "en") -> Column:
    """Words and marks; single characters in Chinese, runs of a script in Japanese and Korean."""
    pattern = {"zh": r"([\x{4e00}-\x{9fff}]|[A-Za-z0-9]+)", "ja": r"([\x{4e00}-\x{9fff}]+|[\x{3040}-\x{309f}]+|[\x{30a0}-\x{30ff}]+|[A-Za-z0-9]+)", "ko": rf"([\x{{ac00}}-\x{{d7af}}]+|{W}+)"}.get(lang, rf"({W}+|[^\s\p{{L}}\p{{N}}_])")
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def tokens_mixed(text: Column) -> Column:
    """Tokens as the detected language has them."""
    lang = detect(text)["language"]
    return F.when(lang == "zh", tokens(text, "zh")).when(lang == "ja", tokens(text, "ja")).when(lang == "ko", tokens(text, "ko")).otherwise(tokens(text))


def romaji(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in HIRAGANA.items() for x in kv])
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
