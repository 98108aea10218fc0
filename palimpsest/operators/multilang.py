"""Extraction in several languages: patterns by language, segments, names across languages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palimpsest.fixed import CROSS_LINGUAL_NAMES
from palimpsest.functions import lang
from palimpsest.functions.text import W, ident

_B = r"(?U:\b)"
_CJK, _KATA = r"[\x{4e00}-\x{9fa5}]", r"[\x{30a1}-\x{30f4}\x{30fc}]"
_EN, _ES = "[A-Z][a-z]+", "[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+"

# Language, kind, expressions; the first group is what is found.
PATTERNS = {
    "en": {
        "person": [rf"({_B}(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+{_EN}(?:\s+{_EN})*)", rf"({_B}{_EN}(?:\s+{_EN}){{1,2}}{_B})"],
        "location": [rf"{_B}in\s+({_EN}(?:\s+{_EN})*)", rf"{_B}from\s+({_EN}(?:\s+{_EN})*)"],
        "time": [rf"({_B}[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}{_B})", rf"({_B}(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+[0-9]{{1,2}}(?:,?\s*[0-9]{{4}})?{_B})"],
    },
    "zh": {
        "person": [rf"([李王张刘陈杨黄赵周吴]{_CJK}{{1,2}})", rf"((?:先生|女士|小姐)\s*{_CJK}{{2,3}})"],
        "location": [rf"在\s*({_CJK}{{2,6}}(?:省|市|区|县|镇|村))", rf"来自\s*({_CJK}{{2,6}})"],
        "time": [r"([0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)", r"([0-9]{1,2}月[0-9]{1,2}日)"],
    },
    "es": {
        "person": [rf"({_B}(?:Sr|Sra|Srta|Dr|Dra)\.?\s+{_ES}(?:\s+{_ES})*)", rf"({_B}{_ES}(?:\s+{_ES}){{1,2}}{_B})"],
        "location": [rf"{_B}en\s+({_ES}(?:\s+{_ES})*)", rf"{_B}de\s+({_ES}(?:\s+{_ES})*)"],
        "time": [rf"({_B}[0-9]{{1,2}}\s+de\s+(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre){_B})", rf"({_B}[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}{_B})"],
    },
    "ja": {
        "person": [rf"({_CJK}{{1,4}}(?:さん|様|氏|君))", rf"({_KATA}+(?:さん|様))"],
        "location": [rf"({_CJK}{{2,6}}(?:都|道|府|県|市|区|町|村))"],
        "time": [r"([0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日)", r"((?:令和|平成|昭和)[0-9]{1,2}年)"],
    },
}
# Language, predicate, expression of subject and object.
RELATIONS = {
    "en": {"works_at": rf"({W}+)\s+works?\s+at\s+({W}+)", "lives_in": rf"({W}+)\s+lives?\s+in\s+({W}+)", "is_a": rf"({W}+)\s+is\s+(?:a|an)\s+({W}+)", "has": rf"({W}+)\s+has\s+(?:a|an)?\s*({W}+)"},
    "es": {"works_at": rf"({W}+)\s+trabaja\s+en\s+({W}+)", "lives_in": rf"({W}+)\s+vive\s+en\s+({W}+)", "is_a": rf"({W}+)\s+es\s+(?:un|una)\s+({W}+)"},
    "zh": {"works_at": rf"({_CJK}+)\s*在\s*({_CJK}+)\s*工作", "lives_in": rf"({_CJK}+)\s*住在\s*({_CJK}+)", "is_a": rf"({_CJK}+)\s*是\s*(?:一个|一名)?\s*({_CJK}+)"},
    "ja": {"works_at": rf"((?:{_CJK}|{_KATA})+)は\s*((?:{_CJK}|{_KATA})+)で働", "lives_in": rf"((?:{_CJK}|{_KATA})+)は\s*((?:{_CJK}|{_KATA})+)に住"},
}
CONFIDENCE = {"person": 0.7, "location": 0.5, "time": 0.4}


def detected(texts: DataFrame, text: str = "content") -> DataFrame:
    """texts with language, one of those that patterns are for."""
    d = lang.detect(F.col(text))["language"]
    return texts.withColumn("language", F.when(d.isin(*PATTERNS), d).otherwise("en"))


def entities(texts: DataFrame, text: str = "content", key: str = "conv_id") -> DataFrame:
    """(key, ent_id, name, type, importance) by the patterns of each text's language; a lower-cased name once."""
    got = []
    rank = 0
    for code, kinds in PATTERNS.items():
        for kind, expressions in kinds.items():
            for e in expressions:
                found = texts.filter(F.col("language") == code).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(e), F.lit(1))).alias("pos", "name"))
                got.append(found.select(key, "name", F.lit(kind).alias("type"), F.lit(CONFIDENCE[kind]).alias("importance"), F.struct(F.lit(rank).alias("rank"), "pos").alias("o")))
                rank += 1
    every = reduce(DataFrame.unionByName, got).withColumn("name", F.trim("name")).filter(F.length("name") > 1)
    first = every.groupBy(key, F.lower("name").alias("lname")).agg(F.min_by(F.struct("name", "type", "importance"), "o").alias("e"))
    return first.select(key, ident("ent_", F.col(key), F.col("lname")).alias("ent_id"), "e.*")


def relation_facts(texts: DataFrame, ents: DataFrame, text: str = "content", key: str = "conv_id") -> DataFrame:
    """(key, subject, predicate, object, confidence) whose subject or object is an entity of the text."""
    got = []
    for code, table in RELATIONS.items():
        for predicate, e in table.items():
            both = F.arrays_zip(F.regexp_extract_all(text, F.lit("(?i)" + e), F.lit(1)).alias("subject"), F.regexp_extract_all(text, F.lit("(?i)" + e), F.lit(2)).alias("object"))
            got.append(texts.filter(F.col("language") == code).select(key, F.explode(both).alias("m")).select(key, "m.subject", F.lit(predicate).alias("predicate"), "m.object"))
    every = reduce(DataFrame.unionByName, got).withColumn("confidence", F.lit(0.7)).distinct()
    names = ents.select(key, F.lower("name").alias("n")).distinct()
    hit = lambda side: every.withColumn("n", F.lower(side)).join(names, [key, "n"], "left_semi").drop("n")
    return hit("subject").unionByName(hit("object")).distinct()


# Expressions of subject, attribute and value: Chinese, and what all other languages have.
ATTRIBUTES = {
    "zh": (rf"({_CJK}+)的({_CJK}+)是({_CJK}+)",),
    "en": (rf"({W}+)'s\s+({W}+)\s+is\s+({W}+)", rf"({W}+)\s+has\s+({W}+)\s+({W}+)"),
}


def attribute_facts(texts: DataFrame, ents: DataFrame, text: str = "content", key: str = "conv_id") -> DataFrame:
    """(key, subject, predicate, object, confidence) of the forms X's Y is Z and X has Y Z, about entities."""
    parts = lambda e: F.arrays_zip(*[F.regexp_extract_all(text, F.lit("(?i)" + e), F.lit(k)).alias(n) for k, n in ((1, "subject"), (2, "a"), (3, "object"))])
    rows = lambda df, e: df.select(key, F.explode(parts(e)).alias("m"))
    chinese = F.col("language") == "zh"
    got = [rows(texts.filter(chinese), e) for e in ATTRIBUTES["zh"]] + [rows(texts.filter(~chinese), e) for e in ATTRIBUTES["en"]]
    every = reduce(DataFrame.unionByName, got).select(key, F.trim("m.subject").alias("subject"), F.concat(F.lit("has_"), F.trim("m.a")).alias("predicate"), F.trim("m.object").alias("object"), F.lit(0.6).alias("confidence"))
    return every.withColumn("n", F.lower("subject")).join(ents.select(key, F.lower("name").alias("n")).distinct(), [key, "n"], "left_semi").drop("n")


def segments(texts: DataFrame, key: str, text: str = "content", least: int = 20) -> DataFrame:
    """(key, segment, language, content): neighbouring sentences of one language together; short segments go."""
    each = texts.select(key, F.posexplode(F.split(text, "[.!?。！？\n]+")).alias("pos", "s")).withColumn("s", F.trim("s")).filter("s != ''").withColumn("language", lang.detect(F.col("s"))["language"])
    w = Window.partitionBy(key).orderBy("pos")
    run = each.withColumn("new", F.when(F.col("language") == F.lag("language").over(w), 0).otherwise(1)).withColumn("segment", F.sum("new").over(w))
    got = run.groupBy(key, "segment", "language").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("l"))
    return got.select(key, "segment", "language", F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("content")).filter(F.length("content") >= least)


def known_names(spark) -> DataFrame:
    """(name, pivot) of the names that are known in several languages."""
    return spark.createDataFrame(list(CROSS_LINGUAL_NAMES.items()), "name string, pivot string")


def cross_lingual(entities_: DataFrame, mapping: DataFrame) -> DataFrame:
    """(cluster, ent_ids): entities whose names map to one pivot name by mapping (name, pivot), a table of bounded size."""
    pivot = mapping.select(F.lower("name").alias("ln"), F.lower("pivot").alias("p")).unionByName(mapping.select(F.lower("pivot").alias("ln"), F.lower("pivot").alias("p"))).distinct()
    named = entities_.withColumn("ln", F.lower("name")).join(F.broadcast(pivot), "ln", "left").withColumn("cluster", F.coalesce("p", "ln"))
    return named.groupBy("cluster").agg(F.array_sort(F.collect_set("ent_id")).alias("ent_ids"))
