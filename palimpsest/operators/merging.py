"""Memories into one: union, resolution of entities, conflicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import ir
from palimpsest.fixed import UNIQUE_PREDICATES
from palimpsest.functions.similarity import cosine, fuzzy_name
from palimpsest.ir import Memory
from palimpsest.operators.selection import top_k



def _first(df: DataFrame, key: list[Column], latest: bool, *rank: Column) -> DataFrame:
    """One row a key, by the rank, then the order of memories (the last first where latest) and of rows."""
    order = F.struct(*[c.alias(f"r{k}") for k, c in enumerate(rank)], (-F.col("memory") if latest else F.col("memory")).alias("m"), F.col("ord").alias("o"))
    keys = {f"__k{k}": c for k, c in enumerate(key)}
    got = df.withColumns(keys).groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("row"))
    return got.select("row.*")


def union_entities(df: DataFrame, latest: bool = False) -> DataFrame:
    """Entities of (memory, conv_id, …), the first of each lower-cased name."""
    return _first(df, [F.col("conv_id"), F.lower("name")], latest)


def union_facts(df: DataFrame, latest: bool = False) -> DataFrame:
    return _first(df, [F.col("conv_id"), F.lower(F.concat_ws("|", "subject", "predicate", "object"))], latest)


def union_by_id(df: DataFrame, key: str, latest: bool = False) -> DataFrame:
    return _first(df, [F.col("conv_id"), F.col(key)], latest)


def surest_facts(df: DataFrame) -> DataFrame:
    """Of equal facts the most confident; of equally confident ones the first."""
    return _first(df, [F.col("conv_id"), F.lower(F.concat_ws("|", "subject", "predicate", "object"))], False, -F.col("confidence"))


def in_all(df: DataFrame, memories: int) -> DataFrame:
    """Facts that every memory has, as the first has them."""
    key = F.lower(F.concat_ws("|", "subject", "predicate", "object"))
    common = df.groupBy("conv_id", key.alias("k")).agg(F.countDistinct("memory").alias("n")).filter(F.col("n") == memories)
    return union_facts(df.withColumn("k", key).join(common, ["conv_id", "k"], "left_semi").drop("k"))


def limited(df: DataFrame, n: int) -> DataFrame:
    return top_k(df, n, [F.desc("importance"), F.col("ord")], "conv_id").drop("rank")


def match_score(a: str = "a", b: str = "b", vectors: bool = False) -> Column:
    """Of two entities: equal names 1, other types 0, a shared alias 0.95, else the better of letters and vectors."""
    c = lambda s, f: F.col(f"{s}.{f}")
    low = lambda s: F.transform(F.array_union(F.array(c(s, "name")), c(s, "aliases")), lambda x: F.lower(x))
    fuzzy = fuzzy_name(c(a, "name"), c(b, "name"))
    near = F.greatest(fuzzy, cosine(c(a, "embedding"), c(b, "embedding"))) if vectors else fuzzy
    return F.when(F.lower(c(a, "name")) == F.lower(c(b, "name")), 1.0).when(c(a, "type") != c(b, "type"), 0.0).when(F.arrays_overlap(low(a), low(b)), 0.95).otherwise(near)


def _spelt(df: DataFrame, side: str) -> DataFrame:
    """(conv_id, type, ent_id as i{side}, and the sorted letters of its name): names of one spelling of letters score alike."""
    text = F.lower(F.regexp_replace("name", " ", ""))
    letters = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return df.select("conv_id", "type", F.col("ent_id").alias(f"i{side}"), (letters if side == "a" else F.array_distinct(letters)).alias(f"l{side}"), F.length(text).alias(f"n{side}"))


def _alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(conv_id, ia, ib) of one type whose names' letters reach the threshold, which is over 0.

    The letters of names are compared, not names: different ones of left, rarest letter first, and different sets of right. A
    right set lacks at most so many letters, so it has one of the rarest that are more.
    """
    own, other = _spelt(left, "a"), _spelt(right, "b")
    xs, ys = own.select("conv_id", "type", "la", "na").distinct(), other.select("conv_id", "type", "lb", "nb").distinct()
    posts = ys.withColumn("k", F.explode("lb"))
    df = posts.groupBy("conv_id", "type", "k").agg(F.count(F.lit(1)).alias("df"))
    each = xs.withColumn("k", F.explode(F.array_distinct("la"))).join(df, ["conv_id", "type", "k"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = each.groupBy("conv_id", "type", "la", "na").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("r"))
    count = lambda k: F.size(F.filter("la", lambda c: c == k))
    spare = F.col("na") - F.ceil(F.col("na") * F.lit(threshold) - 1e-9)
    before = lambda i: F.aggregate(F.slice("r", 1, i), F.lit(0), lambda n, x: n + count(x["k"]))
    probes = rare.withColumn("probe", F.filter("r", lambda x, i: before(i) <= spare)).select("conv_id", "type", "la", "na", F.explode("probe.k").alias("k"))
    hits = F.size(F.filter("la", lambda c: F.array_contains("lb", c)))
    met = probes.join(posts, ["conv_id", "type", "k"]).filter(hits >= F.greatest("na", "nb") * F.lit(threshold) - 1e-9).select("conv_id", "type", "la", "na", "lb", "nb").distinct()
    return own.join(met, ["conv_id", "type", "la", "na"]).join(other, ["conv_id", "type", "lb", "nb"]).select("conv_id", "ia", "ib")


def candidates(left: DataFrame, right: DataFrame, threshold: float = 0.8, vectors: bool = False, equal: bool = False) -> DataFrame:
    """(conv_id, a, b, oa, ob, score) of pairs in one conversation at the threshold or above; with equal, only of names equal but for case.

    Pairs meet by equal names, by a shared alias, and by the letters of names; only with vectors by any shared letter.
    Nothing crosses conversations.
    """
    blank = lambda c: F.replace(c, F.lit(" "), F.lit("")) == ""

    def named(df: DataFrame, side: str, column) -> DataFrame:
        return df.select("conv_id", *([] if side in "ab" else ["type"]), F.col("ent_id").alias(f"i{side[0]}"), column.alias("n")).filter(~blank(F.col("n"))).distinct()

    def keyed(df: DataFrame, side: str) -> DataFrame:
        text = F.lower(F.regexp_replace(F.concat_ws("", F.array(F.col("name")), F.col("aliases")), " ", ""))
        return df.select("conv_id", F.col("ent_id").alias(f"i{side}"), F.explode(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))).alias("k"))

    same = named(left, "a", F.lower("name")).join(named(right, "b", F.lower("name")), ["conv_id", "n"])
    if equal:
        key = same
    elif vectors or threshold <= 0:
        key = keyed(left, "a").join(keyed(right, "b"), ["conv_id", "k"])
    else:
        names = F.explode(F.transform(F.array_union(F.array("name"), "aliases"), lambda x: F.lower(x)))
        shared = named(left, "a+", names).join(named(right, "b+", names), ["conv_id", "type", "n"])
        key = same.select("conv_id", "ia", "ib").unionByName(shared.select("conv_id", "ia", "ib")).unionByName(_alike(left, right, threshold))
    key = key.select("conv_id", "ia", "ib").distinct()
    a, b = left.alias("a"), right.alias("b")
    both = key.join(a, (key["conv_id"] == F.col("a.conv_id")) & (key["ia"] == F.col("a.ent_id"))).join(b, (key["conv_id"] == F.col("b.conv_id")) & (key["ib"] == F.col("b.ent_id")))
    scored = both.select(key["conv_id"], "ia", "ib", F.col("a.ord").alias("oa"), F.col("b.ord").alias("ob"), match_score("a", "b", vectors).alias("score")).filter(F.col("score") >= threshold)
    return scored.select("conv_id", F.col("ia").alias("a"), F.col("ib").alias("b"), "oa", "ob", "score")


def resolve(pairs: DataFrame) -> DataFrame:
    """(conv_id, a, b, score): each left entity in order takes its best free right one. Order decides: a conversation is one task's."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for _, own in pdf.sort_values(["oa", "ob"], kind="stable").groupby("oa", sort=True):
            free = own[~own["b"].isin(used)]
            if len(free):
                best = free.loc[free["score"].idxmax()]
                used.add(best["b"])
                out.append((best["conv_id"], best["a"], best["b"], best["score"]))
        return pd.DataFrame(out, columns=["conv_id", "a", "b", "score"])

    return pairs.groupBy("conv_id").applyInPandas(run, "conv_id bigint, a string, b string, score double")


def merge_entities(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """left with what its matches know: their names as aliases, their attributes where it has none, the larger importance."""
    m = matches.select("conv_id", F.col("a").alias("ent_id"), F.col("b").alias("__b"))
    r = right.select("conv_id", F.col("ent_id").alias("__b"), F.struct("name", "aliases", "attributes", "mentions", "importance").alias("r"))
    own = left.join(m, ["conv_id", "ent_id"], "left").join(r, ["conv_id", "__b"], "left")
    hit = F.col("r").isNotNull()
    keys = F.map_filter("r.attributes", lambda k, v: ~F.array_contains(F.map_keys("attributes"), k))
    out = own.withColumns({
        "aliases": F.when(hit, F.array_remove(F.array_union(F.array_union("aliases", "r.aliases"), F.array("r.name")), F.col("name"))).otherwise(F.col("aliases")),
        "attributes": F.when(hit, F.map_concat("attributes", keys)).otherwise(F.col("attributes")),
        "mentions": F.when(hit, F.concat("mentions", "r.mentions")).otherwise(F.col("mentions")), "importance": F.greatest("importance", F.coalesce("r.importance", F.lit(0.0)))})
    new = right.join(matches.select("conv_id", F.col("b").alias("ent_id")), ["conv_id", "ent_id"], "left_anti").withColumn("ent_id", F.concat("ent_id", F.lit("_merged")))
    return ir.conform(out, "entities").unionByName(ir.conform(new, "entities"))


def canonical(clusters: DataFrame) -> DataFrame:
    """(cluster, name, aliases, importance) of (cluster, ent_id, ord, name, aliases, mentions, importance): the most mentioned name."""
    per = clusters.groupBy("cluster", "name").agg(F.sum(F.size("mentions")).alias("n"), F.min("ord").alias("ord"))
    name = per.groupBy("cluster").agg(F.max_by("name", F.struct("n", (-F.col("ord")).alias("o"))).alias("name"))
    rest = clusters.groupBy("cluster").agg(F.array_distinct(F.flatten(F.collect_list(F.array_union(F.array("name"), "aliases")))).alias("all"), F.max("importance").alias("importance"))
    return name.join(rest, "cluster").select("cluster", "name", F.array_sort(F.array_remove("all", F.col("name"))).alias("aliases"), "importance")


def remap(facts: DataFrame, matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """facts whose subject or object names a matched right entity name the left one."""
    names = matches.join(left.select("conv_id", F.col("ent_id").alias("a"), F.col("name").alias("to")), ["conv_id", "a"]).join(right.select("conv_id", F.col("ent_id").alias("b"), F.col("name").alias("from")), ["conv_id", "b"])
    for side in ("subject", "object"):
        facts = facts.join(names.select("conv_id", F.col("from").alias(side), "to").dropDuplicates(["conv_id", side]), ["conv_id", side], "left").withColumn(side, F.coalesce("to", side)).drop("to")
    return facts


def fact_conflicts(facts: DataFrame) -> DataFrame:
    """(conv_id, a, b, conflict, cross) of (memory, …) facts with one subject and predicate: duplicates and contradictions."""
    f = facts.select("conv_id", "memory", "ord", "fact_id", F.lower("subject").alias("s"), F.lower("predicate").alias("p"), F.lower("object").alias("o"))
    a, b = f.alias("a"), f.alias("b")
    before = F.struct("a.memory", "a.ord") < F.struct("b.memory", "b.ord")
    both = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.p") == F.col("b.p")) & before)
    unique = F.lit(False)
    for u in UNIQUE_PREDICATES:
        unique = unique | F.col("a.p").contains(u)
    kind = F.when(F.col("a.o") == F.col("b.o"), "duplicate_fact").when(unique, "contradictory_facts")
    return both.select(F.col("a.conv_id").alias("conv_id"), F.col("a.fact_id").alias("a"), F.col("b.fact_id").alias("b"), kind.alias("conflict"), (F.col("a.memory") != F.col("b.memory")).alias("cross")).filter("conflict is not null")


def type_conflicts(entities: DataFrame) -> DataFrame:
    """(conv_id, lname, types): names with more than one type."""
    return entities.groupBy("conv_id", F.lower("name").alias("lname")).agg(F.array_sort(F.collect_set("type")).alias("types")).filter(F.size("types") > 1)


def attribute_conflicts(entities: DataFrame) -> DataFrame:
    """(conv_id, lname, attribute, values): the first attribute of a name with more than one value."""
    each = entities.select("conv_id", F.lower("name").alias("lname"), F.explode("attributes").alias("attribute", "v"), "ord")
    many = each.groupBy("conv_id", "lname", "attribute").agg(F.array_sort(F.collect_set("v")).alias("values"), F.min("ord").alias("ord")).filter(F.size("values") > 1)
    return many.groupBy("conv_id", "lname").agg(F.min_by(F.struct("attribute", "values"), F.struct("ord", "attribute")).alias("x")).select("conv_id", "lname", "x.attribute", "x.values")


def resolved(conflicts: DataFrame, facts: DataFrame, method: str = "keep_latest") -> DataFrame:
    """(conv_id, a, b, conflict, winner): duplicates go to the surer; contradictions by the method; keep_both has no winner."""
    own = facts.select("conv_id", "fact_id", "confidence", "importance")
    side = lambda k: own.select("conv_id", F.col("fact_id").alias(k), F.col("confidence").alias(f"c{k}"), F.col("importance").alias(f"i{k}"))
    both = conflicts.join(side("a"), ["conv_id", "a"]).join(side("b"), ["conv_id", "b"])
    by = {"keep_first": F.col("a"), "keep_latest": F.when(F.col("ib") > F.col("ia"), F.col("b")).otherwise(F.col("a")), "keep_both": F.lit(None).cast("string"), "drop": F.lit(None).cast("string")}[method]
    surer = F.when(F.col("ca") >= F.col("cb"), F.col("a")).otherwise(F.col("b"))
    return both.select("conv_id", "a", "b", "conflict", F.when(F.col("conflict") == "duplicate_fact", surer).otherwise(by).alias("winner"))


def conflict_summary(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("conflict").count()


def merge(parts: list[Memory], how: str = "union", entities: int | None = None, facts: int | None = None) -> Memory:
    """Memories in order into one: union, latest, or smart, which first matches entities and keeps the surest of equal facts."""
    tag = lambda name: [getattr(m, name).withColumn("memory", F.lit(k)) for k, m in enumerate(parts)]

    def every(name: str) -> DataFrame:
        out, *rest = tag(name)
        for r in rest:
            out = out.unionByName(r)
        return out

    latest = how == "latest"
    f = surest_facts(every("facts")) if how == "smart" else union_facts(every("facts"), latest)
    if how == "smart":
        e = parts[0].entities
        for m in parts[1:]:
            e = merge_entities(e, m.entities, resolve(candidates(e, m.entities)))
    else:
        e = union_entities(every("entities"), latest)
    one = lambda name, key: ir.conform(union_by_id(every(name) if "ord" in ir.SCHEMAS[name] else every(name).withColumn("ord", F.lit(0)), key, latest), name)
    e, f = ir.conform(e, "entities"), ir.conform(f, "facts")
    turns = union_by_id(every("turns").withColumn("ord", F.col("turn")), "turn", latest)
    return Memory(turns=ir.conform(turns, "turns"), entities=limited(e, entities) if entities else e, facts=limited(f, facts) if facts else f,
                  relations=one("relations", "rel_id"), events=one("events", "evt_id"), sequences=one("sequences", "seq_id"))
