"""The memory of many conversations: one DataFrame a component, each keyed by conv_id."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.fixed import INVERSE_RELATIONS, RELATION_FAMILIES

MENTIONS = "array<struct<turn:int,start:int,end:int>>"
SCHEMAS = {
    "turns": "conv_id bigint, turn int, role string, content string",
    "entities": f"conv_id bigint, ent_id string, ord bigint, name string, type string, aliases array<string>, attributes map<string,string>, mentions {MENTIONS}, importance double",
    "facts": "conv_id bigint, fact_id string, ord bigint, subject string, predicate string, object string, fact_type string, confidence double, source_turns array<int>, negated boolean, temporal_scope string, importance double",
    "relations": "conv_id bigint, rel_id string, src string, dst string, rtype string, confidence double, bidirectional boolean",
    "events": "conv_id bigint, evt_id string, ord bigint, description string, event_type string, turn int, participants array<string>, related_facts array<string>, importance double",
    "sequences": "conv_id bigint, seq_id string, ord bigint, summary string, sequence_type string, events array<struct<evt_id:string,turn:int,event_type:string,description:string,participants:array<string>,importance:double>>",
}

@dataclass(frozen=True)
class Memory:
    """A bundle of components; passes return a new one."""

    turns: DataFrame
    entities: DataFrame
    facts: DataFrame
    relations: DataFrame
    events: DataFrame
    sequences: DataFrame

    def with_(self, **parts: DataFrame) -> Memory:
        return replace(self, **parts)

    def parts(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def empty(spark: SparkSession) -> Memory:
    return Memory(**{k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()})


def conform(df: DataFrame, part: str) -> DataFrame:
    """The columns of a component in order; those that are missing are null."""
    said = [x.strip().split(" ", 1) for x in _columns(SCHEMAS[part])]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in said])


def _columns(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def name_index(entities: DataFrame) -> DataFrame:
    """(conv_id, lname, ent_id): entities by lower-cased name or alias; the last that took a name has it."""
    names = entities.select("conv_id", "ent_id", "ord", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    return names.groupBy("conv_id", F.lower("n").alias("lname")).agg(F.max_by("ent_id", "ord").alias("ent_id"))


def refs(mentions: Column) -> Column:
    return F.greatest(F.size(mentions), F.lit(0))


def last_turn(mentions: Column) -> Column:
    return F.array_max(F.transform(mentions, lambda m: m["turn"]))


def first_turn(mentions: Column) -> Column:
    return F.array_min(F.transform(mentions, lambda m: m["turn"]))


def turn_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("num_turns"))


# what the inserts, deletes and lookups of one memory are over many


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of old whose key new does not have, and new."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def find_or_create(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """asked entities that no name or alias finds are added."""
    known = name_index(entities)
    fresh = asked.join(known, (asked["conv_id"] == known["conv_id"]) & (F.lower(asked["name"]) == known["lname"]), "left_anti")
    return entities.unionByName(fresh)


def remove_entities(memory: Memory, gone: DataFrame) -> Memory:
    """Delete entities (conv_id, ent_id), the facts that name them exactly, and those facts' relations."""
    names = memory.entities.join(gone, ["conv_id", "ent_id"], "left_semi").select("conv_id", F.col("name").alias("n")).distinct()
    dead = names.join(memory.facts.select("conv_id", "fact_id", F.explode(F.array("subject", "object")).alias("n")), ["conv_id", "n"]).select("conv_id", "fact_id").distinct()
    return remove_facts(memory.with_(entities=memory.entities.join(gone, ["conv_id", "ent_id"], "left_anti")), dead)


def remove_facts(memory: Memory, gone: DataFrame) -> Memory:
    """Delete facts (conv_id, fact_id) and the relations that touch them."""
    rel = memory.relations
    for side in ("src", "dst"):
        rel = rel.join(gone.select("conv_id", F.col("fact_id").alias(side)), ["conv_id", side], "left_anti")
    return memory.with_(facts=memory.facts.join(gone, ["conv_id", "fact_id"], "left_anti"), relations=conform(rel, "relations"))


def remove_events(memory: Memory, gone: DataFrame) -> Memory:
    return memory.with_(events=memory.events.join(gone, ["conv_id", "evt_id"], "left_anti"))


def remove_relations(memory: Memory, gone: DataFrame) -> Memory:
    return memory.with_(relations=memory.relations.join(gone, ["conv_id", "rel_id"], "left_anti"))


def add_alias(name: Column, aliases: Column, alias: Column) -> Column:
    """aliases with one more, unless it is the name or there already."""
    return F.array_remove(F.array_union(aliases, F.array(alias)), name)


def facts_about(facts: DataFrame, name: str) -> DataFrame:
    return facts.filter((F.lower("subject") == name.lower()) | (F.lower("object") == name.lower()))


def both_ways(relations: DataFrame) -> DataFrame:
    """(conv_id, src, dst, rtype): bidirectional edges twice."""
    cols = ("conv_id", "src", "dst", "rtype")
    back = relations.filter("bidirectional").select("conv_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "rtype")
    return relations.select(*cols).unionByName(back)


def neighbours(relations: DataFrame) -> DataFrame:
    """(conv_id, fact_id, other): facts one relation away, either way."""
    out = relations.select("conv_id", F.col("src").alias("fact_id"), F.col("dst").alias("other"))
    return out.unionByName(relations.select("conv_id", F.col("dst").alias("fact_id"), F.col("src").alias("other"))).distinct()


def equivalents(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """(conv_id, fact_id, other): facts an equivalence away, and each fact itself; no closure."""
    own = facts.select("conv_id", "fact_id", F.col("fact_id").alias("other"))
    return own.unionByName(neighbours(relations.filter("rtype = 'equivalent'"))).distinct()


def inverse(relations: DataFrame) -> DataFrame:
    """Each relation turned round; a type without an inverse becomes related."""
    table = F.create_map(*[F.lit(x) for kv in INVERSE_RELATIONS.items() for x in kv])
    return relations.select("conv_id", F.concat("rel_id", F.lit("_inv")).alias("rel_id"), F.col("dst").alias("src"), F.col("src").alias("dst"),
                            F.coalesce(F.element_at(table, F.col("rtype")), F.lit("related")).alias("rtype"), "confidence", "bidirectional", F.col("rtype").alias("was"))


def family(rtype: Column) -> Column:
    out = None
    for name, members in RELATION_FAMILIES.items():
        out = F.when(rtype.isin(*members), name) if out is None else out.when(rtype.isin(*members), name)
    return out
