"""A memory as items under a budget, packed and rendered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import ir
from palimpsest.fixed import MARKDOWN_HEADERS, QUERY_WORDS, STRUCTURED_HEADERS
from palimpsest.functions import scores
from palimpsest.functions.text import tokens_scaled, word_set
from palimpsest.ir import Memory
from palimpsest.operators import selection

TYPE_ORDER = ("summary", "entity", "fact", "event")


def items(memory: Memory, query: str | None = None) -> DataFrame:
    """(conv_id, id, ord, content, tokens, importance, recency, relevance, item_type) of entities, facts and summaries."""
    attrs = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    named = F.concat_ws(" - ", F.concat("name", F.lit(" ("), "type", F.lit(")")), F.when(F.size("aliases") > 0, F.concat(F.lit("Also known as: "), F.array_join("aliases", ", "))),
                        F.when(F.size("attributes") > 0, F.concat(F.lit("Attributes: "), attrs)))
    last = ir.last_turn(F.col("mentions"))
    top = memory.entities.select("conv_id", last.alias("t")).unionByName(memory.facts.select("conv_id", F.array_max("source_turns").alias("t"))).groupBy("conv_id").agg(F.coalesce(F.nullif(F.max("t"), F.lit(0)), F.lit(1)).alias("top"))
    asked = F.array(*map(F.lit, sorted(set(query.lower().split())))) if query else None

    def row(df: DataFrame, kind: str, key: Column, content: Column, importance: Column, recency: Column) -> DataFrame:
        relevant = scores.context_relevance(word_set(content), asked) if query else F.lit(0.5)
        return df.join(top, "conv_id", "left").select("conv_id", F.concat(F.lit(f"{kind}:"), key).alias("id"), (F.lit({"entity": 0, "fact": 1, "summary": 2}[kind] << 56) + F.col("ord")).alias("ord"), content.alias("content"), tokens_scaled(content).alias("tokens"),
                                                      importance.alias("importance"), recency.alias("recency"), relevant.alias("relevance"), F.lit(kind).alias("item_type"))

    turn = F.nullif(F.array_max("source_turns"), F.lit(0))
    return reduce(DataFrame.unionByName, (
        row(memory.entities, "entity", F.col("ent_id"), named, F.col("importance"), F.coalesce(last / F.col("top"), F.lit(0.5))),
        row(memory.facts, "fact", F.col("fact_id"), F.concat_ws(" ", "subject", "predicate", "object"), F.col("importance"), F.coalesce(turn / F.col("top"), F.lit(0.5))),
        row(memory.sequences, "summary", F.col("seq_id"), F.col("summary"), F.lit(0.8), F.lit(0.9))))


def pack(things: DataFrame, how: str = "balanced", budget: int = 4000, group: str = "conv_id", weights=(0.4, 0.3, 0.3)) -> DataFrame:
    """things that fit the budget: greedy, query_focused, balanced and hierarchical pass over what is too large; or knapsack."""
    if how == "knapsack":
        value = (F.col("importance") + F.col("recency") + F.col("relevance")) / 3
        asked = things.select(group, "id", value.alias("value"), F.col("tokens").alias("weight"), "ord", F.lit(budget).alias("budget"))
        return things.join(selection.knapsack_by_group(asked, group), [group, "id"], "left_semi")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("item_type")), F.lit(0)), F.lit(9))
    score = scores.combined(F.col("importance"), F.col("recency"), F.col("relevance"), weights)
    order = {"greedy": [-F.col("importance")], "query_focused": [-F.col("relevance"), -F.col("importance")], "balanced": [-score], "hierarchical": [rank, -F.col("importance")]}[how]
    return things.join(selection.greedy(things, group, "id", "tokens", [*order, F.col("ord")], F.lit(budget)), [group, "id"], "left_semi")


def optimise(memory: Memory, query: str | None = None, how: str = "balanced", tokens: int = 4000, reserve: int = 500, system: int = 200, extra: int = 0) -> DataFrame:
    """Items of the memory that fit what the reserves leave of the tokens."""
    return pack(items(memory, query), how, tokens - reserve - system - extra)


def adaptive(things: DataFrame, query: str, budget: int, group: str = "conv_id") -> DataFrame:
    """Filtered as the kind of query asks, then the best by the mean of the three scores."""
    low = query.lower()
    kind = next((k for k, ws in QUERY_WORDS if any(w in low for w in ws)), "general")
    chosen = selection.select(things, **selection.criteria_for(kind))
    mean = (F.col("importance") + F.col("recency") + F.col("relevance")) / 3
    return chosen.join(selection.greedy(chosen, group, "id", "tokens", [-mean, F.col("ord")], F.lit(budget)), [group, "id"], "left_semi")


def truncate(things: DataFrame, most: int) -> DataFrame:
    """Contents cut to most characters; their tokens are words then."""
    long = F.length("content") > most
    cut = F.concat(F.substring("content", 1, most - 3), F.lit("..."))
    return things.withColumns({"tokens": F.when(long, F.size(F.filter(F.split(cut, r"\s+"), lambda w: w != ""))).otherwise(F.col("tokens")), "content": F.when(long, cut).otherwise(F.col("content"))})


def overlap(things: DataFrame, query: str, least: int = 1) -> DataFrame:
    return things.filter(F.size(F.array_intersect(word_set(F.col("content")), F.array(*map(F.lit, sorted(set(query.lower().split())))))) >= least)


def render(things: DataFrame, form: str = "plain", group: str = "conv_id", additional: str | None = None) -> DataFrame:
    """(group, text): plain, structured, xml, markdown or json; types in order of their first item, additional text first."""
    more = additional or ""
    ordered = things.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(F.col("item_type").alias("type"), "content", "importance").alias("x")))).alias("l"))
    if form == "json":
        body = F.struct(F.lit(more).alias("additional"), F.transform("l", lambda x: x["x"]).alias("items"))
        return ordered.select(group, F.to_json(F.struct(body.alias("context"))).alias("text"))
    if form == "plain":
        lines = F.transform("l", lambda x: x["x"]["content"])
        return ordered.select(group, F.array_join(F.concat(F.array(F.lit(more)), lines) if more else lines, "\n").alias("text"))
    by = things.groupBy(group, "item_type").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "content"))).alias("l"))
    kind = F.col("item_type")

    def header(table: dict[str, str], before: str) -> Column:
        said = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.coalesce(F.element_at(said, kind), F.concat(F.lit(before), F.initcap(kind)))

    def lines_of(line) -> Column:
        return F.array_join(F.transform("l", line), "\n")

    escaped = lambda x: F.replace(F.replace(x["content"], F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    block = {
        "structured": F.concat(F.lit("\n--- "), header(STRUCTURED_HEADERS, ""), F.lit(" ---\n"), lines_of(lambda x: F.concat(F.lit("• "), x["content"]))),
        "xml": F.concat(F.lit("  <"), kind, F.lit("s>\n"), lines_of(lambda x: F.concat(F.lit("    <"), kind, F.lit(">"), escaped(x), F.lit("</"), kind, F.lit(">"))), F.lit("\n  </"), kind, F.lit("s>")),
        "markdown": F.concat(header(MARKDOWN_HEADERS, "### "), F.lit("\n"), lines_of(lambda x: F.concat(F.lit("- "), x["content"])), F.lit("\n")),
    }[form]
    whole = by.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", block.alias("b")))), lambda x: x["b"]), "\n").alias("t"))
    before, middle, after = {
        "structured": ("=== Relevant Context ===\n", f"\n{more}\n", "\n\n=== End Context ==="),
        "xml": ("<context>\n", f"  <additional>{more}</additional>\n", "\n</context>"),
        "markdown": ("## Relevant Context\n\n", f"{more}\n\n", ""),
    }[form]
    return whole.select(group, F.concat(F.lit(before + (middle if more else "")), "t", F.lit(after)).alias("text"))


def prompt(system: Column, context: Column, user: Column) -> Column:
    """A whole prompt; a null system text or query has no part in it."""
    return F.concat_ws("\n", F.concat(F.lit("System: "), system), F.concat(F.lit("\n"), context), F.concat(F.lit("\nUser: "), user))


def utilisation(things: DataFrame, budget: int, group: str = "conv_id") -> DataFrame:
    """(group, tokens, utilisation)."""
    return things.groupBy(group).agg(F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.lit(budget)).alias("utilisation"))
