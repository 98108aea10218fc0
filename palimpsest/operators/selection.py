"""Choice under a budget, top k, diversity, order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palimpsest.fixed import QUERY_WORDS

#: Items times budget from which greedy choice takes the place of dynamic programming.
CELLS = 1_000_000


def _greedy(items: Column, budget: Column) -> Column:
    """Of an ordered array of (…, cost, id), the ids that fit one after the other; what does not fit is passed over."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"),
                        F.when(fits, F.array_append(acc["ids"], x["id"])).otherwise(acc["ids"]).alias("ids"))

    return F.aggregate(items, start, step, lambda acc: acc["ids"])


def greedy(items: DataFrame, group: str, id_col: str, cost: str, order: Sequence[Column], budget: Column) -> DataFrame:
    """(group, id): chosen in order (ascending; negate for descending) while the budget lasts, passing over what is too large."""
    keys = [c.alias(f"o{k}") for k, c in enumerate(order)]
    row = F.struct(*keys, F.col(cost).cast("bigint").alias("cost"), F.col(id_col).cast("string").alias("id"))
    got = items.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("items"), F.first(budget).cast("bigint").alias("budget"))
    return got.select(group, F.explode(_greedy(F.col("items"), F.col("budget"))).alias(id_col))


def by_ratio(value: str, weight: str) -> Column:
    return -(F.col(value) / F.greatest(F.lit(1), F.col(weight)))


def knapsack(values: np.ndarray, weights: np.ndarray, budget: int) -> list[int]:
    """Places of the items that dynamic programming takes; traced back from the last, an item only where it improves."""
    n = len(values)
    best = np.zeros((n + 1, budget + 1), np.int64)
    for i in range(n):
        w = int(weights[i])
        best[i + 1] = best[i]
        if w <= budget:
            np.maximum(best[i][w:], best[i][: budget + 1 - w] + values[i], out=best[i + 1][w:])
            best[i + 1][:w] = best[i][:w]
    out, left = [], budget
    for i in range(n, 0, -1):
        if best[i][left] != best[i - 1][left]:
            out.append(i - 1)
            left -= int(weights[i - 1])
    return out[::-1]


def choose(values: np.ndarray, weights: np.ndarray, budget: int, cells: int = CELLS) -> list[int]:
    """By dynamic programming where it is small, else by value for weight."""
    if len(values) * budget < cells:
        return knapsack((values * 1000).astype(np.int64), weights, budget)
    out, used = [], 0
    for i in sorted(range(len(values)), key=lambda i: -values[i] / max(weights[i], 1)):
        if used + weights[i] <= budget:
            out.append(i)
            used += weights[i]
    return sorted(out)


def knapsack_by_group(items: DataFrame, group: str, cells: int = CELLS) -> DataFrame:
    """(group, id) from (group, id, value, weight, ord, budget). A group goes to one task: its items and budget bound it."""
    kind = items.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "id"], kind="stable")
        at = choose(pdf["value"].to_numpy(float), pdf["weight"].to_numpy(np.int64), int(pdf["budget"].iloc[0]), cells)
        return pdf.iloc[at][[group, "id"]]

    return items.select(group, "id", "value", "weight", "ord", "budget").groupBy(group).applyInPandas(run, f"{group} {kind}, id string")


def top_k(df: DataFrame, k: int, order: Sequence[Column], *groups: str) -> DataFrame:
    """The first k rows of each group. Spark keeps only k a group and task before it shuffles."""
    if not groups:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("rank") <= k)


def diverse(items: DataFrame, k: int, group: str, kind: str = "item_type", least: float = 0.5, weights: dict[str, float] | None = None) -> DataFrame:
    """k items of each group, in rounds over the types in order of first appearance, each type's best first.

    A type whose weight is 0 or less gives none; one below least gives only its first.
    """
    w = Window.partitionBy(group, kind)
    ranked = items.withColumns({"round": F.row_number().over(w.orderBy(F.desc("importance"), "ord")), "first": F.min("ord").over(w)})
    if weights is not None:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        own = F.coalesce(F.element_at(table, F.col(kind)), F.lit(1.0))
        ranked = ranked.filter((own > 0) & ((F.col("round") == 1) | (own >= least)))
    return top_k(ranked, k, [F.col("round"), F.col("first")], group)


def prefix_within(df: DataFrame, size: Column, order: Sequence[Column], budget, *groups: str) -> DataFrame:
    """The rows before the running size first passes the budget: it stops there, and passes over nothing."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def reorder(items: DataFrame, how: str, group: str) -> DataFrame:
    """items with place, from 0: importance_first, recency_first, type_grouped or interleaved.

    Interleaved takes the best of the upper half and the least of the lower in turn; of an odd number, the middle one goes.
    """
    w = Window.partitionBy(group)
    best = w.orderBy(F.desc("importance"), "ord")
    if how == "interleaved":
        n, r = F.count(F.lit(1)).over(w), F.row_number().over(best) - 1
        half = F.floor(n / 2)
        place = F.when(r < half, r * 2).when(r >= n - half, (n - 1 - r) * 2 + 1)
        return items.withColumn("place", place.cast("int")).filter("place is not null")
    order = {"importance_first": best, "recency_first": w.orderBy(F.desc("recency"), "ord"), "type_grouped": w.orderBy(
        F.when(F.col("item_type") == "summary", 0).when(F.col("item_type") == "entity", 1).when(F.col("item_type") == "fact", 2).otherwise(3), F.desc("importance"), "ord")}[how]
    return items.withColumn("place", F.row_number().over(order) - 1)


def select(items: DataFrame, must=(), importance: float = 0.0, recency: float = 0.0, relevance: float = 0.0, include=(), exclude=(), also: Column | None = None) -> DataFrame:
    """Items that the criteria let through; those that must be there first and unconditionally."""
    must_be = F.col("id").isin(*must) if must else F.lit(False)
    ok = (F.col("importance") >= importance) & (F.col("recency") >= recency) & (F.col("relevance") >= relevance)
    ok = ok & F.col("item_type").isin(*include) if include else ok
    ok = ok & ~F.col("item_type").isin(*exclude) if exclude else ok
    ok = ok & also if also is not None else ok
    return items.filter(must_be | ok).withColumn("must", must_be)


def near_duplicates(items: DataFrame, group: str, threshold: float = 0.8) -> DataFrame:
    """Items kept when each is compared with those kept before it; a better one takes a similar one's place, at the end.

    Order decides, so a group is one task's: bounded by what one context holds.
    """
    kind = items.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[set, float, str]] = []
        for r in pdf.sort_values("ord", kind="stable").itertuples():
            words = set(r.content.lower().split())
            for k, (other, score, _) in enumerate(kept):
                union = len(words | other)
                if union and len(words & other) / union >= threshold:
                    if r.importance > score:
                        del kept[k]
                        kept.append((words, r.importance, r.id))
                    break
            else:
                kept.append((words, r.importance, r.id))
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(kept), "id": [i for *_, i in kept], "place": range(len(kept))})

    return items.select(group, "id", "content", "importance", "ord").groupBy(group).applyInPandas(run, f"{group} {kind}, id string, place int")


def query_kind(query: Column) -> Column:
    """person, temporal, location, factual or general, by the first words that hit."""
    q = F.lower(query)
    return F.coalesce(*[F.when(q.rlike("|".join(ws)), kind) for kind, ws in QUERY_WORDS], F.lit("general"))


def criteria_for(kind: str) -> dict:
    """What to select for a kind of query."""
    if kind in ("person", "location"):
        return {"importance": 0.2, "include": ("entity", "fact")}
    return {"recency": 0.3, "include": ("event", "fact")} if kind == "temporal" else {"importance": 0.1}
