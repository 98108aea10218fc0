"""Buffers of turns: what each holds after all turns of a table, and the same kept as a stream's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from palimpsest.functions import scores
from palimpsest.functions.text import tokens_scaled

STATE = "turns array<struct<turn:int,role:string,content:string>>, seen bigint"


def last_turns(turns: DataFrame, size: int = 20) -> DataFrame:
    """The count buffer: the newest turns of each conversation."""
    return turns.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("back") <= size).drop("back")


def within_tokens(turns: DataFrame, most: int = 4000) -> DataFrame:
    """The token buffer: the newest turns that fit; the newest of all is there even where it alone does not."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    n = turns.withColumns({"tokens": tokens_scaled(F.col("content")), "back": F.row_number().over(w)})
    return n.withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("used") <= most) | (F.col("back") == 1)).drop("back", "used")


def slid(turns: DataFrame, most: int = 4000, overlap: int = 200) -> DataFrame:
    """The token buffer after its window slid: evicted down to most less overlap."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return within_tokens(turns, most).withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") <= most - overlap).drop("used")


def recent_context(turns: DataFrame, most: int) -> DataFrame:
    """(conv_id, text): the newest lines that fit, oldest first."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    kept = turns.withColumn("used", F.sum(tokens_scaled(F.col("content"))).over(w)).filter(F.col("used") <= most)
    got = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "content").alias("line")))).alias("l"))
    return got.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def utilisation(turns: DataFrame, most: int = 4000) -> DataFrame:
    return within_tokens(turns, most).groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.least(F.lit(1.0), F.sum("tokens") / F.lit(most)).alias("utilisation"))


def by_priority(items: DataFrame, size: int = 100, group: str = "conv_id") -> DataFrame:
    """The priority buffer after (group, ord, id, priority) arrived in order: a new item evicts the least only if it is higher.

    Of equal least ones the earliest goes, so order decides; a group is one task's, and the buffer bounds its state.
    """
    import heapq

    kind = items.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heap: list[tuple[float, int, str]] = []
        for r in pdf.sort_values("ord", kind="stable").itertuples():
            if len(heap) < size:
                heapq.heappush(heap, (r.priority, r.ord, r.id))
            elif r.priority > heap[0][0]:
                heapq.heapreplace(heap, (r.priority, r.ord, r.id))
        return pd.DataFrame([(pdf[group].iloc[0], i, p) for p, _, i in sorted(heap, key=lambda x: (-x[0], x[1]))], columns=[group, "id", "priority"])

    return items.select(group, "ord", "id", "priority").groupBy(group).applyInPandas(run, f"{group} {kind}, id string, priority double")


def micro_batches(turns: DataFrame, size: int = 5, threshold: int = 4000) -> DataFrame:
    """(conv_id, batch, turns, tokens, compress): batches of that many turns; compress where the tokens since the last pass the threshold."""
    b = turns.groupBy("conv_id", F.floor(F.col("turn") / size).cast("int").alias("batch")).agg(F.count(F.lit(1)).alias("turns"), F.sum(tokens_scaled(F.col("content"))).alias("tokens"))
    w = Window.partitionBy("conv_id").orderBy("batch")
    upto = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    step = F.floor(upto / threshold)
    return b.withColumn("step", step).withColumn("compress", F.col("step") > F.coalesce(F.lag("step").over(w), F.lit(0))).drop("step")


def adaptive_ratio(turns: DataFrame, least: float = 0.3, most: float = 0.7) -> DataFrame:
    """(conv_id, turn, ratio): by the mean density of the last five turns, from the fifth on; before, the middle."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = turns.withColumns({"density": scores.density(F.col("content")), "n": F.row_number().over(w)}).withColumn("mean", F.avg("density").over(w.rowsBetween(-4, 0)))
    line = F.lit(most) - (F.col("mean") - 0.05) / F.lit(0.1) * F.lit(most - least)
    ratio = F.when(F.col("n") < 5, (least + most) / 2).when(F.col("mean") > 0.15, least).when(F.col("mean") < 0.05, most).otherwise(line)
    return d.select("conv_id", "turn", ratio.alias("ratio"))


def changes(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(conv_id, turn, event, item): the first time each name and each fact comes is an addition; a name's later ones are updates."""
    e = entities.select("conv_id", F.floor(F.col("ord") / (1 << 32)).cast("int").alias("turn"), "name", "ord")
    k = F.row_number().over(Window.partitionBy("conv_id", F.lower("name")).orderBy("ord"))
    ents = e.withColumn("k", k).select("conv_id", "turn", F.when(F.col("k") == 1, "entity_added").otherwise("entity_updated").alias("event"), F.col("name").alias("item"))
    f = facts.select("conv_id", F.array_max("source_turns").alias("turn"), F.lower(F.concat_ws("|", "subject", "predicate", "object")).alias("item"))
    return ents.unionByName(f.groupBy("conv_id", "item").agg(F.min("turn").alias("turn")).select("conv_id", "turn", F.lit("fact_added").alias("event"), "item"))


# ---- streams


def stream_buffer(stream: DataFrame, size: int = 20) -> DataFrame:
    """A stream of (conv_id, turn, role, content) to (conv_id, seen, held): the count buffer as state; one row for each batch of a conversation."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, seen = state.get if state.exists else ([], 0)
        held = [tuple(x) for x in held]
        for p in parts:
            held += [(int(t), r, c) for t, r, c in zip(p["turn"], p["role"], p["content"])]
            seen += len(p)
        held = sorted(held)[-size:]
        state.update((held, seen))
        yield pd.DataFrame({"conv_id": [key[0]], "seen": [seen], "held": [",".join(str(t) for t, _, _ in held)]})

    return stream.groupBy("conv_id").applyInPandasWithState(step, "conv_id bigint, seen bigint, held string", STATE, "update", "NoTimeout")


def stream_batches(stream: DataFrame, size: int = 5) -> DataFrame:
    """A stream of turns to (conv_id, batch, turns, text): each whole batch of turns goes out once, what is left stays in the state."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, done = state.get if state.exists else ([], 0)
        held = [tuple(x) for x in held]
        for p in parts:
            held += [(int(t), r, c) for t, r, c in zip(p["turn"], p["role"], p["content"])]
        held.sort()
        out = []
        while len(held) >= size:
            now, held = held[:size], held[size:]
            out.append((key[0], done, size, "\n".join(f"{r}: {c}" for _, r, c in now)))
            done += 1
        state.update((held, done))
        yield pd.DataFrame(out, columns=["conv_id", "batch", "turns", "text"])

    return stream.groupBy("conv_id").applyInPandasWithState(step, "conv_id bigint, batch bigint, turns bigint, text string", STATE, "append", "NoTimeout")


def windowed_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """A stream of events with ts to counts by event time and type; what is later than the watermark is left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def process(stream: DataFrame, handle, checkpoint: str):
    """Each micro-batch of turns to handle(batch, id), once; what fails is tried again from the checkpoint, so no turn is lost."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
