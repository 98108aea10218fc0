"""Metrics as rows (name, kind, ts, value, labels): counters, gauges, histograms, profiles, and their text forms."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.evaluation import health, histogram

__all__ = ["Spans", "counters", "gauges", "health", "histogram", "profile_summary", "prometheus", "record_compressions"]


def counters(metrics: DataFrame, *by: str) -> DataFrame:
    """(name, by, value): sums."""
    return metrics.filter("kind = 'counter'").groupBy("name", *by).agg(F.sum("value").alias("value"))


def gauges(metrics: DataFrame, *by: str) -> DataFrame:
    """(name, by, value): the last by time, and of equal times the largest."""
    return metrics.filter("kind = 'gauge'").groupBy("name", *by).agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def record_compressions(runs: DataFrame) -> DataFrame:
    """Metrics of compressions (ts, original_tokens, compressed_tokens, entities, facts, latency_ms, ratio): five counters, two histograms."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), v.cast("double").alias("value")) for n, k, v in (
        ("compressions_total", "counter", F.lit(1)), ("tokens_processed", "counter", F.col("original_tokens")),
        ("tokens_saved", "counter", F.col("original_tokens") - F.col("compressed_tokens")), ("entities_extracted", "counter", F.col("entities")),
        ("facts_extracted", "counter", F.col("facts")), ("compression_latency_ms", "histogram", F.col("latency_ms")), ("compression_ratio", "histogram", F.col("ratio")))])
    return runs.select("ts", F.explode(rows).alias("m")).select("m.name", "m.kind", "ts", "m.value")


def profile_summary(results: DataFrame, name: str = "name", ms: str = "ms", mb: str = "mb") -> DataFrame:
    """One row: count, total_time_ms, avg_time_ms, total_memory_mb, slowest."""
    return results.agg(F.count(F.lit(1)).alias("count"), F.sum(ms).alias("total_time_ms"), F.avg(ms).alias("avg_time_ms"), F.sum(mb).alias("total_memory_mb"),
                       F.max_by(name, F.struct(ms, name)).alias("slowest"))


def prometheus(metrics: DataFrame, namespace: str = "palimpsest") -> str:
    """Metrics in the text exposition format: as many lines as there are names, however many rows there are."""
    sums = metrics.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"), F.max_by("value", "ts").alias("last")).orderBy("kind", "name")
    lines = []
    for r in sums.toLocalIterator():
        full = f"{namespace}_{r['name']}"
        lines.append(f"# TYPE {full} {r['kind']}")
        lines += [f"{full}_count {r['n']}", f"{full}_sum {r['sum']}"] if r["kind"] == "histogram" else [f"{full} {r['sum'] if r['kind'] == 'counter' else r['last']}"]
    return "\n".join(lines)


class Spans:
    """Times of driver code by name, nested; rows() are what profile_summary() reads."""

    def __init__(self):
        self.done: list[tuple[str, str | None, float, float]] = []
        self._open: list[str] = []

    @contextmanager
    def span(self, name: str):
        parent, began = (self._open[-1] if self._open else None), time.perf_counter()
        self._open.append(name)
        try:
            yield self
        finally:
            self._open.pop()
            self.done.append((name, parent, (time.perf_counter() - began) * 1000, 0.0))

    def timed(self, f: Callable) -> Callable:
        """f in a span of its name."""
        @wraps(f)
        def run(*a, **b):
            with self.span(f.__name__):
                return f(*a, **b)
        return run

    def rows(self, spark) -> DataFrame:
        return spark.createDataFrame(self.done, "name string, parent string, ms double, mb double")
