"""The graph of entities that facts link."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import ir
from palimpsest.operators.folding import materialised


def edges(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(conv_id, a, b, weight): entities that facts link, by how many facts do."""
    index = ir.name_index(entities)
    s = index.select("conv_id", F.col("lname").alias("ls"), F.col("ent_id").alias("es"))
    o = index.select("conv_id", F.col("lname").alias("lo"), F.col("ent_id").alias("eo"))
    both = facts.select("conv_id", F.lower("subject").alias("ls"), F.lower("object").alias("lo")).join(s, ["conv_id", "ls"]).join(o, ["conv_id", "lo"])
    return both.filter("es != eo").groupBy("conv_id", F.least("es", "eo").alias("a"), F.greatest("es", "eo").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def degree_centrality(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(conv_id, node, centrality): neighbours over other nodes."""
    ends = graph.select("conv_id", F.explode(F.array("a", "b")).alias("node")).groupBy("conv_id", "node").agg(F.count(F.lit(1)).alias("d"))
    n = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(ends, ["conv_id", "node"], "left").join(n, "conv_id").select("conv_id", "node", F.when(F.col("n") > 1, F.coalesce("d", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


#: A conversation's graph of up to this many nodes and edges is ranked in one task; larger ones by joins over all tasks.
SMALL = 200_000


def _power(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, rounds: int, damping: float, tolerance: float) -> np.ndarray:
    """Ranks by power iteration over directed edges between the nodes 0 to n - 1."""
    total = np.bincount(src, weight, n)
    share, loose = weight / total[src], total == 0
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        before, lost = rank, rank[loose].sum()
        rank = damping * (np.bincount(dst, before[src] * share, n) + lost / n) + (1 - damping) / n
        if np.abs(rank - before).sum() < n * tolerance:
            break
    return rank


def _small(nodes: DataFrame, graph: DataFrame, rounds: int, damping: float, tolerance: float) -> DataFrame:
    def run(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node", kind="stable")
        at = pd.Series(np.arange(len(own)), index=own["node"])
        links = links[links["a"].isin(at.index) & links["b"].isin(at.index)]
        a, b, w = at.loc[links["a"]].to_numpy(), at.loc[links["b"]].to_numpy(), links["weight"].to_numpy(float)
        if not len(own):
            return pd.DataFrame({"conv_id": [], "node": [], "centrality": []})
        rank = _power(len(own), np.r_[a, b], np.r_[b, a], np.r_[w, w], rounds, damping, tolerance)
        return pd.DataFrame({"conv_id": own["conv_id"].to_numpy(), "node": own["node"].to_numpy(), "centrality": rank})

    return nodes.groupBy("conv_id").cogroup(graph.groupBy("conv_id")).applyInPandas(run, "conv_id bigint, node string, centrality double")


def pagerank(nodes: DataFrame, graph: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6, small: int = SMALL) -> DataFrame:
    """(conv_id, node, centrality) by power iteration over weighted undirected edges, each conversation a graph of its own.

    Nodes without edges give their rank to all. Sizes are counted first: a small graph is one task's, a larger one is
    iterated by joins.
    """
    sizes = nodes.select("conv_id").unionByName(graph.select("conv_id")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    large = materialised(sizes.filter(F.col("n") > small).select("conv_id"))
    if large.isEmpty():
        return _small(nodes, graph, rounds, damping, tolerance)
    part = lambda df, how: df.join(large, "conv_id", how)
    few = _small(part(nodes, "left_anti"), part(graph, "left_anti"), rounds, damping, tolerance)
    return few.unionByName(_iterated(part(nodes, "left_semi"), part(graph, "left_semi"), rounds, damping, tolerance))


def _iterated(nodes: DataFrame, graph: DataFrame, rounds: int, damping: float, tolerance: float, every: int = 5) -> DataFrame:
    """The same by joins. Every few rounds the ranks are written, which cuts the lineage, and the change is measured."""
    both = graph.select("conv_id", F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(graph.select("conv_id", F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    out = both.groupBy("conv_id", "src").agg(F.sum("weight").alias("total"))
    share = materialised(both.join(out, ["conv_id", "src"]).select("conv_id", "src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    size = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    linked = share.select("conv_id", F.col("src").alias("node")).distinct().withColumn("linked", F.lit(True))
    base = materialised(nodes.join(size, "conv_id").join(linked, ["conv_id", "node"], "left").select("conv_id", "node", "n", F.col("linked").isNull().alias("dangling")))
    now = base.withColumn("r", 1 / F.col("n"))
    for k in range(1, rounds + 1):
        before = now
        lost = now.groupBy("conv_id").agg(F.sum(F.when(F.col("dangling"), F.col("r")).otherwise(0.0)).alias("lost"))
        sent = now.withColumnRenamed("node", "src").join(share, ["conv_id", "src"]).groupBy("conv_id", F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("p")).alias("got"))
        rank = (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n")) * damping + (1 - damping) / F.col("n")
        now = base.join(lost, "conv_id").join(sent, ["conv_id", "node"], "left").select("conv_id", "node", "n", "dangling", rank.alias("r"))
        if k % every == 0 and k < rounds:
            now = materialised(now)
            moved = now.join(before.select("conv_id", "node", F.col("r").alias("r0")), ["conv_id", "node"]).groupBy("conv_id", "n").agg(F.sum(F.abs(F.col("r") - F.col("r0"))).alias("d"))
            if moved.filter(F.col("d") > tolerance * F.col("n")).isEmpty():
                break
    return now.select("conv_id", "node", F.col("r").alias("centrality"))


def centrality(facts: DataFrame, entities: DataFrame, rounds: int = 100) -> DataFrame:
    nodes = entities.select("conv_id", F.col("ent_id").alias("node")).distinct()
    return pagerank(nodes, materialised(edges(facts, entities)), rounds)
