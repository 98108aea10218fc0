"""Differences of memories, patches, and a history of versions in tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import ir
from palimpsest.ir import Memory

#: The columns that two versions of a row are compared by, and the key of the row.
COMPARED = {
    "entities": (["ent_id"], ["name", "type", "aliases", "importance"]), "facts": (["fact_id"], ["subject", "predicate", "object", "confidence", "negated"]),
    "events": (["evt_id"], ["description", "event_type", "turn"]), "relations": (["src", "dst", "rtype"], ["confidence"]), "sequences": (["seq_id"], ["summary"]),
}


def signature(part: str):
    cols = [F.array_sort(c).alias(c) if c == "aliases" else F.col(c) for c in COMPARED[part][1]]
    return F.substring(F.md5(F.to_json(F.struct(*cols))), 1, 8)


def diff_part(old: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """(conv_id, item_type, item_id, operation) by one full outer join on the row's key."""
    key = F.concat_ws("|", *COMPARED[part][0])
    a = old.select("conv_id", key.alias("item_id"), signature(part).alias("was")).dropDuplicates(["conv_id", "item_id"])
    b = new.select("conv_id", key.alias("item_id"), signature(part).alias("is")).dropDuplicates(["conv_id", "item_id"])
    op = F.when(F.col("was").isNull(), "add").when(F.col("is").isNull(), "remove").when(F.col("was") != F.col("is"), "modify")
    return a.join(b, ["conv_id", "item_id"], "full_outer").select("conv_id", F.lit(part).alias("item_type"), "item_id", op.alias("operation")).filter("operation is not null")


def diff(old: Memory, new: Memory) -> DataFrame:
    return reduce(DataFrame.unionByName, (diff_part(getattr(old, p), getattr(new, p), p) for p in COMPARED))


def diff_summary(changes: DataFrame) -> DataFrame:
    """(item_type, add, remove, modify)."""
    return changes.groupBy("item_type").pivot("operation", ["add", "remove", "modify"]).count().fillna(0)


def patch(base: Memory, changes: DataFrame, new: Memory) -> Memory:
    """base with the changes applied; added and modified rows come whole from new."""
    out = {"turns": new.turns}
    for part, (keys, _) in COMPARED.items():
        own = changes.filter(F.col("item_type") == part)
        key = F.concat_ws("|", *keys)
        gone = own.filter("operation in ('remove', 'modify')").select("conv_id", "item_id")
        come = own.filter("operation in ('add', 'modify')").select("conv_id", "item_id")
        kept = getattr(base, part).withColumn("item_id", key).join(gone, ["conv_id", "item_id"], "left_anti")
        put = getattr(new, part).withColumn("item_id", key).join(come, ["conv_id", "item_id"], "left_semi")
        out[part] = ir.conform(kept.unionByName(put), part)
    return Memory(**out)


class History:
    """Versions of a memory under a folder: whole snapshots, a table of versions, and where the head is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> DataFrame:
        schema = "version_id string, parent_version string, at double, ir_hash string, message string, moved boolean"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/versions")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def head(self) -> str | None:
        """The version that the last commit or rollback left."""
        row = self._log().agg(F.max_by("version_id", "at").alias("v")).first()
        return row["v"]

    def _append(self, *row) -> None:
        self.spark.createDataFrame([row], "version_id string, parent_version string, at double, ir_hash string, message string, moved boolean").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def commit(self, memory: Memory, message: str, at: float) -> str:
        """Store a snapshot; its parent is the head. The id is a hash of the contents, the time and the parent."""
        import hashlib

        parent = self.head()
        sums = [f"{p}:{tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast('decimal(38,0)'))).first())}" for p, df in sorted(memory.parts().items())]
        ir_hash = hashlib.sha256("|".join(sums).encode()).hexdigest()[:12]
        version = hashlib.sha256(f"{ir_hash}|{at}|{parent}".encode()).hexdigest()[:12]
        for p, df in memory.parts().items():
            df.write.mode("overwrite").parquet(f"{self.path}/data/version_id={version}/{p}")
        self._append(version, parent, float(at), ir_hash, message, False)
        return version

    def load(self, version: str | None = None) -> Memory:
        version = version or self.head()
        return Memory(**{p: self.spark.read.schema(s).parquet(f"{self.path}/data/version_id={version}/{p}") for p, s in ir.SCHEMAS.items()})

    def rollback(self, version: str, at: float) -> None:
        """The head moves back; the next commit branches from there."""
        old = self._log().filter((F.col("version_id") == version) & ~F.col("moved")).first()
        if old is None:
            raise KeyError(version)
        self._append(version, old["parent_version"], float(at), old["ir_hash"], f"rollback to {version}", True)

    def versions(self) -> DataFrame:
        return self._log().filter("not moved").orderBy("at")

    def diff(self, old: str, new: str) -> DataFrame:
        return diff(self.load(old), self.load(new))

    def compare(self, old: str, new: str) -> DataFrame:
        return diff_summary(self.diff(old, new))
