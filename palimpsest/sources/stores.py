"""Stores of memories as tables, with search, expiry, export and session lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import ir
from palimpsest.ir import Memory


def safe_key(key):
    """A key as a folder's name."""
    return F.regexp_replace(key, r"[^\p{L}\p{N}_.-]", "_")


class TableStore:
    """Memories under a folder, a partition for each key. Saving a key replaces its partition and no other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def _name(key: str) -> str:
        return "".join(c if c.isalnum() or c in "_.-" else "_" for c in key)

    def save(self, key: str, memory: Memory, at: float = 0.0, ttl: float | None = None) -> None:
        for part, df in memory.parts().items():
            df.write.mode("overwrite").parquet(f"{self.path}/{part}/key={self._name(key)}")
        meta = self.spark.createDataFrame([(key, float(at), None if ttl is None else float(at + ttl))], "original string, updated_at double, expires_at double")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta/key={self._name(key)}")

    def load(self, key: str) -> Memory:
        return Memory(**{p: self.spark.read.schema(s).parquet(f"{self.path}/{p}/key={self._name(key)}") for p, s in ir.SCHEMAS.items()})

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def delete(self, key: str) -> None:
        for part in (*ir.SCHEMAS, "meta"):
            self._delete(f"{self.path}/{part}/key={self._name(key)}")

    def keys(self, prefix: str = "", now: float = 0.0) -> DataFrame:
        """Keys that begin with prefix and have not expired."""
        meta = self.spark.read.parquet(f"{self.path}/meta")
        return meta.filter(F.col("original").startswith(prefix) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).select(F.col("original").alias("key"), "updated_at", "expires_at")

    def exists(self, key: str, now: float = 0.0) -> bool:
        return not self.keys(key, now).filter(F.col("key") == key).isEmpty()

    def expire(self, now: float) -> list[str]:
        """Delete what has expired; its keys."""
        gone = [r["original"] for r in self.spark.read.parquet(f"{self.path}/meta").filter(F.col("expires_at") <= now).select("original").toLocalIterator()]
        for k in gone:
            self.delete(k)
        return gone

    def ttl(self, key: str, now: float) -> float | None:
        """Seconds that a key has left; None where it does not expire or is not there."""
        row = self.keys(key, now).filter(F.col("key") == key).first()
        return None if row is None or row["expires_at"] is None else row["expires_at"] - now

    def set_ttl(self, key: str, now: float, seconds: float | None) -> None:
        """A key expires so many seconds from now; None: never."""
        row = self.keys(key, now).filter(F.col("key") == key).first()
        if row is None:
            raise KeyError(key)
        meta = self.spark.createDataFrame([(key, row["updated_at"], None if seconds is None else now + seconds)], "original string, updated_at double, expires_at double")
        meta.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta/key={self._name(key)}")

    def copy_to(self, path: str) -> None:
        """All memories, key by key, into another folder: a backup, or an export that TableStore(path) reads."""
        meta = self.spark.read.parquet(f"{self.path}/meta").select("original", "updated_at", "expires_at")
        other = TableStore(self.spark, path)
        for r in meta.toLocalIterator():
            left = None if r["expires_at"] is None else r["expires_at"] - r["updated_at"]
            other.save(r["original"], self.load(r["original"]), r["updated_at"], left)

    def table(self, part: str) -> DataFrame:
        """A component of all memories, with key."""
        return self.spark.read.schema(f"{ir.SCHEMAS[part]}, key string").parquet(f"{self.path}/{part}")

    def search_entities(self, text: str) -> DataFrame:
        return self.table("entities").filter(F.lower("name").contains(text.lower())).select("key").distinct()

    def search_facts(self, text: str) -> DataFrame:
        return self.table("facts").filter(F.lower(F.concat_ws(" ", "subject", "predicate", "object")).contains(text.lower())).select("key").distinct()

    def stats(self) -> DataFrame:
        """(part, n) over all memories."""
        return reduce(DataFrame.unionByName, (self.table(p).agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n")) for p in ir.SCHEMAS))

    def compact(self, key: str) -> None:
        """Rewrite a memory's files as few."""
        for part, df in self.load(key).parts().items():
            tmp = f"{self.path}/_tmp/{part}"
            df.coalesce(1).write.mode("overwrite").parquet(tmp)
            self.spark.read.schema(ir.SCHEMAS[part]).parquet(tmp).write.mode("overwrite").parquet(f"{self.path}/{part}/key={self._name(key)}")


def latest(rows: DataFrame, key: str = "key", at: str = "updated_at") -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), at).alias("r")).select("r.*")


def name_terms(entities: DataFrame) -> DataFrame:
    """(key, term): the inverted index of names and aliases."""
    return entities.select("key", F.explode(F.array_union(F.array("name"), "aliases")).alias("t")).select("key", F.lower("t").alias("term")).distinct()


def write_json(memory: Memory, path: str) -> None:
    for part, df in memory.parts().items():
        df.write.mode("overwrite").json(f"{path}/{part}")


def read_json(spark: SparkSession, path: str) -> Memory:
    return Memory(**{p: spark.read.schema(s).json(f"{path}/{p}") for p, s in ir.SCHEMAS.items()})


def export_rows(memory: Memory) -> DataFrame:
    """(type, id, content, importance) of entities and facts: what is exported."""
    e = memory.entities.select(F.lit("entity").alias("type"), F.col("ent_id").alias("id"), F.col("name").alias("content"), "importance")
    f = memory.facts.select(F.lit("fact").alias("type"), F.col("fact_id").alias("id"), F.concat_ws(" ", "subject", "predicate", "object").alias("content"), "importance")
    return e.unionByName(f)


def export(memory: Memory, path: str, form: str) -> None:
    """json, jsonl, csv or parquet."""
    writer = export_rows(memory).write.mode("overwrite")
    {"json": writer.json, "jsonl": writer.json, "csv": lambda p: writer.option("header", True).csv(p), "parquet": writer.parquet}[form](path)


def graph_nodes(memory: Memory) -> DataFrame:
    return memory.entities.select("conv_id", F.col("ent_id").alias("id"), F.col("name").alias("label"), F.lit("entity").alias("kind")).unionByName(
        memory.facts.select("conv_id", F.col("fact_id").alias("id"), F.concat_ws(" ", "subject", "predicate", "object").alias("label"), F.lit("fact").alias("kind")))


def graph_edges(memory: Memory) -> DataFrame:
    index = ir.name_index(memory.entities)
    to = lambda side: memory.facts.withColumn("lname", F.lower(side)).join(index, ["conv_id", "lname"]).select("conv_id", F.col("fact_id").alias("a"), F.col("ent_id").alias("b"), F.lit(side).alias("label"))
    return to("subject").unionByName(to("object")).unionByName(memory.relations.select("conv_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("rtype").alias("label")))


def _quoted(c):
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot(memory: Memory) -> DataFrame:
    """(conv_id, text): each conversation's graph in the DOT language."""
    n = graph_nodes(memory).select("conv_id", F.struct(F.lit(0).alias("s"), "id", F.lit("").alias("b")).alias("at"), F.concat(F.lit("  "), _quoted(F.col("id")), F.lit(" [label="), _quoted(F.col("label")), F.lit("];")).alias("line"))
    e = graph_edges(memory).select("conv_id", F.struct(F.lit(1).alias("s"), F.col("a").alias("id"), F.col("b")).alias("at"), F.concat(F.lit("  "), _quoted(F.col("a")), F.lit(" -> "), _quoted(F.col("b")), F.lit(" [label="), _quoted(F.col("label")), F.lit("];")).alias("line"))
    got = n.unionByName(e).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    return got.select("conv_id", F.concat(F.lit("digraph memory {\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n}")).alias("text"))


def mermaid(memory: Memory) -> DataFrame:
    e = graph_edges(memory).select("conv_id", F.concat(F.lit("  "), F.col("a"), F.lit(" -->|"), F.col("label"), F.lit("| "), F.col("b")).alias("line"))
    return e.groupBy("conv_id").agg(F.concat(F.lit("graph LR\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("text"))


def as_json(memory: Memory) -> DataFrame:
    """(conv_id, part, json): each row of each component as one JSON object."""
    return reduce(DataFrame.unionByName, (df.select("conv_id", F.lit(p).alias("part"), F.to_json(F.struct(*df.columns)).alias("json")) for p, df in memory.parts().items()))


def from_json(rows: DataFrame) -> Memory:
    """The memory that as_json() wrote."""
    part = lambda p, schema: rows.filter(F.col("part") == p).select(F.from_json("json", schema).alias("x")).select("x.*")
    return Memory(**{p: part(p, schema) for p, schema in ir.SCHEMAS.items()})


def graph_json(memory: Memory) -> DataFrame:
    """(conv_id, text): nodes and edges of each conversation as one JSON object."""
    n = graph_nodes(memory).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("id", "label", "kind"))).alias("nodes"))
    e = graph_edges(memory).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), "label"))).alias("edges"))
    none = F.array().cast("array<struct<source:string,target:string,label:string>>")
    return n.join(e, "conv_id", "left").select("conv_id", F.to_json(F.struct("nodes", F.coalesce("edges", none).alias("edges"))).alias("text"))


def html(memory: Memory) -> DataFrame:
    """(conv_id, text): a page that holds the graph's JSON."""
    safe = F.replace(F.col("text"), F.lit("</"), F.lit("<\\/"))
    return graph_json(memory).select("conv_id", F.concat(F.lit("<!DOCTYPE html>\n<html><body><script id=\"graph\" type=\"application/json\">"), safe, F.lit("</script></body></html>")).alias("text"))


def outline(memory: Memory) -> DataFrame:
    """(conv_id, text): counts, all names, ten facts, five relations and five events of each conversation."""
    from palimpsest.functions.text import sentence
    from palimpsest.operators.selection import top_k

    rule = "=" * 50
    lines = []

    def add(section: int, df: DataFrame, line, order) -> None:
        lines.append(df.select("conv_id", F.struct(F.lit(section).alias("s"), order.cast("bigint").alias("k"), line.alias("line")).alias("l")))

    convs = memory.turns.select("conv_id").distinct()
    for k, (part, title) in enumerate((("entities", "Entities"), ("facts", "Facts"), ("relations", "Relations"), ("events", "Events"))):
        n = convs.join(getattr(memory, part).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "conv_id", "left")
        add(10 * k, n, F.concat(F.lit(f"\n{title}: "), F.coalesce("n", F.lit(0)).cast("string")), F.lit(0))
    many = memory.facts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 10")
    add(1, memory.entities, F.concat(F.lit("  - "), "name", F.lit(" ("), "type", F.lit(")")), F.col("ord"))
    add(11, top_k(memory.facts, 10, [F.col("ord")], "conv_id"), F.concat(F.lit("  - "), sentence(F.col("subject"), F.col("predicate"), F.col("object"), F.col("negated"))), F.col("ord"))
    add(12, many, F.concat(F.lit("  ... and "), (F.col("n") - 10).cast("string"), F.lit(" more")), F.lit(0))
    add(21, top_k(memory.relations, 5, [F.col("rel_id")], "conv_id"), F.concat(F.lit("  - "), "src", F.lit(" --"), "rtype", F.lit("--> "), "dst"), F.col("rank"))
    add(31, top_k(memory.events, 5, [F.col("turn"), F.col("ord")], "conv_id"), F.concat(F.lit("  - Turn "), F.col("turn").cast("string"), F.lit(": "), F.substring("description", 1, 50), F.lit("...")), F.col("rank"))
    got = reduce(DataFrame.unionByName, lines).groupBy("conv_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    body = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return got.select("conv_id", F.concat(F.lit(f"{rule}\nMEMORY SUMMARY\n{rule}\n"), body, F.lit(f"\n\n{rule}")).alias("text"))
