"""What the operators share: staged tables, bounded Arrow batches, null-safe keys, joins that do not shuffle texts."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches stay below this many bytes and rows, whatever the texts' lengths.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4000

#: Stands for a null doc_id where a key is needed; it sorts before every other id.
NULL_ID = -(2**63)

#: Bits of a sieve for each key, and in all (16 MB), however many keys there are. A block has 2^16 of them.
SIEVE_KEY_BITS, SIEVE_BITS = 16, 1 << 27
#: A key with over 1/HEAVY of all rows is heavy. Fewer than HEAVY keys can be, which bounds what is broadcast.
HEAVY = 1000

_made: list[tuple[SparkSession, str]] = []


def bound_batches(spark: SparkSession) -> None:
    """Keep each Arrow batch small enough for a worker, also where texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (base or "file:///tmp/checkpoints").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/palimpsest-{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage is cut and it outlives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    if path := getattr(df, "_staged_at", None):
        remove(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if not spark.sparkContext._jsc.sc().isStopped():
                remove(spark, path)
        except Exception:  # the JVM may have gone first
            return


def bytes_of(col: str) -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def key_of(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of the steps before: what nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Sieve:
    """A test of longs that holds for all of keys (one column of longs) and for few others: a Bloom filter in blocks.

    Its size is bounded: with more keys than it has room for, more others pass, and none of the keys is lost.
    """

    def __init__(self, keys: DataFrame, hashed: bool = False):
        """hashed: keys are hashes already, and are taken for their own hash_of."""
        own = F.col(keys.columns[0])
        hashed = keys.select((own if hashed else self.hash_of(own)).alias("h"))
        self.blocks, n = 1, hashed.count()
        while self.blocks << 16 < min(SIEVE_BITS, SIEVE_KEY_BITS * n):
            self.blocks *= 2
        places = self._places

        def fill(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, np.ndarray] = {}
            for b in parts:
                block, bits = places(b.column("h").to_numpy())
                for k in np.unique(block).tolist():
                    of_block = own.setdefault(k, np.zeros(8192, np.uint8))
                    for x in bits:
                        np.bitwise_or.at(of_block, (at := x[block == k]) >> 3, (1 << (at & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([x.tobytes() for x in own.values()], pa.binary())], ["block", "bits"])

        # each block comes from one task: no more is collected than the sieve has
        spread = hashed.repartition(min(self.blocks, 64), F.shiftrightunsigned("h", 48).bitwiseAND(F.lit(self.blocks - 1)))
        table = np.zeros((self.blocks, 8192), np.uint8)
        for k, data in spread.mapInArrow(fill, "block int, bits binary").collect() if n else ():
            table[k] = np.frombuffer(data, np.uint8)
        self.packed = table.tobytes()

    @staticmethod
    def hash_of(key: Column) -> Column:
        return F.xxhash64(key)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        h = h.view(np.uint64)
        return ((h >> np.uint64(48)) & np.uint64(self.blocks - 1)).astype(np.int64), [((h >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int64) for s in (0, 16, 32)]

    def may(self, h: np.ndarray) -> np.ndarray:
        """Of the hash_of of each key, whether the key may be among the sieve's."""
        own = np.frombuffer(self.packed, np.uint8)
        block, bits = self._places(h)
        out = np.ones(len(h), bool)
        for x in bits:
            out &= (own[(block << 13) + (x >> 3)] >> (x & 7).astype(np.uint8)) & 1 == 1
        return out

    def may_hold(self, key: Column) -> Column:
        """The same as an expression of Spark's own, of the key itself."""
        h, own, out = self.hash_of(key), F.lit(bytearray(self.packed)), F.lit(True)
        block = F.shiftrightunsigned(h, 48).bitwiseAND(F.lit(self.blocks - 1)) * 8192
        for s in (0, 16, 32):
            x = F.shiftrightunsigned(h, s).bitwiseAND(F.lit(0xFFFF))
            byte = F.conv(F.hex(F.substring(own, (block + F.shiftright(x, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out &= F.getbit(byte, x.bitwiseAND(F.lit(7)).cast("int")) == 1
        return out


def parted(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """docs whose key is surely not among keys, as they are; and those where it may be, as (row, key).

    Only the second few have to be joined, so the texts of the others are not shuffled. Columns of docs may have any name.
    """
    may = Sieve(keys).may_hold(key_of(key))
    return docs.filter(~may), docs.filter(may).select(F.struct("*").alias("row"), key_of(key).alias("key"))


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not in dropped(doc_id), a staged table; null keys compare as equal."""
    gone = dropped.select(key_of(key).alias("key")).distinct()
    apart, rest = parted(docs, gone, key)
    return apart.unionByName(rest.join(gone, "key", "left_anti").select("row.*"))


def join_skewed(rows: DataFrame, found: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The inner join of two staged tables on keys, which found has once each; n of it is how many of rows each has.

    Heavy keys are joined where their rows stand, so that no task gets all rows of one.
    """
    total = found.agg(F.sum(n)).first()[0] or 0
    heavy = F.broadcast(found.filter(F.col(n) * HEAVY > total))
    light = rows.join(F.broadcast(found.filter(F.col(n) * HEAVY > total).select(*keys)), keys, "left_anti").join(found.filter(F.col(n) * HEAVY <= total), keys)
    return rows.join(heavy, keys).select(*light.columns).unionByName(light)
