"""Line dedup over levelled sorted runs of line hashes.

A store holds runs: tables sorted by line hash with, for each hash, how many documents hold it and the largest of their
ids. Each batch is merge-anti-joined with the runs: the hashes that no run holds become a run of level 0, and FANOUT
runs of a level are merged into one of the next, so that each hash is in one run. What a batch says of hashes that are
held already is a delta, kept and merged apart. Batches split the documents by id, so counts add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import NULL_ID, bound_batches, bytes_of, join_skewed, key_of, stage, unstage

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 3

_WHITE = b" \t\n\x0b\x0c\r"


def line_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 128-bit hash of a line's key; None where the key is too short to count."""
    key = line.strip(_WHITE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


class RunStore:
    """Levelled sorted runs and deltas in the shared folder. Each hash is in one run; deltas add to what runs say."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []
        self.deltas: list[DataFrame] = []

    def _write(self, entries: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(stage(entries.sortWithinPartitions("hash"), f"run{level}"))
        if len(runs := self.levels[level]) >= self.fanout:
            self.levels[level] = []
            self._write(reduce(DataFrame.unionByName, runs).repartition("hash"), level + 1)
            for r in runs:
                unstage(r)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionByName, runs)
        return every.groupBy("hash").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of lines (key, hash); its documents are in no other batch."""
        batch = stage(lines.groupBy("hash").agg(F.countDistinct("key").alias("n_docs"), F.max("key").alias("last")), "batch")
        held = self.runs()
        fresh = stage(self.fresh(batch), "fresh")
        if held:
            self.deltas.append(stage(batch.join(fresh.hint("merge"), "hash", "left_anti").sortWithinPartitions("hash"), "delta"))
        if len(self.deltas) >= self.fanout:
            old, self.deltas = self.deltas, [stage(self._merged(self.deltas).sortWithinPartitions("hash"), "delta")]
            for d in old:
                unstage(d)
        self._write(fresh, 0)
        unstage(fresh)
        unstage(batch)

    def fresh(self, lines: DataFrame) -> DataFrame:
        """The lines whose hash no run holds, by one merge anti join for each run."""
        return reduce(lambda x, r: x.join(r.hint("merge"), "hash", "left_anti"), self.runs(), lines)

    def repeated(self, min_docs: int) -> DataFrame:
        """(hash, n_docs, last) of what at least min_docs documents hold."""
        return self._merged(self.runs() + self.deltas).filter(F.col("n_docs") >= min_docs)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """(key, hash, batch): the distinct line hashes of each row."""
    bound_batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            keys, hashes = [], []
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                own = {h for line in t.split(b"\n") if (h := line_hash(line, min_chars))}
                keys += [k] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.binary())], ["key", "hash"])

    rows = docs.select(key_of("doc_id").alias("key"), bytes_of("text").alias("text"))
    return rows.mapInArrow(run, "key long, hash binary").withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_sha256, and the kept text if asked for.

    A null or empty text is one empty line. Rows of one doc_id are one document, and so are all rows without an id,
    which comes before any other. A line whose key at least min_docs documents hold stays only in the one with the
    largest id, there each time it occurs.
    """
    lines = stage(hashed_lines(docs, min_chars, batches), "lines", partition_by="batch")
    store = RunStore(docs.sparkSession)
    for k in range(batches):
        store.add(lines.filter(F.col("batch") == k).select("key", "hash"))
    held = stage(store.repeated(min_docs), "held")
    gone = join_skewed(lines.select("key", "hash"), held, ["hash"], "n_docs").filter("key != last").groupBy("key").agg(F.collect_set("hash").alias("gone"))

    def rebuild(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            n, dropped, sha, texts = [], [], [], []
            for t, out in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                all_lines = t.split(b"\n")
                if out:
                    out = set(out)
                    kept = [x for x in all_lines if line_hash(x, min_chars) not in out]
                    text = b"\n".join(kept)
                else:
                    kept, text = all_lines, t
                n.append(len(all_lines))
                dropped.append(len(all_lines) - len(kept))
                sha.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    texts.append(text.decode())
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())] * with_text, ["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["text"] * with_text)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of("doc_id").alias("key"), bytes_of("text").alias("text"))
    return rows.join(gone, "key", "left").select("doc_id", "text", "gone").mapInArrow(
        rebuild, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text)


def brute_force(rows: list[tuple[int | None, str | None]], min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> list[tuple]:
    """The same over (doc_id, text) pairs in plain Python, for tests."""
    import re

    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), re.sub(r"^[ \t-\r]+|[ \t-\r]+\Z", "", x))
    own = lambda i: NULL_ID if i is None else i
    holders: dict[str, set] = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(own(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(h := holders.get(key(x), ())) < min_docs or max(h) == own(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
