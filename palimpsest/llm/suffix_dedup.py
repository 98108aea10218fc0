"""Removal of every byte that a repeated string of LENGTH bytes covers, by external induced sorting.

Suffixes are sorted in shards. For that, equal windows of LENGTH bytes must meet in one shard, wherever they stand: of
each window, the GRAM-byte string inside with the least hash is its anchor, equal windows have equal anchors, and a shard
takes all windows of its anchors. A document's windows with one anchor are a run. Windows whose anchor occurs nowhere
else cannot repeat, and a run whose whole context occurs again repeats without looking further: only the others are
sorted. In a shard, neighbours in the order of suffixes that share LENGTH bytes are repeated windows.

Anchors with over HOT different contexts would be one task's: their windows meet by a cryptographic digest of their
bytes instead, which any number of tasks can share, and so do those of texts that are no UTF-8. Either way the same
windows are found.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import induced_sort
from palimpsest.llm.common import HEAVY, bound_batches, bytes_of, join_skewed, key_of, release, stage, unstage

LENGTH = 200
GRAM = 100
#: Bytes that are hashed at once: bounds what a long document takes.
PIECE = 1 << 20
#: Different contexts of an anchor beyond which its windows are compared by digest.
HOT = 10_000
#: Bytes of a shard on average; one that is larger is sorted with what does not fit ROOM rows on disk.
SHARD_BYTES = 1 << 21
ROOM = 1 << 22

#: The largest byte of UTF-8, and what stands between the strings of a shard; bytes are one more there, and 0 ends it.
_LAST, _BETWEEN = 0xF4, 0xF8

_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = (1 << 24) - 1


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


_UP, _DOWN = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 1 << 64), PIECE)
_BYTES = np.random.default_rng(20011).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sums(piece: np.ndarray) -> np.ndarray:
    out = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(_BYTES[piece] * _UP[: len(piece)], out=out[1:])
    return out


def _hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of the strings [lo, hi), wherever they stand."""
    return _mix((sums[hi] - sums[lo]) * _DOWN[lo] + (hi - lo).astype(np.uint64))


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, last window, anchor's hash, context's hash) of each run; pieces of a long text overlap by a window."""
    all_bytes = np.frombuffer(text, np.uint8)
    wide = length - gram + 1
    for start in range(0, max(1, len(all_bytes) - length + 1), PIECE - length + 1):
        piece = all_bytes[start:start + PIECE]
        if len(piece) < length:
            return
        sums = _sums(piece)
        m = len(piece) - gram + 1
        h = _hash(sums, at := np.arange(m), at + gram)
        v = np.full(-(-m // wide) * wide, ~np.uint64(0))
        v[:m] = (h & np.uint64(~_LOW & (2**64 - 1))) | at.astype(np.uint64)
        grid = v.reshape(-1, wide)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = m - wide + 1
        anchor = (np.minimum(back[:windows], ahead[wide - 1:wide - 1 + windows]) & np.uint64(_LOW)).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        hi = np.r_[lo[1:], windows] - 1
        where = anchor[lo]
        context = _mix(_hash(sums, lo, hi + length) + (where - lo).astype(np.uint64))
        yield start + lo, start + hi, h[where], context


def _ids(rows: DataFrame) -> DataFrame:
    """id and mark name a row's text; rows with the same of both are the same text."""
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of("text").alias("text")).withColumns(
        {"id": key_of("doc_id"), "mark": F.xxhash64("text")})


def _marked(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Staged (id, mark, lo, hi) of the runs that are repeated whole; and of those whose windows must be compared, with anchor, hot."""
    spark = docs.sparkSession

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i, m, t in zip(b.column("id").to_pylist(), b.column("mark").to_pylist(), b.column("text").to_pylist()):
                odd = bool((np.frombuffer(t, np.uint8) > _LAST).any())
                for lo, hi, anchor, context in runs(t, length, gram):
                    n = len(lo)
                    cols = (np.full(n, i, np.int64), np.full(n, m, np.int64), lo.astype(np.int64), hi.astype(np.int64), anchor.view(np.int64), context.view(np.int64), np.full(n, odd))
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["id", "mark", "lo", "hi", "anchor", "context", "odd"])

    found = _ids(docs).select("id", "mark", "text").mapInArrow(run, "id long, mark long, lo long, hi long, anchor long, context long, odd boolean")
    every = stage(found, "runs")
    again = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("a"), F.max("context").alias("z"), F.max("odd").alias("any_odd"))
    again = stage(again.filter("n > 1").select("anchor", "n", (F.col("a") != F.col("z")).alias("mixed"), "any_odd"), "again")
    release(spark)
    repeated = stage(join_skewed(every.drop("odd"), again, ["anchor"], "n").drop("n"), "repeated")
    unstage(every)
    unstage(again)
    release(spark)
    own = repeated.filter("mixed").withColumn("name", F.xxhash64("id", "mark", "lo"))
    mixed = stage(own.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("least"), F.max("any_odd").alias("any_odd")), "contexts")
    per = stage(mixed.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") > HOT), "hot")
    hot = F.broadcast(per.filter(F.col("contexts") * HEAVY > mixed.count()).select("anchor"))
    warm = per.select("anchor")
    # heavy anchors are told where their contexts stand, the others by a join
    told = mixed.join(hot, "anchor", "left_semi").withColumn("hot", F.lit(True)).unionByName(
        mixed.join(hot, "anchor", "left_anti").join(warm.withColumn("hot", F.lit(True)), "anchor", "left").select(*mixed.columns, F.coalesce("hot", "any_odd").alias("hot")))
    told = stage(told.drop("any_odd"), "told")
    of = join_skewed(own.drop("any_odd", "mixed"), told, ["anchor", "context"], "n").select("id", "mark", "lo", "hi", "anchor", "n", (F.col("name") == F.col("least")).alias("first"), "hot")
    of = stage(of, "mixed")
    for x in (mixed, per, told):
        unstage(x)
    release(spark)
    whole = repeated.filter("not mixed").select("id", "mark", "lo", "hi").unionByName(of.filter("n > 1").select("id", "mark", "lo", "hi"))
    # of equal contexts, one stands for all
    return whole, of.filter("first").select("id", "mark", "lo", "hi", "anchor", "hot")


def _by_document(spans: DataFrame, name: str) -> DataFrame:
    return spans.groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias(name))


def _windows(docs: DataFrame, runs_of: DataFrame, length: int) -> DataFrame:
    """(id, mark, at, digest) of each window of the runs: BLAKE2b of its bytes, 128 bits."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blake = hashlib.blake2b
        for b in parts:
            lists = b.column("spans")
            lo, hi = (lists.values.field(k).to_numpy() for k in (0, 1))
            ends = lists.offsets.to_numpy()
            for k, (i, m, t) in enumerate(zip(b.column("id").to_pylist(), b.column("mark").to_pylist(), b.column("text").to_pylist())):
                a, z = lo[ends[k]:ends[k + 1]], hi[ends[k]:ends[k + 1]]
                every = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(a, z)]))
                for start in range(0, len(every), 1 << 16):
                    at = every[start:start + (1 << 16)].astype(np.int64)
                    out = [blake(t[x:x + length], digest_size=16).digest() for x in at.tolist()]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(at), x, np.int64)) for x in (i, m)), pa.array(at), pa.array(out, pa.binary())], ["id", "mark", "at", "digest"])

    rows = _ids(docs)
    spans = _by_document(runs_of, "spans")
    return rows.select("id", "mark", "text").join(spans, ["id", "mark"]).select("id", "mark", "text", "spans").mapInArrow(
        run, "id long, mark long, at long, digest binary")


def _strings(docs: DataFrame, runs_of: DataFrame, shards: int, length: int) -> DataFrame:
    """(shard, id, mark, lo, string): the context of each run, all of an anchor in one shard."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = []
            for i, m, t, spans in zip(b.column("id").to_pylist(), b.column("mark").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist()):
                out += [(x["shard"], i, m, x["lo"], t[x["lo"]:x["hi"] + length]) for x in spans]
            cols = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["shard", "id", "mark", "lo", "string"])

    dealt = runs_of.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    spans = dealt.groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "hi", "shard")).alias("spans"))
    return _ids(docs).select("id", "mark", "text").join(spans, ["id", "mark"]).select("id", "mark", "text", "spans").mapInArrow(
        run, "shard long, id long, mark long, lo long, string binary")


class _Shard:
    """The strings of a shard, one after the other; beyond ROOM bytes in a file."""

    def __init__(self):
        self.text, self.rows, self.sizes = tempfile.SpooledTemporaryFile(max_size=ROOM), [], []

    def add(self, row: tuple[int, int, int], string: bytes) -> None:
        self.text.write(string.translate(_SHIFTED))
        self.text.write(bytes([_BETWEEN]))
        self.rows.append(row)
        self.sizes.append(len(string))

    def repeated(self, length: int) -> list[np.ndarray]:
        """id, mark, lo, hi of the stretches that repeated windows cover."""
        self.text.write(b"\0")
        self.text.seek(0)
        if self.text._rolled:
            self.text.flush()
            t = np.memmap(self.text._file, np.uint8, "r")
        else:
            t = np.frombuffer(self.text.read(), np.uint8)
        hit = np.flatnonzero(induced_sort.repeated(t, length, ROOM))
        sizes = np.array(self.sizes)
        starts = np.cumsum(sizes + 1) - sizes - 1
        own = np.minimum(np.searchsorted(starts, hit, "right") - 1, len(starts) - 1)
        whole = hit + length <= starts[own] + sizes[own]  # others reach beyond their string
        hit, own = hit[whole], own[whole]
        first = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (own[1:] != own[:-1])][: len(hit)])
        last = np.r_[first[1:] - 1, len(hit) - 1][: len(first)]
        rows = np.array(self.rows, np.int64).reshape(-1, 3)[own[first]]
        offset = rows[:, 2] - starts[own[first]]
        self.text.close()
        return [rows[:, 0], rows[:, 1], hit[first] + offset, hit[last] + offset + length]


_SHIFTED = bytes(min(b, _LAST) + 1 for b in range(256))


def _sorted_spans(docs: DataFrame, runs_of: DataFrame, length: int) -> DataFrame:
    """(id, mark, lo, hi) of what repeated windows of the runs cover, by sorting the suffixes of each shard."""
    size = runs_of.agg(F.sum(F.col("hi") - F.col("lo") + length)).first()[0] or 0

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in shard.repeated(length)], ["id", "mark", "lo", "hi"])

        shard, now = _Shard(), None
        for b in parts:
            for k, i, m, lo, s in zip(*(b.column(c).to_pylist() for c in ("shard", "id", "mark", "lo", "string"))):
                if k != now and shard.rows:
                    yield emit()
                    shard = _Shard()
                now = k
                shard.add((i, m, lo), s)
        if shard.rows:
            yield emit()

    strings = _strings(docs, runs_of, max(1, -(-size // SHARD_BYTES)), length)
    return strings.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "id long, mark long, lo long, hi long")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, mark, spans): the stretches of each text that repeated strings cover, as lists of (lo, hi), which may overlap.

    Staged. Texts without a repeat have no row.
    """
    spark = docs.sparkSession
    whole, part = _marked(docs, length, gram)
    found = stage(_sorted_spans(docs, part.filter("not hot"), length), "sorted")
    release(spark)
    spans = whole.select("id", "mark", "lo", (F.col("hi") + length).alias("hi")).unionByName(found)
    hot = part.filter("hot").drop("anchor", "hot")
    windows = twice = None
    if not hot.isEmpty():
        windows = stage(_windows(docs, hot, length), "windows")
        release(spark)
        twice = stage(windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
        met = join_skewed(windows, twice, ["digest"], "n").select("id", "mark", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))
        spans = spans.unionByName(met)
    out = stage(_by_document(spans, "spans"), "spans")
    for x in (found, windows, twice):
        if x is not None:
            unstage(x)
    release(spark)
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs, and the kept bytes if asked for.

    A byte goes if a string of length bytes covers it that also starts anywhere else, in the same or another row;
    repeated rows are each other's copies. A null text is empty, and one shorter than length stays whole.
    """
    found = repeats(docs, length, gram)

    def rebuild(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = []
            lists = b.column("spans")
            lo, hi = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ends, there = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            for k, t in enumerate(b.column("text").to_pylist()):
                size, gone, spans = len(t), 0, 0
                if there[k]:
                    order = np.argsort(lo[ends[k]:ends[k + 1]], kind="stable")
                    a, z = lo[ends[k]:ends[k + 1]][order], np.maximum.accumulate(hi[ends[k]:ends[k + 1]][order])
                    first = np.r_[True, a[1:] > z[:-1]]
                    starts, stops = a[first].tolist(), z[np.r_[np.flatnonzero(first)[1:] - 1, len(a) - 1]].tolist()
                    gone, spans = sum(stops) - sum(starts), len(starts)
                    t = b"".join(t[x:y] for x, y in zip([0, *stops], [*starts, size]))
                out.append((size, gone, spans, hashlib.sha256(t).hexdigest(), t))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            n = 4 + with_text
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols[:n], kinds))], ["doc_id", *names[:n]])

    rows = _ids(docs).join(found, ["id", "mark"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(rebuild, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same over texts in plain Python, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k:k + length]] = seen.get(t[k:k + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
