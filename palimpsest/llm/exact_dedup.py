"""Exact dedup over a minimal perfect hash of the historical distinct digests.

A history is a table of shards. A shard holds the levels of a minimal perfect hash over its digests and, by slot, the
full digest and the locator of the row that won it. A lookup computes the slot, compares all 32 bytes, and so knows
members from nonmembers; nonmembers are grouped among themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import HEAVY, key_of, parted, stage, unstage

#: Digests in a shard on average: a shard's slots take some 5 MB.
SHARD_DIGESTS = 100_000
#: Bits of a level for each digest that reaches it.
GAMMA = 2.0

_SPACE = "[\\x20\\x09-\\x0D]+"
_WINNER = "struct<absent:boolean,doc_id:bigint,rid:bigint>"


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level * 0xD1B54A32D192ED03 + 1) & (2**64 - 1)))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
    return words[:, 0].copy(), words[:, 1] ^ words[:, 2]


class PerfectHash:
    """Levels of bits. A key belongs to the first level where its bit is set; its slot is the rank of that bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, at = [], 0
        for bits in levels:
            self.ranks.append(at + np.cumsum(bits) - 1)
            at += int(bits.sum())
        self.size = at

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        a, b = _halves(digests)
        rest, levels = np.arange(len(a)), []
        while len(rest):
            m = max(64, int(GAMMA * len(rest)))
            at = _mix(a[rest], b[rest], len(levels)) % np.uint64(m)
            alone = np.bincount(at.astype(np.int64), minlength=m) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
            if len(levels) > 200:
                raise ValueError("two digests of a history are the same")
        return cls(levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, or -1 where no level has its bit."""
        a, b = _halves(digests)
        out, rest = np.full(len(a), -1, dtype=np.int64), np.arange(len(a))
        for k, bits in enumerate(self.levels):
            at = (_mix(a[rest], b[rest], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[rest[hit]] = self.ranks[k][at[hit]]
            rest = rest[~hit]
            if not len(rest):
                break
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], dtype="<u4").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<u4", n, 4), 4 + 4 * n, []
        for m in map(int, sizes):
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, (m + 7) // 8, at))[:m].astype(bool))
            at += (m + 7) // 8
        return cls(levels)


def _matrix(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(pdf["digest"])
    mph = PerfectHash.build(digests)
    order = np.argsort(mph.slots(digests))
    winner = pdf[["keep_id", "keep_rid", "n"]].iloc[order]
    ids = winner["keep_id"].fillna(0).to_numpy("<i8")
    return pd.DataFrame({
        "shard": [pdf["shard"].iloc[0]], "mph": [mph.to_bytes()], "slots": [digests[order].tobytes()],
        "ids": [ids.tobytes()], "nulls": [winner["keep_id"].isna().to_numpy().tobytes()],
        "rids": [winner["keep_rid"].to_numpy("<i8").tobytes()], "counts": [winner["n"].to_numpy("<i8").tobytes()],
    })


def _probe(asked: pd.DataFrame, history: pd.DataFrame) -> pd.DataFrame:
    out = asked[["digest", "n", "keep_id", "keep_rid"]].copy()
    out["keep_id"] = out["keep_id"].astype("Int64")
    out["known"], out["known_n"] = False, 0
    if len(asked) and len(history):
        row = history.iloc[0]
        digests, slots = _matrix(asked["digest"]), np.frombuffer(row["slots"], np.uint8).reshape(-1, 32)
        at = PerfectHash.from_bytes(row["mph"]).slots(digests)
        hit = np.flatnonzero(at >= 0)
        hit = hit[(slots[at[hit]] == digests[hit]).all(axis=1)]
        ids = pd.array(np.frombuffer(row["ids"], "<i8")[at[hit]], dtype="Int64")
        ids[np.frombuffer(row["nulls"], bool)[at[hit]]] = pd.NA
        out.iloc[hit, out.columns.get_loc("keep_id")] = ids
        out.iloc[hit, out.columns.get_loc("keep_rid")] = np.frombuffer(row["rids"], "<i8")[at[hit]]
        out.iloc[hit, out.columns.get_loc("known_n")] = np.frombuffer(row["counts"], "<i8")[at[hit]]
        out.iloc[hit, out.columns.get_loc("known")] = True
    return out


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, rid), staged: the SHA-256 of each row's normalised text, and a number of the row."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), _SPACE, " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    return stage(rows.withColumn("rid", F.monotonically_increasing_id()), "digests")


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, n, keep_id, keep_rid): the row with the smallest doc_id wins, null last, then the first row."""
    win = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "rid")).alias("win")
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), win).select(
        "digest", "n", F.col("win.doc_id").alias("keep_id"), F.col("win.rid").alias("keep_rid"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_history(groups: DataFrame, shards: int) -> DataFrame:
    """A history table from distinct digests and their winners."""
    return stage(_sharded(groups, shards).groupBy("shard").applyInPandas(
        _build, "shard int, mph binary, slots binary, ids binary, nulls binary, rids binary, counts binary"), "history")


def probe_history(groups: DataFrame, history: DataFrame, shards: int) -> DataFrame:
    """groups, members with the history's winner, its count in known_n, and known true."""
    return _sharded(groups, shards).groupBy("shard").cogroup(history.groupBy("shard")).applyInPandas(
        _probe, "digest binary, n long, keep_id long, keep_rid long, known boolean, known_n long")


def _winners(rows: DataFrame) -> DataFrame:
    """Staged (digest, group_size, keep_id, keep_rid) of all rows.

    The lower half of the doc_id range is the history, the rest one new batch: a member of the history can only lose
    to it, as the history's ids are smaller.
    """
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    cut = 0 if low is None else (low + high) // 2
    old = F.coalesce(F.col("doc_id") <= cut, F.lit(False))
    shards = max(1, -(-n // SHARD_DIGESTS))
    past = stage(grouped(rows.filter(old)), "past")
    history = build_history(past, shards)
    probed = stage(probe_history(grouped(rows.filter(~old)), history, shards), "probed")
    unstage(history)
    again = probed.filter("known").select("digest", F.col("n").alias("more"))
    out = stage(past.join(again, "digest", "left").select(
        "digest", (F.col("n") + F.coalesce("more", F.lit(0))).alias("group_size"), "keep_id", "keep_rid"
    ).unionByName(probed.filter("not known").select("digest", F.col("n").alias("group_size"), "keep_id", "keep_rid")), "winners")
    unstage(past)
    unstage(probed)
    return out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of [\\x20\\x09-\\x0D] became one space; null counts as empty. The
    smallest doc_id stays, null ids last; of repeated rows with that id, exactly one is kept. No rows give no rows.
    """
    rows = digests(docs)
    n = rows.count()
    wins = _winners(rows)
    heavy = F.broadcast(wins.filter(F.col("group_size") > max(1, n // HEAVY)).withColumn("heavy", F.lit(True)))
    first = rows.join(heavy, "digest", "left")
    light = first.filter("heavy is null").select("doc_id", "digest", "rid").join(
        wins.filter(F.col("group_size") <= max(1, n // HEAVY)), "digest")
    return first.filter("heavy").drop("heavy").unionByName(light).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def first_of_equals(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay.

    Only rows whose id may be that of a dropped one are joined with the decisions, on id and digest. Repeated rows of
    one id and text leave one of them.
    """
    text = F.regexp_replace(F.coalesce(F.col("row.text"), F.lit("")), _SPACE, " ")
    many = exact_dedup(docs).filter("group_size > 1").groupBy(key_of("doc_id").alias("key"), F.col("text_sha256").alias("sha"))
    said = stage(many.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("not kept or n > 1").drop("n"), "said")
    apart, rest = parted(docs, said.select("key"))
    rest = rest.withColumn("sha", F.sha2(text.cast("binary"), 256))
    out = apart.unionByName(rest.join(said, ["key", "sha"], "left_anti").select("row.*"))
    if not (repeated := said.filter("kept")).isEmpty():
        out = out.unionByName(rest.join(repeated, ["key", "sha"]).dropDuplicates(["key", "sha"]).select("row.*"))
    return out


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The same decisions over (doc_id, text) pairs in plain Python, for tests; ids are distinct."""
    import re

    by: dict[str, list] = {}
    for i, t in rows:
        by.setdefault(hashlib.sha256(re.sub(r"[ \t-\r]+", " ", t or "").encode()).hexdigest(), []).append(i)
    out = []
    for sha, ids in by.items():
        keep = min(ids, key=lambda x: (x is None, x or 0))
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return out
