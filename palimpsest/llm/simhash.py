"""SimHash near-dedup through an inverted index of byte positions with count filtering.

A fingerprint is 8 bytes. Two that differ in at most 3 bits share at least 5 positional bytes. The index files each
fingerprint under groups of positional bytes, chosen so that whichever 3 positions differ, one group lies outside them;
the more fingerprints, the larger the groups and the shorter the lists. Within a list, postings by single positional
bytes tally what each fingerprint shares with the others; pairs below 5 go, and the bits of the others are compared.

A list with over LIST fingerprints is filed anew under the groups of 5 positions around its own, a constant number of
them. In a list of those, only 3 bytes differ, and links are looked up by changing up to 3 of their 24 bits, so its time
and memory are in proportion to its length, which 3 bytes bound. Links become components by large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import HEAVY, bound_batches, bytes_of, stage, unstage

SHINGLE = 3
BITS = 3
SEED = 42
#: Positional bytes that two fingerprints within BITS bits share at least.
SHARED = 8 - BITS
#: Fingerprints of a list beyond which it is filed anew, or its links are looked up.
LIST = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, unsigned: a bit is 1 if set in over half the shingle hashes; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops)])
    total = np.zeros(64, np.int64)
    grid = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    for k in range(0, n, 1 << 16):
        total += np.unpackbits(grid[k:k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed long, staged."""
    bound_batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of("text").alias("text"))
    return stage(rows.mapInArrow(run, "doc_id long, fp long"), "fingerprints")


def groups(size: int) -> list[tuple[int, ...]]:
    """Groups of byte positions of that size: for any 3 positions, one group is clear of them."""
    if size == 2:
        return [(0, 1), (2, 3), (4, 5), (6, 7)]
    if size == 3:
        return [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
    if size == 4:  # a Steiner system S(3, 4, 8): complements of its blocks are blocks
        return [g for g in combinations(range(8), 4) if g[0] ^ g[1] ^ g[2] ^ g[3] == 0]
    return list(combinations(range(8), 5))


def group_size(n: int) -> int:
    """Positions in a group for n distinct fingerprints: lists stay short, and every size finds every pair."""
    return 2 if n <= 1 << 14 else 3 if n <= 1 << 24 else 4 if n <= 1 << 32 else 5


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    out = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1) >= SHARED
    out[out] = np.bitwise_count(x[out]) <= BITS
    return out


def _tree(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what links join, at most one fewer than there are fingerprints, by tallies of postings."""
    grid = fps.view(np.uint8).reshape(-1, 8)
    varied = [p for p in range(8) if (grid[:, p] != grid[0, p]).any()]
    need = SHARED - (8 - len(varied))
    postings = []
    for p in varied:
        order = np.argsort(grid[:, p], kind="stable")
        postings.append((order, np.searchsorted(grid[order, p], np.arange(257)), grid[:, p]))
    rest, out = np.ones(len(fps), bool), []
    for s in range(len(fps)):
        if not rest[s]:
            continue
        rest[s] = False
        queue = [s]
        while queue:
            u = queue.pop()
            tally = np.zeros(len(fps), np.int8)
            for order, starts, byte in postings:
                tally[order[starts[byte[u]]:starts[byte[u] + 1]]] += 1
            at = np.flatnonzero((tally >= need) & rest)
            near = at[np.bitwise_count(fps[at] ^ fps[u]) <= BITS]
            rest[near] = False
            out += [(u, v) for v in near.tolist()]
            queue += near.tolist()
    return out


def _looked_up(fps: np.ndarray) -> list[tuple[int, int]]:
    """The same for fingerprints that differ in 3 bytes at most, each looked up with up to 3 bits changed."""
    fps.sort()
    differ = np.bitwise_or.reduce(fps ^ fps[0])
    bits = [np.uint64(1 << k) for k in range(64) if int(differ) >> k & 1]
    root = np.arange(len(fps))
    for n in range(1, BITS + 1):
        for mask in combinations(bits, n):
            other = fps ^ np.bitwise_or.reduce(np.array(mask))
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            v = np.flatnonzero(fps[at] == other)
            w = at[v]
            while len(apart := np.flatnonzero(root[v] != root[w])):
                x, y = root[v[apart]], root[w[apart]]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (up := root[root] != root).any():
                    root[up] = root[root[up]]
    return [(r, v) for v, r in enumerate(root.tolist()) if v != r]


def _list_edges(new: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges within lists; new is true where one begins."""
    first = np.flatnonzero(new)
    sizes = np.diff(np.r_[first, len(fps)])
    of = np.repeat(np.arange(len(first)), sizes)
    a_out, b_out = [], []
    small = np.repeat(sizes <= 64, sizes)
    for d in range(1, int(sizes[sizes <= 64].max(initial=1))):
        at = np.flatnonzero((of[d:] == of[:-d]) & small[d:])
        at = at[_close(fps[at], fps[at + d])]
        a_out.append(fps[at])
        b_out.append(fps[at + d])
    for s, m in zip(first[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        own = fps[s:s + m].copy()
        if e := _tree(own) if m <= LIST else _looked_up(own):
            e = np.array(e)
            a_out.append(own[e[:, 0]])
            b_out.append(own[e[:, 1]])
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a_out]), np.concatenate([none, *b_out])


def _mask(group: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in group)
    return m - (1 << 64) if m >> 63 else m


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that join all distinct fps within BITS bits; a list adds fewer links than it has fingerprints."""
    n = fps.count()
    chosen, fives = groups(group_size(n)), groups(5)
    first = 0 if len(chosen[0]) < 5 else 1000  # lists of 5 positions have numbers from 1000 on
    file = [F.struct(F.lit(first + k).alias("g"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("bytes")) for k, g in enumerate(chosen)]
    posts = fps.select("fp", F.explode(F.array(*file)).alias("e")).select("fp", "e.g", "e.bytes")
    if not first:
        long = stage(posts.groupBy("g", "bytes").count().filter(F.col("count") > LIST), "long")
        around = F.create_map(*[x for k, g in enumerate(chosen) for x in (F.lit(k), F.array(*[F.lit(1000 + j) for j, f in enumerate(fives) if set(g) <= set(f)]))])
        masks = F.create_map(*[x for j, f in enumerate(fives) for x in (F.lit(1000 + j), F.lit(_mask(f)))])
        heavy = F.col("count") * HEAVY > n * len(chosen)
        for some, how in ((long.filter(heavy), "broadcast"), (long.filter(~heavy), "shuffle_hash")):
            if not some.isEmpty():
                lists = some.select("g", "bytes").hint(how)
                anew = posts.join(lists, ["g", "bytes"], "left_semi").select("fp", F.explode(around[F.col("g")]).alias("g")).distinct()
                posts = posts.join(lists, ["g", "bytes"], "left_anti").unionByName(anew.withColumn("bytes", F.col("fp").bitwiseAND(masks[F.col("g")])))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(g: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _list_edges(np.r_[True, (g[1:] != g[:-1]) | (key[1:] != key[:-1])], fp.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[list[np.ndarray]] = []
        rows = 0
        for p in parts:
            if not len(p):
                continue
            held.append([p.column(c).to_numpy(zero_copy_only=False) for c in ("g", "bytes", "fp")])
            rows += len(p)
            last = held[-1][0][-1], held[-1][1][-1]
            if rows < 1 << 17 or (held[0][0][0], held[0][1][0]) == last:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.flatnonzero((cols[0] != last[0]) | (cols[1] != last[1]))[-1]) + 1
            yield emit(*(x[:cut] for x in cols))
            held, rows = [[x[cut:] for x in cols]], len(cols[0]) - cut
        if held:
            yield emit(*(np.concatenate(x) for x in zip(*held)))

    dealt = posts.repartition("g", "bytes").sortWithinPartitions("g", "bytes")
    return dealt.select("g", "bytes", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): for each vertex of the edges, the smallest vertex it reaches. Large and small stars, alternately."""
    tidy = lambda e: e.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage(tidy(edges), "edges")
    size = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = size(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = tidy(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = stage(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = stage(tidy(small), "edges")
        unstage(large)
        unstage(now)
        now, was, before = after, before, size(after)
        if was == before:
            break
    out = now.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out._staged_at = now._staged_at
    return out


def near_dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs.

    component_id is the smallest doc_id that links reach, the row's own included; ids that are null count only where a
    component has no other, and then it is null. Equal fingerprints are linked: also those of texts without words.
    """
    rows = fingerprints(docs, shingle)
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps.select("fp")))
    own = fps.join(roots, fps["fp"] == roots["v"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = own.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = own.join(ids, "root").select("fp", "component_id")
    return rows.join(labelled, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple[int, str | None]], shingle: int = SHINGLE) -> list[tuple]:
    """The same over (doc_id, text) pairs by comparing all, for tests."""
    import re

    def own(t: str | None) -> int:
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        parts = [" ".join(words[k:k + shingle]) for k in range(len(words) - shingle + 1)] or [" ".join(words)] * bool(words)
        hs = [xxhash.xxh64_intdigest(p.encode(), SEED) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [own(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in combinations(range(len(rows)), 2):
            if label[i] != label[j] and (fps[i] ^ fps[j]).bit_count() <= BITS:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    least: dict[int, int] = {}
    for k, (i, _) in zip(label, rows):
        least[k] = min(i, least.get(k, i))
    return [(i, f"{f:016x}", least[k]) for (i, _), f, k in zip(rows, fps, label)]
