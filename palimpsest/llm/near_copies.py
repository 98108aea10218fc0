"""Near copies by SimHash: an inverted index of byte positions with count filtering, then the sets of shingles decide.

Shingles have five words, and similar is 0.8. Fingerprints of 64 bits that differ in 3 bits or fewer find few documents
of that similarity, and no group of positional bytes is sure to be shared at the distance where it lies. So fingerprints
have BITS bits, and what is filed in one list comes from a rule that misses none: of the shingles in one common order,
rare ones first, two sets of similarity s share one of the first (1 - s) n + 1 of each. A count sketch of fixed size,
over all documents, tells what is rare; the order needs only be the same everywhere, so the sketch's errors cost time
and no link.

Within a list, postings by single positional bytes tally what each fingerprint shares with the others; pairs with too
few go, then those whose sizes or bits are too far apart, both with room to spare. What is left makes groups; only there
the sets, as hashes of 64 bits a shingle, are compared, and they decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import NULL_ID, Sieve, bound_batches, bytes_of, key_of, release, stage, unstage
from palimpsest.llm.simhash import components

WORDS, SIMILARITY = 5, 0.8
BITS = 512
#: Standard deviations beyond the expected bits that similar sets may differ in: fewer than one pair in 10^12 has more.
SPARE = 8
#: Ways to deal a fingerprint's bits into bytes. One way gives 64 positional bytes, of which similar sets need not share any.
DEALS = 6
#: Share of the pairs of similar sets that the count filter may lose.
LOST = 1e-12
#: Counters of the sketch, in blocks that are summed apart. One byte a counter is shipped to every task.
COUNTERS, BLOCKS = 1 << 20, 64
#: A list longer than this is compared as pairs of chunks, each in a task of its own; so is a group with more members or bytes of sets.
CHUNK, CHUNK_BYTES = 4096, 8 << 20
#: Words a worker remembers, and forms.
MEMO = 150_000

_SEEDS = np.random.default_rng(512).integers(1, 1 << 63, BITS // 64).astype(np.uint64)
_DEALT = np.concatenate([np.random.default_rng(k).permutation(BITS) for k in range(DEALS)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, 5)
        return out


def shingle_set(text: bytes, memo: _Words, words: int = WORDS) -> np.ndarray:
    """The hashes of the different shingles, sorted. Fewer words are one shingle, and so are none."""
    h = np.array([memo[w] for w in text.lower().split()], np.uint64)
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = _mix(out + np.uint64(k + 1)) + h[k:k + n]
    return np.unique(_mix(out))


def fingerprint(shingles: np.ndarray) -> bytes:
    """A bit is 1 if set in over half the shingles' hashes of BITS bits."""
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(shingles), 255):  # so many bits add up to a byte
        grid = _mix(shingles[k:k + 255, None] ^ _SEEDS)
        total += np.add.reduce(np.unpackbits(grid.view(np.uint8).ravel()).reshape(-1, BITS), axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(shingles)).tobytes()


def prefix(shingles: np.ndarray, classes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The shingles of which sets of that similarity share one: rare ones first, then by hash."""
    n = len(shingles)
    keep = n - int(np.ceil(similarity * n - 1e-9)) + 1
    order = np.lexsort((shingles, classes[(shingles % np.uint64(COUNTERS)).astype(np.int64)]))
    return shingles[order[:keep]]


def _short(form: bytes) -> int:
    return int.from_bytes(form[:8], "big", signed=True)


def _forms(docs: DataFrame, words: int) -> DataFrame:
    """Staged (kind, doc_id, form, short, data): of kind 0 a row's set as a hash, its first half, and its fingerprint with the set's size; else a block of counters."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = _Words(), np.zeros(COUNTERS, np.int64)

        def batch(kinds: list, ids: pa.Array, forms: list, data: list) -> pa.RecordBatch:
            short = [_short(x) if x else None for x in forms]
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), ids, pa.array(forms, pa.binary()), pa.array(short, pa.int64()), pa.array(data, pa.binary())], ["kind", "doc_id", "form", "short", "data"])

        for b in parts:
            forms, data = [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, memo, words)
                counts += np.bincount((s % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS) if len(s) > 1 << 14 else 0
                if len(s) <= 1 << 14:
                    np.add.at(counts, (s % np.uint64(COUNTERS)).astype(np.int64), 1)
                forms.append(xxhash.xxh3_128_digest(s.tobytes()))
                data.append(fingerprint(s) + len(s).to_bytes(8, "big"))
            yield batch([0] * len(b), b.column("doc_id"), forms, data)
        if counts.any():
            data = [x.tobytes() for x in np.minimum(counts, 2**31 - 1).astype("<i4").reshape(BLOCKS, -1)]
            yield batch(list(range(1, BLOCKS + 1)), pa.nulls(BLOCKS, pa.int64()), [None] * BLOCKS, data)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of("text").alias("text"))
    return stage(rows.mapInArrow(run, "kind int, doc_id long, form binary, short long, data binary"), "forms")


def _classes(forms: DataFrame) -> np.ndarray:
    """The logarithm of each counter, over all documents: COUNTERS bytes, however many documents there are."""
    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in parts:
            for k, data in zip(b.column("kind").to_pylist(), b.column("data").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(data, "<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.ceil(np.log2(x + 1)).astype(np.uint8).tobytes() for x in sums.values()], pa.binary())], ["kind", "data"])

    out = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.uint8)
    for k, data in forms.filter("kind > 0").select("kind", "data").repartition("kind").mapInArrow(total, "kind int, data binary").collect():
        out[k - 1] = np.frombuffer(data, np.uint8)
    return out.ravel()


def _lists_of(docs: DataFrame, classes: np.ndarray, words: int, similarity: float) -> DataFrame:
    """Staged (shingle, short, m, x, y): the lists with m members, two at least; x and y are of all members.

    One shuffle, of a shingle and half a form for each posting. A task emits the postings of a form once, as long as it
    remembers it, so copies of one text do not pile up in a list.
    """
    packed = classes.tobytes()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, own, seen = _Words(), np.frombuffer(packed, np.uint8), set()
        for b in parts:
            hs, forms = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for t in b.column("text").to_pylist():
                s = shingle_set(t, memo, words)
                if (short := _short(xxhash.xxh3_128_digest(s.tobytes()))) in seen:
                    continue
                if len(seen) >= MEMO:
                    seen.clear()
                seen.add(short)
                hs.append(prefix(s, own, similarity))
                forms.append(np.full(len(hs[-1]), short, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(forms))], ["shingle", "short"])

    postings = docs.select(bytes_of("text").alias("text")).mapInArrow(run, "shingle long, short long").repartition("shingle")
    before, whole = F.lag("short").over(Window.partitionBy("shingle").orderBy("short")), Window.partitionBy("shingle")
    once = postings.withColumn("before", before).filter("before is null or before != short").drop("before")
    sized = once.select("shingle", "short", F.count(F.lit(1)).over(whole).alias("m"), F.bit_xor(F.xxhash64("short")).over(whole).alias("x"), F.sum(F.hash("short").cast("long")).over(whole).alias("y"))
    return stage(sized.filter("m > 1"), "lists")


@lru_cache
def _share(similarity: float) -> float:
    """The share of bits in which fingerprints of similar sets are expected to differ, for the worst sizes."""
    def differ(a: int, b: int) -> float:
        both = int(np.ceil(similarity * (a + b) / (1 + similarity) - 1e-9))
        if both > min(a, b):
            return 0.0
        over = lambda n, s: sum(comb(n - both, k) for k in range(max(0, n // 2 + 1 - s), n - both + 1)) / 2 ** (n - both)
        return sum(comb(both, s) * ((p := over(a, s)) + (q := over(b, s)) - 2 * p * q) for s in range(both + 1)) / 2**both

    return max(acos(2 * similarity / (1 + similarity)) / pi, *(differ(a, b) for a in range(1, 33) for b in range(a, 33)))


def limit(similarity: float = SIMILARITY) -> int:
    """Bits in which fingerprints of similar sets differ at most: those expected of the worst sizes, and SPARE deviations."""
    share = _share(similarity)
    return min(BITS, int(np.ceil(BITS * share + SPARE * np.sqrt(BITS * share * (1 - share)))))


def close(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether sets may be similar. Rows are a fingerprint in words of 64 bits, and the size of the set."""
    n, m = a[..., -1].astype(np.int64), b[..., -1].astype(np.int64)
    return (np.bitwise_count(a[..., :-1] ^ b[..., :-1]).sum(axis=-1, dtype=np.int64) <= limit(similarity)) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6)


@lru_cache
def shared(similarity: float = SIMILARITY) -> int:
    """Positional bytes that fingerprints of similar sets share at least: of pairs of the worst sizes, a share of LOST has fewer.

    Counted as if bytes were independent, given how many bits differ; tallies over all deals vary less than that.
    """
    n, share, d = DEALS * BITS // 8, _share(similarity), np.arange(BITS + 1)
    often = np.array([comb(BITS, k) * share**k * (1 - share) ** (BITS - k) for k in range(BITS + 1)])  # that k bits differ
    same = np.prod([np.maximum(BITS - d - i, 0) / (BITS - i) for i in range(8)], axis=0)  # that a byte has none of d bits
    fewer = np.cumsum([comb(n, k) * (often * same**k * (1 - same) ** (n - k)).sum() for k in range(n + 1)])
    return int((fewer <= LOST).sum())


def positional(fps: np.ndarray) -> np.ndarray:
    """The positional bytes of each row: its fingerprint's bits, dealt into bytes in DEALS ways."""
    out = np.zeros((len(fps), len(_DEALT) // 8), np.uint8)
    for k in range(0, len(fps), CHUNK):
        bits = np.unpackbits(np.ascontiguousarray(fps[k:k + CHUNK, :-1]).view(np.uint8), axis=1)
        out[k:k + CHUNK] = np.packbits(bits[:, _DEALT], axis=1)
    return out


def _tallies(grid: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    """For rows and one more: the positional bytes that each shares with it, from postings by position and byte."""
    m, n = grid.shape
    rows = np.argsort(grid.T, axis=1, kind="stable").astype(np.int32).ravel()
    sizes = np.bincount((grid + 256 * np.arange(n, dtype=np.int32)).ravel(), minlength=256 * n)
    starts = np.cumsum(sizes) - sizes

    def tally(at: np.ndarray, u: int) -> np.ndarray:
        lists = 256 * np.arange(n) + grid[u]
        some = sizes[lists]
        total = int(some.sum())
        if 16 * total > len(at) * n:  # long lists, or few rows: counting their bytes is shorter
            return np.count_nonzero(grid[at] == grid[u], axis=1)
        return np.bincount(rows[np.arange(total) + np.repeat(starts[lists] - np.cumsum(some) + some, some)], minlength=m)[at]

    return tally


def _tree(side: np.ndarray, test: Callable[[np.ndarray, int], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join what links join: at most one fewer than there are rows. side: 0 in both chunks, 1 and 2 in one."""
    rest, out = np.ones(len(side), bool), []
    for s in range(len(side)):
        if not rest[s]:
            continue
        rest[s] = False
        queue = [s]
        while queue:
            u = queue.pop()
            at = np.flatnonzero(rest & ((side != side[u]) | (side == 0)) if side[u] else rest)
            near = at[test(at, u)] if len(at) else at
            rest[near] = False
            out += [(u, v) for v in near.tolist()]
            queue += near.tolist()
    return out


def _edges(key: np.ndarray, fps: np.ndarray, side: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked rows within lists; equal keys are adjacent."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[first, len(key)])
    grid, least = positional(fps), shared(similarity)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(sizes <= 64, sizes)
    for d in range(1, int(sizes[sizes <= 64].max(initial=1))):
        at = np.flatnonzero((key[d:] == key[:-d]) & small[d:] & ((side[d:] != side[:-d]) | (side[d:] == 0)))
        at = np.concatenate([at[:0], *(x[np.count_nonzero(grid[x] == grid[x + d], axis=1) >= least] for x in np.split(at, range(CHUNK, len(at), CHUNK)))])
        at = at[close(fps[at], fps[at + d], similarity)] if len(at) else at
        a.append(at)
        b.append(at + d)
    for s, m in zip(first[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        own, tally = fps[s:s + m], _tallies(grid[s:s + m])

        def test(at: np.ndarray, u: int) -> np.ndarray:
            near = tally(at, u) >= least
            near[near] = close(own[at[near]], own[u], similarity)
            return near

        if e := _tree(side[s:s + m], test):
            e = np.array(e) + s
            a.append(e[:, 0])
            b.append(e[:, 1])
    return np.concatenate(a), np.concatenate(b)


def _lists(dealt: DataFrame, column: str, edges: Callable[[np.ndarray, list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b) of forms that edges(lists, column's values, sides) gives, of lists dealt out whole."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def emit(t: pa.Table) -> pa.RecordBatch:
            a, b = edges(t.column("list").to_numpy(), t.column(column).to_pylist(), t.column("side").to_numpy())
            ids = t.column("form").combine_chunks()
            out = pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))}).combine_chunks().to_batches()
            return out[0] if out else pa.RecordBatch.from_arrays([pa.array([], pa.binary())] * 2, ["a", "b"])

        for p in parts:
            held.append(p)
            rows += len(p)
            size += p.nbytes
            if rows >= 8 * CHUNK or size >= CHUNK_BYTES:
                t = pa.Table.from_batches(held).combine_chunks()
                keys = t.column("list").to_numpy()
                if cut := int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1]):
                    yield emit(t.slice(0, cut))
                    t = t.slice(cut)
                held, rows, size = t.to_batches(), len(t), 0
        if rows:
            yield emit(pa.Table.from_batches(held).combine_chunks())

    return dealt.select("list", "form", column, F.col("side").cast("int").alias("side")).repartition("list").sortWithinPartitions("list").mapInArrow(run, "a binary, b binary").distinct()


def _pieces(own: Column, chunks: Column) -> Column:
    """The pairs of chunks that a row of chunk own is in, as (i, side)."""
    return F.transform(F.sequence(F.lit(0), chunks - 1), lambda o: F.struct(
        (F.least(own, o) * chunks + F.greatest(own, o) + 1).alias("i"), F.when(own == o, 0).when(own < o, 1).otherwise(2).alias("side")))


def links(lists: DataFrame, forms: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) of forms that join all that may be similar. Of lists with the same members one is read."""
    read = stage(lists.groupBy("m", "x", "y").agg(F.min("shingle").alias("shingle")).select("shingle"), "read")
    members = lists.join(read, "shingle").select("shingle", "short", "m").join(forms, "short")
    short = members.filter(F.col("m") <= CHUNK).select(F.xxhash64("shingle", F.lit(0)).alias("list"), "form", "fp", F.lit(0).alias("side"))
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("form"), chunks).cast("int")
    long = members.filter(F.col("m") > CHUNK).select("shingle", "form", "fp", F.explode(_pieces(own, chunks)).alias("p")).select(
        F.xxhash64("shingle", "p.i").alias("list"), "form", "fp", F.col("p.side").alias("side"))

    def edges(key: np.ndarray, data: list[bytes], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fps = np.frombuffer(bytearray(b"".join(data)), np.uint64).reshape(len(data), -1)
        fps[:, -1] = fps[:, -1].byteswap()
        return _edges(key, fps, side, similarity)

    return _lists(short.unionByName(long), "fp", edges)


def _similar(key: np.ndarray, sets: list[bytes], side: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows, linked by their sets, within groups; equal keys are adjacent."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    out = [np.zeros((0, 2), np.int64)]
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
        n = np.array([len(x) // 8 for x in sets[s:e]])
        names, flat = np.unique(np.frombuffer(b"".join(sets[s:e]), np.uint64), return_inverse=True)
        flat, starts, mark = flat.astype(np.int32), np.cumsum(n) - n, np.zeros(len(names), bool)

        def test(at: np.ndarray, u: int) -> np.ndarray:
            near = np.minimum(n[at], n[u]) >= similarity * np.maximum(n[at], n[u]) - 1e-6
            some = at[near]
            mark[flat[starts[u]:starts[u] + n[u]]] = True
            if len(some) > 16:
                both = np.add.reduceat(mark[flat], starts, dtype=np.int64)[some]
            else:
                both = np.array([np.count_nonzero(mark[flat[starts[v]:starts[v] + n[v]]]) for v in some.tolist()], np.int64)
            mark[:] = False
            near[near] = both >= similarity * (n[some] + n[u] - both) - 1e-9
            return near

        out.append(np.array(_tree(side[s:e], test), np.int64).reshape(-1, 2) + s)
    pairs = np.concatenate(out)
    return pairs[:, 0], pairs[:, 1]


def verified(docs: DataFrame, forms: DataFrame, groups: DataFrame, words: int, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) of forms that join all similar ones, by their sets; groups has (v, root) of the forms that may be, but for roots."""
    whole = groups.unionByName(groups.select(F.col("root").alias("v"), "root").distinct())
    held = stage(whole.join(forms, F.col("v") == F.col("form")).select("form", "root", F.coalesce("least", F.lit(NULL_ID)).alias("key"), (8 * F.col("n")).alias("bytes")), "groups")
    sized = held.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("bytes") / CHUNK_BYTES)).cast("int").alias("chunks"))
    asked = stage(held.join(sized, "root").select("form", "root", "key", "chunks"), "asked")
    may = Sieve(asked.select("key")).may_hold

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = _Words(), set()
        for b in parts:
            keep, sets = [], []
            for k, (t, form) in enumerate(zip(b.column("text").to_pylist(), b.column("form").to_pylist())):
                if form not in seen and xxhash.xxh3_128_digest(x := shingle_set(t, memo, words).tobytes()) == form:
                    if len(seen) >= MEMO:
                        seen.clear()
                    seen.add(form)
                    keep.append(k)
                    sets.append(x)
            kept = b.select(["form", "root", "chunks"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], ["form", "root", "chunks", "set"])

    # rows of other texts under the same id are told apart by their forms
    some = docs.select(key_of("doc_id").alias("key"), bytes_of("text").alias("text")).filter(may(F.col("key"))).join(asked, "key")
    sets = some.select("text", "form", "root", "chunks").mapInArrow(run, "form binary, root binary, chunks int, set binary")
    own = F.pmod(F.xxhash64("form"), F.col("chunks")).cast("int")
    dealt = sets.select("form", "root", "set", F.explode(_pieces(own, F.col("chunks"))).alias("p")).select(
        F.xxhash64("root", "p.i").alias("list"), "form", "set", F.col("p.side").alias("side"))
    return _lists(dealt, "set", lambda key, sets, side: _similar(key, sets, side, similarity))


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id for each row of docs: the smallest doc_id that links reach, the row's own included.

    Texts with the same set of shingles are linked: also those of the same words, and those without words. Ids that are
    null count only where a component has no other, and then it is null. Rows may repeat; no rows give no rows.
    """
    bound_batches(docs.sparkSession)
    every = _forms(docs, words)
    rows = every.filter("kind = 0")
    forms = stage(rows.groupBy("form").agg(F.min("short").alias("short"), F.min("data").alias("fp"), F.min("doc_id").alias("least")).withColumn(
        "n", F.conv(F.hex(F.substring("fp", BITS // 8 + 1, 8)), 16, 10).cast("long")), "sets")
    lists = _lists_of(docs, _classes(every), words, similarity)
    release(docs.sparkSession)
    groups = components(links(lists, forms.select("form", "short", "fp"), similarity))
    unstage(lists)
    roots = components(verified(docs, forms, groups, words, similarity))
    unstage(groups)
    release(docs.sparkSession)
    own = forms.select("form", "least").join(roots, F.col("form") == F.col("v"), "left").select("form", "least", F.coalesce("root", "form").alias("root"))
    ids = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "form").join(own.join(ids, "root").select("form", "component_id"), "form").select("doc_id", "component_id")


def brute_force(texts: list[str | None], words: int = WORDS) -> list[list[float]]:
    """The similarity of each two texts, by their shingles as they are, for tests."""
    import re

    def own(t: str | None) -> set:
        ws = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(ws[k:k + words]) for k in range(max(1, len(ws) - words + 1))}

    sets = [own(t) for t in texts]
    return [[len(a & b) / len(a | b) for b in sets] for a in sets]
