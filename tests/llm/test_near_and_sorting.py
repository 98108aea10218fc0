"""Induced sorting, near copies and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import exact_dedup, induced_sort, near_copies, suffix_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(30))
def test_suffixes(seed):
    r = random.Random(seed)
    k, n, cap = r.choice([1, 2, 5, 20]), r.choice([0, 1, 5, 200, 600]), r.choice([3, 20, 200])
    x = [r.randint(1, k) for _ in range(n)]
    x = x + x[: n // 2] + x[n // 3:] + [r.randint(1, k)] * r.choice([0, 1, 300])
    t = np.array([*x, 0], np.uint8)
    order, common = induced_sort.suffixes(t, cap, room=r.choice([60, 300, 1 << 20]))  # small rooms go to disk
    said = [tuple(x[i:i + cap]) for i in range(len(t))]
    assert sorted(order.tolist()) == list(range(len(t)))
    for a, b, c in zip(order[:-1], order[1:], common[1:]):
        p, q = said[a], said[b]
        assert p <= q and c == next((d for d in range(cap) if d >= min(len(p), len(q)) or p[d] != q[d]), cap)
    hit = induced_sort.repeated(t, 3)
    seen = [tuple(x[i:i + 3]) for i in range(len(x))]
    assert all(hit[i] == (len(s) == 3 and seen.count(s) > 1) for i, s in enumerate(seen))


@pytest.mark.parametrize("hot, room", [(10_000, 1 << 22), (1, 1 << 22), (10_000, 2000)])
def test_suffix_dedup_by_sorting_hashing_and_on_disk(spark, monkeypatch, hot, room):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "ROOM", room)
    r = random.Random(hot + room)
    base = "".join(r.choice("abcdé ") for _ in range(700))
    texts = [base[r.randrange(300):r.randrange(450, 700)] + "".join(r.choice("xyz") for _ in range(r.randrange(300))) + base[r.randrange(200):] for _ in range(14)]
    rows = list(enumerate(texts)) + [(50, None), (51, base), (52, base)]
    want = sorted((i, *x) for (i, _), x in zip(rows, suffix_dedup.brute_force([(t or "").encode() for _, t in rows])))
    got = suffix_dedup.suffix_dedup(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want


def copies(seed=7):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    docs = [[word() for _ in range(r.choice([60, 150, 400]))] for _ in range(20)]
    rows = [(10 * k, " ".join(d)) for k, d in enumerate(docs)]
    for k, d in enumerate(docs[:10]):
        e = list(d)
        e[len(e) // 2] = "changed"
        rows.append((10 * k + 5, " ".join(e)))
    passage = [word() for _ in range(50)]
    rows += [(1000 + k, " ".join([*passage, *(word() for _ in range(200))])) for k in range(12)]
    return rows + [(2000, None), (2001, " "), (2002, "one two"), (2003, "ONE  two"), (None, "a text without an id of some words")]


@pytest.mark.parametrize("chunk", [4, 4096])
def test_near_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    rows = copies()
    got = {(r["doc_id"], r["component_id"]) for r in near_copies.near_copies(frame(spark, rows)).collect()}
    label = {i: c for i, c in got}
    alike = near_copies.brute_force([t for _, t in rows])
    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if alike[a][b] >= 0.88:
                assert label[i] == label[j]
            elif alike[a][b] < 0.5 and i is not None and j is not None:
                assert label[i] != label[j]
    assert label[2001] == 2000 and label[2003] == 2002 and label[None] is None and label[15] == 10


def boundary(seed=11):
    """Texts just above, at and below a similarity of 0.8, short and long, each in a group of its own."""
    r = random.Random(seed)
    rows, key = [], 0
    for n, changes in [*[(n, "append") for n in (7, 8, 9, 10, 11, 12) for _ in range(6)], *[(84, "swap")] * 12, *[(104, "replace")] * 12]:
        words = [f"v{r.randrange(10**6)}" for _ in range(n)]
        other = [*words, "more"] if changes == "append" else [*words[10:], *(f"v{r.randrange(10**6)}" for _ in range(10))] if changes == "swap" else [*words[:20], "new", *words[21:60], "newer", *words[61:]]
        rows += [(key, " ".join(words)), (key + 1, " ".join(other))]
        key += 2
    base = [f"v{r.randrange(10**6)}" for _ in range(200)]  # one large group, no two of which are similar
    for _ in range(90):
        rows.append((key, " ".join([*base[:150], *(f"v{r.randrange(10**6)}" for _ in range(30))])))
        key += 1
    return rows


@pytest.mark.parametrize("chunk", [8, 4096])
def test_near_copies_are_those_of_the_sets(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    rows = boundary() + [(5000 + k, t) for k, (_, t) in enumerate(copies()[:-1])] + [(None, "v w x y z a b c d"), (9000, "v w x y z a b c")]
    alike, root = near_copies.brute_force([t for _, t in rows]), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if alike[a][b] >= 0.8 - 1e-9 and root[a] != root[b]:
                root = [root[b] if x == root[a] else x for x in root]
    least = {}
    for (i, _), x in zip(rows, root):
        least[x] = i if least.get(x) is None else least[x] if i is None else min(i, least[x])
    got = near_copies.near_copies(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, least[x]) for (i, _), x in zip(rows, root)} and len(got) == len(rows)


@pytest.mark.parametrize("similarity, linked", [(0.95, set()), (0.75, {1}), (0.5, {1, 2})])
def test_near_copies_of_other_similarities(spark, similarity, linked):
    words = [f"v{k}" for k in range(104)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:88])), (2, " ".join([*words[:78], *(f"y{k}" for k in range(26))]))]
    alike = near_copies.brute_force([t for _, t in rows])
    assert alike[0][1] == 0.84 and 0.5 < alike[0][2] < 0.6 and alike[1][2] < 0.75
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(frame(spark, rows), similarity=similarity).collect()}
    assert {k for k in (1, 2) if got[k] == 0} == linked


def test_prefixes_of_similar_sets_meet():
    r = np.random.default_rng(3)
    classes = r.integers(0, 9, near_copies.COUNTERS).astype(np.uint8)
    for _ in range(300):
        n = int(r.integers(1, 60))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.r_[r.choice(a, int(r.integers(1, len(a) + 1)), replace=False), r.integers(0, 1 << 62, int(r.integers(0, 8))).astype(np.uint64)])
        if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8:
            assert len(np.intersect1d(near_copies.prefix(a, classes), near_copies.prefix(b, classes)))


def rows_of(sets):
    """Rows as near_copies compares them: a fingerprint in words of 64 bits, and the size of the set."""
    return np.array([[*np.frombuffer(near_copies.fingerprint(x), np.uint64), len(x)] for x in sets], np.uint64)


def test_positional_bytes_of_similar_sets_are_tallied():
    r = np.random.default_rng(8)
    for both, a, b in [(4, 4, 5), (5, 5, 6), (8, 9, 9), (80, 80, 100), (80, 90, 90)]:  # similarities of 0.8, and the least above for short texts
        x = [r.integers(0, 1 << 63, a + b - both).astype(np.uint64) for _ in range(300)]
        fps = rows_of([y for s in x for y in (s[:a], np.r_[s[:both], s[a:]])])
        grid = near_copies.positional(fps)
        tally = near_copies._tallies(grid)
        plain = np.array([(grid == g).sum(axis=1) for g in grid])
        for u in range(len(grid)):  # by postings, and by counting where few rows are asked for
            assert (tally(np.arange(len(grid)), u) == plain[u]).all() and (tally(np.array([u ^ 1]), u) == plain[u, u ^ 1]).all()
        assert plain[np.arange(0, 600, 2), np.arange(1, 600, 2)].min() >= near_copies.shared()
        if a >= 80:  # other texts' seldom share so many
            assert (plain[::2, ::2][~np.eye(300, dtype=bool)] >= near_copies.shared()).mean() < 0.02
    assert near_copies.shared(1.0) == grid.shape[1] and near_copies.shared(0.9) > near_copies.shared(0.8) > 0


@pytest.mark.parametrize("others", [0, 100])
def test_pairs_that_share_few_positional_bytes_go(others):
    """In short and long lists: bits near enough, but in so many bytes that similar sets surely share more."""
    r = np.random.default_rng(9)
    fps = np.c_[r.integers(0, 1 << 63, (others + 3, near_copies.BITS // 64)), np.full(others + 3, 100)].astype(np.uint64)
    fps[1], fps[2] = fps[0], fps[0]
    fps[1, 0] ^= np.uint64(1)
    free = np.ones(near_copies.DEALS * near_copies.BITS // 8, bool)
    places = [set(np.flatnonzero(near_copies._DEALT == k) // 8) for k in range(near_copies.BITS)]
    while free.sum() >= near_copies.shared():
        k = max(range(near_copies.BITS), key=lambda b: sum(free[p] for p in places[b]))
        free[list(places[k])] = False
        fps[2].view(np.uint8)[k // 8] ^= 128 >> k % 8
    assert near_copies.close(fps[0], fps[2]) and near_copies.close(fps[1], fps[2])
    a, b = near_copies._edges(np.zeros(len(fps), np.int64), fps, np.zeros(len(fps), np.int64))
    assert set(zip(a.tolist(), b.tolist())) == {(0, 1)}


def test_pipeline(spark):
    """Each stage on what the one before kept, and what it decides against plain versions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, text = [], dict(map(tuple, docs.select("doc_id", "text").collect()))
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
        rows = docs.collect()
        kept.append({r["doc_id"] for r in rows})
        assert len(rows) == len(kept[-1])
        if name == "language_id":
            assert kept[0] == {i for i, t in text.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact_dedup":
            assert kept[1] == {x[0] for x in exact_dedup.brute_force([(i, text[i]) for i in kept[0]]) if x[3]}
        elif name == "near_dedup":
            ids = sorted(kept[1])
            alike = near_copies.brute_force([text[i] for i in ids])
            for a, i in enumerate(ids):
                near = [j for b, j in enumerate(ids) if b != a and alike[a][b] >= 0.6]
                assert i in kept[2] or near  # clean documents stay
                assert not any(j in kept[2] for b, j in enumerate(ids) if b != a and i in kept[2] and alike[a][b] >= 0.88)
        elif name == "decontaminate":
            tidy = lambda t: " ".join((t or "").lower().split())
            items = [tidy(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert kept[3] == {i for i in kept[2] if not any(x in tidy(text[i]) for x in items)}
        docs = docs if name == "tokens" else spark.createDataFrame(rows, docs.schema)
    assert kept[4] == kept[3] and all(r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in rows)
