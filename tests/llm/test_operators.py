"""Each operator against a brute-force version, over a real table and over rows made to be awkward."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import pytest

from palimpsest.llm import bpe, common, decontam, exact_dedup, langid, line_dedup, near_copies, pii, sharding, simhash, suffix_dedup, url_filter
from palimpsest.llm.common import NULL_ID, stage, without

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 977}x{k % 31}" for k in range(30_000))
EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One\u00a0two"), (6, "a" * 5000), (7, "a" * 5000), (8, LONG), (9, LONG + " end"),
    (10, "The same line that is long enough\nx\nthe SAME line that is long enough  "), (11, "\tthe same line that is long enough"),
    (12, "the same line that is long enough\r\nown line that is long enough"), (13, "a b  c"), (14, "a b c"), (15, "a\x0bb c"),
    (16, "ééé ééé ééé ééé\nééé ééé ééé ééé"), (17, "ÄÖÜ 123"), (18, "123 456"), (19, "\u200b\U00032cd0\ub94e"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, mark string, hash binary, key string, keep_id long, fp long, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, None, "m", None, "k", 7, 7, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def rows(real):
    return EDGES + [(i + 100, t) for i, t in real]


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def same(df, expected, *cols):
    assert got(df, *cols) == sorted(expected, key=repr)


def test_line_dedup(spark, rows):
    out = line_dedup.line_dedup(frame(spark, rows))
    same(out, line_dedup.brute_force(rows), "doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_line_dedup_repeated_rows_and_missing_ids(spark):
    line = "a line that three documents hold"
    rows = [(None, line), (None, line + "\nx"), (3, line), (3, line), (2, f"{line}\n{line}")]
    out = line_dedup.line_dedup(frame(spark, rows), with_text=True)
    assert sorted(map(tuple, out.select("doc_id", "text").collect()), key=repr) == sorted(
        [(None, ""), (None, "x"), (3, line), (3, line), (2, "")], key=repr)


def test_runs_are_merged_and_tell_fresh_lines(spark):
    store = line_dedup.RunStore(spark, fanout=2)
    make = lambda *x: spark.createDataFrame([(k, h.encode()) for k, h in x], "key long, hash binary")
    for part in ([(1, "a"), (1, "b")], [(2, "a")], [(3, "a"), (3, "c")]):
        store.add(make(*part))
    assert [len(x) for x in store.levels] == [1, 1]
    assert got(store.fresh(make((9, "a"), (9, "d"))), "hash") == [(bytearray(b"d"),)] or got(store.fresh(make((9, "a"), (9, "d"))), "hash") == [(b"d",)]
    assert [(bytes(r["hash"]), r["n_docs"], r["last"]) for r in store.repeated(3).collect()] == [(b"a", 3, 3)]
    held = [bytes(r["hash"]) for x in store.runs() for r in x.collect()]
    assert sorted(held) == [b"a", b"b", b"c"]  # each hash in one run: batches are anti-joined with the runs
    for k in range(4, 9):
        store.add(make((k, "a"), (k, f"d{k}")))
    assert sum(x.count() for x in store.runs()) == 8 and len(store.deltas) < 4
    assert [(bytes(r["hash"]), r["n_docs"], r["last"]) for r in store.repeated(3).collect()] == [(b"a", 8, 8)]


def test_simhash(spark, rows):
    same(simhash.near_dedup(frame(spark, rows)), simhash.brute_force(rows), "doc_id", "fingerprint", "component_id")


@pytest.mark.parametrize("size", [2, 3, 4, 5])
def test_simhash_groups_miss_no_three_positions(size):
    from itertools import combinations

    for gone in combinations(range(8), 3):
        assert any(not set(g) & set(gone) for g in simhash.groups(size))


@pytest.mark.parametrize("long, size", [(8, 2), (8, 3), (70, 4), (8, 5), (4096, 2), (4096, 4)])
def test_simhash_links_all_close_fingerprints(spark, monkeypatch, long, size):
    monkeypatch.setattr(simhash, "LIST", long)
    monkeypatch.setattr(simhash, "group_size", lambda n: size)
    r = random.Random(long + size)
    fps = set()
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 5, 90])):
            g = f
            for b in r.sample(range(64), r.randrange(5)):
                g ^= 1 << b
            fps.add(g - (1 << 64) if g >> 63 else g)
    dense = r.getrandbits(40) << 24  # many that share 5 bytes, and few bits between them
    fps |= {(g := dense | r.getrandbits(12) << 4) - (1 << 64) * (g >> 63) for _ in range(150)}
    df = spark.createDataFrame([(f,) for f in sorted(fps)], "fp long")
    root = {row["v"]: row["root"] for row in simhash.components(simhash.links(df)).collect()}
    left, expected = set(fps), {}
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            u = todo.pop()
            near = {v for v in left if ((u ^ v) & (2**64 - 1)).bit_count() <= 3}
            left -= near
            part |= near
            todo += near
        expected |= {v: min(part) for v in part}
    assert {f: root.get(f, f) for f in fps} == expected


def test_url_filter(spark):
    urls = [None, "", "no", "http://", "http://Example.ORG/es/x", "http://a.example.org/en/1?q", "http://example.org/en/2", "x://example.org", "x://example.org?/es/",
            "http://b.com/de/", "http://b.com/fr/porn", "http://casino.net/", "http://casinos.net/", "http://notexample.org/es/#a", "http://org/", "http://a.com/de", "q://com/de/1/porn"]
    df = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert [out[k] for k in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.org", "/es/x", "example.org/es/", "block"),
        ("a.example.org", "/en/1", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("example.org", "", None, "allow"),
        ("example.org", "", None, "allow"), ("b.com", "/de/", "com/de/", "block"), ("b.com", "/fr/porn", "com/fr/", "allow"), ("casino.net", "/", None, "block"),
        ("casinos.net", "/", None, "allow"), ("notexample.org", "/es/", "org/", "allow"), ("org", "/", "org/", "allow"), ("a.com", "/de", None, "allow"),
        ("com", "/de/1/porn", "com/de/", "block")]


def brute_url(url, rules=url_filter.PLACES + url_filter.PATTERNS):
    """By splitting and trying each rule, without the index."""
    rest = (url or "").partition("://")[2]
    host, slash, path = re.split("[?#]", rest)[0].partition("/")
    host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
    fit = [r for r in rules if r.pattern is None and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        best = max(fit, key=lambda r: (len(r.name), r.verdict == "block"))
        return host, path, best.name, best.verdict
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    return host, path, None, "block" if any(r.pattern and re.search(r.pattern, low) for r in rules) else "allow"


@pytest.mark.parametrize("block", [3, 100_000])
def test_url_filter_of_control_characters_and_many_rules(spark, monkeypatch, block):
    monkeypatch.setattr(url_filter, "BLOCK_RULES", block)
    r = random.Random(block)
    made = ["http://x.net/a.org\n/b", "http://a.org\n/b", "http://x\n.org/a", "http://example.org\x00/es/", "http://a.example.org/es/\n", "://", "a://b://c.com/de/", "HTTP://Casino.NET",
            "http://x.net/a/sid=0123456789abcdef0", "http://www.cheap-pills.net/", "http://pillsx.net/", "http://x.net/click.php?x=1&id=9f", "http://ads-track.example.net/", "http://tracker.x.net/",
            "http://x.net/adult-only/1", "http://x.net/?tracker=1&y", "http://my-tracker.net", "http://\r\n", "\n://\n/\n?\n"]
    parts = ["http", "://", "/", "?", "#", ".", "-", "org", "com", "example.org", "/es/", "/en/1", "/de/", "casino", "pills", "ads-track", "tracker", "\n", "\x0b", "\u00e9", "Org", "id=", "&", "click"]
    made += ["".join(r.choice(parts) for _ in range(r.randrange(9))) for _ in range(1500)]
    rows = list(enumerate(made)) + [(9999, None), (9999, "http://a.org/"), (None, "http://a.com/fr/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    same(url_filter.filter_urls(df), [(k, *brute_url(u)) for k, u in rows], "page_id", "host", "path", "rule", "verdict")


def test_url_rules_are_filed_under_their_rarest_token():
    rules = url_filter.PLACES
    index = url_filter.Index(rules, {"org": 9, "example": 2, "es": 5, "com": 9, "fr": 1, "de": 1, "en": 3})
    assert index.by["example"] == [1, 2] and index.by["org"] == [0] and index.by["fr"] == [3]


ITEMS = [(1, "If Alice Smith sells 12 apples for 3 dollars each and then buys 12 pears from Alice Smith how much is left of it"),
         (2, "seven short words make up this item"), (3, None), (4, "")]


def test_decontamination(spark):
    body = "some words before it . "
    cases = {
        1: (body + ITEMS[0][1].upper() + " !! and after", [(1, "exact")]),
        2: (body + ITEMS[0][1].replace("12", "40").replace("3 dollars", "7 euros").replace("Alice", "Berta").replace("Smith", "Meier"), [(1, "template")]),
        3: (body + ITEMS[0][1].replace("12 apples", "40 apples").replace("3 dollars", "9 cents").replace("from Alice", "from Carla"), []),  # 12 became 40 once and stayed 12 once
        4: ("Seven, short words; make up this item", [(2, "exact")]),
        5: ("short words make up this item", []),
        6: (None, []), 7: ("", []), 8: (LONG, []), 9: (" ".join(ITEMS[0][1].split()[4:18]), [(1, "exact")]), 10: (" ".join(ITEMS[0][1].split()[4:14]), []),
    }
    docs = frame(spark, [(k, t) for k, (t, _) in cases.items()])
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in decontam.contaminated(docs, bench).collect())
    assert out == sorted((k, *x) for k, (_, xs) in cases.items() for x in xs)
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench).collect()) == [k for k, (_, xs) in cases.items() if not xs]


def test_decontamination_joins_neighbouring_shifts():
    item = "buyers in 3 old shops near the sea of Berlin wanted to pay 40 coins for a very small blue lamp"
    index, words = decontam.Index([(1, item)]), decontam.Words()
    changed = item.replace("3 old", "5 old").replace("Berlin", "New York").replace("40", "70")
    assert [x[:2] for x in index.find(words, "so " + changed + " today")] == [(1, "template")]
    assert index.find(words, changed.replace("70", "5")) == []  # two values became one
    back = changed[changed.index("York"):] + " and " + changed[:changed.index("New")]
    assert index.find(words, back) == []  # the other way round


def test_decontamination_indexes_every_slotted_window():
    items = ["What is 17 times 23?", "Convert 5 miles to 8 km", "Mix three cups and 5kg of it on the 12th", "Tom sells apples near the old town"]
    index, words = decontam.Index(list(enumerate(items))), decontam.Words()
    said = lambda t: [x[:2] for x in index.find(words, t)]
    assert said("We ask: What is 41 times 9?") == [(0, "template")] and said("Convert 6 miles to 9 km now") == [(1, "template")]
    assert said("Mix seven cups and 9kg of it on the 3rd") == [(2, "template")] and said("Carla sells apples near the old town") == [(3, "template")]
    assert said("What is 41 plus 9?") == said("1 2 3 4 5 6 7 8 9") == []


def test_decontamination_finds_all_whole_items(spark, real):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tidy = lambda t: " ".join((t or "").lower().split())
    expected = {(d, i) for d, t in real for i, x in items if tidy(x) in tidy(t)}
    out = decontam.contaminated(frame(spark, real), spark.createDataFrame(items, "item_id long, text string"))
    assert expected and {(r["doc_id"], r["item_id"]) for r in out.collect()} == expected


def test_decontamination_finds_what_trying_each_item_finds(spark):
    """The joins against one index of all items, tried on every text: exact and template hits, repeated ids and items."""
    r = random.Random(17)
    names, nouns, units = ["Alice", "Berta", "Carla", "Doris"], ["apples", "pears", "boxes", "books", "coins"], ["km", "miles", "kg", "dollars"]
    make = lambda: (f"If {r.choice(names)} has {r.randrange(2, 99)} {r.choice(nouns)} and buys {r.randrange(2, 99)} {r.choice(units)} of {r.choice(nouns)} "  # noqa: E731
                    f"then how many {r.choice(nouns)} will {r.choice(names)} have after {r.randrange(2, 30)} days")
    items = [(k, make()) for k in range(40)] + [(7, "What is 17 times 23?"), (None, "Convert 5 miles to 8 km"), (41, None), (42, "..."), (43, make()), (43, make())]
    filler = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(250):
        t = r.choice(items[:40])[1]
        for _ in range(r.randrange(4)):
            a = r.choice(names + nouns + [str(n) for n in range(2, 99)])
            t = t.replace(a, r.choice(names) if a in names else r.choice(nouns) if a in nouns else str(r.randrange(2, 99)))
        texts.append((r.choice([k, 5]), " ".join(r.sample(filler, r.randrange(20))) + ". " + t + " " + " ".join(r.sample(filler, 3))))
    texts += [(None, "What is 4 times 9?"), (900, "We ask: convert 6 miles to 9 km now"), (901, None), (902, "")] + texts[:3]
    index, words = decontam.Index([x for x in items if x[1] is not None]), decontam.Words()
    expected = [(i, *x) for i, t in texts for x in {*index.find(words, t)}]
    out = decontam.contaminated(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    same(out, expected, "doc_id", "item_id", "kind", "covered", "item_words")
    assert {x[2] for x in expected} == {"exact", "template"} and len(expected) > 200
    bad = {(i, t) for i, t in texts if index.find(words, t)}
    kept = decontam.clean(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted((x for x in texts if x not in bad), key=repr)


def test_exact_dedup(spark, rows):
    rows = rows + [(None, "one")]
    out = exact_dedup.exact_dedup(frame(spark, rows))
    same(out, exact_dedup.brute_force(rows), "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    docs = frame(spark, [(1, "x"), (1, "x"), (2, "x"), (3, "y"), (None, "z"), (None, "z"), (None, None), (4, "")])
    out = exact_dedup.exact_dedup(docs)
    assert got(out.filter("kept"), "doc_id", "group_size") == sorted([(1, 3), (3, 1), (None, 2), (4, 2)], key=repr)
    assert got(exact_dedup.first_of_equals(docs), "doc_id", "text") == sorted([(1, "x"), (3, "y"), (None, "z"), (4, "")], key=repr)


def test_perfect_hash_is_minimal_and_perfect():
    import numpy as np

    digests = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(5000)), np.uint8).reshape(-1, 32)
    mph = exact_dedup.PerfectHash.from_bytes(exact_dedup.PerfectHash.build(digests[:4000]).to_bytes())
    assert sorted(mph.slots(digests[:4000]).tolist()) == list(range(4000))
    assert (mph.slots(digests[4000:]) < 4000).all()


def test_suffix_dedup(spark, rows):
    rows = [x for x in rows if x[0] != 9] + [(90, "tail " * 3 + LONG[1000:1250] + "\u20ac" * 100), (91, "\u20ac" * 90 + LONG[5000:5199]), (1, None)]
    expected = [(i, *x) for (i, _), x in zip(rows, suffix_dedup.brute_force([(t or "").encode() for _, t in rows]))]
    same(suffix_dedup.suffix_dedup(frame(spark, rows)), expected, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup_of_repeated_rows_and_pieces(spark, monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(900)) for _ in range(3)]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[1][300:700] + texts[2]), (3, texts[2][:500] * 2)]
    expected = [(i, *x) for (i, _), x in zip(rows, suffix_dedup.brute_force([t.encode() for _, t in rows]))]
    same(suffix_dedup.suffix_dedup(frame(spark, rows)), expected, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_runs_do_not_depend_on_pieces(monkeypatch):
    text = LONG[:5000].encode()
    whole = {x for lo, hi, h, _ in suffix_dedup.runs(text) for a, b, c in zip(lo, hi, h) for x in ((k, c) for k in range(a, b + 1))}
    monkeypatch.setattr(suffix_dedup, "PIECE", 777)
    assert {x for lo, hi, h, _ in suffix_dedup.runs(text) for a, b, c in zip(lo, hi, h) for x in ((k, c) for k in range(a, b + 1))} == whole


def test_sharding(spark, rows):
    rows = rows + [(None, "x"), (None, None), (5, "again")]
    out = [tuple(r) for r in sharding.shard(frame(spark, rows)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()]
    key = lambda i: "null" if i is None else str(i)
    root = sharding.tree()
    expected = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", sharding.brute_place(key(i), root), sharding.brute_place(key(i), sharding.grown(root))) for i, t in rows]
    assert sorted((x[:5] + x[6:] for x in out), key=repr) == sorted(expected, key=repr)
    assert all(x[6] in (x[4], 16) for x in out) and {x[4] for x in out} == set(range(16))
    for s in range(16):
        assert sorted(x[5] for x in out if x[4] == s) == list(range(sum(x[4] == s for x in out)))


def test_sharding_in_bins_has_no_gaps(spark, rows, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 3)
    out = [tuple(r) for r in sharding.shard(frame(spark, rows)).select("shard", "slot").collect()]
    for s in range(16):
        assert sorted(y for x, y in out if x == s) == list(range(sum(x == s for x, _ in out)))


def test_weights_decide_shares_and_moves_stay_in_the_subtree():
    from palimpsest.llm.sharding import Node, brute_place

    make = lambda w: Node("", children=(Node("0", children=(Node("0/0", 0, 1.0), Node("0/1", 1, w))), Node("1", 2, 2.0)))
    before, after = ([brute_place(str(k), make(w)) for k in range(4000)] for w in (1.0, 3.0))
    assert abs(before.count(2) / 4000 - 0.5) < 0.05 and abs(after.count(1) / 4000 - 0.5) < 0.05
    assert all(b in (a, 0, 1) for a, b in zip(before, after))


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, p.PATTERN, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, rows, tokenizers):
    path, pattern, tik = tokenizers
    out = bpe.digests(frame(spark, rows), path, pattern)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    expected = [(i, len(ids := tik.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows]
    same(out, expected, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    encoded = bpe.encode(frame(spark, rows), path, pattern, with_offsets=True)
    same(bpe.decode(encoded, path, pattern), [(i, t or "") for i, t in rows], "doc_id", "text")


def test_bpe_of_any_characters(tokenizers):
    path, pattern, tik = tokenizers
    r, codec = random.Random(5), bpe.codec(path, pattern)
    pools = ["ab  \n\t'sé1²日\u200b\u00a0\x85\x1c😀!", None]
    for _ in range(3000):
        pool = r.choice(pools)
        n = r.choice([1, 3, 20, 150])
        t = "".join(r.choice(pool) if pool else chr(c) for c in (r.randrange(0x110000) for _ in range(n)) if not 0xD800 <= c < 0xE000)
        ids = next(codec.encode([t]))
        assert ids == tik.encode_ordinary(t) and codec.decode(ids) == t
        assert [x[0] for x in codec.offsets(t, ids)] == [o for o in tik.decode_with_offsets(ids)[1]]


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    again = langid.train(docs)
    assert (again.weights == model.weights).all() and again.temperature == model.temperature
    edge = {r["doc_id"]: (r["lang_pred"], r["held_out"]) for r in langid.identify(frame(spark, EDGES + [(None, "the")]), model).collect()}
    assert {edge[k][0] for k in (1, 2, 3, 18)} == {"und"} and edge[17][0] in model.langs and edge[None] == (edge[None][0], False)
    kept = {r["doc_id"] for r in langid.keep_known(frame(spark, EDGES), model, 0.0).collect()}
    assert kept == {i for i, _ in EDGES} - {1, 2, 3, 18}


    clear = next(r["text"] for r in docs.filter("lang = 'en' and n_chars > 2000").limit(1).collect())
    said = [(1, clear), (2, "\u03b1\u03b2\u03b3 \u03b4\u03b5\u03b6"), (3, "123"), (4, None)]
    least = max(langid.LEAST, model.predict(said[1][1])[1] + 0.01)
    assert {r["doc_id"] for r in langid.keep_known(frame(spark, said), model, least).collect()} == {1}


def test_language_id_without_labels(spark):
    docs = frame(spark, EDGES).filter("false")
    model = langid.train(docs)
    kept = {r["doc_id"] for r in langid.keep_known(frame(spark, EDGES), model).collect()}
    assert kept == {i for i, t in EDGES if any(c.isalpha() for c in t or "")}
    assert model.langs == [] and langid.identify(frame(spark, EDGES), model).filter("lang_pred != 'und'").count() == 0


def test_pii_base(spark, rows):
    cases = ["a@b.c@d.e.f x@y", "@@a.b@c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.03.004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111",
             "+1 (555) 123-4567 +12 +1234567890123456 ++49 30 1234567.", "x" * 3000 + "@" + "y" * 3000, "1" * 3000 + ".", "é€ a_b@c-d.e 1.1.1.1", "+1 2\n+3 4567890"]
    rows = rows + list(enumerate(cases, 1000))
    out = pii.find_pii(frame(spark, rows))
    same(out, [(i, *(x := pii.brute_base(t))[0], x[1]) for i, t in rows], "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert all(r["n_spans"] == len([x for x in r["spans"].split(",") if x]) for r in out.collect())


def test_pii_bootstraps_labels(spark):
    seeds = [(k, f"text. Call phone no: +1 (555) 123-45{k:02d} now") for k in range(10)]
    more = [(50, "phone no: 030 1234 567 or so"), (51, "page no: 030 1234 567"), (52, "just 030 1234 567"), (53, None)]
    out = {r["doc_id"]: (r["n_phone"], r["spans"]) for r in pii.find_pii(frame(spark, seeds + more)).collect()}
    assert out[50] == (0, "phone:10:22") and out[51] == (0, "") == out[52] == out[53] and out[0] == (1, "phone:21:38")
    bad = [(k, f"phone no: 12 34{k:02d} 567") for k in range(60, 80)]  # unknown ones outnumber the seeds: no trust
    assert pii.find_pii(frame(spark, seeds + bad)).filter("doc_id >= 60 and spans != ''").count() == 0


def test_pii_finds_many_unseen_forms_and_words_around(spark):
    found = lambda rows: {r["doc_id"]: r["spans"] for r in pii.find_pii(frame(spark, rows)).collect()}
    seeds = [(k, f"phone: +1 555 123 4{k:03d}") for k in range(70)]
    out = found(seeds + [(100 + k, f"phone: (555) 123-4{k:03d}") for k in range(30)] + [(200 + k, f"phone: 030 55{k:02d} 123") for k in range(30)])
    assert all(out[k] == "phone:7:21" for k in range(100, 130)) and all(out[k] == "phone:7:19" for k in range(200, 230))
    words = [(k, f"please call me at +1 555 123 40{k:02d}") for k in range(9)] + [(20 + k, f"well, +49 30 1234 5{k:02d} is my number") for k in range(9)]
    out = found(words + [(50, "call me at 555 123 4567"), (51, "Now 030 1234 567 is my number"), (52, "come by at 555 123 4567"), (53, "see 030 1234 567 in stock")])
    assert (out[50], out[51], out[52], out[53]) == ("phone:11:23", "phone:4:16", "", "")
    against = [(k, f"ref: {x}") for k, x in enumerate([*(f"+1 555 123 40{n:02d}" for n in range(9)), "1.2.3.4", "5.6.7.8", "17", "030 1234 567"])]
    assert found(against)[12] == ""  # values of other kinds and shapes


def test_clashing_columns(spark, tokenizers):
    """Other columns of the tables may have any name that the operators use themselves."""
    names = "row key h may mark said id gone hash sha kept n lo hi anchor context digest fp form short shingle m x y list root item need items held_out order rid base mentions size law shard slot __gone __own __kept".split()
    rows = [r for r in EDGES if r[0] not in (8, 9)] + [(100, ITEMS[1][1]), (101, "call +1 555 123 4567"), (102, ITEMS[1][1])]
    clash = spark.createDataFrame([(i, t, "en", *(f"{n}{i}" for n in names)) for i, t in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    plain = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(*x, "a", "b") for x in ITEMS], "item_id long, text string, item string, hash string")
    pages = spark.createDataFrame([(1, "http://a.org/", "h", "r")], "page_id long, url string, host string, rule string")
    model = langid.train(clash)
    for f in (line_dedup.line_dedup, simhash.near_dedup, exact_dedup.exact_dedup, suffix_dedup.suffix_dedup, sharding.shard, lambda d: bpe.digests(d, *tokenizers[:2]), pii.find_pii,
              lambda d: decontam.contaminated(d, bench), lambda d: langid.identify(d, model), near_copies.near_copies):
        assert sorted(map(str, f(clash).collect())) == sorted(map(str, f(plain).collect()))
    assert url_filter.filter_urls(pages).collect()[0]["rule"] == "org/"
    dropped = stage(plain.filter("doc_id > 50").select("doc_id"), "dropped")
    for f in (exact_dedup.first_of_equals, lambda d: decontam.clean(d, bench), lambda d: langid.keep_known(d, model, 0.0), lambda d: without(d, dropped)):
        out = f(clash)
        assert out.columns == clash.columns and sorted(map(str, out.select("doc_id", "text", "lang").collect())) == sorted(map(str, f(plain).collect()))
        assert all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)


def test_sieves_hold_all_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    for bits, n in ((1 << 27, 30_000), (1 << 16, 30_000), (1 << 27, 1), (1 << 27, 0)):
        monkeypatch.setattr(common, "SIEVE_BITS", bits)
        sieve = common.Sieve(spark.range(n).select((F.col("id") * 7919 - 1000).alias("k")))
        asked = spark.range(-5000, 60_000).select("id", sieve.may_hold(F.col("id")).alias("may"), sieve.hash_of(F.col("id")).alias("h")).toPandas()
        assert (sieve.may(asked["h"].to_numpy()) == asked["may"]).all()
        held = (asked["id"] + 1000) % 7919 == 0
        held &= (asked["id"] >= -1000) & (asked["id"] < 7919 * n - 1000)
        assert asked["may"][held].all() and len(sieve.packed) <= bits // 8 and (bits == 1 << 16 or asked["may"][~held].mean() < 0.01)


def test_empty_tables(spark, tokenizers):
    none = frame(spark, EDGES).filter("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string")
    for df in (line_dedup.line_dedup(none), simhash.near_dedup(none), url_filter.filter_urls(pages), decontam.contaminated(none, bench), decontam.clean(none, bench),
               exact_dedup.exact_dedup(none), exact_dedup.first_of_equals(none), suffix_dedup.suffix_dedup(none), sharding.shard(none), bpe.digests(none, *tokenizers[:2]), pii.find_pii(none)):
        assert df.count() == 0
    assert decontam.contaminated(frame(spark, EDGES), bench).count() == 0 and NULL_ID < 0
