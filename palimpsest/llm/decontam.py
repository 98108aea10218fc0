"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, also spelled or with a unit attached, names and units turn into typed placeholders.
Windows of template words, and of the words as they are, are hashed on both sides and hash-joined; a bounded filter of
the benchmark's hashes keeps those of the documents that may meet one. What an item and a document share makes them a
candidate pair. Each pair is verified on its words: hits are aligned with the item, and slots must be consistent:
wherever the item repeats a value, the document repeats one, and different values stay different.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Sieve, bound_batches, join_skewed, key_of, parted, stage, unstage

WINDOW = 8
#: An item is found where windows cover this many of its words, or all of fewer.
COVER = 13
#: Words by which the hits of one item may be off each other on either side, where values have other numbers of words.
DRIFT = 8
#: Words of a template window that must be no placeholders: without any, it would fit every row of numbers.
LITERALS = 1
#: Words a worker remembers.
MEMO = 150_000

_NUM = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*%?\Z")
_UNITS = frozenset("mm cm m km in ft yd mi mile miles inch inches foot feet mg g kg lb lbs oz ton tons ml l litre litres liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros pound pounds percent % °c °f mph kmh watt watts volt volts byte bytes mb gb".split())
_SPELLED = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_ATTACHED = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*-?(?P<unit>[a-z°]+)\Z")
#: Words that begin sentences and are no names, and those that follow a name which does.
_STARTERS = frozenset("a an the if when while what which who whose how why where is are was were do does did can could will would should this that these those there it he she they we you i in on at by for from to of with and but or so then as after before each every all some many most no not one our my your his her its their let find given suppose assume now first next finally also however".split())
_VERBS = frozenset("has had is was can will and got went made bought sold ate gave took".split())
_VERB = re.compile(r"[a-z]+(?:[^su]s|ed)\Z")
#: What ends words and is no part of them; the rest of it is trimmed by _TRIM.
_CLOSING = ".,;:!?)\"'"
_TRIM = re.compile(r"\A[^\w+\-$€£]+|[^\w%]+\Z")
_NONE, _WORD, _NUMBER, _UNIT, _NAME = range(5)
#: Sets hashes of template windows apart.
_TEMPLATE = np.uint64(0x5555)
_SLOT = np.array([0, 0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class Words(dict):
    """Numbers of raw words; arrays by number hold what is known of each."""

    def __init__(self):
        super().__init__()
        self._clear()

    def _clear(self) -> None:
        self.clear()
        self.plain, self.flag = np.zeros(1024, np.uint64), np.zeros(1024, np.uint8)
        self.new_plain: list[int] = []
        self.new_flag: list[int] = []

    def __missing__(self, raw: str) -> int:
        core = raw.rstrip(_CLOSING)
        simple = core.isalpha()
        if not simple:
            core = _TRIM.sub("", raw)
        low = core.lower()
        if not core:
            kind = _NONE
        elif low in _SPELLED or not simple and (_NUM.match(core) or all(x in _SPELLED for x in low.split("-")) or (m := _ATTACHED.match(low)) and (m["unit"] in _UNITS or m["unit"] in ("st", "nd", "rd", "th"))):
            kind = _NUMBER
        elif low in _UNITS:
            kind = _UNIT
        else:
            kind = _NAME if core[0].isupper() and core.isalpha() and not core.isupper() else _WORD
        ends = raw is not core and (raw[-1] in ".!?:" or raw.endswith(('."', ".)", '!"', '?"')))
        verb = core in _VERBS or core[-1:] in ("s", "d") and _VERB.match(core) is not None
        self.new_flag.append(kind | ends << 3 | (low in _STARTERS) << 4 | verb << 5)
        self.new_plain.append(xxhash.xxh64_intdigest(low.encode("utf-8", "replace"), 7) | 1 if core else 0)
        self[raw] = k = len(self)
        return k

    def _known(self) -> None:
        """Put what is new into the arrays."""
        n = len(self) - len(self.new_plain)
        while len(self) > len(self.plain):
            self.plain, self.flag = (np.concatenate([x, np.zeros_like(x)]) for x in (self.plain, self.flag))
        self.plain[n:len(self)], self.flag[n:len(self)] = self.new_plain, self.new_flag
        self.new_plain.clear()
        self.new_flag.clear()

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word with a core: its hash, the kind of slot it is (0: none), its template's hash."""
        if len(self) > MEMO:
            self._clear()
        said = text.split()
        at = np.fromiter(map(self.__getitem__, said), np.int64, len(said))
        if self.new_plain:
            self._known()
        if not len(at):
            return self.plain[:0], self.flag[:0], self.plain[:0]
        flag = self.flag[at]
        start = np.r_[True, (flag[:-1] & 8) > 0]
        full = (flag & 7) != _NONE
        at, start, flag = at[full], start[full], flag[full]
        plain, kind, starter, verb = self.plain[at], flag & 7, (flag & 16) > 0, (flag & 32) > 0
        number = np.r_[False, kind[:-1] == _NUMBER] if len(kind) else np.zeros(0, bool)
        kind[(kind == _UNIT) & ~number] = _WORD
        # a name at the start of a sentence is one elsewhere in the text, or is followed by a name or a verb
        first = np.flatnonzero((kind == _NAME) & start)
        if len(first):
            after = np.minimum(first + 1, len(kind) - 1)
            named = (first + 1 < len(kind)) & ((kind[after] == _NAME) & ~start[after] | verb[after]) | np.isin(plain[first], plain[(kind == _NAME) & ~start])
            kind[first[~named | starter[first]]] = _WORD
        kind[kind == _WORD] = 0
        return plain, kind, np.where(kind > 0, _SLOT[kind], plain)


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    if len(ids) < n:
        return ids[:0]
    out = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9FB21C651E98DF25) + ids[k:len(ids) - n + 1 + k]
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9) ^ np.uint64(n)


def _item_windows(plain: np.ndarray, kind: np.ndarray, templ: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(hashes, places, words of a window, mark) of an item's windows as they are (0), and of those with a slot and a word (1)."""
    if n := min(WINDOW, len(plain)):
        h = _windows(plain, n)
        yield h, np.arange(len(h)), n, 0
        literal = np.convolve(kind == 0, np.ones(n, int), "valid") >= min(LITERALS, n)
        slotted = np.convolve(kind > 0, np.ones(n, int), "valid") > 0
        t = np.flatnonzero(literal & slotted)
        yield _windows(templ, n)[t] ^ _TEMPLATE, t, n, 1


class Index:
    """The windows of some benchmark items by hash, and the items' words."""

    def __init__(self, items: list[tuple[int, str]], words: Words | None = None):
        words = words or Words()
        self.items = [(i, *(x.copy() for x in words.read(t))) for i, t in items]
        self.lengths = sorted({min(WINDOW, len(p)) for _, p, _, _ in self.items if len(p)})
        hashes, owners, places, sizes, marks = [], [], [], [], []
        for k, (_, plain, kind, templ) in enumerate(self.items):
            for hs, at, n, mark in _item_windows(plain, kind, templ):
                hashes.append(hs)
                places.append(at)
                owners.append(np.full(len(at), k))
                sizes.append(np.full(len(at), n))
                marks.append(np.full(len(at), mark))
        cat = lambda x, kind: np.concatenate([np.zeros(0, kind), *x]).astype(kind)
        self.hashes, self.owner, self.place, self.size, self.mark = (cat(*x) for x in ((hashes, np.uint64), (owners, np.int64), (places, np.int64), (sizes, np.int64), (marks, np.int64)))
        order = np.argsort(self.hashes, kind="stable")
        for name in ("hashes", "owner", "place", "size", "mark"):
            setattr(self, name, getattr(self, name)[order])

    def _hits(self, ids: np.ndarray, flip: int) -> Iterator[tuple[int, int]]:
        """(place in the document, entry) of each window that the index has."""
        for n in self.lengths:
            h = _windows(ids, n) ^ np.uint64(flip)
            at = np.arange(len(h))
            lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for e in range(a, b):
                    if self.size[e] == n and self.mark[e] == (flip > 0):
                        yield p, e

    def find(self, words: Words, text: str | None) -> list[tuple[int, str, int, int]]:
        """(item_id, kind, covered, item_words) of each item in a text; kind is exact or template."""
        if not text:
            return []
        plain, kind, templ = words.read(text)
        found: dict[int, np.ndarray] = {}
        for p, e in self._hits(plain, 0):
            k = int(self.owner[e])
            found.setdefault(k, np.zeros(len(self.items[k][1]), bool))[self.place[e]:self.place[e] + self.size[e]] = True
        diagonals: dict[int, dict[int, np.ndarray]] = {}
        for p, e in self._hits(templ, int(_TEMPLATE)):
            k, at = int(self.owner[e]), int(self.place[e])
            of_item = diagonals.setdefault(k, {})
            if p - at not in of_item:
                of_item[p - at] = np.zeros(len(self.items[k][1]), bool)
            of_item[p - at][at:at + self.size[e]] = True
        out = []
        done = set()
        for k, cover in found.items():
            if (c := int(cover.sum())) >= min(COVER, len(cover)):
                out.append((self.items[k][0], "exact", c, len(cover)))
                done.add(k)
        best: dict[int, int] = {}
        for k, covers in diagonals.items():
            need, exact = min(COVER, len(self.items[k][1])), found.get(k, False)
            for shift in covers if k not in done else ():
                near = [covers[x] for x in range(shift - DRIFT, shift + DRIFT + 1) if x in covers]
                if int((np.logical_or.reduce(near) | exact).sum()) >= max(need, best.get(k, 0) + 1) and (place := self._joined(k, shift, covers, plain)) is not None:
                    best[k] = max(best.get(k, 0), int(((place >= 0) | exact).sum()))
        out += [(self.items[k][0], "template", c, len(self.items[k][1])) for k, c in best.items() if c >= min(COVER, len(self.items[k][1]))]
        return sorted(out)

    def _joined(self, k: int, shift: int, covers: dict[int, np.ndarray], plain: np.ndarray) -> np.ndarray | None:
        """Places in the document of an item's words, -1 where not found: by that shift, and by near ones that keep order and slots."""
        _, ours, kind, _ = self.items[k]
        place = np.full(len(ours), -1, np.int64)
        for x in sorted((x for x in range(shift - DRIFT, shift + DRIFT + 1) if x in covers), key=lambda x: abs(x - shift)):
            after = np.where(covers[x] & (place < 0), np.arange(len(ours)) + x, place)
            at = np.flatnonzero(after >= 0)
            slots = at[kind[at] > 0]
            if (np.diff(after[at]) > 0).all() and self._consistent(ours[slots], plain[after[slots]]):
                place = after
            elif x == shift:
                return None
        return place

    @staticmethod
    def _consistent(ours: np.ndarray, theirs: np.ndarray) -> bool:
        pairs = set(zip(ours.tolist(), theirs.tolist()))
        return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (item, item_id, text) and (hash, item, need, size): items by number, and their different windows.

    An item with need > 1 takes two windows at least to be found. Null texts and texts without words have no windows.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    items = stage(rows.withColumn("item", F.monotonically_increasing_id()), "items")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in parts:
            for k, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                read = words.read(t)
                for h, _, n, _ in _item_windows(*read):
                    h = np.unique(h)
                    cols = (h.view(np.int64), np.full(len(h), k), np.full(len(h), 1 + (min(COVER, len(read[0])) > n)), np.full(len(h), n))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["hash", "item", "need", "size"])

    return items, stage(items.mapInArrow(run, "hash long, item long, need long, size long").distinct(), "windows")


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Staged (id, mark, item_id, kind, covered, item_words): each different text, by id and mark, and an item found in it."""
    bound_batches(docs.sparkSession)
    rows = docs.select(key_of("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter("text is not null").withColumn("mark", F.xxhash64("text"))
    items, windows = _items(benchmark)
    lengths = [r["size"] for r in windows.select("size").distinct().collect()]  # WINDOW of them at most
    sieve = Sieve(windows.select("hash"), hashed=True)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in parts:
            ids, marks, hashes = [], [], []
            for i, m, t in zip(*(b.column(c).to_pylist() for c in ("id", "mark", "text"))):
                plain, kind, templ = words.read(t)
                slots = np.r_[0, np.cumsum(kind > 0)]
                for n in lengths:
                    h = _windows(plain, n)
                    slotted = slots[n:] > slots[:-n] if len(h) else slots[:0] > 0
                    if slotted.any():
                        h = np.concatenate([h, _windows(templ, n)[slotted] ^ _TEMPLATE])
                    if len(h := np.unique(h[sieve.may(h)])):
                        ids.append(np.full(len(h), i))
                        marks.append(np.full(len(h), m))
                        hashes.append(h.view(np.int64))
            cat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]))
            yield pa.RecordBatch.from_arrays([cat(ids), cat(marks), cat(hashes)], ["id", "mark", "hash"])

    hits = stage(rows.mapInArrow(run, "id long, mark long, hash long"), "hits")
    met = stage(hits.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).join(windows.groupBy("hash").agg(F.collect_set(F.struct("item", "need")).alias("of")), "hash"), "met")
    shared = join_skewed(hits, met, ["hash"], "n").select("id", "mark", "hash", F.explode("of").alias("of")).select("id", "mark", "hash", "of.*")
    pairs = stage(shared.groupBy("id", "mark", "item").agg(F.countDistinct("hash").alias("shared"), F.max("need").alias("need")).filter("shared >= need").select("id", "mark", "item"), "pairs")
    many = stage(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).join(items, "item"), "asked")
    asked = stage(join_skewed(pairs, many, ["item"], "n").groupBy("id", "mark").agg(F.collect_list(F.struct("item_id", "text")).alias("items")), "candidates")
    may = Sieve(asked.select("mark")).may_hold
    some = rows.filter(may(F.col("mark"))).join(asked, ["id", "mark"]).select("id", "mark", "text", "items")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in parts:
            out = []
            for i, m, t, own in zip(*(b.column(c).to_pylist() for c in ("id", "mark", "text", "items"))):
                out += [(i, m, *x) for x in Index([(x["item_id"], x["text"]) for x in own], words).find(words, t)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 6, kinds)], ["id", "mark", "item_id", "kind", "covered", "item_words"])

    out = stage(some.mapInArrow(verify, "id long, mark long, item_id long, kind string, covered long, item_words long").distinct(), "found")
    for x in (items, windows, hits, met, pairs, many, asked):
        unstage(x)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, kind, covered, item_words, coverage), a row for each document and item found in it.

    kind is `exact` where the words are the item's, case and punctuation aside, else `template`: numbers, names or
    units were replaced consistently. Clean documents, null and empty texts give no row; rows of one doc_id give their
    own rows each. An item shorter than a window must be found whole.
    """
    said = found(docs, benchmark)
    _, rest = parted(docs, said.select("id"))
    own = rest.select("key", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("row.text").cast("string")).alias("mark"))
    return own.join(said.withColumnRenamed("id", "key"), ["key", "mark"]).select("doc_id", "item_id", "kind", "covered", "item_words", (F.col("covered") / F.col("item_words")).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found; all columns stay, and only texts that may have to go are joined."""
    gone = found(docs, benchmark).select(F.col("id").alias("key"), "mark").distinct()
    apart, rest = parted(docs, gone.select("key"))
    rest = rest.withColumn("mark", F.xxhash64(F.col("row.text").cast("string")))
    return apart.unionByName(rest.join(gone, ["key", "mark"], "left_anti").select("row.*"))
