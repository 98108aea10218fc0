"""Personal data by bootstrapped contextual extraction.

Base expressions give seed entities. The labels before them (such as `phone no:`) and the words directly before and
after them are lexical patterns. Patterns and the instances they introduce form a graph that is scored in rounds: a
pattern by the instances known of a kind and those that speak against it, which are known of other kinds or are numbers
of no identifier's shape. Unseen instances count for neither; those of one form are taken up while they do not outnumber
the known ones, and are then known in the next round. So good patterns give identifiers that no base expression fits.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches, stage, unstage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Distinct known instances that a pattern needs, their least share of those and the instances against it, an instance's least score.
SUPPORT, CONFIDENCE, SCORE = 3, 0.8, 0.8
#: The kind of what is a number and no identifier.
OTHER = -1
#: Digits of a phone number at least, where no base expression says that it is one.
PHONE_DIGITS = 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# Possessive, and from the start of a run of digits on: the same matches, in time linear in the text.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: What may be an identifier of a kind where no base expression says so.
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.(-])\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,5}){1,4}(?![0-9])"),
}
_LABEL = re.compile(r"([^\W\d_]{2,20})(?:[ ]([^\W\d_]{1,20}))?[ ]?([:=#])[ \"']{0,3}\Z")

_BEFORE = re.compile(r"(?<![^\W_])(?:([^\W\d_]{1,20})\s)?([^\W\d_]{1,20})\s([^\W\d_]{1,20})\s\Z")
_AFTER = re.compile(r"\s([^\W\d_]{1,20})\s([^\W\d_]{1,20})(?![^\W_])(?:\s([^\W\d_]{1,20})(?![^\W_]))?")
_NUMBER = re.compile(r"(?<![\w.+-])[0-9][\w.,:/-]*")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each @ outwards: time is linear in the text."""
    out, end, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > end and t[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            end = m.end()
            out.append((start, end))
        at = t.find("@", max(at + 1, end))
    return out


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), by kind, then start."""
    out = [(0, *x) for x in emails(t)] if "@" in t else []
    if not _DIGIT.search(t):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(t) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    if "+" in t:
        out += [(3, *m.span()) for m in _PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _patterns(t: str, start: int, end: int) -> list[str]:
    """Lower-cased: the label before a span, one or two words and a mark; else the two and three words before it; those after it."""
    before, out = t[max(0, start - 65):start], []
    if m := _LABEL.search(before[-50:]):
        out.append(" ".join(x.lower() for x in m.groups() if x))
    elif m := _BEFORE.search(before):
        words = [x.lower() for x in m.groups() if x]
        out += [" ".join(words[-k:]) + " _" for k in range(2, len(words) + 1)]
    if m := _AFTER.match(t[end:end + 65]):
        words = [x.lower() for x in m.groups() if x]
        out += ["_ " + " ".join(words[:k]) for k in range(2, len(words) + 1)]
    return out


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans, where overlapping ones are one."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _meets(merged: tuple[list[int], list[int]], s: int, e: int) -> bool:
    k = bisect_left(merged[0], e) - 1
    return k >= 0 and merged[1][k] > s


def mentions(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str, bool]]:
    """(kind, start, end, pattern, instance, known) of base spans, loose ones beside them, and other numbers, by each of their patterns."""
    out = [(k, s, e, p, t[s:e].lower(), True) for k, s, e in base for p in _patterns(t, s, e)]
    taken, loose = _merged([x[1:] for x in base]), []
    for k, name in enumerate(KINDS):
        if k == 0 and "at)" not in t and "at]" not in t or k == 1 and ":" not in t or k > 1 and not _DIGIT.search(t):
            continue
        for m in _LOOSE[name].finditer(t):
            if not _meets(taken, *m.span()) and (k != 3 or sum(c.isdigit() for c in m[0]) >= PHONE_DIGITS):
                loose.append(m.span())
                out += [(k, *m.span(), p, m[0].lower(), False) for p in _patterns(t, *m.span())]
    taken = _merged([x[1:] for x in base] + loose)
    return out + [(OTHER, *m.span(), p, m[0].lower(), False) for m in _NUMBER.finditer(t) if not _meets(taken, *m.span()) for p in _patterns(t, *m.span())]


_MENTION = "array<struct<kind:int,start:int,end:int,pattern:string,instance:string,known:boolean>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, base, mentions) of each row, staged: base as a list of (kind, start, end)."""
    bound_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    mention = pa.struct([*span, ("pattern", pa.string()), ("instance", pa.string()), ("known", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            base, named = [], []
            for t in b.column("text").to_pylist():
                found = base_spans(t)
                base.append([dict(zip(("kind", "start", "end"), x)) for x in found])
                named.append([dict(zip(("kind", "start", "end", "pattern", "instance", "known"), x)) for x in mentions(t, found)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(named, pa.list_(mention))], ["doc_id", "base", "mentions"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, f"doc_id long, base array<struct<kind:int,start:int,end:int>>, mentions {_MENTION}")
    return stage(out.withColumn("rid", F.monotonically_increasing_id()), "scan")


def _form(kind: Column, instance: Column) -> Column:
    """What instances of one form share: digits of cards and phones by their number, other runs of characters as one."""
    return F.when(kind == 0, F.regexp_replace(instance, "[a-z0-9._%+-]+", "a")).when(kind == 1, F.regexp_replace(instance, "[0-9a-f]+", "a")).otherwise(F.regexp_replace(instance, "[0-9]", "9"))


def good_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, pattern, form) whose unseen instances the graph (kind, pattern, instance, known) takes up in the rounds."""
    seeded = edges.filter("known").groupBy("kind", "pattern").agg(F.countDistinct("instance").alias("n")).filter(F.col("n") >= SUPPORT).select("pattern").distinct()
    score = F.max(F.when(F.col("known"), 1.0).otherwise(0.0)).alias("score")
    now = stage(edges.join(seeded, "pattern", "left_semi").groupBy("kind", "pattern", "instance").agg(score).withColumn("form", _form(F.col("kind"), F.col("instance"))), "edges")
    # what base expressions know of a kind, and numbers that are no identifier, speak against all other kinds
    against = stage(now.filter((F.col("kind") == OTHER) | (F.col("score") == 1)).groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n")), "against")
    every = against.groupBy("pattern").agg(F.sum("n").alias("all"))
    own = against.filter(F.col("kind") != OTHER).join(every, "pattern").select("kind", "pattern", (F.col("all") - F.col("n")).alias("against"))
    own = stage(own, "own")
    good = None
    for _ in range(rounds):
        trusted = now.filter(F.col("score") >= SCORE).groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("support")).join(own, ["kind", "pattern"]).withColumn(
            "trust", F.col("support") / (F.col("support") + F.col("against"))).filter((F.col("trust") >= CONFIDENCE) & (F.col("support") >= SUPPORT))
        unseen = now.groupBy("kind", "pattern", "form").agg(F.count(F.when(F.col("score") < SCORE, 1)).alias("unseen"))
        good = stage(unseen.join(trusted, ["kind", "pattern"]).filter(F.col("unseen") <= F.col("support")).select("kind", "pattern", "form", "trust"), "patterns")
        # an instance is wrong only if each good pattern that introduces it is
        doubt = F.when(F.count("trust") > 0, 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6))))))
        scored = now.join(good, ["kind", "pattern", "form"], "left").groupBy("kind", "instance").agg(doubt.alias("by_pattern"))
        after = stage(now.join(scored, ["kind", "instance"]).select("kind", "pattern", "instance", F.greatest("score", F.coalesce("by_pattern", F.lit(0.0))).alias("score"), "form"), "edges")
        unstage(now)
        now = after
    return good.select("kind", "pattern", "form")


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def find_pii(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans for each row of docs.

    The four counts and the hash are of the base spans alone; spans has those that good patterns added, too, and n_spans
    counts them. A null text
    counts as empty. Added spans never overlap base spans.
    """
    rows = scan(docs)
    named = rows.select("rid", F.explode("mentions").alias("m")).select("rid", "m.*")
    good = good_patterns(named, rounds)
    loose = named.filter(~F.col("known") & (F.col("kind") != OTHER)).withColumn("form", _form(F.col("kind"), F.col("instance")))
    more = loose.join(good, ["kind", "pattern", "form"], "left_semi").groupBy("rid").agg(
        F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.select("doc_id", "base", "rid").join(more, "rid", "left").select(
        "doc_id", *map(count, range(4)), F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _said(F.concat("base", F.coalesce("more", none))).alias("spans"), (F.size("base") + F.size(F.coalesce("more", none))).cast("long").alias("n_spans"))


def brute_base(t: str | None) -> tuple[list[int], str]:
    """Counts and hash of the base spans by the plain expressions, for tests."""
    t = t or ""
    tests = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(d := re.sub("[ -]", "", x)) <= 19 and _luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(re.findall("[0-9]", x)) <= 15),
    )
    by = [[m.span() for m in re.finditer(p, t) if ok(m[0])] for p, ok in tests]
    said = ",".join(reduce(list.__add__, [[f"{k}:{s}:{e}" for s, e in x] for k, x in zip(KINDS, by)], []))
    return [len(x) for x in by], hashlib.sha256(said.encode()).hexdigest()
