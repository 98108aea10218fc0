"""URL filters: pattern rules indexed by their rarest literal token.

Each rule's pattern holds literal tokens that any url it fits must have. The index files a rule under the one of these
that the fewest urls have, counted over all urls. A url's tokens fetch candidate rules, and only their expressions run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches

_TOKEN = re.compile(r"[a-z0-9]+")
#: Rules that are shipped to a task at once; more are tried in further passes over the urls, none of which shuffles.
BLOCK_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """host and path prefix with its verdict; or, where pattern is set, an expression over the lower-cased url.

    literals are tokens ([a-z0-9]+) that each url has which the expression finds something in.
    """

    name: str
    verdict: str
    host: str = ""
    path: str = ""
    pattern: str | None = None
    literals: tuple[str, ...] = ()

    def tokens(self) -> set[str]:
        """Tokens that every url has which the rule fits; a path's last one may go on in the url."""
        if self.pattern is not None:
            return set(self.literals)
        return set(_TOKEN.findall(self.host)) | set(_TOKEN.findall(re.sub(r"[A-Za-z0-9]+$", "", self.path).lower()))

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)


def _pattern(name: str, literal: str, expression: str) -> Rule:
    return Rule(name, "block", pattern=expression, literals=(literal,))


_EDGE, _END = r"(?:^|[^a-z0-9])", r"(?:[^a-z0-9]|$)"
#: A host one of whose names has the word as a part between hyphens.
_HOST = r"://(?:[a-z0-9-]+\.)*(?:[a-z0-9]+-)*{}(?:-[a-z0-9]+)*\.[a-z]"

#: (host, path) rules of the default list; the longest that fits decides.
PLACES = tuple(Rule(h + p, v, h, p) for v, h, p in (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/")))
#: What decides where no place does: adult, gambling and tracking addresses, by words and by the shape of hosts and paths.
PATTERNS = tuple(_pattern(w, w, _EDGE + w + _END) for w in (
    "porn", "xxx", "casino", "poker", "betting", "viagra", "torrent", "warez", "doubleclick", "adserver")) + tuple(
    _pattern(f"{w} host", w, _HOST.format(w)) for w in ("adult", "sex", "pills", "meds", "bets", "spam", "replica")) + (
    _pattern("adult section", "adult", r"/adult(?:-(?:only|content|chat|videos?))?(?:[/?#]|$)"),
    _pattern("advertising host", "ads", _HOST.format(r"ads-(?:track|click|serve|count)(?:er|r|ing|s)?")),
    _pattern("redirect through a tracker", "tracker", r"://(?:[^/?#]*[^a-z0-9/?#])?tracker(?:[^a-z0-9/?#][^/?#]*)?/|[?&;](?:[a-z]+_)?tracker="),
    _pattern("click counter", "click", r"/click(?:\.php|\.cgi|\.aspx)?\?(?:[^#]*&)?(?:id|aff|clickid|banner)=[0-9a-f]+"),
    _pattern("session in the path", "sid", r"[/;?&]sid=[0-9a-f]{16,}"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty where the url is null or has no ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    cut = rest.find("/", 0, end)
    host, path = (rest[:end], "") if cut < 0 else (rest[:cut], rest[cut:end])
    return host.encode().lower().decode(), path  # bytes.lower() is A-Z only


class Index:
    """Rules by rarest token; those without a token are candidates of every url."""

    def __init__(self, rules: tuple[Rule, ...], seen: dict[str, int]):
        self.by: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules = rules
        self.tests = [r.pattern and re.compile(r.pattern) for r in rules]
        for k, r in enumerate(rules):
            if tokens := r.tokens():
                self.by.setdefault(min(tokens, key=lambda t: (seen.get(t, 0), t)), []).append(k)
            else:
                self.always.append(k)

    def judge(self, url: str | None, rule: str | None = None, verdict: str | None = None) -> tuple[str | None, str]:
        """The longest place rule that fits, or None, and the verdict; rule and verdict are those of the blocks before."""
        host, path = split_url(url)
        low = (url or "").encode().lower().decode()
        fetched = dict.fromkeys(self.always)
        for t in set(_TOKEN.findall(low)):
            fetched.update(dict.fromkeys(self.by.get(t, ())))
        for k in sorted(fetched):
            r, test = self.rules[k], self.tests[k]
            if test is None:
                if r.fits(host, path) and (rule is None or (len(r.name), r.verdict == "block") > (len(rule), verdict == "block")):
                    rule, verdict = r.name, r.verdict
            elif rule is None and verdict != "block" and test.search(low):
                verdict = r.verdict
        return rule, verdict or "allow"


def token_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many urls have each token of the rules, over all urls. No more counts come back than the rules have tokens."""
    asked = sorted(set().union(*(r.tokens() for r in rules)))
    if not asked:
        return {}
    words = F.array_intersect(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+")), F.array(*map(F.lit, asked)))
    return dict(map(tuple, urls.select(F.explode(words).alias("t")).groupBy("t").count().collect()))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = PLACES + PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict for each row.

    The longest (host, path) rule that fits gives rule and verdict; a tie goes to a block. Elsewhere rule is null and
    the patterns decide: block if one is found, allow if none. A null or malformed url has empty host and path and is
    allowed. Control characters are characters like others. A rule with no literal token is tried on every url. Rules
    beyond BLOCK_RULES are tried block by block, places first.
    """
    bound_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    ordered = tuple(sorted(rules, key=lambda r: r.pattern is not None))
    out = urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    for at in range(0, len(ordered), BLOCK_RULES):
        block = ordered[at:at + BLOCK_RULES]
        out = _judged(out, Index(block, token_counts(urls, block)), kind)

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, path = zip(*map(split_url, b.column("url").to_pylist())) if len(b) else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(host, pa.string()), pa.array(path, pa.string()), b.column("rule"), b.column("verdict")], ["page_id", "host", "path", "rule", "verdict"])

    whole = out.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    return whole.mapInArrow(parts_of, f"page_id {kind}, host string, path string, rule string, verdict string")


def _judged(rows: DataFrame, index: Index, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = list(map(index.judge, *(b.column(c).to_pylist() for c in ("url", "rule", "verdict"))))
            cols = zip(*said) if said else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *(pa.array(c, pa.string()) for c in cols)], ["page_id", "url", "rule", "verdict"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, rule string, verdict string")
