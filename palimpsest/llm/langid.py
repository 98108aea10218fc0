"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learned by follow-the-regularised-leader with elastic-net penalties on a bounded sample; document
frequencies are counted over all rows that may be learned from. There is no bias: a text of which no n-gram was learned is
as likely in any language. A temperature, fitted on a part of the sample that the weights never saw, makes the
probabilities honest; its targets fall short of 1 by what a sample of that size cannot tell.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Rows that the weights are fitted on at most, split evenly over the languages.
SAMPLE = 4000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
EPOCHS = 2
UNKNOWN = "und"
#: The calibrated probability below which a filter takes a text to be in none of the languages.
LEAST = 0.35


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x32000)], bool)


def counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets of the text's n-grams and how often each occurs; None without a letter. What is no letter is a blank."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[np.minimum(cp, 0x31FFF)] if len(cp) else np.zeros(0, bool)
    if not letter.any():
        return None
    c = np.where(letter, cp, 32)
    keep = np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]  # runs of blanks count once
    c = np.r_[np.uint32(32), c[keep], np.uint32(32)].astype(np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(c), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(ORDERS) + 1):
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1:] * np.uint32(0x9E3779B1) + np.uint32(n)
            if n in ORDERS:
                x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                total += np.bincount(x >> np.uint32(17), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def may_learn(doc_id: str = "doc_id") -> Column:
    """Whether a row may be learned from, its label aside; a row without an id may not."""
    return F.coalesce(~_out(doc_id), F.lit(False)) & F.col(doc_id).isNotNull()


def _out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


class Model:
    """Weights by bucket and language, inverse document frequencies, a temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf = langs, idf.astype(np.float32)
        self.weights = np.zeros((len(langs), BUCKETS), np.float32)
        self.temperature = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n).astype(np.float32) * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ self.vector(at, n)

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], held: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """rows: (language, buckets, counts) in the order they are learned in. held: those for the temperature."""
        size = (len(self.langs), BUCKETS)
        z, n2 = np.zeros(size), np.zeros(size)

        def weights(z: np.ndarray, n2: np.ndarray) -> np.ndarray:
            return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n2)) / ALPHA + L2)

        for _ in range(EPOCHS):
            for y, cols, n in rows:
                x = self.vector(cols, n).astype(np.float64)
                w = weights(z[:, cols], n2[:, cols])
                p = _softmax(w @ x)
                p[y] -= 1
                g = p[:, None] * x
                sigma = (np.sqrt(n2[:, cols] + g * g) - np.sqrt(n2[:, cols])) / ALPHA
                z[:, cols] += g - sigma * w
                n2[:, cols] += g * g
        self.weights = weights(z, n2).astype(np.float32)
        if held:
            said, truth = np.array([self.logits(a, n) for _, a, n in held]), np.array([y for y, _, _ in held])
            target = np.full(said.shape, 1 / (len(held) + 2) / max(1, len(self.langs) - 1))
            target[np.arange(len(truth)), truth] = 1 - 1 / (len(held) + 2)
            loss = lambda t: -np.mean((target * np.log(np.maximum(_softmax(said / t), 1e-12))).sum(axis=1))
            self.temperature = float(min(np.geomspace(0.02, 5, 120), key=loss))

    def predict(self, text: str | None) -> tuple[str, float]:
        """A learned language and its probability; und and 0 for a null text, one without a letter, or no language."""
        found = counts(text) if text and self.langs else None
        if found is None:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*found) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], min(1.0, float(p[k]))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled rows whose crc32 lets them be learned from. Their languages are the ones it can say."""
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string").alias("text")
    rows = docs.filter(may_learn() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", text)
    per = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(per)

    def frequencies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for b in parts:
            for t in b.column("text").to_pylist():
                if found := counts(t):
                    total[found[0]] += 1
                    total[BUCKETS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    df = np.zeros(BUCKETS + 1)
    for k, n in rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        df[k] = n
    model = Model(langs, np.log((1 + df[-1]) / (1 + df[:-1])) + 1)
    if not langs:
        return model

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            got = [(d, y, *f) for d, y, t in zip(*(b.column(c).to_pylist() for c in ("order", "lang", "text"))) if (f := counts(t))]
            cols = list(zip(*got)) if got else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array([x.astype("<i4").tobytes() for x in cols[2]], pa.binary()), pa.array([x.astype("<i4").tobytes() for x in cols[3]], pa.binary())], ["order", "lang", "at", "n"])

    share = F.create_map(*[x for y, n in per.items() for x in (F.lit(y), F.lit(min(1.0, sample / len(langs) / n)))])
    order = F.xxhash64(F.col("doc_id").cast("string"))
    drawn = F.shiftrightunsigned(F.xxhash64(order), 11).cast("double") / F.lit(float(1 << 53)) < share[F.col("lang")]
    picked = rows.filter(drawn).select(order.alias("order"), "lang", "text").mapInArrow(features, "order long, lang string, at binary, n binary")
    got = sorted(picked.limit(2 * sample).collect(), key=lambda r: (r["order"], r["at"], r["n"]))
    known = [(langs.index(r["lang"]), np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["n"], "<i4")) for r in got]
    if len(known) < 10:
        model.fit(known, [])
    else:
        model.fit([x for k, x in enumerate(known) if k % 5], known[::5])
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs."""
    bound_batches(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            lang, score = zip(*map(model.predict, b.column("text").to_pylist())) if len(b) else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(_out("doc_id"), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of docs that have a letter and whose likeliest language has at least that probability; all columns stay.

    Where no language could be learned, rows with a letter stay.
    """
    bound_batches(docs.sparkSession)

    def known(text: str | None) -> bool:
        said, p = model.predict(text)
        return said != UNKNOWN and p >= least or not model.langs and counts(text or "") is not None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield b.filter(pa.array([known(t) for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
