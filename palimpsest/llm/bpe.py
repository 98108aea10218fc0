"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file becomes a vocabulary over the printable characters that stand for bytes, and merges: every split of a token
into two known tokens, in the order of the token's rank. A whole match that is a token is taken as it is.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bound_batches

#: Matches whose ids a worker remembers; the library encodes the others.
MEMO, MEMO_CHARS = 150_000, 64


#: Characters that the regex library's newer Unicode tables call letters or numbers, and the encoder's tables nothing yet.
_NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)


@functools.cache
def byte_table() -> tuple[str, ...]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return tuple(chr(b) if b in plain else chr(next(extra)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Memo(dict):
    """Ids by match. What is missing is encoded by the library's model, and kept unless long."""

    def __init__(self, model, of: tuple[str, ...]):
        super().__init__()
        self.model, self.of = model, dict(enumerate(of))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        out = tuple([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.of))])
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = out
        return out


class Codec:
    """Encoding and decoding by one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import models

        ranks = read_ranks(path)
        of = byte_table()
        name = {t: "".join(of[b] for b in t) for t in ranks}
        merges = [(name[t[:k]], name[t[k:]]) for t in sorted(ranks, key=ranks.get) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, k in ranks.items():
            self.tokens[k] = t
        self.lengths = np.array([len(t) for t in self.tokens])
        self._say = [str(k) for k in range(len(self.tokens))]
        self._split = regex.compile(pattern, regex.VERSION0).findall
        spans = [[chr(int(x, 16)) for x in r.split("-")] for r in _NEWER.split()]
        newer = regex.compile("[" + "".join("-".join(x) for x in spans) + "]", regex.VERSION0)
        self._newer, self._hide = newer.search, functools.partial(newer.sub, "\ue000")
        self.memo = _Memo(models.BPE({name[t]: k for t, k in ranks.items()}, merges, ignore_merges=True, cache_capacity=0), of)

    def split(self, text: str) -> list[str]:
        """The matches of the pattern, as the encoder's Unicode tables have them."""
        if text.isascii() or not self._newer(text):
            return self._split(text)
        ends = [0, *itertools.accumulate(map(len, self._split(self._hide(text))))]  # a private character takes their place
        return [text[a:b] for a, b in itertools.pairwise(ends)]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text: those of each match of the pattern, in order."""
        of = self.memo.__getitem__
        for t in texts:
            yield list(itertools.chain.from_iterable(map(of, self.split(t))))

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes of ids: a character split between tokens comes back whole."""
        tokens = self.tokens
        return b"".join([tokens[k] for k in ids])

    def decode(self, ids: list[int]) -> str:
        """Text; bytes that are no whole character, as a cut list may leave, become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """For each token, the code points [start, end) it touches; a character split between tokens is in each."""
        raw = np.frombuffer(text.encode(), np.uint8)
        lead = (raw & 0xC0) != 0x80
        char = np.append(np.cumsum(lead) - 1, lead.sum())  # of each byte
        ends = np.cumsum(self.lengths[np.asarray(ids, dtype=np.int64)])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return [(int(char[a]), int(char[b - 1]) + 1) for a, b in zip(starts, ends)]

    def said(self, ids: list[int]) -> bytes:
        say = self._say
        return ",".join([say[k] for k in ids]).encode()


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def _each(path: str, pattern: str, b: pa.RecordBatch) -> tuple[Codec, list[str], Iterator[list[int]]]:
    c, texts = codec(path, pattern), [t or "" for t in b.column("text").to_pylist()]
    return c, texts, c.encode(texts)


def encode(docs: DataFrame, path: str, pattern: str, with_offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>, and offsets array<struct<start,end>> if asked for. A null text counts as empty: no ids."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, texts, all_ids = _each(path, pattern, b)
            cols, names = [b.column("doc_id"), pa.array(ids := list(all_ids), pa.list_(pa.int32()))], ["doc_id", "ids"]
            if with_offsets:
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                cols.append(pa.array([[{"start": s, "end": e} for s, e in c.offsets(t, i)] for t, i in zip(texts, ids)], kind))
                names.append("offsets")
            yield pa.RecordBatch.from_arrays(cols, names)

    extra = ", offsets array<struct<start:int,end:int>>" if with_offsets else ""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>{extra}")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids count as none."""
    bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = codec(path, pattern)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.decode(i or []) for i in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and decoded again in one pass; ids if asked for."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, _, all_ids = _each(path, pattern, b)
            n, ids_sha, out_sha, kept = [], [], [], []
            for ids in all_ids:
                n.append(len(ids))
                if with_ids:
                    kept.append(np.array(ids, np.int32))
                ids_sha.append(hashlib.sha256(c.said(ids)).hexdigest())
                out_sha.append(hashlib.sha256(c.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string()), *[pa.array(kept, pa.list_(pa.int32()))] * with_ids], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
