"""Quality by nearest-neighbour voting in a latent-semantic space.

A document's terms are its words (hashed), trigrams of its bytes (hashed), trigrams of its characters'
classes (letters, capitals, digits, blanks, each punctuation mark), and how often a word or a phrase
follows itself.
A truncated SVD of a bounded labelled sample gives the space.  The labelled vectors are broadcast;
for every document all cosines with them are computed exactly, in blocks, and the nearest vote
with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import by_batch, labelled, need, read

#: Different labelled texts of each class that are fitted on and vote, at most; dimensions of the space;
#: neighbours that vote; share of the votes that keeps a document.
FIT_ROWS, DIMENSIONS, NEIGHBOURS, KEEP = 1024, 48, 15, 0.5
_HASHED, _WORDS = 1024, 1024
#: Length of the group of words, the others having 1.  With a few hundred labelled rows single words mislead:
#: held-out junk found at sf0.01 (12 halves) is 0.947 at 0, 0.941 at 0.3 and 0.918 at 1, at sf0.1 0.989 at all.
_LEXICAL = 0.3
_LAGS = (1, 2, 3)


def _classes() -> bytes:
    table = bytearray([1] * 256)  # other bytes: letters beyond ASCII
    for c in range(128):
        ch = chr(c)
        table[c] = 2 if ch.isupper() else 1 if ch.islower() else 3 if ch.isdigit() else 4 if ch == " " else 5 if ch == "\n" else 0
    for i, group in enumerate((".,;:", "!?", "|", "*", "#", "$", "%", "&", "'\"-()", "_/\\<>[]{}=+~^`@")):
        for ch in group:
            table[ord(ch)] = 6 + i
    return bytes(table)


_CLASS = _classes()
_REPEATS = 4096 + _HASHED + _WORDS
WIDTH = _REPEATS + 2 * len(_LAGS)


def features(texts: list[str | None]) -> np.ndarray:
    """(n, WIDTH) float32; each of the four groups of terms has the length 1, words _LEXICAL (texts of
    under three bytes have no trigrams, blank ones no words)."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    hashed: dict[str, int] = {}
    for row, text in zip(out, texts):
        b = (text or "").encode("utf-8", "replace")
        if len(b) > 2:
            a = np.frombuffer(b.translate(_CLASS), np.uint8).astype(np.uint16)
            row[:4096] = np.bincount((a[:-2] << 8) | (a[1:-1] << 4) | a[2:], minlength=4096)
            a = np.frombuffer(b.lower(), np.uint8).astype(np.uint32)
            row[4096 : 4096 + _HASHED] = np.bincount(((a[:-2] * 0x9E3779B1 ^ a[1:-1] * 0x85EBCA6B ^ a[2:] * 0xC2B2AE35) >> 15) % _HASHED, minlength=_HASHED)
            row[: 4096 + _HASHED] /= len(b) - 2
        words = (text or "").lower().split()
        if words:
            for w in words:
                if w not in hashed:
                    hashed[w] = crc32(w.encode("utf-8", "replace")) % _WORDS
            row[4096 + _HASHED : _REPEATS] = np.bincount([hashed[w] for w in words], minlength=_WORDS) * (_LEXICAL**2 / len(words))
        for i, lag in enumerate(_LAGS):
            again = sum(x == y for x, y in zip(words, words[lag:])) / max(1, len(words) - lag)
            row[_REPEATS + 2 * i : _REPEATS + 2 * i + 2] = again, (1 - again) * 0.2
    return np.sqrt(out)


@dataclass
class Space:
    """idf and axes map features to the space; votes: unit vectors of the labelled, with labels."""

    idf: np.ndarray
    axes: np.ndarray
    votes: np.ndarray
    labels: np.ndarray

    def place(self, texts: list[str | None]) -> np.ndarray:
        x = (features(texts) * self.idf) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None], k: int = NEIGHBOURS) -> np.ndarray:
        cos = self.place(texts) @ self.votes.T
        k = min(k, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, axis=1), 1e-6) ** 4
        return (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, dimensions: int = DIMENSIONS) -> Space | None:
    """The space of at most ``rows`` labelled documents of each class, taken by a hash of their
    ids; equal texts count once; None if there aren't labelled rows of both classes."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        x = features(b.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], ["doc_id", "quality", "x"])

    found = labelled(docs, labels, "quality", rows).mapInArrow(by_batch(count, 256), "doc_id long, quality int, x binary").collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    if len({r.quality for r in found}) < 2:
        return None
    x = np.stack([np.frombuffer(r.x, np.float16) for r in found]).astype(np.float32)
    y = np.array([r.quality for r in found], dtype=np.float32)
    del found
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x *= idf
    values, vectors = np.linalg.eigh(x @ x.T)
    top = np.argsort(-values)[: min(dimensions, len(x))]
    top = top[values[top] > values.max() * 1e-7]
    axes = (x.T @ vectors[:, top] / np.sqrt(values[top])).astype(np.float32)
    votes = x @ axes
    return Space(idf, axes, votes / np.maximum(np.linalg.norm(votes, axis=1, keepdims=True), 1e-9), y)


def _scorer(docs: DataFrame, space: Space | None):
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def score(texts: list[str | None]) -> list[float | None]:
        if shared.value is None:
            return [None] * len(texts)
        scores = [round(float(s), 6) for s in shared.value.score(texts)]
        return [s if t and not t.isspace() else 0.0 for t, s in zip(texts, scores)]

    return score


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, keep) for each row: the share of the neighbours' votes for good quality.

    A null, empty or blank text has score 0 and isn't kept.  Without labelled rows of both classes
    nothing is judged: score is null and keep true.  A null doc_id stays null; repeated rows are
    scored each; the whole text counts; other columns are ignored; an empty table gives no rows.
    """
    score = _scorer(docs, fit(docs, labels))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = score(b.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([x is None or x >= KEEP for x in s], pa.bool_())], ["doc_id", "score", "keep"])

    own = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return own.mapInArrow(by_batch(run, 256), "doc_id long, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that quality() keeps, all columns as they were; a table without text is an error."""
    need(docs, "text")
    score = _scorer(docs, fit(docs, labels))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = score(b.column(b.schema.get_field_index("text")).to_pylist())
        return b.filter(pa.array([x is None or x >= KEEP for x in s], pa.bool_()))

    return docs.mapInArrow(by_batch(run, 256), docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality() of all documents."""
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
