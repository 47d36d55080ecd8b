"""Toxicity by a weighted lexicon.

Texts are folded (homoglyphs, digits and signs that stand for letters, case, punctuation) and
scanned once by an Aho-Corasick automaton of lexicon terms, which are whole words or beginnings of
words.  Matches inside an exception phrase don't count.  The weights' sum over the length in words
is the score.  Weights are log-odds of a term in labelled toxic and other documents; a seed list
holds for corpora without labels.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import by_batch, labelled, need, plain, read, spool, unspool

#: Weights of English terms that hold without any labelled row.
SEEDS = {w: 4.0 for w in ("idiot", "moron", "stupid", "worthless", "pathetic", "scum", "trash", "loser", "disgusting", "clown")}
#: Phrases in which a term means no harm.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "pathetic fallacy", "loser bracket", "rodeo clown")
#: Different labelled texts of each class that the lexicon is fitted on, at most.
FIT_ROWS = 4000
#: Documents, share of the toxic ones and log-odds that a learned term needs; letters of a beginning.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS, STEMS = 3, 0.02, 3.0, (5, 6, 7)
#: Score without labelled rows, per 100 words; shorter texts count as of so many words.
THRESHOLD, LEAST_WORDS = 0.6, 20

_LOOKALIKE = {
    **dict(zip("аеорсухіјѕԁһкмтвнгп", "aeopcyxijsdhkmtbhrn")), **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοινκτυρ", "abezhikmnoptyxaoivktup")),
    **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}, **{chr(0xFF21 + i): chr(97 + i) for i in range(26)}, **{chr(0xFF10 + i): chr(48 + i) for i in range(10)},
    **dict.fromkeys("​‌‍⁠﻿­", ""), "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l",
}
_FOLD = str.maketrans(_LOOKALIKE | {c.upper(): f for c, f in _LOOKALIKE.items() if len(c.upper()) == 1})
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _FOLD))) + "]")
_DIGITS = str.maketrans("0134578", "oieastb")
_INSIDE = re.compile(r"(?<=\w)[@$!](?=\w)")
_SIGNS = {"@": "a", "$": "s", "!": "i"}


def fold(text: str) -> str:
    """plain() of the text with lookalikes put back: " words between single spaces "."""
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_FOLD)
    if "@" in text or "$" in text or "!" in text:
        text = _INSIDE.sub(lambda m: _SIGNS[m[0]], text)
    return plain(text).translate(_DIGITS)


def compiled(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> ahocorasick.Automaton:
    """lexicon: folded " word " or " beginning" -> weight. Exceptions have the weight None."""
    a = ahocorasick.Automaton()
    for term, w in [*lexicon.items(), *((fold(e), None) for e in exceptions)]:
        a.add_word(term, (len(term), w))
    if len(a):
        a.make_automaton()
    return a


def rate(text: str, a: ahocorasick.Automaton) -> tuple[float, int]:
    """(weights per 100 words, words that count); a word counts once, with its largest weight."""
    folded = fold(text)
    best: dict[int, float] = {}
    safe: list[tuple[int, int]] = []
    for last, (size, w) in a.iter(folded) if len(a) else ():
        at = last - size + 1
        if w is None:
            safe.append((at, last))
        elif w > best.get(at, 0):
            best[at] = w
    kept = [w for at, w in best.items() if not any(s <= at < e for s, e in safe)] if safe else best.values()
    return 100 * sum(kept) / max(folded.count(" ") - 1, LEAST_WORDS), len(kept)


def _terms(text: str) -> set[str]:
    out = set()
    for w in set(fold(text).split()):
        if len(w) > 2:
            out.add(f" {w} ")
            out.update(" " + w[:k] for k in STEMS if len(w) > k)
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[dict[str, float], float]:
    """(lexicon, threshold) from at most ``rows`` labelled documents of each class, taken by a
    hash of their ids; equal texts count once, or copies of one document would make its words
    telling.  Without labelled rows of both classes: the seeds and THRESHOLD."""
    sample = spool(labelled(docs, labels, "toxic", rows).select("toxic", "text"), "toxic-sample")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    seeds = {fold(w): v for w, v in SEEDS.items()}
    if len(n) < 2:
        unspool(sample)
        return seeds, THRESHOLD

    def tally(batches):
        seen = Counter(), Counter()
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[k].update(_terms(t))
        terms = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in seen)], ["term", "no", "yes"])

    odds = F.log((F.col("yes") + 0.5) / (n[1] + 1)) - F.log((F.col("no") + 0.5) / (n[0] + 1))
    counted = sample.mapInArrow(tally, "term string, no long, yes long").groupBy("term").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    learned = {r.term: r.w for r in counted.where(F.col("yes") >= max(LEAST_DOCS, LEAST_SHARE * n[1])).select("term", odds.alias("w")).where(F.col("w") >= LEAST_ODDS).collect()}
    short = sorted(learned, key=len)
    lexicon: dict[str, float] = {}
    for t in short:  # a longer term says something only if its weight is higher
        if all(lexicon.get(t[:k], 0) < learned[t] - 0.5 for k in range(4, len(t))):
            lexicon[t] = learned[t]
    lexicon |= {t: max(w, lexicon.get(t, 0)) for t, w in seeds.items()}
    scored = sample.mapInArrow(by_batch(lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([rate(t, compiled_once(lexicon))[0] for t in b.column(1).to_pylist()])], ["toxic", "score"])), "toxic int, score double").toPandas()
    unspool(sample)
    y, s = scored["toxic"].to_numpy(), scored["score"].to_numpy()
    order = np.argsort(-s, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(np.diff(s[order]) != 0, True)  # a cut must not part equal scores
    k = int(np.argmax(np.where(last & (s[order] > 0), f1, 0)))
    below = s[order][k + 1] if k + 1 < len(s) else 0.0
    return lexicon, float((s[order][k] + below) / 2)


_once: dict[int, tuple[dict, ahocorasick.Automaton]] = {}


def compiled_once(lexicon: dict[str, float]) -> ahocorasick.Automaton:
    key = id(lexicon)
    if key not in _once or _once[key][0] is not lexicon:
        _once.clear()
        _once[key] = lexicon, compiled(lexicon)
    return _once[key][1]


def toxicity(docs: DataFrame, lexicon: dict[str, float], threshold: float) -> DataFrame:
    """(doc_id, score, n_hits, toxic) for each row.

    A null or empty text has score 0 and isn't toxic; a null doc_id stays null; repeated rows are
    scored each; the whole text counts; other columns are ignored; an empty table gives no rows.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        a = compiled_once(lexicon)
        rated = [(0.0, 0) if not t else rate(t, a) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([round(s, 6) for s, _ in rated], pa.float64()), pa.array([n for _, n in rated], pa.int32()), pa.array([n > 0 and s >= threshold for s, n in rated], pa.bool_())], ["doc_id", "score", "n_hits", "toxic"]
        )

    own = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return own.mapInArrow(by_batch(run), "doc_id long, score double, n_hits int, toxic boolean")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toxicity() of all documents by the lexicon fitted on the labelled ones."""
    docs = read(spark, sf_dir, "documents")
    return toxicity(docs, *fit(docs, read(spark, sf_dir, "labels")))
