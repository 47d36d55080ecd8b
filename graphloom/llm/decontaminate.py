"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised to plain words; every run of WINDOW words (the whole item where it is
shorter) is a pattern of one automaton, which each Python worker builds once from the broadcast items.
In scripts that put no blanks between words, characters are words that count half.
Each text is normalised the same way and scanned once.  Only texts with a hit are normalised a
second time, with offsets, to say where in the original the passage stands.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import by_batch, need, plain, plain_spans, read, unparted

#: Words of a pattern.
WINDOW = 8
#: The automaton lives in every executor, so items are refused beyond this size.
MAX_ITEM_BYTES = 256_000_000

#: Of a Python worker: the automaton of the last benchmark, by a name that only that benchmark has.
_built: dict[str, ahocorasick.Automaton] = {}


def patterns(items: list[tuple[int, str]], window: int = WINDOW) -> dict[str, list[int]]:
    """Pattern -> ids of the items that have it."""
    out: dict[str, list[int]] = defaultdict(list)
    for item, text in items:
        words = plain(text).split()
        for a, b in windows([0.5 if unparted(w) else 1 for w in words], window):
            own = out[" " + " ".join(words[a:b]) + " "]
            if item not in own:
                own.append(item)
    return out


def windows(weights: list[float], window: int) -> list[tuple[int, int]]:
    """The shortest runs that weigh ``window`` and end no earlier than the one before; the whole where
    it weighs less; none if there is nothing."""
    out, b, weight = [], 0, 0.0
    for a, own in enumerate(weights):
        while weight < window and b < len(weights):
            weight += weights[b]
            b += 1
        if weight < window:
            return out or [(0, len(weights))]
        out.append((a, b))
        weight -= own
    return out


def automaton(items: list[tuple[int, str]], window: int = WINDOW) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p, ids in patterns(items, window).items():
        a.add_word(p, (len(p), tuple(ids)))
    if len(a):
        a.make_automaton()
    return a


def spans(text: str, a: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(item, start, end) in the original text; overlapping matches of an item are one span."""
    if not len(a) or not (hits := list(a.iter(plain(text)))):
        return []
    _, start, end = plain_spans(text)
    found: dict[int, list[list[int]]] = defaultdict(list)
    for last, (size, ids) in hits:
        s, e = start[last - size + 2], end[last - 1]
        for item in ids:
            own = found[item]
            if own and s <= own[-1][1]:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
    return [(item, s, e) for item, own in sorted(found.items()) for s, e in own]


def _items(benchmark: DataFrame) -> list[tuple[int, str]]:
    own = need(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"{size} bytes of items; {MAX_ITEM_BYTES} at most: split the benchmark and run once for each part")
    return [(r.item_id, r.text) for r in own.orderBy("item_id", "text").collect()]


def _shared(docs: DataFrame, benchmark: DataFrame, window: int):
    items, name = docs.sparkSession.sparkContext.broadcast(_items(benchmark)), uuid.uuid4().hex

    def get() -> ahocorasick.Automaton:
        if name not in _built:
            _built.clear()
            _built[name] = automaton(items.value, window)
        return _built[name]

    return get


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, start, end) for each passage of a test item in a document; offsets count
    the characters of the original text, end is past the last.

    Case, punctuation and white space don't matter.  A match has to begin and end with a word.  An item of fewer words than the window
    is looked for whole, however short: a one-word answer is found wherever the word stands.  Rows
    without doc_id or text, and items without id, text or a word, are left out; empty texts have no
    passage; an item that is there twice counts once; repeated documents are reported each; other
    columns are ignored; with an empty table on either side there are no rows.
    """
    get = _shared(docs, benchmark, window)

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        a = get()
        rows = [(d, *s) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in spans(t, a)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "start", "end"])

    own = need(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return own.select(F.col("doc_id").cast("long"), "text").mapInArrow(by_batch(scan), "doc_id long, item_id long, start int, end int")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows whose text has no passage of a test item, all columns as they were.  Rows without
    text stay; a table without that column is an error.  Short items count as in contamination(), so a benchmark of answers like "yes" takes
    every text with that word; leave such items out of benchmark where that isn't wanted."""
    need(docs, "text")
    get = _shared(docs, benchmark, window)

    def clean(b: pa.RecordBatch) -> pa.RecordBatch:
        a = get()
        texts = b.column(b.schema.get_field_index("text")).to_pylist()
        return b.filter(pa.array([t is None or not len(a) or next(a.iter(plain(t)), None) is None for t in texts], pa.bool_()))

    return docs.mapInArrow(by_batch(clean), docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination() of all documents by all items."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
