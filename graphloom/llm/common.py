"""What the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import release, scratch, shared_dir, spool, unspool  # noqa: F401

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def need(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, whatever else the table has; a missing one is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*columns)


def free(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't use yet, so added columns can't clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label, text): different texts of labelled documents, at most ``rows`` of each of the
    labels 0 and 1, taken by a hash: however often an id, a label or a text is there, no more rows
    come out."""
    known = need(labels, "doc_id", label).where(f"doc_id IS NOT NULL AND {label} IN (0, 1)").distinct()
    picked = [known.where(F.col(label) == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    picked = picked[0].unionAll(picked[1]).withColumnRenamed("doc_id", "id")
    found = need(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), F.col("doc_id") == F.col("id"))
    each = found.groupBy(label, "text").agg(F.min("doc_id").alias("doc_id"))
    out = [each.where(F.col(label) == k).orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "text").limit(rows) for k in (0, 1)]
    # A limit leaves one partition; what is done with the sample is for all cores.
    return out[0].unionAll(out[1]).select("doc_id", label, "text").repartition(docs.sparkSession.sparkContext.defaultParallelism)


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch | None], rows: int = 1024) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: f over slices of a bounded number of rows, so that a batch of very long
    texts doesn't need all its intermediate arrays at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                if (out := f(b.slice(at, rows))) is not None:
                    yield out

    return run


# ---- plain words, for matching -------------------------------------------------------------

_ASCII = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: General punctuation, Latin-1 punctuation, CJK punctuation as UTF-8 bytes.
_WIDE = re.compile(rb"\xe2[\x80\x81][\x80-\xbf]|\xc2[\xa0-\xbf]|\xe3\x80[\x80-\x9f]|\xc3[\x97\xb7]")
#: Characters of scripts that put no blanks between words (kana, Han, Thai, Lao, Myanmar, Khmer).
_UNPARTED = re.compile(rb"\xe3(?:[\x81-\x83]|[\x90-\xbf])[\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xf0[\xa0-\xb3][\x80-\xbf]{2}|\xe0[\xb8-\xbb][\x80-\xbf]|\xe1(?:[\x80-\x82]|[\x9e\x9f])[\x80-\xbf]")
_MAYBE = re.compile(rb"[\xe0\xe1\xe3-\xe9\xf0]")


def unparted(word: str) -> bool:
    """Whether a word of plain() is one character of a script without blanks."""
    return not word.isascii() and _UNPARTED.fullmatch(word.encode("latin-1")) is not None


def plain(text: str) -> str:
    """Lower-case words between single spaces, with a space before and after, punctuation
    dropped.  In scripts that put no blanks between words each character is a word.  The result holds
    one character per UTF-8 byte: it is for matching only."""
    b = text.lower().encode("utf-8", "replace") if not text.isascii() else text.encode()
    b = b.translate(_ASCII)
    if _MAYBE.search(b):
        b = _UNPARTED.sub(rb" \g<0> ", b)
    if b"\xc2" in b or b"\xe2" in b or b"\xe3" in b or b"\xc3\x97" in b or b"\xc3\xb7" in b:
        b = _WIDE.sub(b" ", b)
    return " " + b" ".join(b.split()).decode("latin-1") + " "


def plain_spans(text: str) -> tuple[str, list[int], list[int]]:
    """plain(text), and for each of its characters where in text it starts and ends."""
    out, start, end = [" "], [0], [0]
    for i, ch in enumerate(text):
        b = ch.lower().encode("utf-8", "replace").translate(_ASCII)
        for c in _WIDE.sub(b" ", b if ch.isascii() else _UNPARTED.sub(rb" \g<0> ", b)).decode("latin-1"):
            if c.isascii() and c.isspace():
                if out[-1] != " ":
                    out.append(" "), start.append(i), end.append(i)
            else:
                out.append(c), start.append(i), end.append(i + 1)
    if out[-1] != " " or len(out) == 1:
        out.append(" "), start.append(len(text)), end.append(len(text))
    return "".join(out), start, end
