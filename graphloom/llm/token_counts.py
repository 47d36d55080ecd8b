"""Token counts with a public byte-level BPE vocabulary.

A document of at most ``chunk`` characters is encoded in one piece.  A longer one is encoded as
overlapping chunks, with the offset of every token.  The splitter in front of the BPE matches from
left to right and remembers nothing, so a place where both chunks begin a piece is a proven common
boundary if no match of the left chunk up to there can have seen the left chunk's end: tokens
before it are taken from the left chunk, tokens after it from the right one.  Where the overlap
holds no such place (a very long run without a boundary) it is widened until there is one.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import by_batch, need, read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitter of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk and of the overlap that is tried first.
CHUNK, OVERLAP = 32_768, 256


@lru_cache(maxsize=4)
def _encoding(ranks: bytes) -> tiktoken.Encoding:
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})


class Vocabulary:
    """A vocabulary file, read where this is made and sent to the workers with what uses it, so that
    only the driver needs the file.  It is refused beyond ``most`` bytes."""

    def __init__(self, path: str = VOCABULARY, most: int = 16_000_000) -> None:
        self.ranks = Path(path).read_bytes()
        if len(self.ranks) > most:
            raise ValueError(f"{len(self.ranks)} bytes of vocabulary; {most} at most")

    def encoding(self) -> tiktoken.Encoding:
        return _encoding(self.ranks)


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    return Vocabulary(path).encoding()


#: The same in this library's terms, whose \\s holds four control characters more.
_piece = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _starts(text: str, begin: int, end: int) -> list[int]:
    """Where the pieces of text[begin:end] start, as the splitter sees that chunk alone."""
    return [begin + m.start() for m in _piece.finditer(text[begin:end])]


def boundary(text: str, begin: int, known: int, right: int, end: int) -> int | None:
    """The last proven common boundary, after ``known``, of the chunks text[begin:end] and
    text[right:...].

    Both are looked at up to the same end, beyond which the text goes on.  The last two pieces
    may have seen that end (the last may be cut; a run of blanks before it looks one character
    ahead), so places after them prove nothing."""
    own = set(_starts(text, begin, end)[:-2])
    return max((p for p in _starts(text, right, end)[:-2] if p > known and p in own), default=None)


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(begin, end, first, last): encode text[begin:end], take the tokens that start in
    text[first:last].  A chunk begins in the one before it, at most ``overlap`` characters before
    that one's end where an overlap of that length holds a proven boundary, else further back; if
    there is none at all the chunk before is made longer."""
    out = []
    begin = first = 0
    end = chunk
    while end < len(text):
        wide, at = overlap, None
        while at is None:
            right = max(first, end - wide)
            at = boundary(text, begin, first, right, end)
            if right == first:
                break
            wide *= 2
        if at is None:
            end += max(chunk, end - begin)
            continue
        out.append((begin, end, first, at))
        begin, first, end = right, at, right + chunk + (at - right)
    return [*out, (begin, len(text), first, len(text))]


def encode(text: str, enc: tiktoken.Encoding, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of the whole text, spliced from its chunks by the tokens' offsets."""
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for begin, end, first, last in chunks(text, chunk, overlap):
        ids = enc.encode_ordinary(text[begin:end])
        starts = np.cumsum([0, *map(len, enc.decode_tokens_bytes(ids))])[:-1]
        low, high = (len(text[begin:p].encode()) for p in (first, last))
        out += ids[np.searchsorted(starts, low) : np.searchsorted(starts, high)]
    return out


def count(text: str, enc: tiktoken.Encoding, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    return len(encode(text, enc, chunk, overlap))


def token_counts(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens) for each row.

    A null text has a null count, an empty one 0; a null doc_id stays null; repeated rows are
    counted each; strings that look like special tokens are ordinary text; other columns are
    ignored; an empty table gives no rows.
    """

    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = shared.value.encoding()
        n = [None if t is None else count(t, enc, chunk, overlap) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    own = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return own.mapInArrow(by_batch(run), "doc_id long, n_tokens long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts() of all documents."""
    return token_counts(read(spark, sf_dir, "documents"))
