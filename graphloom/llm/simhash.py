"""Near-duplicate detection by SimHash: all pairs of signatures within a Hamming distance, none missed.

A document's features are its distinct lower-case words, weighted by length (short words are
mostly function words and count little).  Their random-hyperplane signature has ``LANES`` lanes of
64 bits; ``ORDER_LANES`` more have the distinct pairs of neighbouring words as features.

A signature is cut into ``SEGMENTS`` segments, so many that of two signatures which differ in at most
``MAX_BITS`` bits one segment differs by at most one bit: with two in each they would differ in more.
So signatures that agree in a segment but for one bit are candidates, and the Hamming distances of the
whole signatures decide.  As segments are short (11 or 12 bits), about one pair in seven is
a candidate; they are not joined but compared array by array in Python.  Few signatures are all compared
without segments.

Equal signatures are one class before that, so a group of thousands of exact copies costs one
signature.  Signatures are dealt to blocks; a task has two blocks, or one, and some of the segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_batch, free, need, read, release, spool, unspool

#: 64-bit lanes of a signature.
LANES = 5
#: Bits in which near copies differ at most: over all lanes, in each of them, in the lanes of order.
MAX_BITS, LANE_BITS, ORDER_LANES, ORDER_BITS = 55, 22, 2, 48
#: Segments, and the bits of a segment (some have one more).
SEGMENTS = MAX_BITS // 2 + 1
WIDTH = LANES * 64 // SEGMENTS
#: Up to here no pair is missed.
GUARANTEED = 2 * SEGMENTS - 1
#: Signatures of a block, tasks that a signature is sent to in one pass (about), pairs compared at once.
BLOCK, COPIES, AT_ONCE = 1 << 19, 32, 1 << 16
#: Up to so many signatures all pairs are compared, in blocks of SMALL_BLOCK.
SMALL, SMALL_BLOCK = 1 << 15, 1 << 12
WORD = re.compile(r"\w+")
_WEIGHT = np.array([0, 1, 1, 2, 4, 6, 8, 8], dtype=np.uint64)
_LANE = [f"s{i}" for i in range(LANES)]
_ALL = [*_LANE, *(f"o{i}" for i in range(ORDER_LANES))]


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Each byte as eight bytes, one for each of its bits.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _bits(hashes: np.ndarray, lanes: range) -> np.ndarray:
    """(n, 8 * lanes) uint64, whose bytes are the bits of the hyperplanes."""
    return np.concatenate([_SPREAD[_mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)).view(np.uint8).reshape(-1, 8)] for k in lanes], axis=1)


def _tally(bits: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    """Sums of runs of rows of those sizes.  Up to ``rows`` rows are added eight bytes at once, as they
    can't overflow a byte."""
    n = -(-sizes // rows)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    chunks = np.repeat(begin, n) + (np.arange(n.sum()) - np.repeat(first, n)) * rows
    return np.add.reduceat(np.add.reduceat(bits, chunks, axis=0).view(np.uint8).reshape(len(chunks), -1), first, axis=0, dtype=np.int32)


def signatures(texts: list[str]) -> np.ndarray:
    """uint64 array (len(texts), LANES + ORDER_LANES).  A text without words has the signature 0, one
    of fewer than two words zeros in the lanes of order."""
    out = np.zeros((len(texts), LANES + ORDER_LANES), dtype=np.uint64)
    place: dict[str, int] = {}
    rows = [np.array([place.setdefault(w, len(place)) for w in WORD.findall(t.lower())], dtype=np.int64) for t in texts]
    if not place:
        return out
    words = list(place)
    known = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    heavy = _WEIGHT[np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 7)]

    def filled(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.flatnonzero(sizes), sizes[sizes > 0]

    own = [np.unique(r) for r in rows]
    at, sizes = filled(own)
    each = np.concatenate(own)
    votes = _tally((_bits(known, range(LANES)) * heavy[:, None])[each], sizes, 255 // int(_WEIGHT.max()))
    whole = np.add.reduceat(heavy[each].astype(np.int32), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    out[at, :LANES] = np.packbits(2 * votes > whole[:, None], axis=1, bitorder="little").view(np.uint64)
    pairs = [np.unique(_mix(known[r[:-1]] * np.uint64(0xD6E8FEB86659FD93) + known[r[1:]])) for r in rows]
    at, sizes = filled(pairs)
    if len(at):
        votes = _tally(_bits(np.concatenate(pairs), range(LANES, LANES + ORDER_LANES)), sizes, 255)
        out[at, LANES:] = np.packbits(2 * votes > sizes[:, None], axis=1, bitorder="little").view(np.uint64)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, ht, s0, ..., o0, ...): ht is a hash of the text; rows whose text has a word."""

    def sign(b: pa.RecordBatch) -> pa.RecordBatch:
        s = signatures(b.column(2).to_pylist()).view(np.int64)
        out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(s[:, i]) for i in range(len(_ALL)))], ["doc_id", "ht", *_ALL])
        return out.filter(pa.array((s != 0).any(axis=1)))

    own = need(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("ht"), "text")
    return own.mapInArrow(by_batch(sign, 256), "doc_id long, ht long, " + ", ".join(f"{c} long" for c in _ALL))


def classes(own: DataFrame) -> DataFrame:
    """(rep, s0, ..., o0, ..., first, n): one row for each different signature; rep is a number of
    no meaning, first the smallest (doc_id, ht), n the rows."""
    return own.groupBy(*_ALL).agg(F.min(F.struct("doc_id", "ht")).alias("first"), F.count(F.lit(1)).alias("n")).withColumn("rep", F.monotonically_increasing_id())


def _bounds(max_bits: int) -> list[tuple[int, int]]:
    """First bit of each segment and the bit after its last: so many segments that at max_bits one
    differs by at most one bit."""
    n = max(SEGMENTS, max_bits // 2 + 1)
    return [(s * LANES * 64 // n, (s + 1) * LANES * 64 // n) for s in range(n)]


def _value(lanes: list[np.ndarray], low: int, high: int) -> np.ndarray:
    """The bits from low to before high of each signature."""
    at, shift = divmod(low, 64)
    out = lanes[at] >> np.uint64(shift)
    if high > 64 * (at + 1):
        out = out | lanes[at + 1] << np.uint64(64 - shift)
    return out & np.uint64(2 ** (high - low) - 1)


def _meetings(left: list[np.ndarray], right: list[np.ndarray], low: int, high: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of signatures of left and right whose bits from low to before high differ in at
    most one, and that differ in at most LANE_BITS in a lane that the segment isn't in.  same: left is
    right, each pair comes once."""
    x, y = _value(left, low, high), _value(right, low, high)
    by_x, by_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    probe = (low // 64 + 2) % LANES
    of_x, of_y = left[probe][by_x], right[probe][by_y]
    every = np.arange(2 ** (high - low) + 1, dtype=np.uint64)
    at_x, at_y = (np.searchsorted(v[by], every).tolist() for v, by in ((x, by_x), (y, by_y)))
    flips = [0, *(1 << k for k in range(high - low))]
    bits, hits = np.empty(AT_ONCE, dtype=np.uint64), np.zeros(AT_ONCE, dtype=bool)
    for v in range(len(every) - 1):
        runs = [slice(at_y[u], at_y[u + 1]) for u in (v ^ f for f in flips) if at_y[u] < at_y[u + 1] and (u >= v or not same)]
        if at_x[v] == at_x[v + 1] or not runs:
            continue
        there, lane = np.concatenate([by_y[r] for r in runs]), np.concatenate([of_y[r] for r in runs])
        for c in range(0, len(lane), AT_ONCE):
            part = lane[c : c + AT_ONCE]
            rows = AT_ONCE // len(part)
            for r in range(at_x[v], at_x[v + 1], rows):
                own = of_x[r : min(r + rows, at_x[v + 1])]
                n = len(own) * len(part)
                differ = np.bitwise_xor(own[:, None], part, out=bits[:n].reshape(len(own), len(part)))
                np.less_equal(np.bitwise_count(differ), LANE_BITS, out=hits[:n].reshape(differ.shape))
                hits[n : -(-n // 8) * 8] = False
                eights = hits[: -(-n // 8) * 8]  # few have a hit, so eight are looked at together
                found = np.flatnonzero(eights.view(np.uint64))
                e, k = np.nonzero(eights.reshape(-1, 8)[found])
                i, j = np.divmod(found[e] * 8 + k, len(part))
                i, j = by_x[r + i], there[c + j]
                if same:
                    once = (i < j) | (x[i] != x[j])
                    i, j = i[once], j[once]
                if len(i):
                    yield i, j


def _near(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, earlier: list[tuple[int, int]], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the places (i, j) where near copies are that didn't meet in an earlier segment."""
    far = np.zeros(len(i), dtype=np.int64)
    for a, b in zip(left[:LANES], right[:LANES]):
        apart = np.bitwise_count(a[i] ^ b[j])
        far += apart
        ok = (apart <= LANE_BITS) & (far <= max_bits)
        i, j, far = i[ok], j[ok], far[ok]
    ok = sum(np.bitwise_count(a[i] ^ b[j]).astype(np.int64) for a, b in zip(left[LANES:], right[LANES:])) <= ORDER_BITS
    i, j = i[ok], j[ok]
    differ = [a[i] ^ b[j] for a, b in zip(left[:LANES], right[:LANES])]
    for low, high in earlier:
        ok = np.bitwise_count(_value(differ, low, high)) > 1
        i, j, differ = i[ok], j[ok], [d[ok] for d in differ]
    return i, j


def _compare(bounds: list[tuple[int, int]], groups: int, max_bits: int):
    """For mapInArrow over all rows (task, side, rep, s0, ..., o0, ...) of tasks: pairs (a, b) of near
    signatures.  side: 0 left, 1 right, 2 both; task modulo groups tells the segments."""

    def pairs(left: list[np.ndarray], right: list[np.ndarray], same: bool, group: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in range(group, len(bounds), groups):
            some, size = [], 0
            for met in _meetings(left, right, *bounds[s], same):
                some.append(met)
                size += len(met[0])
                if size >= AT_ONCE:
                    yield _near(left, right, *map(np.concatenate, zip(*some)), bounds[:s], max_bits)
                    some, size = [], 0
            if some:
                yield _near(left, right, *map(np.concatenate, zip(*some)), bounds[:s], max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := list(batches)):
            return
        whole = pa.Table.from_batches(got)
        task, side, rep = (whole.column(c).to_numpy() for c in ("task", "side", "rep"))
        lanes = [whole.column(c).to_numpy().view(np.uint64) for c in _ALL]
        del got, whole
        for n in np.unique(task):
            own, other = (np.flatnonzero((task == n) & (side != k)) for k in (1, 0))
            a, b = [x[own] for x in lanes], [x[other] for x in lanes]
            for i, j in pairs(a, b, bool((side[own] == 2).any()), int(n) % groups):
                i, j = rep[own[i]], rep[other[j]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    return run


def similar(signs: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, small: int = SMALL) -> list[DataFrame]:
    """Spooled tables of pairs (a, b), a < b, of reps of near signatures: all there are, each once.
    signs: rows (rep, s0, ..., o0, ...), each rep once.  Near are signatures that differ in at most
    max_bits bits over all, LANE_BITS in each lane and ORDER_BITS in the lanes of order.

    Signatures are dealt to an odd number of blocks of about ``block``; at distance d of 0, 1, ... each
    block meets the d-th after it, which is all pairs of blocks once.  Few blocks make few tasks, so
    their segments are shared among several.  Some distances are one pass, so no more than COPIES
    copies (about) of the signatures are on disk.  Up to ``small`` signatures all pairs are compared."""
    spark, out, rows, bounds = signs.sparkSession, [], signs.count(), _bounds(max_bits)
    if rows <= small:
        block, bounds = min(block, SMALL_BLOCK), [(0, 0)]  # one segment of no bits, in which all agree
    blocks = -(-rows // block) | 1
    groups = min(len(bounds), max(1, COPIES // blocks), rows // 1024 + 1)
    apart, step = range(blocks // 2 + 1), max(1, (COPIES // groups + 1) // 2)
    own = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    for first in range(0, len(apart), step):
        now, to = apart[first : first + step], []
        for d in now:
            for at, side in ((own, 0), (F.pmod(own - d, F.lit(blocks)), 1)) if d else ((own, 2),):
                to += [F.struct(((at + (d - first) * blocks) * groups + g).cast("int").alias("task"), F.lit(side).alias("side")) for g in range(groups)]
        sent = signs.select(F.explode(F.array(*to)).alias("to"), "rep", *_ALL).select("to.task", "to.side", "rep", *_ALL)
        pairs = sent.repartitionById(len(now) * blocks * groups, F.col("task")).mapInArrow(_compare(bounds, groups, max_bits), "a long, b long")
        out.append(spool(pairs, "near-pairs"))
        del sent, pairs
        release(spark)  # of the copies of the pass
    return out


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected graph of pairs but roots, spooled; root is the smallest
    node of its component.  Large-star and small-star steps alternate until nothing changes, about
    log(size) times."""
    edges = spool(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    known = _print(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = spool(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionAll(joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = spool(small, "small-star")
        unspool(large), unspool(edges)
        edges, before, known = after, known, _print(after)
        if known == before:
            out = edges.toDF("node", "root")
            out._spooled_at = edges._spooled_at
            return out


def _print(edges: DataFrame) -> tuple:
    """The number of edges and sums of 128 bits of hashes of them: equal sets have equal ones."""
    h = [F.bit_xor(F.xxhash64(F.lit(i), "u", "v")) for i in (0, 1)]
    return tuple(edges.agg(F.count(F.lit(1)), *h).first())


def _grouped(docs: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows as of signed(); groups: one row (s0, ..., o0, ..., group_id, keeper,
    n_same, n_links) for each signature whose group has more than one row.  Both are spooled."""
    own = spool(signed(docs), "signatures")
    signs = spool(classes(own), "classes")
    parts = similar(signs, max_bits)
    pairs = reduce(DataFrame.unionAll, parts)
    found = components(pairs)
    linked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    placed = signs.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(linked, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    groups = placed.groupBy("root").agg(F.min("first").alias("keeper"), F.sum("n").alias("size")).where("size > 1")
    out = placed.join(groups, "root").select(*_ALL, F.col("keeper.doc_id").alias("group_id"), "keeper", (F.col("n") - 1).alias("n_same"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = spool(out, "groups")
    for df in (signs, *parts, found):
        unspool(df)
    return own, out


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, group_id, n_same, n_links) for each row that has a near copy; group_id is the smallest
    doc_id of its group, groups being the connected parts of the graph of near copies; n_same
    counts the other rows with the same signature, n_links the other signatures that are near.

    Near are signatures that differ in at most max_bits bits over all, LANE_BITS in each lane and
    ORDER_BITS in the lanes of order, so the same words in another order are no copy.  Rows without doc_id
    or text and texts without a word (empty, blank, punctuation only) are in no group.  Whatever
    the length, the whole text counts.  Rows of one doc_id with other texts are judged each for
    itself, and groups of different keepers may bear the same group_id then; repeated rows are copies
    of each other; other columns are ignored; an empty table gives no rows.
    """
    own, groups = _grouped(docs, max_bits)
    return own.join(groups, _ALL).select("doc_id", "group_id", "n_same", "n_links")


def drop_near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All columns of the rows that are in no group of near_duplicates(), and of each group the one
    with the smallest (doc_id, hash of the text); of repeated rows of that kind one stays.  Rows
    without doc_id or text stay."""
    own, groups = _grouped(docs, max_bits)
    gone_id, gone_ht, again = (free(docs, n) for n in ("gone_id", "gone_ht", "again"))
    rows = own.join(groups, _ALL).select(F.col("doc_id").alias(gone_id), F.col("ht").alias(gone_ht), (F.col("keeper.doc_id") == F.col("doc_id")) & (F.col("keeper.ht") == F.col("ht")))
    rows = spool(rows.toDF(gone_id, gone_ht, again), "copies")
    same = lambda gone: (F.col("doc_id").cast("long") == gone[gone_id]) & (F.xxhash64("text") == gone[gone_ht])
    gone = rows.where(~F.col(again)).select(gone_id, gone_ht).distinct()
    kept = docs.join(gone, same(gone), "left_anti")
    twice = spool(rows.where(again).groupBy(gone_id, gone_ht).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(gone_id, gone_ht), "repeated-rows")
    for df in (own, groups):
        unspool(df)
    if twice.isEmpty():
        return kept
    repeated = kept.join(twice, same(twice), "left_semi")
    return kept.join(twice, same(twice), "left_anti").unionAll(repeated.dropDuplicates(["doc_id", "text"]))


def op2(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents"))
