"""Cross-site boilerplate: lines that occur on many distinct sites.

A line is known by two 64-bit hashes of its trimmed text.  Per line a HyperLogLog sketch of its
sites is built on the map side and merged by the aggregation; where the estimate is within BAND of
the threshold the distinct sites are counted exactly.  Of a line that reaches the threshold the
first occurrence (smallest doc_id, then hash of the text, then position) stays, all others are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free, need, read, spool, unspool

#: Distinct sites that make a line boilerplate; width of the band that is counted exactly, as a
#: share of the threshold; log2 of the sketch's registers (error about 1.04 / sqrt(2^LG)).
MIN_SITES, BAND, LG = 8, 0.5, 8


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, ht (hash of the text), site, pos, h1, h2: one row per line that isn't blank."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("ht"), F.coalesce("source", F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(" \t\r"))
    return lines.where(line != "").select("doc_id", "ht", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first) for every line on at least min_sites distinct sites, as a spooled table."""
    lines = _lines(docs)
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG)).alias("sketch"), F.min(F.struct("doc_id", "ht", "pos")).alias("first"))
    sketched = spool(sketched.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - BAND)), "sites")
    sure = sketched.where(F.col("sites") > min_sites * (1 + BAND)).select("h1", "h2", "first")
    near = sketched.where(F.col("sites") <= min_sites * (1 + BAND))
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    out = spool(sure.unionAll(near.select("h1", "h2", "first").join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi")), "boilerplate")
    unspool(sketched)
    return out


def strip_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with all but the first occurrence of each boilerplate line removed.

    Rows, columns and untouched texts stay as they are; ``removed`` (the name is free of clashes)
    counts the lines taken out.  Lines are compared without blanks around them, and blank lines
    never count.  Documents without source are one site.  A null text stays null with removed 0;
    rows without doc_id keep their text and aren't counted; rows equal in doc_id and text count as
    one document, rows of one doc_id with other texts as one each; other columns are carried along.
    """
    counted = need(docs, "doc_id", "text", "source").where("doc_id IS NOT NULL AND text IS NOT NULL")
    bad = boilerplate(counted, min_sites)
    hits = _lines(counted).join(bad, ["h1", "h2"]).where("NOT (doc_id <=> first.doc_id AND ht <=> first.ht AND pos <=> first.pos)")
    hits = hits.groupBy("doc_id", "ht").agg(F.collect_set("pos").alias("gone"))
    ht, gone, removed, hit_id, hit_ht = (free(docs, n) for n in ("ht", "gone", "removed", "hit_id", "hit_ht"))
    hits = hits.select(F.col("doc_id").alias(hit_id), F.col("ht").alias(hit_ht), F.col("gone").alias(gone))
    joined = docs.withColumn(ht, F.xxhash64("text")).join(hits, (F.col("doc_id") == F.col(hit_id)) & (F.col(ht) == F.col(hit_ht)), "left").drop(hit_id, hit_ht, ht)
    # Within one array of all lines, so that they are cut once; the rest of the positions comes by hashing.
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    text = F.get(F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(kept(lines), "\n")), F.lit(0))
    return joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(text)).withColumn(removed, F.coalesce(F.size(F.when(F.col(gone).isNotNull(), F.col(gone)).otherwise(F.array())), F.lit(0))).drop(gone)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strip_boilerplate() of all documents."""
    return strip_boilerplate(need(read(spark, sf_dir, "documents"), "doc_id", "text", "source")).select("doc_id", "text", F.col("removed").cast("int").alias("removed"))


SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce(source, '') AS site, text, string_split(text, chr(10)) AS ls FROM documents
  WHERE doc_id IS NOT NULL AND text IS NOT NULL),
lines AS (
  SELECT doc_id, site, ls[i] AS raw, trim(ls[i], ' ' || chr(9) || chr(13)) AS line, i AS pos
  FROM (SELECT doc_id, site, ls, unnest(range(1, len(ls) + 1)) AS i FROM cut)),
bad AS (
  SELECT line, min((doc_id, pos)) AS first FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (
  SELECT l.doc_id, l.pos, l.raw, b.line IS NOT NULL AND (l.doc_id, l.pos) <> b.first AS gone
  FROM lines l LEFT JOIN bad b ON l.line = b.line)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS removed
FROM marked GROUP BY doc_id
"""
