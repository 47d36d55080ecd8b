"""Mixing sources to target weights by Sainte-Laguë apportionment.

Documents are put into shards by a seeded hash.  Within a shard and source, in seeded order, their
tokens are cut into blocks of equal size; a document belongs to the block in which it begins, and that
block is drawn together with those after it in which none begins.  Each shard has a budget of blocks,
whose seats go to sources by the highest quotients weight / (2 * seats + 1), never more than a source
has: integer quotas per shard.  Of each source's blocks a seeded selection fills the quota, as near as
whole documents allow.  A shard holds a fixed number of documents on average, so all of this stays
local however large the corpus is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import free, need, read, spool

#: Tokens of a block; documents of a shard on average; share of the blocks that the mix keeps;
#: weights of sources (all others have 1).
BLOCK_TOKENS, SHARD_DOCS, BUDGET, SEED = 4096, 8192, 0.5, 17
WEIGHTS = {"src1": 2.0, "src2": 0.5}


#: Characters of scripts that put no blanks between words (Thai, Lao, Myanmar, Khmer, kana, Han): each is a
#: token.  Java and SQL read the ranges alike.
UNPARTED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{323AF}"
TOKEN = rf"[{UNPARTED}]|[^\s{UNPARTED}]+"


def n_tokens(text: str) -> Column:
    """Runs of non-blank characters, and characters of scripts without blanks."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.coalesce(F.when(ascii_only, F.regexp_count(text, F.lit(r"\S+"))).otherwise(F.regexp_count(text, F.lit(TOKEN))), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float = BUDGET, block_tokens: int = BLOCK_TOKENS, shard_docs: int = SHARD_DOCS, seed: int = SEED, counted: str | None = None) -> DataFrame:
    """The rows of the selected blocks, with shard, block and tokens added (names free of clashes
    with the table's own).

    Tokens are those of n_tokens(), or of the column ``counted`` of the table, where a tokenizer has
    counted them (null is 0).  A null source is the source ''.  A null or empty text has no tokens and
    goes with the block in which it falls.  Order and shard come from a hash of doc_id and text, so
    rows without doc_id or of one doc_id spread over all shards; rows equal in doc_id, text and source
    go together, into the block of the first.  A weight of 0 excludes a source.  An empty table gives no
    rows.
    """
    weights = WEIGHTS if weights is None else weights
    need(docs, "doc_id", "text", "source")
    shard, block, tokens = (free(docs, n) for n in ("shard", "block", "tokens"))
    own, order = (free(docs, n) for n in ("own_source", "own_order"))
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    size = F.coalesce(F.col(counted).cast("long"), F.lit(0)) if counted else n_tokens("text")
    # Texts are counted once, for a lean table; they are moved once, to meet what was chosen.
    lean = docs.select(F.coalesce("source", F.lit("")).alias("src"), F.md5(mark).alias("o"), size.alias("tokens"))
    lean = spool(lean.groupBy("src", "o").agg(F.max("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies")), "mixing")
    n = lean.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    placed = lean.withColumn("shard", F.conv(F.substring("o", 1, 8), 16, 10).cast("long") % F.lit(n // shard_docs + 1))
    before = Window.partitionBy("shard", "src").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("tokens") * F.col("copies")
    placed = placed.withColumn("block", F.floor(F.coalesce(F.sum(t).over(before), F.lit(0)) / block_tokens).cast("long"))
    chosen = choose(placed.groupBy("shard", "src", "block").agg(F.sum(t).alias("t")), weights, budget, block_tokens, seed)
    kept = placed.join(chosen, ["shard", "src", "block"]).select("src", "o", F.col("shard").alias(shard), F.col("block").alias(block), F.col("tokens").alias(tokens)).withColumnsRenamed({"src": own, "o": order})
    return docs.withColumns({own: F.coalesce("source", F.lit("")), order: F.md5(mark)}).join(kept, [own, order]).select(*docs.columns, shard, block, tokens)


def choose(begun: DataFrame, weights: dict[str, float], budget: float, block_tokens: int, seed: int) -> DataFrame:
    """From (shard, src, block in which documents begin, their tokens t): (shard, src, block) of
    those selected."""
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("src") == name, F.lit(float(w))).otherwise(weight)
    shard, source = Window.partitionBy("shard"), Window.partitionBy("shard", "src")
    last = F.greatest(F.ceil(F.sum("t").over(source) / block_tokens).cast("long"), F.col("block") + 1)
    units = begun.withColumn("span", F.coalesce(F.lead("block").over(source.orderBy("block")), last) - F.col("block"))
    sizes = units.groupBy("shard", "src").agg(F.sum("span").alias("n")).withColumn("weight", weight).where("weight > 0")
    seats = sizes.select("shard", "src", "weight", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seat"))
    seats = seats.withColumn("rank", F.row_number().over(shard.orderBy((F.col("weight") / (2 * F.col("seat") + 1)).desc(), "src", "seat")))
    seats = seats.withColumn("won", F.col("rank") <= F.floor(F.count(F.lit(1)).over(shard) * F.lit(float(budget)) + 0.5))
    quotas = seats.groupBy("shard", "src").agg(F.count_if("won").alias("quota"))
    lot = F.md5(F.concat_ws(":", F.lit(str(seed)), "shard", "src", "block"))
    drawn = units.withColumn("to", F.sum("span").over(source.orderBy(lot, "block")))
    return drawn.join(quotas, ["shard", "src"]).where("2 * to - span <= 2 * quota").select("shard", "src", "block")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of all documents, without their texts."""
    return mix(need(read(spark, sf_dir, "documents"), "doc_id", "text", "source")).drop("text")


_WEIGHT = "CASE src " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items()) + " ELSE 1::DOUBLE END"
SQL = f"""
WITH own AS (
  SELECT doc_id, source, text, coalesce(source, '') AS src, coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0) AS tokens,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS o FROM documents),
keyed AS (SELECT src, o, max(tokens) AS tokens, count(*) AS copies FROM own GROUP BY ALL),
sharded AS (SELECT *, CAST('0x' || substr(o, 1, 8) AS BIGINT) % ((SELECT count(*) FROM own) // {SHARD_DOCS} + 1) AS shard FROM keyed),
placed AS (
  SELECT *, tokens * copies AS own_t, CAST(floor(coalesce(sum(tokens * copies) OVER (PARTITION BY shard, src ORDER BY o
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {BLOCK_TOKENS}) AS BIGINT) AS block FROM sharded),
begun AS (SELECT shard, src, block, sum(own_t) AS t FROM placed GROUP BY ALL),
ends AS (
  SELECT *, lead(block) OVER (PARTITION BY shard, src ORDER BY block) AS next, ceil(sum(t) OVER (PARTITION BY shard, src) / {BLOCK_TOKENS}) AS n FROM begun),
units AS (SELECT shard, src, block, CAST(coalesce(next, greatest(n, block + 1)) AS BIGINT) - block AS span FROM ends),
sizes AS (SELECT shard, src, CAST(sum(span) AS BIGINT) AS n FROM units GROUP BY ALL),
seats AS (SELECT shard, src, {_WEIGHT} AS weight, seat FROM (SELECT *, unnest(range(0, n)) AS seat FROM sizes)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY shard ORDER BY weight / (2 * seat + 1) DESC, src, seat)
    <= floor(count(*) OVER (PARTITION BY shard) * {BUDGET} + 0.5) AS won FROM seats WHERE weight > 0),
quotas AS (SELECT shard, src, count(*) FILTER (WHERE won) AS quota FROM ranked GROUP BY ALL),
drawn AS (
  SELECT u.*, sum(span) OVER (PARTITION BY shard, src ORDER BY md5('{SEED}:' || shard || ':' || src || ':' || block), block) AS upto FROM units u)
SELECT w.doc_id, w.source, p.shard, p.block, p.tokens FROM own w JOIN placed p ON p.src = w.src AND p.o = w.o JOIN drawn d ON p.shard = d.shard AND p.src = d.src AND p.block = d.block
  JOIN quotas q ON q.shard = d.shard AND q.src = d.src WHERE 2 * d.upto - d.span <= 2 * q.quota
"""
