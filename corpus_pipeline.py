"""From raw documents to a training mix: each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import decontaminate, line_dedup, mixing, quality, simhash
from graphloom.llm.common import read, scratch, spool, unspool


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site lines; n_chars follows the text. What was nothing but
    boilerplate goes."""
    out = line_dedup.strip_boilerplate(docs)
    removed = [c for c in out.columns if c not in docs.columns][0]
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.where((F.col(removed) == 0) | (F.btrim("text", F.lit(" \t\r\n")) != "")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, and all that have none."""
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a test item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the blocks that the mix selects."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("line_dedup", without_boilerplate),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Voting in a fitted space can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch():  # what a stage had written on its way goes when its result is written
            docs = spool(stage(spark, docs, sf_dir), name, keep=True)
        if last is not None:
            unspool(last)
        last = docs
    return docs
