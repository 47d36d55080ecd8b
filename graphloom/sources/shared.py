"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Tables of each open scratch(), the innermost last.
_scratch: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where it is unset, a local session gets a folder of
    its own; a cluster has to name one."""
    if base := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="graphloom-"))


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are spooled within are deleted at the end; those with keep belong to the scratch
    around this one, if there is one.  Only for results that are written within."""
    own: list[DataFrame] = []
    token = _scratch.set((*_scratch.get(), own))
    try:
        yield
    finally:
        _scratch.reset(token)
        for df in own:
            unspool(df)


def spool(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it again: it cuts lineage, and what was
    computed survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spooled_at = path
    if scopes := _scratch.get()[: -1 if keep else None]:
        scopes[-1].append(out)
    return out


#: Bytes of input files (columns packed as Parquet packs them) for each partition of spread().
SPREAD_BYTES = 4_000_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df with rows of equal keys together, in as many partitions as its input files ask for.  Their number
    grows with the input, whatever spark.sql.shuffle.partitions is, and small ones aren't joined to larger ones,
    so what a task holds stays the same."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # What has no size of its own (rows made by code) says it is endless.
    n_bytes = sum(x for x in sizes if x < 1 << 50)
    return df.repartition(min(max(n_bytes // SPREAD_BYTES, df.sparkSession.sparkContext.defaultParallelism), 20_000), *keys)


def unspool(df: DataFrame) -> None:
    """Delete a spooled table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._spooled_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more: Spark deletes them once
    both sides have collected their garbage, which a driver with much memory seldom does."""
    gc.collect()
    spark._jvm.System.gc()
