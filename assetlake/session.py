"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

_mine: ContextVar[list[str] | None] = ContextVar("tables of this run", default=None)
REPO = str(Path(__file__).resolve().parents[1])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A session that names none must run on this machine alone; then a temporary folder
    is taken. On a cluster that would not be shared, so it is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not jsc.getCheckpointDir().isDefined():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="assetlake-"))
    return named or jsc.getCheckpointDir().get()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a checkout."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result has no lineage, survives lost executors, and later readers prune
    its columns. The files stay until the folder's owner clears it, or ``release`` does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/assetlake/{name}-{uuid.uuid4().hex}"
    if (mine := _mine.get()) is not None:
        mine.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tables_of_run() -> Iterator[list[str]]:
    """Paths of the tables that this thread writes inside, for ``release``."""
    token = _mine.set(mine := [])
    try:
        yield mine
    finally:
        _mine.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete the tables of a run but the last; nothing may still need them."""
    for path in paths[:-1]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del paths[:-1]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small or iterative table."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that one task is to hold, of tables that are grouped or sorted.
TASK_ROWS = 250_000


def task_parts(spark: SparkSession, rows: int) -> int:
    """Number of parts of ``rows`` rows, at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def spread(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """``df`` by ``keys`` in a number of parts that follows ``rows``, so a task holds the same share at any size.

    Later groupings by these and more keys need no other shuffle. Parts made by a number
    that is asked for are not put together again, as those that Spark chooses are.
    """
    return df.repartition(task_parts(df.sparkSession, rows), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
