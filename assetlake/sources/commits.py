"""Batches with a commit log: a batch is there once its marker is, and the marker says what it covers.

Data go to ``data/<name>``; then ``commits/<name>.json`` appears by one rename, with the
facts of the batch. Whatever stopped before that rename never was, and is written over
when the batch is made again. One writer at a time is assumed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from assetlake.sources.files import _fs


def is_committed(spark: SparkSession, path: str, name: str) -> bool:
    p, fs = _fs(spark, f"{path}/commits/{name}.json")
    return fs.exists(p)


def commit(df: DataFrame, path: str, name: str, facts: dict | None = None) -> bool:
    """Write and commit a batch; False, and nothing is done, if it is committed already."""
    spark = df.sparkSession
    if is_committed(spark, path, name):
        return False
    df.write.mode("overwrite").parquet(f"{path}/data/{name}")
    _mark(spark, path, name, facts or {})
    return True


def _mark(spark: SparkSession, path: str, name: str, facts: dict) -> None:
    (beside, fs), (marker, _) = _fs(spark, f"{path}/commits/.{name}.making"), _fs(spark, f"{path}/commits/{name}.json")
    out = fs.create(beside, True)
    out.write(bytearray((json.dumps({"name": name, **facts}) + "\n").encode()))
    out.close()
    if not fs.rename(beside, marker):
        raise OSError(f"could not commit {name} in {path}")


def commits(spark: SparkSession, path: str, facts: str = "") -> DataFrame:
    """``name`` and the named facts of each committed batch, one row a batch."""
    schema = "name string" + (f", {facts}" if facts else "")
    p, fs = _fs(spark, f"{path}/commits")
    return spark.read.schema(schema).json(p.toString()) if fs.exists(p) else spark.createDataFrame([], schema)


def batch(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data/{name}")


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed batches, or None if there is none."""
    names = [r.name for r in commits(spark, path).collect()]  # one row a batch
    return spark.read.option("mergeSchema", True).parquet(*[f"{path}/data/{n}" for n in names]) if names else None
