"""Work that goes on where it stopped: positions in a shuffled epoch, and items still to be built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.operators.manifest import with_global_index
from assetlake.operators.sampling import seeded
from assetlake.sources.commits import batch, commit, commits, committed, is_committed

_OFFSETS = "run string, epoch long, start long, stop long, slots long"


def epoch_order(df: DataFrame, key: str, path: str, seed: int, epoch: int) -> DataFrame:
    """``key, pos`` of a shuffled epoch, written once and sorted by place, so a batch reads only its part of it."""
    name = f"order-{seed}-{epoch:06d}"
    if not is_committed(df.sparkSession, path, name):
        ordered = df.select(key, seeded(seed + epoch, key).alias("_o"))
        commit(with_global_index(ordered, ["_o", key], "pos").drop("_o"), path, name)
    return batch(df.sparkSession, path, name)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """The commit log as a table: ``name, run, epoch, start, stop, slots`` of each batch handed out."""
    return commits(spark, f"{path}/batches", _OFFSETS)


def position(spark: SparkSession, path: str, run: str) -> tuple[int, int, int, int]:
    """Where a run stands: its epoch, the places of it that are handed out, slots and batches so far."""
    mine = offsets(spark, path).where(F.col("run") == run)
    got = mine.groupBy("epoch").agg(F.max("stop").alias("stop"), F.sum("slots").alias("slots"), F.count("*").alias("n")).orderBy(F.desc("epoch")).first()
    return (got.epoch, got.stop, got.slots, got.n) if got else (0, 0, 0, 0)


def next_batch(df: DataFrame, key: str, path: str, run: str, seed: int, world: int, slots: int, drop_last: bool = False) -> DataFrame | None:
    """``key, epoch, pos, rank, slot`` of the next ``slots`` slots of each of ``world`` ranks; None when its epoch is over.

    The batch and the place up to which it goes are committed together, before it is
    handed out: a run that stops earlier makes the same batch again, one that stops later
    goes on behind it. The place counts items, not slots, so ``world`` may differ from one
    batch to the next. Slots count on through an epoch. At its end the order starts again
    to fill the last slot, or with ``drop_last`` the slot that isn't full is left out.
    After None the next call begins the next epoch. ``df`` must hold the same keys during
    an epoch.
    """
    spark = df.sparkSession
    epoch, start, past, number = position(spark, path, run)
    order = epoch_order(df, key, f"{path}/orders", seed, epoch)
    n = order.count()
    if start >= n or (drop_last and n - start < world):
        over = spark.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, epoch long, pos long, rank int, slot long")
        commit(over, f"{path}/batches", f"{run}-{epoch + 1:06d}-{0:06d}", {"run": run, "epoch": epoch + 1, "start": 0, "stop": 0, "slots": 0})
        return None
    stop = min(n, start + slots * world)
    if drop_last:
        stop = start + (stop - start) // world * world
    end = start + -(-(stop - start) // world) * world
    rows = order.where((F.col("pos") >= start) & (F.col("pos") < stop))
    if end > n:
        again = order.where(F.col("pos") < end - n)
        rows = rows.unionByName(again.withColumn("pos", F.explode(F.sequence(F.col("pos") + n, F.lit(end - 1), F.lit(n).cast("long")))))
    away = F.col("pos") - start
    rows = rows.select(key, F.lit(epoch).cast("long").alias("epoch"), "pos", F.pmod(away, F.lit(world)).cast("int").alias("rank"), (past + F.floor(away / world)).alias("slot"))
    name = f"{run}-{epoch:06d}-{number:06d}"
    commit(rows, f"{path}/batches", name, {"run": run, "epoch": epoch, "start": start, "stop": stop, "slots": (end - start) // world})
    return batch(spark, f"{path}/batches", name)


def latest_status(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The last record of each key over all committed runs."""
    log = committed(spark, path)
    if log is None:
        return None
    last = F.max_by(F.struct(*[c for c in log.columns if c != key]), "run")
    return log.groupBy(key).agg(last.alias("r")).select(key, "r.*")


def run_pending(items: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], path: str, run: int, retry: tuple[str, ...] = ("build_failed",)) -> DataFrame:
    """One run over ``items``: the records ``key, run, status, ...`` of every item, committed as a whole.

    ``build`` gets the items that no earlier run has settled, new ones and those whose last
    status is in ``retry``, and gives ``key, status`` and more columns for each. What was
    built before is ``cached``; what was skipped or empty keeps its status without being
    built again. A run that is committed is not done twice; one that stopped before leaves
    no record.
    """
    spark, name = items.sparkSession, f"run-{run:06d}"
    if not is_committed(spark, path, name):
        log = latest_status(spark, path, key)
        if log is None:
            todo, kept = items, None
        else:
            settled = log.where(~F.col("status").isin(*retry))
            todo = items.join(settled.select(key), key, "left_anti")
            kept = settled.join(items.select(key).distinct(), key, "left_semi").withColumn("status", F.when(F.col("status") == "success", "cached").otherwise(F.col("status")))
        records = build(todo).withColumn("run", F.lit(run).cast("long"))
        if kept is not None:
            records = records.unionByName(kept.withColumn("run", F.lit(run).cast("long")), allowMissingColumns=True)
        commit(records, path, name)
    return batch(spark, path, name)
