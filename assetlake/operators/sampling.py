"""Training-set planning: seeded, stratified, balanced and resumable samples."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.operators.manifest import with_global_index


def seeded(seed: int, *cols: str) -> Column:
    """An order that looks random, the same in every engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def stratified_sample(df: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each stratum; Spark keeps n per task before it shuffles."""
    w = Window.partitionBy(by).orderBy(seeded(seed, key), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def bucket_label(value: float) -> str:
    return str(value).replace(".", "p")


def bucket_sample(df: DataFrame, value: str, starts: list[float], upper: float, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each ratio bucket [s_i, s_i+1), the last closed at ``upper``; non-finite values are left out."""
    edges = [*starts, upper]
    if any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("bucket bounds must increase")
    v, label = F.col(value), F.lit(None).cast("string")
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = (v >= a) & ((v <= b) if i == len(starts) - 1 else (v < b))
        label = F.when(inside, f"ratio_{bucket_label(a)}_to_{bucket_label(b)}").otherwise(label)
    kept = df.where(~F.isnan(v)).withColumn("bucket", label).where("bucket is not null")
    return stratified_sample(kept, "bucket", key, n, seed)


def sample_epoch(df: DataFrame, key: str, seed: int, epoch: int, world: int, drop_last: bool = False, start: int = 0) -> DataFrame:
    """(key, rank, slot) of one epoch: shuffled, padded by wrapping round or cut, dealt in turn, resumed at ``start``."""
    ordered = df.select(key, seeded(seed + epoch, key).alias("_o"))
    indexed = with_global_index(ordered, ["_o", key], "pos").drop("_o")
    n = indexed.count()
    if drop_last:
        rows = indexed.where(F.col("pos") < n // world * world)
    else:
        total = -(-n // world) * world
        again = F.sequence(F.col("pos"), F.lit(total - 1), F.lit(max(1, n)).cast("long"))
        rows = indexed.where(F.col("pos") < total).withColumn("pos", F.explode(again))
    out = rows.select(key, F.pmod("pos", F.lit(world)).cast("int").alias("rank"), F.floor(F.col("pos") / world).alias("slot"))
    return out.where(F.col("slot") >= start)


def balance_loads(loads: list[float], k: int, equal: bool) -> list[int]:
    """Group of each item: heaviest first, to the lightest open group, the lower number on ties.

    With ``equal`` a group closes at len(loads) // k items; what is left when all are closed
    goes to group 0. Fewer items than groups close none.
    """
    full = len(loads) // k if equal else 0
    open_, size, out = [(0.0, g) for g in range(k)], [0] * k, [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: -loads[i]):
        if not open_:
            break  # the rest stays in group 0
        total, g = heapq.heappop(open_)
        out[i], size[g] = g, size[g] + 1
        if size[g] != full:
            heapq.heappush(open_, (total + loads[i], g))
    return out


def balance_groups(df: DataFrame, by: list[str], key: str, load: str, k: int, equal: bool = True) -> DataFrame:
    """(by, key, load, group): each group of ``by``, which the caller keeps small, is dealt out by load; null loads weigh nothing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        return pdf.assign(group=balance_loads(pdf[load].fillna(0).tolist(), k, equal))

    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, key, load])
    return df.select(*by, key, load).groupBy(*by).applyInPandas(run, f"{fields}, group int")


def balance_chunks(df: DataFrame, by: str, key: str, load: str, k: int, seed: int = 0, most: int = 4096, equal: bool = True) -> DataFrame:
    """(by, chunk, key, load, group): ``balance_groups`` in chunks of at most ``most`` rows of each ``by``, in a seeded order.

    A ``by`` of any size is many chunks. Groups are balanced in each chunk, so in the whole too.
    """
    placed = with_global_index(df.select(by, key, load, seeded(seed, key).alias("_o")), [by, "_o", key], "_i").drop("_o")
    first = placed.groupBy(by).agg(F.min("_i").alias("_f")).withColumnRenamed(by, "_by")
    placed = placed.join(first, F.col(by).eqNullSafe(F.col("_by")))
    chunked = placed.select(by, F.floor((F.col("_i") - F.col("_f")) / most).alias("chunk"), key, load)
    return balance_groups(chunked, [by, "chunk"], key, load, k, equal)


def snake_groups(df: DataFrame, load: str, key: str, k: int) -> DataFrame:
    """Whole-table variant: rows by falling load, dealt there and back."""
    keyed = with_global_index(df.withColumn("_l", -F.col(load)), ["_l", key], "pos").drop("_l")
    turn, at = F.floor(F.col("pos") / k), F.pmod("pos", F.lit(k))
    return keyed.withColumn("group", F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int")).drop("pos")


def balanced_batches(df: DataFrame, key: str, load: str, seed: int, batch: int, world: int) -> DataFrame:
    """Shuffled chunks of batch * world rows, the remainder dropped, each dealt to ranks by load in equal numbers."""
    size = batch * world
    indexed = with_global_index(df.select(key, load, seeded(seed, key).alias("_o")), ["_o", key], "pos").drop("_o")
    chunked = indexed.where(F.col("pos") < indexed.count() // size * size).withColumn("chunk", F.floor(F.col("pos") / size))
    return balance_groups(chunked, ["chunk"], key, load, world).withColumnRenamed("group", "rank")
