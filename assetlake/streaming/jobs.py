"""Incremental forms: record merges, event windows and best values; what needs an order is in ``ordered``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.operators.manifest import merge_records
from assetlake.sources.files import finish_swap, replace_table
from assetlake.streaming.ordered import STATE_STORE


def drain(df: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything that is there and stop; ``sink(batch, id)`` gets each batch."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():  # a query keeps the settings it starts with
        conf.set(k, v)
    try:
        q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    q.awaitTermination()


def stream_records(spark: SparkSession, path: str, schema: str, manifest: str, key: str, columns: list[str], checkpoint: str, archive: str | None = None) -> None:
    """Merge record shards that arrive in ``path`` into the manifest table, each file once.

    The manifest is swapped whole, once a batch, so ``maxFilesPerTrigger`` sets how much
    one rewrite takes in. A batch that is run again after a failure, at whatever step,
    finds its swap done, finishes it, or merges anew.
    """
    reader = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", 1000)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    shards = reader.csv(path).select("*", F.col("_metadata.file_name").alias("_file"))

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        if finish_swap(s, manifest, f"{number:06d}"):
            return
        replace_table(merge_records(s.read.parquet(manifest), batch, key, columns, ["_file"]), manifest, f"{number:06d}")

    drain(shards, merge, checkpoint)


def tumbling(events: DataFrame, ts: str, by: str, value: str, width: str, delay: str = "10 minutes") -> DataFrame:
    """Count and sum per event-time window and key; rows later than ``delay`` are dropped when streaming."""
    w = F.window(ts, width)
    return events.withWatermark(ts, delay).groupBy(w, by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, ts: str, by: str, value: str, width: str, slide: str, delay: str = "10 minutes") -> DataFrame:
    w = F.window(ts, width, slide)
    return events.withWatermark(ts, delay).groupBy(w, by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), by, "n", "mean")


def sessions(events: DataFrame, ts: str, by: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def stream_best(log: DataFrame, mode: str = "max") -> DataFrame:
    """Best (step, value) of each run so far, the smaller step of equal values, kept across restarts; log rows are (run, step, value)."""
    up = mode == "max"
    good = log.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    best = (F.max if up else F.min)(F.struct(F.col("value").cast("double").alias("value"), (-F.col("step") if up else F.col("step")).cast("long").alias("s")))
    step = -F.col("b.s") if up else F.col("b.s")
    return good.groupBy("run").agg(best.alias("b")).select("run", step.alias("step"), F.col("b.value").alias("best"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text log appended by a run, as a stream of (step, metric, value)."""
    from assetlake.sources.files import parse_run_log

    return parse_run_log(spark.readStream.text(path))
