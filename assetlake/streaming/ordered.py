"""Streams whose rows must be taken in order: rows wait in state until their time is over.

A run's rows come in any order. They are kept in map state, a span of event time and a
part of at most FRAME_ROWS rows each, and a timer at the end of the span releases them in
the order of their steps once the watermark says that no more can come. What is carried
from row to row (a ring of norms, the best value so far) is list or value state. A task
holds one span of one run, however many rows the batch brought.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Rows of one frame that goes out, and of one part in state.
FRAME_ROWS = 2_000
#: State that keeps maps, lists and timers.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class InOrder(StatefulProcessor):
    """Rows (step, value) of a key by falling due; ``fold`` takes them in order, frame by frame."""

    def __init__(self, span_ms: int):
        self.span_ms = span_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span long, part long", "steps array<long>, vals array<double>")
        self.parts = handle.getMapState("parts", "span long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf[pdf["at"].notna() & np.isfinite(pdf["value"].to_numpy(float))]
            span = pdf["at"].astype("datetime64[ms]").astype("int64") // self.span_ms
            for s, some in pdf.groupby(span, sort=False):
                s = int(s)
                known = self.parts.containsKey((s,))
                n = self.parts.getValue((s,))[0] if known else 0
                for lo in range(0, len(some), FRAME_ROWS):
                    part = some.iloc[lo : lo + FRAME_ROWS]
                    self.waiting.updateValue((s, n), (part["step"].tolist(), part["value"].astype(float).tolist()))
                    n += 1
                self.parts.updateValue((s,), (n,))
                if not known:
                    self.handle.registerTimer((s + 1) * self.span_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = expiredTimerInfo.getExpiryTimeInMs() // self.span_ms - 1
        steps, values = [], []
        for n in range(self.parts.getValue((s,))[0]):
            a, b = self.waiting.getValue((s, n))
            steps.append(np.array(a, np.int64))
            values.append(np.array(b, float))
            self.waiting.removeKey((s, n))
        self.parts.removeKey((s,))
        step, value = np.concatenate(steps), np.concatenate(values)
        order = np.lexsort((value, step))
        for lo in range(0, len(order), FRAME_ROWS):
            at = order[lo : lo + FRAME_ROWS]
            out = self.fold(step[at], value[at])
            if len(out):
                out.insert(0, "run", key[0])
                yield out

    def fold(self, step: np.ndarray, value: np.ndarray) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Clip(InOrder):
    """Threshold of each step: a percentile of the last norms before it, once there are enough; list state."""

    def __init__(self, span_ms: int, percentile: float, buffer: int, cap: float):
        super().__init__(span_ms)
        self.percentile, self.buffer, self.cap = percentile, buffer, cap

    def init(self, handle) -> None:
        super().init(handle)
        self.ring = handle.getListState("ring", "norm double")

    def fold(self, step: np.ndarray, value: np.ndarray) -> pd.DataFrame:
        before = [r[0] for r in self.ring.get()] if self.ring.exists() else []
        seen = np.concatenate([np.array(before, float), value])
        threshold = np.full(len(step), self.cap)
        if len(seen) > self.buffer:  # of each step but the first few, the window that ends before it
            full = np.lib.stride_tricks.sliding_window_view(seen[:-1], self.buffer)
            threshold[len(step) - len(full) :] = np.minimum(np.percentile(full, 100 * self.percentile, axis=1), self.cap)
        self.ring.put([(float(x),) for x in seen[-self.buffer :]])
        return pd.DataFrame({"step": step, "threshold": threshold})


class Improve(InOrder):
    """Steps that strictly improve on all before them; value state."""

    def __init__(self, span_ms: int, mode: str):
        super().__init__(span_ms)
        self.sign = 1.0 if mode == "max" else -1.0

    def init(self, handle) -> None:
        super().init(handle)
        self.best = handle.getValueState("best", "best double")

    def fold(self, step: np.ndarray, value: np.ndarray) -> pd.DataFrame:
        best = self.best.get()[0] * self.sign if self.best.exists() else -np.inf
        so_far = np.maximum.accumulate(np.concatenate([[best], self.sign * value]))
        better = so_far[1:] > so_far[:-1]
        self.best.update((float(so_far[-1] * self.sign),))
        return pd.DataFrame({"step": step[better], "best": value[better]})


def _released(log: DataFrame, processor: InOrder, schema: str, delay: str) -> DataFrame:
    if "at" not in log.columns:
        log = log.withColumn("at", F.timestamp_millis(F.col("step") * 1000 + 1))  # at the watermark itself a row is late already
    rows = log.select("run", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value"), "at")
    return rows.withWatermark("at", delay).groupBy("run").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def stream_clip(log: DataFrame, percentile: float, buffer: int, cap: float, delay: str = "1 milliseconds", span_seconds: int = 1000) -> DataFrame:
    """``run, step, threshold`` of each finite norm of ``run, step, value`` and event time ``at``.

    Without ``at`` a step is a second, which suits runs that share one clock. Steps must
    grow with event time from one span of ``span_seconds`` to the next; within a span, and
    less than ``delay`` behind the latest row of the batches before, rows come in any order. A span is put out once, when the watermark
    has passed it, so the last ones wait for later rows (of any run). Needs STATE_STORE,
    which ``drain`` sets.
    """
    return _released(log, Clip(1000 * span_seconds, percentile, buffer, cap), "run string, step long, threshold double", delay)


def stream_improvements(log: DataFrame, mode: str = "max", delay: str = "1 milliseconds", span_seconds: int = 1000) -> DataFrame:
    """``run, step, best``: the finite values that beat all before them, each put out once; rows as in ``stream_clip``."""
    return _released(log, Improve(1000 * span_seconds, mode), "run string, step long, best double", delay)


def step_windows(lines: DataFrame, every: int, delay_steps: int = 0, skip_nan: bool = True) -> DataFrame:
    """``window, metric, mean, n`` of run-log lines over windows of ``every`` steps.

    A step is a second of event time; on a stream, in append mode, a window is put out once
    no step of it can come any more, ``delay_steps`` after its end, and its state goes. With
    ``skip_nan`` lines that hold a NaN count for nothing.
    """
    from assetlake.sources.files import parse_run_log

    if skip_nan:
        lines = lines.where(~F.col("value").rlike(r"(?i)\bnan\b"))
    rows = parse_run_log(lines).where("step is not null").withColumn("at", F.timestamp_seconds("step")).withWatermark("at", f"{delay_steps} seconds")
    got = rows.groupBy(F.window("at", f"{every} seconds"), "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return got.select((F.unix_seconds("window.start") / every).cast("long").alias("window"), "metric", "mean", "n")
