"""Ordered state, step windows, resumed epochs and pending runs: restarts, crashes, late and unordered rows."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assetlake.operators import metrics as X
from assetlake.operators import resume as P
from assetlake.sources import commits as C
from assetlake.streaming import jobs as J
from assetlake.streaming import ordered as O

LOG = "run string, step long, value double"


def put(spark, path, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)


def end(spark, path):
    put(spark, path, [("", 10**6, None)])


def runs(spark, tmp_path, name, job):
    """Drain what is there now, into a table that grows."""
    src, out = str(tmp_path / "in"), str(tmp_path / name)
    J.drain(job(spark.readStream.schema(LOG).parquet(src)), lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / f"ck-{name}"))
    return spark.read.parquet(out)


def test_clip_and_improvements_keep_their_state_and_take_rows_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    src = str(tmp_path / "in")
    rows = [(r, i, rng.choice([rng.uniform(0, 50), float("nan"), float("inf"), 7.0])) for r in "ab" for i in range(400)]
    rng.shuffle(rows)
    clip, best = (lambda s: O.stream_clip(s, 0.5, 6, 40.0, span_seconds=50)), (lambda s: O.stream_improvements(s, "min", span_seconds=50))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        for lo, hi in ((0, 150), (150, 400)):
            put(spark, src, [r for r in rows if lo <= r[1] < hi])
            got = runs(spark, tmp_path, "clip", clip)
            kept = runs(spark, tmp_path, "best", best)
        end(spark, src)
        got, kept = runs(spark, tmp_path, "clip", clip), runs(spark, tmp_path, "best", best)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    df = spark.createDataFrame(rows, LOG).where("value < double('infinity')")
    text = lambda d, c: sorted((r.run, r.step, round(r[c], 9)) for r in d.collect())
    assert text(got, "threshold") == text(X.adaptive_clip(df, ["run"], ["step"], "value", 0.5, 6, 40.0), "threshold")
    assert text(kept, "best") == text(X.running_best(df, ["run"], ["step"], "value", "min").withColumnRenamed("value", "best"), "best")


def test_rows_behind_the_watermark_change_nothing(spark, tmp_path):
    src = str(tmp_path / "in")
    job = lambda s: O.stream_improvements(s, span_seconds=10)
    put(spark, src, [("r", i, float(i)) for i in range(0, 40)])
    assert {r.step for r in runs(spark, tmp_path, "best", job).collect()} == set(range(30))  # the last span is open
    put(spark, src, [("r", 3, 99.0), ("r", 41, 41.0)])
    end(spark, src)
    assert sorted(r.step for r in runs(spark, tmp_path, "best", job).collect()) == [*range(40), 41]


def test_a_task_holds_one_span(monkeypatch):
    """100 batches of one run: no frame and no part in state grows with them."""

    class Map(dict):
        most = 0

        def containsKey(self, k):
            return k in self

        def getValue(self, k):
            return self[k]

        def updateValue(self, k, v):
            self[k] = v
            self.most = max(self.most, len(v[0]) if isinstance(v[0], list) else 0)

        def removeKey(self, k):
            del self[k]

    class Handle:
        def __init__(self):
            self.timers, self.maps = set(), []

        def getMapState(self, *_):
            self.maps.append(Map())
            return self.maps[-1]

        def getListState(self, *_):
            class Ring(list):
                exists, get = (lambda self: bool(self)), (lambda self: list(self))

                def put(self, rows):
                    self[:] = rows

            return Ring()

        def registerTimer(self, ms):
            self.timers.add(ms)

    class Due:
        def __init__(self, ms):
            self.getExpiryTimeInMs = lambda: ms

    handle, job = Handle(), O.Clip(1_000_000, 0.5, 10, 1e9)
    job.init(handle)
    pulled = []

    def frames():
        for k in range(100):
            pulled.append(k)
            step = range(k * 5000, k * 5000 + 5000)
            yield pd.DataFrame({"step": step, "value": [float(x % 13) for x in step], "at": pd.to_datetime(list(step), unit="s")})

    assert list(job.handleInputRows(("r",), frames(), None)) == [] and len(pulled) == 100
    assert handle.maps[0].most <= O.FRAME_ROWS and len(handle.timers) == 500
    sizes = [len(f) for ms in sorted(handle.timers) for f in job.handleExpiredTimer(("r",), None, Due(ms))]
    assert max(sizes) <= O.FRAME_ROWS and sum(sizes) == 500_000 and not handle.maps[0] and not handle.maps[1]


def test_step_windows_close_once(spark, tmp_path):
    src, out = tmp_path / "log", str(tmp_path / "out")
    src.mkdir()
    lines = [f"{s}: {{'time': {{'step': 1.0}}, 'loss': {'nan' if s == 7 else s / 10}, 'bin_3': {{'mse': np.float64({s})}}}}" for s in range(95)]
    drain = lambda: J.drain(O.step_windows(spark.readStream.text(str(src)), 10, 5), lambda b, n: b.withColumn("n_batch", F.lit(n)).write.mode("append").parquet(out), str(tmp_path / "ck"))
    (src / "a.txt").write_text("\n".join(lines[:33] + lines[34:48]) + "\nValidation mIoU: 0.5\n")
    drain()
    first = {(r.window, r.metric) for r in spark.read.parquet(out).collect()}
    assert first == {(w, m) for w in range(4) for m in ("loss", "bin_3")}  # 47 is the last step seen, less than 5 behind 50
    (src / "b.txt").write_text("\n".join(lines[48:]))
    drain()
    got = spark.read.parquet(out).collect()
    assert len(got) == len({(r.window, r.metric) for r in got}) and {r.window for r in got} == set(range(8))
    want = {w: [s for s in range(10 * w, 10 * w + 10) if s not in (7, 33)] for w in range(8)}
    assert all(r.n == len(want[r.window]) and abs(r["mean"] - sum(want[r.window]) / r.n / (10 if r.metric == "loss" else 1)) < 1e-9 for r in got)


def test_an_epoch_goes_on_with_another_world(spark, tmp_path):
    df, path = spark.range(50).withColumnRenamed("id", "k"), str(tmp_path / "e")
    order = [r.k for r in P.epoch_order(df, "k", f"{path}/orders", 3, 0).orderBy("pos").collect()]
    worlds, seen = [4, 4, 3, 7, 7], []
    for w in worlds:
        b = P.next_batch(df, "k", path, "r", 3, w, 4)
        rows = b.orderBy("pos").collect()
        if seen:
            assert {r.slot for r in rows} >= {seen[-1].slot + 1} and min(r.slot for r in rows) == seen[-1].slot + 1
        assert all(len({r.rank for r in rows if r.slot == s}) == w for s in {r.slot for r in rows})
        seen += rows
        if len({r.pos for r in seen}) >= 50:
            break
    assert [r.k for r in seen[:50]] == order and [r.k for r in seen[50:]] == order[: len(seen) - 50]
    assert P.next_batch(df, "k", path, "r", 3, 7, 4) is None
    again = P.next_batch(df, "k", path, "r", 3, 5, 100).orderBy("pos").collect()
    assert {r.epoch for r in again} == {1} and sorted(r.k for r in again) == list(range(50)) and [r.k for r in again] != order
    assert P.next_batch(df, "k", path, "other", 3, 5, 1).count() == 5


@pytest.mark.parametrize("drop_last", [False, True])
def test_the_end_of_an_epoch(spark, tmp_path, drop_last):
    df, path = spark.range(10).withColumnRenamed("id", "k"), str(tmp_path / "e")
    got = []
    while (b := P.next_batch(df, "k", path, "r", 0, 4, 2, drop_last)) is not None:
        got += b.collect()
    assert len(got) == (8 if drop_last else 12) and len({r.pos for r in got}) == len(got)


@pytest.mark.parametrize("when", ["data", "marker"])
def test_a_crash_before_the_commit_repeats_and_loses_nothing(spark, tmp_path, monkeypatch, when):
    df, path = spark.range(40).withColumnRenamed("id", "k"), str(tmp_path / "e")
    args = (df, "k", path, "r", 1)
    seen = P.next_batch(*args, 4, 3).collect()
    mark = C._mark

    def stops(s, p, name, facts):
        if "batches" in p:
            if when == "marker":
                p_, fs = C._fs(s, f"{p}/commits/.{name}.making")
                fs.create(p_, True).close()
            raise OSError("the driver is gone")
        mark(s, p, name, facts)

    monkeypatch.setattr(C, "_mark", stops)
    with pytest.raises(OSError, match="gone"):
        P.next_batch(*args, 4, 3)
    monkeypatch.setattr(C, "_mark", mark)
    assert P.position(spark, path, "r")[:2] == (0, 12) and P.offsets(spark, path).count() == 1
    while (b := P.next_batch(*args, 5, 3)) is not None:
        seen += b.collect()
    assert sorted(r.k for r in seen if r.pos < 40) == list(range(40)) and len({r.pos for r in seen}) == len(seen)


def test_three_runs_over_pending_items(spark, tmp_path):
    items, path, asked = spark.range(6).withColumnRenamed("id", "k"), str(tmp_path / "log"), []

    def build(fails):
        def run(todo):
            asked.append(sorted(r.k for r in todo.collect()))
            status = F.when(F.col("k") == 0, "skip_prefilter").when(F.col("k") == 1, "empty").when(F.col("k").isin(*fails), "build_failed").otherwise("success")
            return todo.select("k", status.alias("status"), F.when(F.col("k") == 0, "too_large").alias("reason"), F.when(F.col("k").isin(*fails), "boom").alias("error"))

        return run

    status = lambda df: {r.k: r.status for r in df.collect()}
    first = status(P.run_pending(items, "k", build([2, 3]), path, 1))
    assert first == {0: "skip_prefilter", 1: "empty", 2: "build_failed", 3: "build_failed", 4: "success", 5: "success"}
    second = P.run_pending(items.unionByName(spark.range(6, 7).withColumnRenamed("id", "k")), "k", build([3]), path, 2)
    assert status(second) == {0: "skip_prefilter", 1: "empty", 2: "success", 3: "build_failed", 4: "cached", 5: "cached", 6: "success"}
    assert {r.k: r.reason for r in second.collect()}[0] == "too_large" and asked[1] == [2, 3, 6]
    third = status(P.run_pending(items, "k", build([9]), path, 3))
    assert third == {0: "skip_prefilter", 1: "empty", 2: "cached", 3: "success", 4: "cached", 5: "cached"} and asked[2] == [3]
    assert status(P.run_pending(items, "k", build([9]), path, 3)) == third and len(asked) == 3
    assert {r.k: (r.run, r.status) for r in P.latest_status(spark, path, "k").collect()}[6] == (2, "success")
