"""Operator 6: shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id, row number): equal texts lie side by
side, and as no two rows share a key, one text or one row with very many copies can
still be cut anywhere. For each of the wanted positions in the byte order, an interval
of keys that holds it is narrowed: every round counts, in each partition, the exact
bytes below all candidate keys, sums the counts, and keeps the sub-interval in which
the position lies. Only these counts, a few per splitter, reach the driver. A splitter
is settled when its interval holds one row or the bytes below it are within the
tolerance. Then rows are exchanged once and numbered in sub-ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.common import prepare
from assetlake.session import materialize

SHARDS = 40
OVERHEAD = 16
#: Candidate keys per open splitter and round.
PROBES = 16
#: A splitter is settled at this part of a shard's share.
TOLERANCE = 1e-4
#: Rows of one sub-range: the unit that one task numbers.
RANGE_ROWS = 200_000

#: Key: hash of the text (40 bits), doc_id, number of the row.
Key = tuple[int, int, int]
_KEY = np.dtype([("h", "<i8"), ("d", "<i8"), ("r", "<i8")])


def candidates(lo: Key, hi: Key, low: Key, high: Key, probes: int) -> list[Key]:
    """Up to ``probes`` keys strictly between ``lo`` and ``hi``, on the first part in which they differ.

    ``low`` and ``high`` are the least and greatest values of each part. Where two parts
    are neighbours and nothing behind tells the keys apart, the next part decides.
    """
    for i in range(3):
        if hi[i] - lo[i] > 1:
            step = max(1, (hi[i] - lo[i]) // (probes + 1))
            return [(*lo[:i], x, *low[i + 1 :]) for x in range(lo[i] + step, hi[i], step)][:probes]
        if hi[i] > lo[i]:
            edge = (*lo[:i], hi[i], *low[i + 1 :])
            if edge < hi:
                return [edge]
            hi = (*lo[: i + 1], *(x + 1 for x in high[i + 1 :]))
    return []


def _keys(points: list[Key]) -> np.ndarray:
    return np.array(points, _KEY)


def _places(edges: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
    key = np.empty(b.num_rows, _KEY)
    for name in _KEY.names:
        key[name] = b.column(name).to_numpy()
    return np.searchsorted(edges, key, side="right")


def _count_below(rows: DataFrame, points: list[Key]) -> list[tuple[int, int]]:
    """(bytes, rows) with a key below each point: one pass, one row per point and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _keys(points)
        size, count = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            at = _places(edges, b)
            np.add.at(size, at, b.column("size").to_numpy())
            count += np.bincount(at, minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(size[some]), pa.array(count[some])], ["at", "bytes", "n"])

    got = rows.select("h", "d", "r", "size").mapInArrow(run, "at int, bytes long, n long").groupBy("at").agg(F.sum("bytes"), F.sum("n")).collect()
    size, count = np.zeros(len(points) + 1, np.int64), np.zeros(len(points) + 1, np.int64)
    for at, s, n in got:
        size[at], count[at] = s, n
    return list(zip(np.cumsum(size)[:-1].tolist(), np.cumsum(count)[:-1].tolist(), strict=True))


def splitters(rows: DataFrame, positions: list[float], low: Key, high: Key, total: tuple[int, int], tolerance: float) -> list[Key]:
    """For each byte position, in order: a key below which so many bytes lie, about."""
    # each interval: keys lo and hi, with the bytes and rows below them
    spans = [[low, (high[0] + 1, low[1], low[2]), (0, 0), total] for _ in positions]
    while True:
        wide = {}
        for i, (lo, hi, (size, n), (size_hi, n_hi)) in enumerate(spans):
            if n_hi - n > 1 and min(positions[i] - size, size_hi - positions[i]) > tolerance:
                points = candidates(lo, hi, low, high, PROBES)
                if not points:
                    raise RuntimeError(f"no key between {lo} and {hi}, though {n_hi - n} rows lie there")
                wide[i] = points
        if not wide:
            break
        points = sorted({p for v in wide.values() for p in v})
        below = dict(zip(points, _count_below(rows, points), strict=True))
        for i, mine in wide.items():
            for p in mine:
                if below[p][0] <= positions[i]:
                    spans[i][0], spans[i][2] = p, below[p]
                else:
                    spans[i][1], spans[i][3] = p, below[p]
                    break
    out = []
    for (lo, hi, a, b), pos in zip(spans, positions, strict=True):
        out.append(lo if pos - a[0] <= b[0] - pos else hi)
    return sorted(out)


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    Law ``bytes``: size is the UTF-8 length of the text (null: 0) plus 16. In the
    order of (hash of the text, doc_id, row number) all bytes are cut into equal parts
    at the nearest row, so a shard misses its share by at most half a document, or
    ``TOLERANCE`` of the share, at each end. Slots have no gaps. Equal texts stay side by
    side; repeated rows, which are alike in the result, are cut like any others. A null
    doc_id sorts as -1. More shards than rows leave shards empty. Texts of any length are
    read whole; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce("text", F.lit("")).cast("binary")
    h = F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("long")
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    rows = docs.select("doc_id", d.alias("d"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), h.alias("h"), F.monotonically_increasing_id().alias("r"))
    rows = materialize(rows, "shard-keys")
    got = rows.agg(F.sum("size"), F.count("*"), *[f(c) for f in (F.min, F.max) for c in ("h", "d", "r")]).first()
    size, count = got[0] or 0, got[1]
    edges = splitters(rows, [size * i / shards for i in range(1, shards)], tuple(got[2:5]), tuple(got[5:8]), (size, count), TOLERANCE * size / shards) if count else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _keys(edges)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_places(at, b).astype(np.int32))], [*b.schema.names, "shard"])

    parts = max(1, -(-count // (shards * RANGE_ROWS)))
    placed = rows.mapInArrow(place, "doc_id long, d long, size long, text_crc32 long, h long, r long, shard int")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("h", "d", "r"), F.lit(parts)).cast("int"))
    if parts > 1:
        placed = materialize(placed, "shard-parts")
        sums = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
        before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("h", "d", "r"))
    placed = placed.withColumn("slot", slot)
    placed = placed.join(starts, ["shard", "part"]) if parts > 1 else placed.withColumn("start", F.lit(0))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
