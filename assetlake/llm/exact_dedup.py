"""Operator 10: exact duplicates, with a heavy-hitter split.

Rows are (doc_id, SHA-256 of the text). A Misra-Gries summary of each partition,
summed by digest, holds every digest with at least ``rows / counters`` copies.
Those candidates are counted exactly; the verified winners, at most ``counters``
of them, are broadcast and settle their groups where the rows already are. The
rest, whose groups are all smaller than that, meet in an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.common import prepare
from assetlake.session import materialize

COUNTERS = 1024


def misra_gries(digests: Iterator[bytes], counters: int) -> dict[bytes, int]:
    """Counts that are low by at most n / (counters + 1)."""
    held: dict[bytes, int] = {}
    for d in digests:
        if d in held:
            held[d] += 1
        elif len(held) < counters:
            held[d] = 1
        else:
            held = {k: c - 1 for k, c in held.items() if c > 1}
    return held


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries((d for b in batches for d in b.column(0).to_pylist()), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "low"])

    return run


def _digest() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def heavy_digests(rows: DataFrame, total: int, counters: int) -> DataFrame:
    """Verified groups of at least total / counters rows: (digest, keep_id, group_size)."""
    merged = rows.select("digest").mapInArrow(_summaries(4 * counters), "digest binary, low long").groupBy("digest").agg(F.sum("low").alias("low"))
    # each summary is low by at most a 4*counters-th of its rows, so every digest above the bar keeps 3/4 of it
    bar = max(2, -(-total // counters))
    found = merged.where(F.col("low") >= 3 * bar // 4).select("digest")
    checked = rows.join(F.broadcast(found), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return checked.where(F.col("group_size") >= bar)


def _digests(docs: DataFrame, counters: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: ``doc_id, digest`` of every row, and the heavy digests."""
    prepare(docs.sparkSession)
    rows = materialize(docs.select("doc_id", _digest().alias("digest")), "digests")
    return rows, materialize(heavy_digests(rows, rows.count(), counters), "heavy")  # at most `counters` rows


def exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Texts are equal when their bytes are. Null counts as the empty text. Of equal
    texts the row with the largest doc_id stays; rows that repeat both are one
    document and are kept together; a null doc_id never beats another one. Texts of
    any length are read whole; extra columns are ignored; an empty table gives an
    empty result.
    """
    rows, heavy = _digests(docs, counters)
    hot = rows.join(F.broadcast(heavy), "digest")
    light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    both = hot.unionByName(light.join(groups, "digest"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each text, all its columns unchanged.

    The row with the largest doc_id stays, whatever other rows that id has; a null
    doc_id stays only where no other row has the text. Of rows that repeat id and text
    one stays, the first by a hash of their columns. Null counts as the empty text. An
    empty table gives an empty one; column names can't clash, as rows travel as one
    struct. Losers of heavy digests go where they are read, and each partition sends at
    most one row of a digest.
    """
    _, heavy = _digests(docs, counters)
    hashed = [F.col(f"row.`{f.name}`") for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    rows = docs.select(_digest().alias("digest"), F.col("doc_id").alias("id"), F.struct("*").alias("row"))
    winners = heavy.select("digest", "keep_id", F.lit(True).alias("heavy"))
    rows = rows.join(F.broadcast(winners), "digest", "left").where(F.col("heavy").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    first = Window.partitionBy("digest").orderBy(F.desc_nulls_last("id"), F.xxhash64(*hashed))
    return rows.select("digest", "id", "row").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*")
