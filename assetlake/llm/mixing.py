"""Operator 9: mix sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Rows of one source, key and size are alike and
are counted; the counts are sorted in key ranges of bounded size. Sums per range, and
over the ranges before, give each range its offset, and a running sum inside the range
the exact number of words before each key. So every source gets its cut: the key at
which its budget is spent, and the words left there. One row a source, the cut then
tells every document what the mix takes of it, where the document is read: rows are
never exchanged, and neither a hot source nor a repeated key meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.common import WORD
from assetlake.session import materialize, shared_dir

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Keys that one range of one source should hold at most, about; rows of one key that one task numbers.
RANGE_ROWS = 20_000
#: Sources up to which their cuts, about 100 bytes each, are broadcast; more are joined by salted exchange.
BROADCAST_SOURCES, SALTS = 100_000, 256


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets per source from ``(source, source_size)``, one row a source.

    Sources by code point, null last, take the weights in turn. A target is
    ``rate * weight`` but at most ``most * source_size``: with sources by the rate
    at which they reach their limit, the rate is what is left of the total divided
    by the weights left, at the first source that stays below its limit. That is
    where sharing the excess again and again by weight ends.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1).withColumn("weight", w)
    cap = (F.lit(most) * F.col("source_size")).cast("long")
    by_rate = Window.orderBy((cap / F.col("weight")), F.col("rank"))
    before = by_rate.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = ranked.withColumn("cap", cap).withColumn("total", F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rate = (F.lit(share) * F.col("total").cast("double") - F.col("capped").cast("double")) / (F.col("weights") - F.col("used")).cast("double")
    t = t.withColumn("rate", rate).withColumn("rate", F.max(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.col("rate"))).over(every))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("rate") * F.col("weight"), F.col("cap").cast("double")))
    return t.select("source", "source_size", target.alias("target"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _key(seed: str) -> Column:
    """Hash of the id; rows without one have the hash of their text."""
    by_id = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f"|{seed}")).cast("binary"))
    return F.coalesce(by_id, F.md5(F.concat(F.lit(f"{seed}|"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")))


def _hinted(by_source: DataFrame, sources: int) -> DataFrame:
    return F.broadcast(by_source) if sources <= BROADCAST_SOURCES else by_source


def source_cuts(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """One row a source of ``rows`` (source, key, size): where its last epoch ends.

    ``source, source_size, target, epochs`` and, for the rows of key ``cut_key`` and
    size ``cut_size``, how many of the ``cut_rows`` come ``whole`` and how many words
    (``part``) of one more. Rows before that key come whole, later ones not at all;
    without a cut every row comes in whole epochs only.
    """
    total, sources = rows.agg(F.count("*"), F.count_distinct(F.coalesce("source", F.lit("null")), F.col("source").isNull())).first()
    digits = 1
    while 16**digits * RANGE_ROWS < total * 4:
        digits += 1
    coarse = digits // 2
    rows = rows.select("source", "key", "size", F.substring("key", 1, digits).alias("range"))
    ranges = materialize(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    # offsets in two levels: of the coarse ranges, and of the fine ones inside a coarse range
    high = F.substring("range", 1, coarse) if coarse else F.lit("")
    ranges = ranges.withColumn("high", high)
    before = lambda *by: Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    tops = ranges.groupBy("source", F.col("high").alias("at")).agg(F.sum("words").alias("words")).withColumn("top", F.coalesce(F.sum("words").over(before("source")), F.lit(0)))
    fine = ranges.withColumn("at", F.col("range")).withColumn("inner", F.coalesce(F.sum("words").over(before("source", "high")), F.lit(0)))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    budgets = targets.withColumn("epochs", epochs).withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    # the range in which the rest of the budget ends, then the key: of a source, one range is sorted
    t, f, b = tops.alias("t"), fine.alias("f"), budgets.alias("b")
    placed = f.join(t, F.col("f.source").eqNullSafe(F.col("t.source")) & (F.col("f.high") == F.col("t.at"))).select(F.col("f.source").alias("source"), "range", "f.words", (F.col("top") + F.col("inner")).alias("offset")).alias("p")
    ends = placed.join(b, F.col("p.source").eqNullSafe(F.col("b.source"))).where("offset < rest and rest <= offset + words").select(F.col("p.source").alias("source"), "range", "offset", "rest")
    here = F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.range") == F.col("e.range"))
    near = rows.alias("r").join(_hinted(ends, sources).alias("e"), here, "left_semi")
    groups = near.groupBy("source", "range", "key", "size").agg(F.count("*").alias("n"))
    last = groups.alias("r").join(ends.alias("e"), here).select("r.source", "r.range", "key", "size", "n", "offset", "rest")
    within = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("upto", F.col("offset") + F.sum(F.col("size") * F.col("n")).over(within)).withColumn("start", F.col("upto") - F.col("size") * F.col("n"))
    cut = last.where("start < rest and rest <= upto").select("source", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.col("n").alias("cut_rows"), F.expr("(rest - start) div greatest(size, 1)").alias("whole"), F.expr("(rest - start) % greatest(size, 1)").alias("part")).alias("c")
    return materialize(b.join(cut, F.col("b.source").eqNullSafe(F.col("c.source")), "left").select("b.source", "source_size", "target", "epochs", "cut_key", "cut_size", "cut_rows", "whole", "part"), "cuts")


def _with_taken(rows: DataFrame, cuts: DataFrame, sources: int) -> DataFrame:
    """``rows`` (source, key, size, nth, ...) with ``source_size, target, taken`` by their source's cut.

    ``nth`` counts the rows of a cut with several rows, from 0.
    """
    r = rows.withColumnRenamed("source", "own")
    if sources <= BROADCAST_SOURCES:
        both = r.join(F.broadcast(cuts), F.col("own").eqNullSafe(F.col("source")))
    else:
        r = r.withColumn("salt", F.pmod(F.xxhash64("key", "nth"), F.lit(SALTS)))
        c = cuts.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = r.join(c, F.col("own").eqNullSafe(F.col("source")) & (F.col("salt") == F.col("copy"))).drop("salt", "copy")
    here = F.struct("key", "size")
    cut = F.struct(F.col("cut_key").alias("key"), F.col("cut_size").alias("size"))
    at_cut = F.when(F.col("nth") < F.col("whole"), F.col("size")).when(F.col("nth") == F.col("whole"), F.col("part")).otherwise(F.lit(0))
    last = F.when(F.col("cut_key").isNull(), F.lit(0)).when(here < cut, F.col("size")).when(here == cut, at_cut).otherwise(F.lit(0))
    return both.withColumn("taken", (F.col("epochs") * F.col("size") + last).cast("long")).drop("own", "epochs", "cut_key", "cut_size", "cut_rows", "whole", "part")


def _numbered(rows: DataFrame, cuts: DataFrame, sources: int) -> DataFrame:
    """``row, nth`` of the rows at cuts that several rows share, numbered from 0.

    Rows are dealt into parts of about RANGE_ROWS by their number; part sums give the
    offsets, so a key of any number of rows is numbered by many tasks.
    """
    c = cuts.where("cut_rows > 1").select(F.col("source").alias("cut_source"), "cut_key", "cut_size", F.ceil(F.col("cut_rows") / RANGE_ROWS).cast("long").alias("parts"))
    same = F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("key") == F.col("cut_key")) & (F.col("size") == F.col("cut_size"))
    some = rows.join(_hinted(c, sources), same).select("row", "cut_source", F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"))
    some = materialize(some, "cut-rows")
    sums = some.groupBy("cut_source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cut_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).alias("o")
    s = some.withColumn("k", F.row_number().over(Window.partitionBy("cut_source", "part").orderBy("row")) - 1).alias("s")
    return s.join(sums, F.col("s.cut_source").eqNullSafe(F.col("o.cut_source")) & (F.col("s.part") == F.col("o.part"))).select("row", (F.col("offset") + F.col("k")).alias("nth"))


def _mixed(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    cuts = source_cuts(rows, weights, share, most)
    sources, shared_cuts = cuts.agg(F.count("*"), F.count_if(F.col("cut_rows") > 1)).first()
    if shared_cuts:
        rows = rows.join(_numbered(rows, cuts, sources), "row", "left").withColumn("nth", F.coalesce("nth", F.lit(0)))
    else:
        rows = rows.withColumn("nth", F.lit(0))
    return _with_taken(rows, cuts, sources)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs``.

    A source's budget is its target, rounded down. Whole epochs take every document
    once; the last epoch takes documents in key order until the budget is spent, the
    document at the cut with the words that are left. Null text has size 0 and takes 0;
    null is a source of its own. Keys come from doc_id, of rows without one from the
    text; rows with the same key go by size, and of rows alike in all this, which are
    separate rows, as many are taken as the budget allows. Texts of any length are
    counted whole; extra columns are ignored; an empty table gives an empty result.
    """
    shared_dir(docs.sparkSession)
    rows = materialize(docs.select("doc_id", "source", _size().alias("size"), _key(seed).alias("key"), F.monotonically_increasing_id().alias("row")), "mix")
    out = _mixed(rows, weights, share, most)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def _tie(docs: DataFrame) -> Column:
    """What tells rows of one key apart: digest of the text, then a hash of all columns and of which are null."""
    hashed = [f"`{f.name}`" for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    cells = [x for c in hashed for x in (F.col(c).isNull(), F.col(c))]
    return F.concat(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.hex(F.xxhash64(*cells)))


def repeat_mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` as the mix reads them: each row as often as an epoch takes words of it.

    The document at a budget's cut comes whole, so texts stay as they are. Rows are
    judged one by one, so null or repeated ids lose nothing; a row of no words never
    comes. Rows of one doc_id go by their texts and then by their other columns, so what
    comes does not depend on files or partitions; only rows alike in every column, or
    that differ in maps alone, are taken in whatever order. Columns come back as they
    were, whatever their names; an empty table gives an empty one.
    """
    shared_dir(docs.sparkSession)
    key = F.concat(_key(seed), _tie(docs))
    rows = materialize(docs.select(F.struct("*").alias("whole_row"), "source", _size().alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    out = _mixed(rows, weights, share, most).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select("whole_row.*")
