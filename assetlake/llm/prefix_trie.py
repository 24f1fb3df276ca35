"""Operator 13: the prefix trie of rebuilt conversations, by collapsing whole sequences.

A conversation ``c`` is rebuilt from the first ``h`` turns of the conversation its
group of ``fork`` ids begins with, followed by its own turns after the first ``h``.

1. Turns are numbered in one range sort, so a conversation of any length is spread over
   tasks. A turn is its SHA-256 digest and its bytes from then on.
2. The key of a prefix is its depth and 128 bits: the exclusive or of a hash of (place,
   turn) over its turns. Running keys are taken in blocks of places, with what the
   earlier blocks bring added, so no window holds a long conversation.
3. Identical rebuilt conversations collapse into one sequence with its weight and
   smallest id. Sequences that are no proper prefix of another, by an anti-join, are
   the leaves. Only one conversation of each sequence is opened into its prefixes.
4. Weighted prefixes are summed. For sums over subtrees a node belongs to the sequence
   of its smallest member: the nodes a sequence owns are the lower end of its path, so
   sums from the bottom of each path, added up per node, are the sums of the subtrees.
5. Lists of the ids that end in a node are sorted by ranges, joined in pieces, and
   hashed piece after piece; no list is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.common import join_groups, prepare
from assetlake.operators.manifest import with_global_index
from assetlake.session import materialize

#: Ids of a group that share their beginning; turns shared are crc32 of the id modulo SHARE.
FORK, SHARE = 5, 9
#: Places of one window.
BLOCK = 1 << 16
KEY = ["depth", "a", "b"]


def turn_digest() -> Column:
    """SHA-256 of role and text, the role with its length before it; nulls are empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def _running(rows: DataFrame, by: str, place: str, columns: list[str], block: int, longest: int, fold, downward: bool = True) -> DataFrame:
    """``rows`` with each of ``columns`` folded over the places up to its own, or from its own on.

    ``fold`` is an aggregate such as ``F.bit_xor`` or ``F.sum``, and combines two values
    when given two columns. Windows take ``block`` places at most; longer sequences get
    the totals of the other blocks added.
    """
    agg, plus = fold
    cell = F.col(place).cast("long") if block == 1 else F.expr(f"{place} div {block}")
    rows = rows.withColumn("_cell", cell)
    order = F.col(place) if downward else F.desc(place)
    w = Window.partitionBy(by, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({f"_{c}": agg(c).over(w) for c in columns})
    if longest >= block:
        totals = rows.groupBy(by, "_cell").agg(*(agg(c).alias(c) for c in columns))
        order = F.col("_cell") if downward else F.desc("_cell")
        before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(by, "_cell", *(agg(c).over(before).alias(f"+{c}") for c in columns))
        out = out.join(carry.where(F.col(f"+{columns[0]}").isNotNull()), [by, "_cell"], "left")
        out = out.withColumns({f"_{c}": F.coalesce(plus(F.col(f"_{c}"), F.col(f"`+{c}`")), F.col(f"_{c}")) for c in columns}).drop(*(f"+{c}" for c in columns))
    return out.drop("_cell")


_XOR = (F.bit_xor, lambda x, y: x.bitwiseXOR(y))
_SUM = (F.sum, lambda x, y: x + y)


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows: one row per run of a key in a batch, its ids joined by commas."""
    for t in batches:
        if not t.num_rows:
            continue
        key = [t.column(i).to_numpy() for i in range(3)]
        new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in key])]
        at = np.flatnonzero(new)
        ids = t.column(3).to_pylist()
        cols = [pa.array(k[at]) for k in key] + [pa.array([ids[i] for i in at], pa.int64())]
        text = [",".join(map(str, ids[i:j])) for i, j in zip(at, [*at[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(text, pa.string())], ["depth", "a", "b", "first", "ids"])


def _piece_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces: SHA-256 of each key's pieces joined by commas, one piece in hand at a time."""
    now, digest, out = None, hashlib.sha256(), []

    def done(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["depth", "a", "b", "ends_sha256"])

    for t in batches:
        for *key, ids in zip(*(t.column(c).to_pylist() for c in ("depth", "a", "b", "ids")), strict=True):
            if key == now:
                digest.update(b",")
            else:
                if now:
                    out.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        if len(out) >= 1000:
            yield done(out)
            out = []
    if now:
        out.append((*now, digest.hexdigest()))
    if out:
        yield done(out)


def end_lists(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256``: digest of the ids of ``ends`` (key and conv_id), ascending, joined by commas."""
    ends = ends.select(*KEY, "conv_id")
    pieces = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_id_pieces, "depth long, a long, b long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_piece_hashes, "depth long, a long, b long, ends_sha256 string")


def rebuilt_turns(conversations: DataFrame, fork: int = FORK, share: int = SHARE) -> tuple[DataFrame, DataFrame, int]:
    """Rebuilt conversations: ``conv_id, length`` of each, and their turns ``conv_id, depth, turn, bytes``.

    The third value is the largest number of turns. Turns of one conversation with equal
    turn numbers follow each other by their digest. Both tables are written.
    """
    prepare(conversations.sparkSession)
    slim = conversations.where("conv_id is not null").select("conv_id", F.col("turn").alias("nth"), turn_digest().alias("turn"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    indexed = with_global_index(slim, ["conv_id", "nth", "turn"])
    sizes = materialize(indexed.groupBy("conv_id").agg(F.min("idx").alias("first"), F.count("*").alias("size")), "conv-sizes")
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % share
    convs = sizes.withColumns({"h": own, "base": F.col("conv_id") - F.col("conv_id") % fork})
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "first", "size", "h", "base", "taken", "length"), "convs")
    seen = convs.agg(F.sum("size"), F.max("length")).first()
    turns = join_groups(indexed, convs.select("conv_id", "first", "size", "h", "taken"), "conv_id", "size", seen[0] or 0)
    turns = materialize(turns.select("conv_id", (F.col("idx") - F.col("first") + 1).alias("place"), "h", "taken", "turn", "bytes"), "turns")
    rest = turns.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "turn", "bytes")
    heads = turns.where(f"place < {share} and conv_id % {fork} = 0").select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "turn", "bytes")
    begun = convs.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("depth <= taken").select("conv_id", "depth", "turn", "bytes")
    return convs.select("conv_id", "length"), begun.unionByName(rest), seen[1] or 0


def prefix_trie(conversations: DataFrame, fork: int = FORK, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    Null roles and texts are empty; null turn numbers come first; turns with the same
    number are ordered by the digest of role and text, so repeated rows are turns one
    after another. Rows of a null conv_id belong to no conversation and are left out.
    Texts of any length are read whole, once. Extra columns are ignored. Without a
    conversation there is no root and the result is empty.
    """
    convs, turns, longest = rebuilt_turns(conversations, fork, share)
    turns = turns.withColumns({c: F.xxhash64(F.lit(k), "depth", "turn") for k, c in enumerate(("x", "y"), 1)})
    prefixes = _running(turns, "conv_id", "depth", ["x", "y"], block, longest, _XOR)
    prefixes = prefixes.select("conv_id", "depth", F.col("_x").alias("a"), F.col("_y").alias("b"), F.expr("_x ^ x").alias("pa"), F.expr("_y ^ y").alias("pb"), "bytes")
    prefixes = materialize(prefixes, "prefixes")

    whole = convs.where("length > 0").withColumnRenamed("length", "depth").join(prefixes.select("conv_id", *KEY), ["conv_id", "depth"])
    zero = F.lit(0).cast("long")
    ends = materialize(whole.unionByName(convs.where("length = 0").select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"))), "ends")
    grouped = ends.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"))
    proper = prefixes.select((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
    leaves = grouped.join(proper, KEY, "left_anti").withColumn("leaf", F.lit(1))
    sequences = materialize(leaves.unionByName(grouped.join(proper, KEY, "left_semi").withColumn("leaf", F.lit(0))), "sequences")

    some = sequences.select("conv_id", F.col("depth").alias("size"), "weight", "leaf")
    total = sequences.agg(F.sum("depth")).first()[0] or 0
    paths = join_groups(prefixes, some, "conv_id", "size", total).drop("size")
    tops = sequences.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("bytes"), "weight", "leaf")
    paths = materialize(paths.unionByName(tops), "paths")

    sums = [F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("leaf").alias("n_leaves"), *(F.max(c).alias(c) for c in ("bytes", "pa", "pb"))]
    nodes = materialize(paths.groupBy(*KEY).agg(*sums), "nodes")
    owned = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    below = paths.select("conv_id", *KEY).join(owned, ["conv_id", "depth"], "left").withColumn("saved", F.coalesce("saved", zero))
    below = _running(below, "conv_id", "depth", ["saved"], block, longest, _SUM, downward=False)
    saved = below.groupBy(*KEY).agg(F.sum("_saved").alias("saved_tokens"))

    up = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(saved, KEY).join(up, KEY, "left").join(end_lists(ends), KEY, "left")
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", zero), "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))})
    nodes = materialize(nodes, "trie")
    parents = nodes.where("n_children > 0").select(F.struct(*KEY).alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    rows = nodes.withColumn("parent", F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))))
    out = join_groups(rows, parents, "parent", "size", nodes.count(), how="left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
