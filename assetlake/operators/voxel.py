"""Sparse voxel tables: ``b, x, y, z`` (batch or asset, coordinates) and ``feats``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.functions import geometry as G
from assetlake.operators.graph import connected_components, local_labels
from assetlake.session import cut

XYZ = ("x", "y", "z")
#: Resolution up to which the voxels of an asset go to one task: a grid of 8 MB.
TASK_RES = 128
#: Edge of the blocks whose voxels meet in one task.
BLOCK = 32
KEY = ("b", *XYZ)


def in_bounds(df: DataFrame, res: int) -> DataFrame:
    return df.where(" and ".join(f"{a} >= 0 and {a} < {res}" for a in XYZ))


def cells(points: DataFrame, res: int) -> DataFrame:
    """Adds cell coordinates vx, vy, vz to points x, y, z."""
    return points.withColumns({f"v{a}": G.cell(a, res) for a in XYZ})


def voxelize(points: DataFrame, res: int) -> DataFrame:
    """Occupied voxels per asset with their number of points."""
    v = [F.col(f"v{a}").alias(a) for a in XYZ]
    return cells(points, res).groupBy("asset", *v).agg(F.count("*").alias("n"))


def group_points(points: DataFrame, res: int, order: list[str]) -> DataFrame:
    """Per voxel and class: number of points, and the points in the order given."""
    kept = F.sort_array(F.collect_list(F.struct(*order, *XYZ)))
    return cells(points, res).groupBy("asset", "vx", "vy", "vz", "cls").agg(F.count("*").alias("n"), kept.alias("points"))


def majority_class(points: DataFrame, res: int, order: list[str], boundary: DataFrame | None = None, default: str | None = None) -> DataFrame:
    """Class with most points in each voxel, the earlier of ``order`` on ties; boundary voxels get order[0]."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("cls"))
    counts = cells(points, res).groupBy("asset", "vx", "vy", "vz", "cls").agg(F.count("*").alias("n"))
    best = counts.groupBy("asset", "vx", "vy", "vz").agg(F.max_by("cls", F.struct("n", (-rank).alias("r"))).alias("cls"), F.sum("n").alias("n"))
    if boundary is not None:
        marks = boundary.select("asset", "vx", "vy", "vz").distinct().withColumn("_b", F.lit(True))
        best = best.join(marks, ["asset", "vx", "vy", "vz"], "left").withColumn("cls", F.when(F.col("_b"), order[0]).otherwise(F.col("cls"))).drop("_b")
    return best.withColumn("cls", F.coalesce("cls", F.lit(default))) if default else best


def _offsets(radius: int = 1, half: bool = False) -> Column:
    r = range(-radius, radius + 1)
    found = [(i, j, k) for i in r for j in r for k in r if (i, j, k) > (0, 0, 0) or not half and (i, j, k) != (0, 0, 0)]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in found])


def neighbours(vox: DataFrame, half: bool = False) -> DataFrame:
    """Pairs of occupied 26-neighbours; ``half`` gives each pair once."""
    moved = vox.select(*KEY, F.explode(_offsets(half=half)).alias("o"))
    moved = moved.select("b", *[F.col(a).alias(f"{a}0") for a in XYZ], *[(F.col(a) + F.col(f"o.{o}")).alias(a) for a, o in zip(XYZ, "ijk", strict=True)])
    return moved.join(vox.select(*KEY), list(KEY))


def _blocks(a: str, block: int, reach: tuple[int, ...] = (0,)) -> Column:
    """Numbers of the blocks along an axis that a voxel moved by each of ``reach`` is in."""
    return F.array_distinct(F.array(*[F.floor((F.col(a) + i) / block).cast("int") for i in reach]))


def neighbour_counts(vox: DataFrame, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """Occupied 26-neighbours of each voxel (``neighbours``); voxels come once each.

    A voxel goes to its block and to those it touches, and is counted there: one shuffle of
    little more than the voxels, and at most (block + 2)^3 of them in a group.
    """
    near = vox.select(*KEY)
    for a in XYZ:
        near = near.withColumn(f"_b{a}", F.explode(_blocks(a, block, (-1, 0, 1))))
    keys = ["b", *[f"_b{a}" for a in XYZ]]
    near = near.repartition(*([parts] if parts else []), *keys)
    around = F.array(*[F.struct(*[F.lit(v - 1).alias(o) for v, o in zip(c, "ijk", strict=True)]) for c in np.ndindex(3, 3, 3)])
    moved = near.withColumn("_o", F.explode(around)).withColumn("_self", F.expr("_o.i = 0 and _o.j = 0 and _o.k = 0"))
    moved = moved.select(*keys, "_self", *[(F.col(a) + F.col(f"_o.{o}")).alias(a) for a, o in zip(XYZ, "ijk", strict=True)])
    home = G.total((F.floor(F.col(a) / block).cast("int") == F.col(f"_b{a}")).cast("int") for a in XYZ) == 3
    found = moved.where(home).groupBy(*keys, *XYZ).agg(F.count_if(~F.col("_self")).alias("neighbours"), F.bool_or("_self").alias("_self"))
    return found.where("_self").select(*KEY, "neighbours")


def voxel_components(vox: DataFrame, res: int, block: int = BLOCK) -> DataFrame:
    """26-connected component of each voxel, all assets at once: the least flat index in it.

    The voxels of a block of an asset are joined by one task; where the grid has more blocks
    than one, the components of blocks that touch are a graph job. So its edges are those
    between blocks only, once for each two components. Repeated voxels count once.
    """
    cube = res**3
    node = F.col("b").cast("long") * cube + F.col("x").cast("long") * (res * res) + F.col("y") * res + F.col("z")
    kept = vox.select(*KEY, *[F.floor(F.col(a) / block).cast("int").alias(f"_b{a}") for a in XYZ], node.alias("node")).distinct()
    kinds = dict(kept.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*KEY, "node")) + ", part long"

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")  # the least row number is then the least node
        coords = np.stack([t.column(a).to_numpy().astype(np.int64) for a in XYZ], axis=1)
        nodes = t.column("node").to_numpy()
        labels = grid_labels(coords - coords.min(axis=0), int(np.ptp(coords, axis=0).max()) + 1)
        return t.select([*KEY, "node"]).append_column("part", pa.array(nodes[labels], pa.int64()))

    local = kept.groupBy("b", *[f"_b{a}" for a in XYZ]).applyInArrow(run, schema)
    if res > block:
        local = cut(local)
        edge = F.lit(False)
        for a in XYZ:
            edge = edge | F.pmod(F.col(a), F.lit(block)).isin(0, block - 1)
        rim = local.where(edge).select(*KEY, "part")  # only these have neighbours in another block
        moved = rim.select("b", "part", *XYZ, F.explode(_offsets(half=True)).alias("o"))
        moved = moved.select("b", F.col("part").alias("u"), *[(F.col(a) + F.col(f"o.{o}")).alias(a) for a, o in zip(XYZ, "ijk", strict=True)])
        links = moved.join(rim.withColumnRenamed("part", "v"), list(KEY)).where("u <> v").select("u", "v").distinct()
        found = connected_components(links, "u", "v").withColumnRenamed("node", "part")
        local = local.join(found, "part", "left").withColumn("part", F.coalesce("component", "part"))
    return local.select(*KEY, (F.col("part") - F.col("b") * cube).alias("component"))


def grid_labels(coords: np.ndarray, res: int) -> np.ndarray:
    """26-connected component of each row of ``coords`` (n x 3): the least row number in it."""
    n = len(coords)
    at = np.full((res + 2,) * 3, -1, np.int32)
    x, y, z = (coords.astype(np.int64) + 1).T
    at[x, y, z] = np.arange(n)
    ends = []
    for i, j, k in np.ndindex(3, 3, 3):
        if (i, j, k) > (1, 1, 1):
            v = at[x + i - 1, y + j - 1, z + k - 1]
            u = np.flatnonzero(v >= 0)
            ends.append((u, v[u]))
    u, v = (np.concatenate(e) for e in zip(*ends, strict=True))
    return local_labels(n, u, v)


def component_sizes(vox: DataFrame, res: int, task_res: int = TASK_RES) -> DataFrame:
    """Per asset: components, size of the largest, voxels; repeated voxels count once.

    Up to resolution ``task_res`` an asset is at most task_res^3 voxels and is handled by
    one task; finer grids are a graph job over all voxels, whatever an asset's size.
    """
    kept = vox.select(F.col("b").cast("long").alias("b"), *XYZ).distinct()
    if res > task_res:
        sizes = voxel_components(kept, res).groupBy("b", "component").agg(F.count("*").alias("n"))
        return sizes.groupBy("b").agg(F.count("*").alias("component_count"), F.max("n").alias("largest_component_size"), F.sum("n").alias("total_voxels"))

    def run(t: pa.Table) -> pa.Table:
        coords = np.stack([t.column(a).to_numpy() for a in XYZ], axis=1)
        sizes = np.bincount(grid_labels(coords, res))
        row = [t.column("b")[0].as_py(), int(np.count_nonzero(sizes)), int(sizes.max()), len(coords)]
        return pa.Table.from_arrays([pa.array([v], pa.int64()) for v in row], names=["b", "component_count", "largest_component_size", "total_voxels"])

    return kept.groupBy("b").applyInArrow(run, "b long, component_count long, largest_component_size long, total_voxels long")


def component_metrics(vox: DataFrame, assets: DataFrame, res: int) -> DataFrame:
    """Per asset: components, size and share of the largest, share of the rest, voxels; zeros when empty."""
    out = assets.select("b").join(component_sizes(vox, res), "b", "left")
    n = F.coalesce("total_voxels", F.lit(0))
    ratio = F.when(n > 0, F.col("largest_component_size") / n).otherwise(0.0)
    return out.select("b", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("component_count", "largest_component_size", "total_voxels")], ratio.alias("largest_component_ratio"), F.when(n > 0, 1 - ratio).otherwise(0.0).alias("small_component_ratio"))


def _mean_feats(channels: int) -> Column:
    return F.array(*[F.avg(F.col("feats")[i]) for i in range(channels)])


def downsample(vox: DataFrame, factor: tuple[int, int, int], channels: int) -> DataFrame:
    """Mean of the features over blocks."""
    keys = [F.floor(F.col(a) / f).cast("int").alias(a) for a, f in zip(XYZ, factor, strict=True)]
    return vox.groupBy("b", *keys).agg(_mean_feats(channels).alias("feats"))


def upsample(children: DataFrame, parents: DataFrame, factor: int) -> DataFrame:
    """Each child takes its parent's features; children without one are dropped."""
    own = children.select(*KEY, *[F.floor(F.col(a) / factor).cast("int").alias(f"p{a}") for a in XYZ])
    up = parents.select("b", *[F.col(a).alias(f"p{a}") for a in XYZ], "feats")
    return own.join(up, ["b", "px", "py", "pz"]).select(*KEY, "feats")


def _corners() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (0, 1) for j in (0, 1) for k in (0, 1)])


def subdivide(vox: DataFrame) -> DataFrame:
    """Eight children at doubled coordinates, features copied."""
    out = vox.withColumn("o", F.explode(_corners()))
    return out.select("b", *[(F.col(a) * 2 + F.col(f"o.{o}")).alias(a) for a, o in zip(XYZ, "ijk", strict=True)], "feats")


def cubes_to_verts(vox: DataFrame, channels: int) -> DataFrame:
    """Corner vertices: mean of the voxels around each, and mean squared deviation from it."""
    out = vox.withColumn("o", F.explode(_corners()))
    at = [(F.col(a) + F.col(f"o.{o}")).alias(a) for a, o in zip(XYZ, "ijk", strict=True)]
    corners = out.select("b", *at, "feats")
    spread = F.array(*[F.var_pop(F.col("feats")[i]) for i in range(channels)])
    return corners.groupBy(*KEY).agg(_mean_feats(channels).alias("feats"), spread.alias("variance"), F.count("*").alias("k"))


def batch_broadcast(vox: DataFrame, per_batch: DataFrame, value: str, op) -> DataFrame:
    """Per-batch value on each row by any binary column function."""
    v = F.col(value)
    return vox.join(per_batch.select("b", value), "b").withColumn("feats", F.transform("feats", lambda x: op(x, v))).drop(value)


#: Elementwise operations by name.
OPERATIONS = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b}


def elementwise(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    other = b.select(*KEY, F.col("feats").alias("_other"))
    return a.join(other, list(KEY)).withColumn("feats", F.zip_with("feats", "_other", OPERATIONS[op])).drop("_other")


def scalar(a: DataFrame, value: float, op: str) -> DataFrame:
    return a.withColumn("feats", F.transform("feats", lambda x: OPERATIONS[op](x, F.lit(value))))


def negate(a: DataFrame) -> DataFrame:
    return a.withColumn("feats", F.transform("feats", lambda x: -x))


def compare_voxels(pred: DataFrame, gt: DataFrame, key: list[str]) -> DataFrame:
    """TP, FP or FN per occupied voxel."""
    p, g = pred.select(*key).distinct().withColumn("_p", F.lit(True)), gt.select(*key).distinct().withColumn("_g", F.lit(True))
    kind = F.when(F.col("_p") & F.col("_g"), "TP").when(F.col("_p"), "FP").otherwise("FN")
    return p.join(g, key, "full_outer").select(*key, kind.alias("outcome"))


def full_grid(spark, low: tuple[int, int, int], high: tuple[int, int, int], batches: int, channels: int, value: float) -> DataFrame:
    """A constant dense grid per batch; both ends of each range count."""
    out = spark.range(batches).select(F.col("id").cast("int").alias("b"))
    for a, lo, hi in zip(XYZ, low, high, strict=True):
        out = out.withColumn(a, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return out.withColumn("feats", F.array_repeat(F.lit(float(value)), channels))


def coalesce_duplicates(vox: DataFrame, channels: int) -> DataFrame:
    """Rows of one coordinate are summed."""
    return vox.groupBy(*KEY).agg(F.array(*[F.sum(F.col("feats")[i]) for i in range(channels)]).alias("feats"))


def full_grid_of(batches: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int], channels: int, value: float) -> DataFrame:
    """All voxels lo to hi, both included, of each batch ``b`` of a table, with constant features."""
    out = batches.select(F.col("b").cast("int").alias("b"))
    for a, low, high in zip(XYZ, lo, hi, strict=True):
        out = out.withColumn(a, F.explode(F.sequence(F.lit(low), F.lit(high))))
    return out.withColumn("feats", F.array(*[F.lit(float(value))] * channels))


def to_dense(vox: DataFrame, res: int, value: Column) -> DataFrame:
    """One flat array of res^3 values per batch, 0 where empty."""

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for b, i, x in zip(rows["b"], rows["i"], rows["v"], strict=True):  # one grid in hand at a time
                dense = np.zeros(res**3)
                dense[i] = x
                yield pd.DataFrame({"b": [b], "dense": [dense]})

    at = (F.col("x") * (res * res) + F.col("y") * res + F.col("z")).cast("int")
    held = vox.groupBy("b").agg(F.sort_array(F.collect_list(F.struct(at.alias("i"), value.cast("double").alias("v")))).alias("m"))
    return held.select("b", "m.i", "m.v").mapInPandas(scatter, f"b {dict(vox.dtypes)['b']}, dense array<double>")


def from_dense(dense: DataFrame, res: int) -> DataFrame:
    rows = dense.select("b", F.posexplode("dense").alias("i", "v")).where("v <> 0")
    x, y, z = G.flat_to_coords("i", res)
    return rows.select("b", x.alias("x"), y.alias("y"), z.alias("z"), F.array("v").alias("feats"))


def regrid(vox: DataFrame, res: int, to: int, value: Column) -> DataFrame:
    """Trilinear resize with cell centres aligned: eight weighted taps per target cell."""
    src = vox.select(*KEY, value.cast("double").alias("v"))
    targets = vox.select("b").distinct()
    for a in XYZ:
        targets = targets.withColumn(f"t{a}", F.explode(F.sequence(F.lit(0), F.lit(to - 1))))
    for a in XYZ:
        s = F.greatest((F.col(f"t{a}") + 0.5) * (res / to) - 0.5, F.lit(0.0))
        lo = F.floor(s).cast("int")
        hi = F.least(lo + 1, F.lit(res - 1))
        w = s - lo
        targets = targets.withColumn("_t", F.explode(F.array(F.struct(lo.alias("at"), (1 - w).alias("w")), F.struct(hi.alias("at"), w.alias("w")))))
        targets = targets.withColumn(a, F.col("_t.at")).withColumn(f"w{a}", F.col("_t.w")).drop("_t")
    got = targets.where("wx * wy * wz > 0").join(src, list(KEY), "left")
    return got.groupBy("b", "tx", "ty", "tz").agg(F.sum(F.col("wx") * F.col("wy") * F.col("wz") * F.coalesce("v", F.lit(0.0))).alias("v"))


def serialize_windows(vox: DataFrame, size: int, code: Column, shift: int = 0) -> DataFrame:
    """Rows in curve order per batch, in windows of ``size`` rows.

    A batch of n rows has ceil(n / size) windows. Each owns an even share of the
    order (``valid``) and is filled up around its middle by the rows beside it, which
    wrap around; a batch that fits into one window is that window, unfilled. A share is
    more than half a window, so a row can only be in its own window and those beside it:
    each row names them itself and meets no other.
    """
    by = Window.partitionBy("b")
    w = vox.withColumn("position", F.row_number().over(by.orderBy(code, *XYZ)) - 1).withColumn("n", F.count("*").over(by).cast("int"))
    w = w.withColumn("windows", F.ceil(F.col("n") / size).cast("int"))
    share = F.col("n") / F.col("windows")
    own = F.floor((F.col("position") - shift) / share).cast("int")
    w = w.withColumn("window", F.explode(F.array_distinct(F.array(*[F.pmod(own + i, F.col("windows")) for i in range(-2, 3)]))))
    edge = lambda i: F.floor(i * share + shift).cast("int")
    single = F.col("windows") == 1
    begin = F.when(single, 0).otherwise(F.floor((F.col("window") + 0.5) * share + shift - 0.5 * size).cast("int"))
    length = F.when(single, F.col("n")).otherwise(size)
    w = w.withColumn("_begin", begin).withColumn("slot", F.pmod(F.col("position") - F.col("_begin"), F.col("n"))).where(F.col("slot") < length)
    at = F.col("_begin") + F.col("slot")
    valid = single | (at >= edge(F.col("window"))) & (at < edge(F.col("window") + 1))
    return w.select("b", "position", "window", "slot", valid.alias("valid"), *[c for c in vox.columns if c != "b"])


def window_partition(vox: DataFrame, size: int, shift: int) -> DataFrame:
    """Window of each row after a shift, its order inside, and rows per window."""
    keys = [F.floor((F.col(a) + shift) / size).cast("int").alias(f"w{a}") for a in XYZ]
    out = vox.select(*KEY, *keys)
    w = Window.partitionBy("b", "wx", "wy", "wz")
    return out.withColumn("slot", F.row_number().over(w.orderBy(*XYZ)) - 1).withColumn("rows", F.count("*").over(w))


def cat_batches(parts: list[DataFrame]) -> DataFrame:
    """Batches one after another: numbers go on where the last table ended."""
    out = parts[0]
    for df in parts[1:]:
        base = F.broadcast(out.agg((F.coalesce(F.max("b"), F.lit(-1)) + 1).alias("_base")))
        out = out.unionByName(df.crossJoin(base).withColumn("b", F.col("b") + F.col("_base")).drop("_base"))
    return out


def cat_channels(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select(*KEY, F.col("feats").alias("_other"))
    return a.join(other, list(KEY)).withColumn("feats", F.concat("feats", "_other")).drop("_other")


def select_batches(vox: DataFrame, order: list[int]) -> DataFrame:
    """The chosen batches, numbered anew in the order given."""
    new = vox.sparkSession.createDataFrame([(old, i) for i, old in enumerate(order)], "b long, nb int")
    return vox.join(F.broadcast(new), "b").withColumn("b", F.col("nb")).drop("nb")


def unbind_channels(vox: DataFrame) -> DataFrame:
    return vox.select(*KEY, F.posexplode("feats").alias("channel", "value"))


def collate(vox: DataFrame, groups: DataFrame) -> DataFrame:
    """Assets of a group stacked into one batch table: groups hold (group, b)."""
    numbered = groups.withColumn("batch", F.row_number().over(Window.partitionBy("group").orderBy("b")) - 1)
    return vox.join(numbered, "b").select("group", "batch", "b", *XYZ, "feats")


def replicate(vox: DataFrame, n: int) -> DataFrame:
    return vox.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def batch_layout(vox: DataFrame, batches: int | None = None) -> DataFrame:
    """Start and stop row of each batch; empty batches between keep a row."""
    n = vox.groupBy("b").agg(F.count("*").alias("n"))
    top = vox.agg(F.max("b").alias("m")) if batches is None else vox.sparkSession.range(1).select(F.lit(batches - 1).alias("m"))
    every = top.where("m is not null").select(F.explode(F.sequence(F.lit(0), F.col("m").cast("int"))).alias("b"))
    rows = every.join(n.withColumn("b", F.col("b").cast("int")), "b", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    stop = F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))  # one row a batch
    return rows.select("b", (stop - F.col("n")).alias("start"), stop.alias("stop"))


def standardize_groups(vox: DataFrame, channels: int, groups: int, eps: float = 1e-5) -> DataFrame:
    """Per batch and channel group: minus the mean, over sqrt(population variance + eps)."""
    per = channels // groups
    part = [F.slice("feats", i * per + 1, per) for i in range(groups)]
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    means = [F.avg(total(p) / per).alias(f"m{i}") for i, p in enumerate(part)]

    # a voxel's squares about its own mean, and the spread of those means: nothing large is subtracted
    def about_mean(p: Column) -> Column:
        return total(F.transform(p, lambda x: (x - total(p) / per) * (x - total(p) / per)))

    inside = [F.avg(about_mean(p) / per).alias(f"w{i}") for i, p in enumerate(part)]
    between = [F.var_pop(total(p) / per).alias(f"v{i}") for i, p in enumerate(part)]
    out = vox.join(vox.groupBy("b").agg(*means, *inside, *between), "b")
    feats = []
    for ch in range(channels):
        i = ch // per
        feats.append((F.col("feats")[ch] - F.col(f"m{i}")) / F.sqrt(F.col(f"w{i}") + F.col(f"v{i}") + eps))
    return out.select(*[x for x in vox.columns if x != "feats"], F.array(*feats).alias("feats"))


def octree_rollup(leaves: DataFrame, depth: int) -> DataFrame:
    """Sum of leaves below each inner node, all levels in one pass; occupancy = leaves / 8^levels."""
    level = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("d")
    up = leaves.select("b", *XYZ, "value", level)
    keys = [F.floor(F.col(a) / F.pow(F.lit(2), F.lit(depth) - F.col("d"))).cast("int").alias(a) for a in XYZ]
    return up.groupBy("b", "d", *keys).agg(F.sum("value").alias("value"), F.count("*").alias("leaves")).withColumn("occupancy", F.col("leaves") / F.pow(F.lit(8.0), F.lit(depth) - F.col("d")))


def octree_children(nodes: DataFrame) -> DataFrame:
    """Per parent of nodes ``b, d, x, y, z, value, leaf``: sums and numbers of its leaf and of its inner children."""
    at = [F.floor(F.col(a) / 2).cast("int").alias(a) for a in XYZ]
    part = lambda inner: F.when(F.col("leaf") != F.lit(inner), F.col("value"))
    up = nodes.where("d > 0").select("b", (F.col("d") - 1).alias("d"), *at, "value", "leaf")
    aggs = [F.coalesce(F.sum(part(i)), F.lit(0.0)).alias(f"{n}_sum") for n, i in (("leaf", False), ("inner", True))]
    return up.groupBy("b", "d", *XYZ).agg(*aggs, F.count_if(F.col("leaf")).alias("leaves"), F.count_if(~F.col("leaf")).alias("inner_nodes"))


def label_points(points: DataFrame, vox: DataFrame, res: int, key: list[str]) -> DataFrame:
    """Columns ``key`` of each point with ``label``, the class of the voxel (``asset, vx, vy, vz, cls``) it falls in; points in no voxel go."""
    at = ["asset", "vx", "vy", "vz"]
    return cells(points, res).join(vox.select(*at, F.col("cls").alias("label")), at).select(*key, "label")


#: Numbers of channels by which a dense tensor tells which of its axes they lie on.
LAYOUTS = (8, 14, 80)


def dense_layout(shape: Column) -> Column:
    """``first`` or ``last``, where the channels of a four-dimensional shape lie; null for no layout known."""
    ok = F.size(shape) == 4
    known = lambda c: c.isin(*LAYOUTS)
    return F.when(ok & known(F.get(shape, F.lit(0))), "first").when(ok & known(F.get(shape, F.lit(3))), "last")


def from_layout(tensors: DataFrame, asset: str = "asset") -> DataFrame:
    """``b, x, y, z, feats`` of the voxels of dense tensors (``asset, shape, values``) where any channel isn't 0.

    A shape with no layout known is an error at run time.
    """
    where = dense_layout(F.col("shape"))
    text = F.concat(F.lit("no channel layout known for shape "), F.col("shape").cast("string"))
    where = F.when(where.isNull(), F.raise_error(text)).otherwise(where)
    s, first = F.col("shape"), F.col("_w") == "first"
    rows = tensors.select(F.col(asset).alias("b"), "shape", where.alias("_w"), F.posexplode("values").alias("i", "v"))
    rows = rows.withColumn("_c", F.when(first, s[0]).otherwise(s[3]))
    sizes = {a: F.when(first, s[k + 1]).otherwise(s[k]) for k, a in enumerate(XYZ)}
    rows = rows.withColumns({f"_{a}": v for a, v in sizes.items()})
    per = "(_x * _y * _z)"
    cell = F.expr(f"case when _w = 'first' then i % {per} else i div _c end")
    channel = F.expr(f"case when _w = 'first' then i div {per} else i % _c end").cast("int")
    rows = rows.where("v <> 0").select("b", cell.alias("p"), channel.alias("ch"), "v", "_c", "_y", "_z")
    held = rows.groupBy("b", "p", "_c", "_y", "_z").agg(F.map_from_entries(F.collect_list(F.struct("ch", F.col("v").cast("double")))).alias("m"))
    feats = F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0)))
    x, y, z = F.expr("cast(p div (_y * _z) as int)"), F.expr("cast((p div _z) % _y as int)"), F.expr("cast(p % _z as int)")
    return held.select("b", x.alias("x"), y.alias("y"), z.alias("z"), feats.alias("feats"))


def octree_refine(leaves: DataFrame, least: int, most: int) -> DataFrame:
    """Leaves (b, d, x, y, z, value, mask): +1 splits in eight, -1 merges when all eight siblings ask, 0 stays."""
    parent = [F.floor(F.col(a) / 2).cast("int").alias(f"p{a}") for a in XYZ]
    want = F.when((F.col("mask") > 0) & (F.col("d") < most), 1).when((F.col("mask") < 0) & (F.col("d") > least), -1).otherwise(0)
    rows = leaves.select("b", "d", *XYZ, "value", want.alias("m"), *parent)
    asks = rows.groupBy("b", "d", "px", "py", "pz").agg(F.count_if(F.col("m") < 0).alias("asks"), F.sum("value").alias("total"))
    rows = rows.join(asks, ["b", "d", "px", "py", "pz"])
    merges = (F.col("m") < 0) & (F.col("asks") == 8)
    merged = rows.where(merges).groupBy("b", "d", "px", "py", "pz").agg(F.first("total").alias("value")).select("b", (F.col("d") - 1).alias("d"), *[F.col(f"p{a}").alias(a) for a in XYZ], "value")
    split = rows.where("m > 0").withColumn("o", F.explode(_corners())).select("b", (F.col("d") + 1).alias("d"), *[(F.col(a) * 2 + F.col(f"o.{o}")).alias(a) for a, o in zip(XYZ, "ijk", strict=True)], "value")
    stay = rows.where(~merges & (F.col("m") <= 0)).select("b", "d", *XYZ, "value")
    return merged.unionByName(split).unionByName(stay)

