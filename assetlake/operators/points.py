"""Point clouds: frames, duplicates, exact neighbours, normals, patches and their reports."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.functions import geometry as G
from assetlake.operators.graph import connected_components, local_labels
from assetlake.operators.manifest import with_global_index
from assetlake.session import cut, spread

XYZ = ("x", "y", "z")
PLACE = ("n_x", "n_y", "n_z")
#: Points of a group up to which all of them are candidates for each other.
SMALL_GROUP = 64
#: Points and queries of a group up to which one task compares all of them.
TASK_GROUP = 4096
#: Rows of groups that a task compares at a time, about.
BUCKET_ROWS = 16_384
#: Points of an asset up to which its patches are joined by one task.
TASK_POINTS = 200_000
#: Cell widths tried are the group's extent over 4^0 to 4^LEVELS.
LEVELS = 8


def valid_points(df: DataFrame, limit: float = 1.05) -> DataFrame:
    """Finite and inside [-limit, limit] on each axis."""
    ok = [~F.isnan(a) & F.col(a).between(-limit, limit) for a in XYZ]
    return df.where(ok[0] & ok[1] & ok[2])


def bounds(points: DataFrame, by: str) -> DataFrame:
    """Box, centre, half diagonal (at least 0.05) and padded cube half width (at least 1e-3)."""
    box = points.groupBy(by).agg(*[f(a).alias(f"{n}_{a}") for a in XYZ for n, f in (("lo", F.min), ("hi", F.max))])
    ext = [F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in XYZ]
    box = box.withColumns({f"c{a}": (F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2 for a in XYZ})
    return box.withColumns({"radius": F.greatest(F.lit(0.05), F.sqrt(G.total(e * e for e in ext)) / 2), "cube": F.greatest(F.lit(1e-3), 0.55 * F.greatest(*ext)), "extent": F.greatest(*ext)})


def normalize_unit_cube(points: DataFrame, by: str) -> DataFrame:
    """ux, uy, uz: centred, divided by the largest extent, clipped just inside +-0.5."""
    edge = 0.5 - 1e-6
    b = bounds(points, by).select(by, "cx", "cy", "cz", "extent")
    new = {f"u{a}": F.least(F.lit(edge), F.greatest(F.lit(-edge), (F.col(a) - F.col(f"c{a}")) / F.col("extent"))) for a in XYZ}
    return points.join(b, by).withColumns(new).drop("cx", "cy", "cz", "extent")


def restore_world(points: DataFrame, boxes: DataFrame, by: str) -> DataFrame:
    """wx, wy, wz: local [-1, 1] back into the box: times half its largest extent, plus its centre."""
    j = points.join(boxes, by)
    half = F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in XYZ]) / 2
    out = j.withColumns({f"w{a}": F.col(a) * half + (F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2 for a in XYZ})
    return out.select(*points.columns, "wx", "wy", "wz")


def quantised(step: float) -> list[Column]:
    """Half-to-even rounding of each coordinate to the step."""
    return [F.rint(F.col(a) / step).cast("long").alias(f"q{a}") for a in XYZ]


def dedup_first(points: DataFrame, step: float, by: list[str], order: list[str]) -> DataFrame:
    """The first point of each quantised place."""
    place = Window.partitionBy(*by, *quantised(step)).orderBy(*order)
    cols = [x for x in points.columns if x not in by]
    return points.withColumn("_r", F.row_number().over(place)).where("_r = 1").select(*by, *cols)


def merge_duplicates(points: DataFrame, step: float, by: str, boundary: int = 0) -> DataFrame:
    """Per quantised place: mean point, majority class other than the boundary (which wins only alone), modal voxel, count.

    Points carry ``cls`` (number) and ``voxel``; the smaller class and voxel win ties.
    """
    keys = [by, "qx", "qy", "qz"]
    p = points.select("*", *quantised(step)).dropna(subset=keys)
    kinds = p.groupBy(*keys, "cls", "voxel").agg(*[F.sum(a).alias(a) for a in XYZ], F.count("*").alias("n"))
    votes = lambda c: F.sum("n").over(Window.partitionBy(*keys, c))
    kinds = kinds.withColumn("_c", votes("cls")).withColumn("_v", votes("voxel"))
    mean = [(F.sum(a) / F.sum("n")).alias(a) for a in XYZ]
    cls = F.max_by("cls", F.struct((F.col("cls") != boundary).alias("o"), "_c", (-F.col("cls")).alias("r"))).alias("cls")
    voxel = F.max_by("voxel", F.struct("_v", (-F.col("voxel")).alias("r"))).alias("voxel")
    return kinds.groupBy(*keys).agg(*mean, F.sum("n").alias("source_count"), cls, voxel)


def _nearest_rows(q: np.ndarray, r: np.ndarray, k: int, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of r, squared distance, rank from 1) of the k nearest of r to each row of q; the earlier row of r on ties."""
    out = []
    k = min(k, len(r))
    step = max(1, chunk // len(r))
    for lo in range(0, len(q), step):
        d = [q[lo : lo + step, None, i] - r[None, :, i] for i in range(3)]
        d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        at, near = np.nonzero(d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k])
        value = d2[at, near]
        order = np.lexsort((near, value, at))
        at, near, value = at[order], near[order], value[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
        kept = rank <= k
        out.append((at[kept] + lo, near[kept], value[kept], rank[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _nearest_in_groups(q: np.ndarray, qg: np.ndarray, r: np.ndarray, rg: np.ndarray, k: int, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_nearest_rows`` inside many groups at once: ``qg`` and ``rg`` number the groups, and ``r`` lies by group.

    Rows of small groups of one size are compared together.
    """
    n = np.bincount(rg, minlength=max(qg.max(initial=-1), rg.max(initial=-1)) + 1)
    start = np.cumsum(n) - n
    by_size = np.lexsort((qg, n[qg]))
    edges = np.flatnonzero(np.diff(n[qg][by_size], prepend=-1))
    out = [(np.array([], int), np.array([], int), np.array([]), np.array([], int))]
    for rows in np.split(by_size, edges[1:]):
        size = n[qg[rows[0]]] if len(rows) else 0
        if size > SMALL_GROUP:
            for some in np.split(rows, np.flatnonzero(np.diff(qg[rows])) + 1):
                lo = start[qg[some[0]]]
                at, near, d2, rank = _nearest_rows(q[some], r[lo : lo + size], k)
                out.append((some[at], near + lo, d2, rank))
        elif size:
            for lo in range(0, len(rows), max(1, chunk // size)):
                some = rows[lo : lo + max(1, chunk // size)]
                near = start[qg[some]][:, None] + np.arange(size)
                d = [q[some, None, i] - r[near, i] for i in range(3)]
                d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
                first = np.argsort(d2, axis=1, kind="stable")[:, :k]
                rank = np.broadcast_to(np.arange(1, first.shape[1] + 1), first.shape)
                out.append((np.repeat(some, first.shape[1]), np.take_along_axis(near, first, 1).ravel(), np.take_along_axis(d2, first, 1).ravel(), rank.ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _buckets(sides: list[DataFrame], keys: list[str], rows: int) -> list[DataFrame]:
    """Tables with ``_b``, the same for rows of one key and for about ``BUCKET_ROWS`` rows, in parts by it."""
    b = F.pmod(F.xxhash64(*keys), F.lit(-(-rows // BUCKET_ROWS))).alias("_b")
    return [spread(df.dropna(subset=keys).select("*", b), rows, "_b") for df in sides]


def _numbers(tables: list[pa.Table], keys: list[str]) -> list[np.ndarray]:
    """The group of each row of some tables, numbered through all of them by their keys."""
    code = pd.concat([t.select(keys).to_pandas() for t in tables]).groupby(keys, sort=False).ngroup().to_numpy()
    return np.split(code, np.cumsum([len(t) for t in tables])[:-1])


def _task_knn(query: DataFrame, ref: DataFrame, keys: list[str], k: int, rows: int, own: tuple[str, ...], other: tuple[str, ...], far: bool) -> DataFrame:
    """``grid_knn`` of groups that one task can hold, many of them at a time; ``far`` is for a table and itself."""
    kinds, theirs = dict(query.dtypes), dict(ref.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (*keys, "id")] + [f"nid {theirs['id']}, d2 double, r int"] + [f"`{c}` {kinds[c]}" for c in own] + [f"`n_{c}` {theirs[c]}" for c in other] + ["far double, n_far double"] * far)

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        qg, rg = _numbers([q, r], keys)
        in_order = lambda t, g: t.append_column("_g", pa.array(g)).sort_by([("_g", "ascending"), ("id", "ascending")])
        r = in_order(r, rg)
        if far:  # both sides have the same rows
            q, qg = in_order(q, qg), np.sort(qg)
        places = [np.stack([t.column(a).to_numpy() for a in XYZ], axis=1).astype(float) for t in (q, r)]
        at, near, d2, rank = _nearest_in_groups(places[0], qg, places[1], r.column("_g").to_numpy(), k)
        mine, found = q.select([*keys, "id", *own]).take(pa.array(at)), r.select(list(dict.fromkeys(["id", *other]))).take(pa.array(near))
        columns = [*(mine.column(c) for c in (*keys, "id")), found.column("id"), pa.array(d2), pa.array(rank.astype(np.int32)), *(mine.column(c) for c in own), *(found.column(c) for c in other)]
        if far:
            most = np.full(len(q), -np.inf)
            np.maximum.at(most, at, d2)
            columns += [pa.array(most[at]), pa.array(most[near])]
        return pa.Table.from_arrays(columns, [*keys, "id", "nid", "d2", "r", *own, *(f"n_{c}" for c in other), *(("far", "n_far") if far else ())])

    # columns get names of their own, for query and ref may be one table
    wanted = [list(dict.fromkeys((*keys, "id", *XYZ, *c))) for c in (own, other)]
    q, r = [df.select(*[(F.col(c).cast(kinds[c]) if c in keys else F.col(c)).alias(c) for c in cols]) for df, cols in zip((query, ref), wanted, strict=True)]
    q, r = [df.groupBy("_b") for df in _buckets([q, r], keys, rows)]
    return q.cogroup(r).applyInArrow(run, schema)


def grid_knn(query: DataFrame, ref: DataFrame, keys: list[str], k: int, max_rounds: int = 48, own: tuple[str, ...] = (), other: tuple[str, ...] = (), far: bool = False) -> DataFrame:
    """Exact k nearest of ``ref`` for each point of ``query`` inside the same keys.

    Both have ``id, x, y, z``. Candidates come from the 27 grid cells around the
    query; an answer stands once its k-th distance is no more than the cell width,
    which is how far those cells surely reach. The others try again with cells twice
    as wide. Cells start, per group, at the widest of some widths at which no cell holds
    many points, so outliers and clusters don't make a group one cell; of points in one
    place only the k first by id can be answers, and only they are kept. All that is for
    groups of more than ``TASK_GROUP`` points or queries: those of a group that is no larger
    are compared by one task, which takes many groups at a time, and many queries of few points
    are joined. Columns: keys, id, nid, d2, r (1-based, ties by nid), the query's columns
    ``own`` and the neighbour's columns ``other`` as ``n_<name>``, and with ``far``, for a table
    and itself, the ``d2`` of the last neighbour of both ends as ``far`` and ``n_far``. Query
    points whose keys have no reference point have no row.
    """
    local, rest = _grid_knn(query, ref, keys, k, max_rounds, own, other, far)
    if rest:
        pairs = _with_columns(reduce(DataFrame.unionByName, rest), query, ref, keys, own, other)
        if far:
            last = pairs.groupBy(*keys, "id").agg(F.max("d2").alias("far"))
            pairs = with_attributes(pairs, last, keys, ["far"])
        local.append(pairs)
    return reduce(DataFrame.unionByName, local)


def _with_columns(pairs: DataFrame, query: DataFrame, ref: DataFrame, keys: list[str], own: tuple[str, ...], other: tuple[str, ...]) -> DataFrame:
    if own:
        pairs = pairs.join(query.select(*keys, "id", *own), [*keys, "id"])
    if other:
        pairs = pairs.join(ref.select(*keys, F.col("id").alias("nid"), *[F.col(c).alias(f"n_{c}") for c in other]), [*keys, "nid"])
    return pairs


def _grid_knn(query: DataFrame, ref: DataFrame, keys: list[str], k: int, max_rounds: int, own: tuple[str, ...], other: tuple[str, ...], far: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """The answers of groups that one task compares, with the columns asked for, and those of the other groups without."""
    w = Window.partitionBy(*keys, "id")

    def nearest(pairs: DataFrame) -> DataFrame:
        d = [F.col(a) - F.col(f"n{a}") for a in XYZ]
        near = pairs.withColumn("d2", d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
        return near.withColumn("r", F.row_number().over(w.orderBy("d2", "nid"))).where(F.col("r") <= k)

    sizes = ref.groupBy(*keys).agg(F.count("*").alias("_n"))
    sizes = cut(sizes.withColumn("_q", F.col("_n")) if query is ref else sizes.join(query.groupBy(*keys).agg(F.count("*").alias("_q")), keys))
    most = F.greatest("_n", "_q")
    fits, few = most <= TASK_GROUP, (F.col("_n") <= SMALL_GROUP) & (F.col("_q") > TASK_GROUP)
    held, n_few, n_large = sizes.agg(F.sum(F.when(fits, most)), F.count_if(few), F.count_if(~fits & ~few)).first()
    groups = lambda where: sizes.where(where).select(*keys)
    local, done = [], []
    if held or not (n_few or n_large):
        pick = (lambda df: df.join(groups(fits), keys, "left_semi")) if n_few or n_large else (lambda df: df)
        local.append(_task_knn(pick(query), pick(ref), keys, k, held or 1, own, other, far))
    first = ref.select(*keys, F.col("id").alias("nid"), *[F.col(a).alias(f"n{a}") for a in XYZ])
    query = query.select(*keys, "id", *XYZ)
    if n_few:
        done.append(nearest(query.join(first.join(groups(few), keys), keys)).select(*keys, "id", "nid", "d2", "r"))
    if not n_large:
        return local, done
    large = groups(~fits & ~few)
    place = Window.partitionBy(*keys, *[f"n{a}" for a in XYZ]).orderBy("nid")
    first = cut(first.join(large, keys).withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= k).drop("_p"))
    stats = first.groupBy(*keys).agg(F.count("*").alias("_n"), *[(F.max(f"n{a}") - F.min(f"n{a}")).alias(f"_e{a}") for a in XYZ])
    extent = F.greatest(*[F.col(f"_e{a}") for a in XYZ], F.lit(1e-9))
    stats = cut(stats.select(*keys, "_n", F.least(F.col("_n"), F.lit(k)).alias("_k"), extent.alias("_e")))
    crowd = first.join(stats, keys).withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    width = F.col("_e") / F.pow(F.lit(4.0), F.col("_l"))
    crowd = crowd.groupBy(*keys, "_l", *[F.floor(F.col(f"n{a}") / width).alias(f"_c{a}") for a in XYZ]).agg(F.count("*").alias("_in"))
    fine = crowd.groupBy(*keys, "_l").agg(F.max("_in").alias("_in"))
    level = fine.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_in") <= F.greatest(F.lit(SMALL_GROUP), F.lit(4 * k)), F.col("_l"))), F.lit(LEVELS)).alias("_l"))
    stats = cut(stats.join(level, keys, "left").withColumn("_h0", F.col("_e") / F.pow(F.lit(4.0), F.coalesce("_l", F.lit(0)))).drop("_e", "_l"))
    r0 = first.join(stats, keys).drop("_n")
    todo = cut(query.join(stats.select(*keys, "_h0"), keys))
    offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, "ijk", strict=True)]) for o in np.ndindex(3, 3, 3)])
    for i in range(max_rounds):
        if todo.isEmpty():
            break
        h = F.col("_h0") * float(2**i)
        r = r0.withColumns({f"_c{a}": F.floor(F.col(f"n{a}") / h) for a in XYZ}).drop("_h0")
        q = todo.withColumn("_h", h).withColumn("_o", F.explode(offsets))
        q = q.withColumns({f"_c{a}": F.floor(F.col(a) / F.col("_h")) + F.col(f"_o.{o}") - 1 for a, o in zip(XYZ, "ijk", strict=True)}).drop("_o")
        near = nearest(q.join(r, [*keys, "_cx", "_cy", "_cz"]))
        sure = (F.max("r").over(w) == F.col("_k")) & (F.sqrt(F.max("d2").over(w)) <= F.col("_h"))
        got = cut(near.withColumn("_ok", sure).where("_ok").select(*keys, "id", "nid", "d2", "r"))
        done.append(got)
        todo = cut(todo.join(got.where("r = 1").select(*keys, "id"), [*keys, "id"], "left_anti"))
    else:
        raise RuntimeError("neighbour search did not settle")
    return local, done


def knn(points: DataFrame, keys: list[str], k: int, own: tuple[str, ...] = (), other: tuple[str, ...] = (), far: bool = False) -> DataFrame:
    """k nearest including the point itself, k at least 2 and at most the number of points."""
    return grid_knn(points, points, keys, max(k, 2), own=own, other=other, far=far)


def local_scale(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of the farthest neighbour kept, at least 1e-6."""
    return pairs.groupBy(*keys, "id").agg(F.greatest(F.sqrt(F.max("d2")), F.lit(1e-6)).alias("scale"))


def with_attributes(pairs: DataFrame, attrs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Both ends' attributes: ``c`` of the point as ``c``, of the neighbour as ``n_c``."""
    own = attrs.select(*keys, "id", *columns)
    other = attrs.select(*keys, F.col("id").alias("nid"), *[F.col(x).alias(f"n_{x}") for x in columns])
    return pairs.join(own, [*keys, "id"]).join(other, [*keys, "nid"])


def patch_edges(points: DataFrame, keys: list[str], k: int, radius_scale: float, voxel_gap: int, angle: float, curvature: tuple[int, float], radius: tuple[tuple[int, ...], float]) -> DataFrame:
    """Neighbour pairs that belong to one patch; only those where the neighbour's id is larger.

    Points have id, x, y, z, cls, normal (array), curvature, radius, vx, vy, vz; keys
    include cls. ``curvature`` is (class, limit), ``radius`` (classes, relative limit);
    both tests are skipped when either value is missing.
    """
    seen = ("normal", "curvature", "radius", "vx", "vy", "vz")
    j = knn(points, keys, k, own=seen, other=seen, far=True).where("nid > id")
    gap = F.greatest(*[F.abs(F.col(a) - F.col(f"n_{a}")) for a in ("vx", "vy", "vz")])
    both = lambda a: F.col(a).isNotNull() & F.col(f"n_{a}").isNotNull() & ~F.isnan(a) & ~F.isnan(f"n_{a}")
    bend = (F.col("cls") != curvature[0]) | ~both("curvature") | (F.abs(F.col("curvature") - F.col("n_curvature")) <= curvature[1])
    rel = F.abs(F.col("radius") - F.col("n_radius")) / F.greatest("radius", "n_radius", F.lit(1e-6))
    round_ = ~F.col("cls").isin(*radius[0]) | ~both("radius") | (rel <= radius[1])
    scale = F.greatest(F.sqrt(F.greatest("far", "n_far")), F.lit(1e-6))
    ok = (F.sqrt("d2") <= scale * radius_scale) & (gap <= voxel_gap) & (G.vector_angle("normal", "n_normal") <= angle)
    return j.where(ok & bend & round_).select(*keys, "id", "nid")


def _graph_components(points: DataFrame, edges: DataFrame, asset: str) -> DataFrame:
    """Points with ``component``, the least place of those joined, over all points by asset and id."""
    placed = cut(with_global_index(points, [asset, "id"], "node"))
    end = lambda c, name: placed.select(asset, F.col("id").alias(c), F.col("node").alias(name))
    links = edges.join(end("id", "u"), [asset, "id"]).join(end("nid", "v"), [asset, "nid"])
    found = connected_components(links, "u", "v")
    p = placed.join(found, "node", "left")
    return p.select(asset, "cls", "id", F.coalesce("component", "node").cast("long").alias("component"))


def _task_components(points: DataFrame, edges: DataFrame, asset: str, rows: int) -> DataFrame:
    """Points with ``component``, the least place of those joined, in the asset by id; many assets a task at a time."""
    kinds = dict(points.dtypes)

    def run(p: pa.Table, e: pa.Table) -> pa.Table:
        pg, eg = _numbers([p, e], [asset])
        ids = [t.column(c).to_numpy() for t, c in ((p, "id"), (e, "id"), (e, "nid"))]
        known, place = np.unique(np.concatenate(ids), return_inverse=True)
        own, u, v = [g * len(known) + i for g, i in zip((pg, eg, eg), np.split(place, np.cumsum([len(i) for i in ids])[:-1]), strict=True)]
        order = np.argsort(own, kind="stable")
        own = own[order]
        at = [np.minimum(np.searchsorted(own, x), max(len(own) - 1, 0)) for x in (u, v)]
        there = (own[at[0]] == u) & (own[at[1]] == v) if len(own) else np.zeros(len(u), bool)
        label = local_labels(len(own), at[0][there], at[1][there])
        return p.select([asset, "cls", "id"]).take(pa.array(order)).append_column("component", pa.array(label.astype(np.int64)))

    sides = _buckets([points, edges.select(F.col(asset).cast(kinds[asset]).alias(asset), "id", "nid")], [asset], rows)
    return sides[0].groupBy("_b").cogroup(sides[1].groupBy("_b")).applyInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in (asset, "cls", "id")) + ", component long")


def grow_patches(points: DataFrame, edges: DataFrame, asset: str, min_size: int, skip_class: int | None = None) -> DataFrame:
    """Patch of each point: components of the edges with enough points, numbered by class and least member; -1 else.

    Points have (asset, cls, id), ids are unique inside an asset.
    """
    points, edges = points.select(asset, "cls", "id"), edges.select(asset, "id", "nid")
    sizes = points.groupBy(asset).agg(F.count("*").alias("_n"))
    many = (F.col("_n") > TASK_POINTS) | F.col(asset).isNull()
    held, n_many = sizes.agg(F.sum(F.when(~many, F.col("_n"))), F.count_if(many)).first()
    if not n_many:
        p = _task_components(points, edges, asset, held or 1)
    else:
        large = cut(sizes.where(many).select(F.col(asset).alias("_a")))
        same = F.col(asset).eqNullSafe(F.col("_a"))
        p = _graph_components(points.join(large, same, "left_semi"), edges, asset)
        if held:
            p = p.unionByName(_task_components(points.join(large, same, "left_anti"), edges, asset, held))
    p = cut(p)
    big = p.groupBy(asset, "cls", "component").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    if skip_class is not None:
        big = big.where(F.col("cls") != skip_class)
    ids = big.withColumn("patch_id", F.dense_rank().over(Window.partitionBy(asset).orderBy("cls", "component")) - 1)
    return p.join(ids.select(asset, "component", "patch_id"), [asset, "component"], "left").select(asset, "cls", "id", F.coalesce("patch_id", F.lit(-1)).alias("patch_id"))


def _smallest_axis(*cov: Column) -> Column:
    """Least principal axis and its share, from the six covariances."""

    @F.pandas_udf("struct<x:double, y:double, z:double, curvature:double>")
    def axis(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1).astype(float)
        good = np.isfinite(m).all(axis=(1, 2))
        value, vector = np.linalg.eigh(np.where(good[:, None, None], m, 0.0))
        total = np.maximum(value.sum(axis=1), 1e-12)
        found = np.where(good[:, None], np.column_stack([vector[:, :, 0], value[:, 0] / total]), np.nan)
        return pd.DataFrame(found, columns=["x", "y", "z", "curvature"])

    return axis(*cov)


def estimate_normals(points: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least principal axis of each point's neighbours, curvature = its share; null with fewer than 3 points.

    Neighbours' places are looked up where the pairs don't have them (``n_x, n_y, n_z``).
    """
    if not set(PLACE) <= set(pairs.columns):
        n = points.select(*keys, F.col("id").alias("nid"), *[F.col(a).alias(f"n_{a}") for a in XYZ])
        pairs = pairs.join(n, [*keys, "nid"])
    names = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    cov = pairs.groupBy(*keys, "id").agg(F.count("*").alias("k"), *[F.covar_samp(f"n_{a}", f"n_{b}").alias(a + b) for a, b in names])
    axis = cov.withColumn("_a", _smallest_axis(*[F.col(a + b) for a, b in names]))
    few = F.col("k") < 3
    return axis.select(*keys, "id", "k", F.when(~few & F.col("_a.x").isNotNull(), F.array("_a.x", "_a.y", "_a.z")).alias("normal"), F.when(~few, F.col("_a.curvature")).alias("curvature"))


def class_neighbours(points: DataFrame, asset: str, k: int, boundary: int | None = None, boundary_k: int | None = None) -> DataFrame:
    """Neighbour pairs for normals: points look at their own class of the asset, those of class ``boundary`` at all its points.

    Ids are unique in an asset, so what follows goes by asset and id; ``cls`` is the point's, ``n_x, n_y, n_z`` the neighbour's place.
    """
    if boundary is None:
        return knn(points, [asset, "cls"], k, other=XYZ)
    own = knn(points.where(F.col("cls") != boundary), [asset, "cls"], k, other=XYZ)
    edge = grid_knn(points.where(F.col("cls") == boundary), points, [asset], max(boundary_k or k, 2), other=XYZ)
    return own.unionByName(edge.withColumn("cls", F.lit(boundary).cast(dict(points.dtypes)["cls"])))


def primitive_radius(points: DataFrame, pairs: DataFrame, keys: list[str], least_degrees: float = 3.0) -> DataFrame:
    """Median over neighbours of chord / (2 sin(angle / 2)) where the normals differ enough."""
    j = with_attributes(pairs.where("nid <> id"), points, keys, ["normal"])
    angle = G.vector_angle("normal", "n_normal")
    chord = F.sqrt("d2") / (2 * F.sin(F.radians(angle) / 2))
    chords = j.withColumn("a", angle).where(F.col("a") >= least_degrees).groupBy(*keys, "id").agg(F.sort_array(F.collect_list(chord)).alias("_c"))
    # lists of at most k: a percentile keeps a table of counts for each point
    low, high = [F.get("_c", F.floor((F.size("_c") - i) / 2).cast("int")) for i in (1, 0)]
    return chords.select(*keys, "id", F.when(low == high, low).otherwise(0.5 * low + 0.5 * high).alias("radius"))


def refine_normals(points: DataFrame, pairs: DataFrame, keys: list[str], classes: tuple[int, ...], tolerance: float) -> DataFrame:
    """PCA again over neighbours of like radius, signs kept; others and sets under 4 points stay as they are."""
    j = with_attributes(pairs, points, keys, ["radius"])
    known = F.col("radius").isNotNull() & F.col("n_radius").isNotNull()
    like = ~known | (F.abs(F.col("radius") - F.col("n_radius")) / F.greatest("radius", "n_radius", F.lit(1e-6)) <= tolerance)
    chosen = j.where(like).select(*keys, "id", "nid", "d2", "r", *[c for c in PLACE if c in pairs.columns])
    again = estimate_normals(points, chosen, keys).where("k >= 4").select(*keys, "id", F.col("normal").alias("_new"))
    out = points.join(again, [*keys, "id"], "left")
    sign = F.when(G.dot3("normal", "_new") < 0, -1.0).otherwise(1.0)
    new = F.array(*[F.get("_new", F.lit(i)) * sign for i in range(3)])
    return out.withColumn("normal", F.when(F.col("cls").isin(*classes) & F.col("_new").isNotNull(), new).otherwise(F.col("normal"))).drop("_new")


def summarize(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, median, p90, p95, max with linear interpolation; nulls when empty."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    got = df.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("_q"), F.max(value).alias("max"))
    return got.select(*(by or []), "n", "mean", *[F.col("_q")[i].alias(x) for i, x in enumerate(("median", "p90", "p95"))], "max")


def angle_report(matches: DataFrame, classes: list[int]) -> DataFrame:
    """Per class and overall (null): matches, mean distance, median angle, share of angles within 5, 10, 20 degrees."""
    share = [F.avg((F.col("angle") <= d).cast("double")).alias(f"within_{d}") for d in (5, 10, 20)]
    aggs = [F.count("*").alias("n"), F.avg("dist").alias("mean_dist"), F.percentile("angle", F.lit(0.5)).alias("median_angle"), *share]
    got = matches.rollup("cls").agg(*aggs)
    every = matches.sparkSession.createDataFrame([(c,) for c in [*classes, None]], "cls int")
    j = every.alias("e").join(got.alias("g"), F.col("e.cls").eqNullSafe(F.col("g.cls")), "left")
    return j.select("e.cls", F.coalesce("n", F.lit(0)).alias("n"), "mean_dist", "median_angle", "within_5", "within_10", "within_20")


def patch_purity(points: DataFrame, by: list[str], patch: str, face: str) -> DataFrame:
    """Per patch its majority face (lowest on ties), the share of it, and the size."""
    n = points.where(f"{patch} >= 0").groupBy(*by, patch, face).agg(F.count("*").alias("n"))
    return n.groupBy(*by, patch).agg(F.max_by(face, F.struct("n", (-F.col(face)).alias("r"))).alias(face), F.max("n").alias("top"), F.sum("n").alias("size")).withColumn("purity", F.col("top") / F.col("size"))


def face_completeness(points: DataFrame, gt: DataFrame, by: list[str], patch: str, face: str) -> DataFrame:
    """Per face the share of all its points that the best patch holds; 0 for faces no patch touches."""
    best = points.where(f"{patch} >= 0").groupBy(*by, patch, face).agg(F.count("*").alias("n")).groupBy(*by, face).agg(F.max("n").alias("best"))
    all_ = gt.groupBy(*by, face).agg(F.count("*").alias("points"))
    return all_.join(best, [*by, face], "left").withColumn("completeness", F.coalesce(F.col("best") / F.col("points"), F.lit(0.0))).drop("best")


def stage_summary(points: DataFrame, asset: str, classes: list[int]) -> DataFrame:
    """Class counts, valid normals, mean source count, means of curvature and radius without NaN, patches."""
    ok = lambda a: F.when(~F.isnan(a), F.col(a))
    patches = points.where("patch_id >= 0").groupBy(asset, "patch_id").agg(F.count("*").alias("n")).groupBy(asset).agg(F.count("*").alias("patches"), F.avg("n").alias("mean_patch"), F.percentile("n", F.lit(0.5)).alias("median_patch"))
    aggs = [F.count_if(F.col("cls") == c).alias(f"class_{c}") for c in classes]
    got = points.groupBy(asset).agg(*aggs, F.count_if("normal_valid").alias("valid_normals"), F.avg("source_count").alias("mean_sources"), F.avg(ok("curvature")).alias("mean_curvature"), F.avg(ok("radius")).alias("mean_radius"))
    return got.join(patches, asset, "left").fillna(0, ["patches"])


def even_positions(k: int) -> Column:
    """Positions of linspace(0, n - 1, k), truncated, for column ``n``; the last is n - 1."""
    step = (F.col("n") - 1).cast("double") / (k - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == k - 1, F.col("n") - 1).otherwise(F.floor(i * step)).cast("long"))


def even_subsample(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """At most k evenly spaced rows of each group in the order given; order columns must be unique."""
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    keep = n.where(F.col("n") > k).select(*by, F.explode(F.array_distinct(even_positions(k))).alias("_i"))
    every = n.where(F.col("n") <= k).select(*by)
    return ranked.join(keep, [*by, "_i"], "left_semi").unionByName(ranked.join(every, by, "left_semi")).drop("_i")


def cap_by_centroid(points: DataFrame, by: list[str], k: int, order: list[str]) -> DataFrame:
    """At most k points of each group, evenly spaced by squared distance to the group's mean."""
    mean = points.groupBy(*by).agg(*[F.avg(a).alias(f"_m{a}") for a in XYZ])
    d = [F.col(a) - F.col(f"_m{a}") for a in XYZ]
    ranked = points.join(mean, by).withColumn("_d2", F.round(d[0] * d[0] + d[1] * d[1] + d[2] * d[2], 12))
    return even_subsample(ranked, by, ["_d2", *order], k).drop("_mx", "_my", "_mz", "_d2")


def farthest_points(points: DataFrame, by: list[str], n: int, order: list[str], cap: int = 512, step: float = 1e-5) -> DataFrame:
    """n points per group: start nearest the mean, then always the farthest from those taken; short groups repeat.

    Groups are capped and freed of duplicates before, so one array per group is bounded.
    """
    p = dedup_first(cap_by_centroid(points, by, cap, order), step, by, order)
    arrays = p.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, *XYZ))).alias("p"))

    @F.pandas_udf("array<int>")
    def pick(groups: pd.Series) -> pd.Series:
        out = []
        for g in groups:
            a = np.array([[r["x"], r["y"], r["z"]] for r in g])
            d = ((a - a.mean(axis=0)) ** 2).sum(axis=1)
            taken = [int(np.argmin(d))]
            best = ((a - a[taken[0]]) ** 2).sum(axis=1)
            while len(taken) < min(n, len(a)):
                taken.append(int(np.argmax(best)))
                best = np.minimum(best, ((a - a[taken[-1]]) ** 2).sum(axis=1))
            out.append([taken[i % len(taken)] for i in range(n)])
        return pd.Series(out)

    rows = arrays.withColumn("i", pick("p")).select(*by, "p", F.posexplode("i").alias("slot", "i"))
    return rows.select(*by, "slot", *[F.col("p")[F.col("i")][a].alias(a) for a in XYZ])


def merge_point_sources(faces: DataFrame, edges: DataFrame, columns: list[str], most: float | None = None) -> DataFrame:
    """Face points (label 0; valid ones only where a limit is given) and all edge points (label 1)."""
    inner = faces if most is None else valid_points(faces, most)
    one = lambda df, label: df.select(*columns, F.lit(label).alias("label"))
    return one(inner, 0).unionByName(one(edges, 1))


def explode_samples(points: DataFrame, step: float, voxel: list[str], slot: str, most: float) -> DataFrame:
    """The valid points of each voxel, the first in slot order of those in one place."""
    return dedup_first(valid_points(points, most), step, voxel, [slot])
