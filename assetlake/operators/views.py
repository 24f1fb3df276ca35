"""View planning, projection, feature fusion, and mesh tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlake.functions import geometry as G
from assetlake.operators.graph import connected_components, local_labels
from assetlake.operators.manifest import with_global_index
from assetlake.session import cut

XYZ = ("x", "y", "z")
#: Faces of a mesh up to which one task joins them.
TASK_FACES = 200_000


def view_plan(assets: DataFrame, asset: str, n: int, offset: tuple[float, float] = (0.0, 0.0), remap: bool = False) -> DataFrame:
    """n views of each asset, spread over the sphere."""
    rows = assets.select(asset, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("view"))
    yaw, pitch = G.hammersley("view", n, offset, remap)
    return rows.select(asset, "view", yaw.alias("yaw"), pitch.alias("pitch"))


def random_fov_radius(df: DataFrame, seed: int, low: float = 10.0, high: float = 70.0) -> DataFrame:
    """Radius drawn uniformly in 1 / r^2 between the two fields of view, and the field that fits it."""
    import math

    half = math.sqrt(3) / 2
    k0, k1 = (1 / (half / math.sin(math.radians(f) / 2)) ** 2 for f in (low, high))
    r = 1 / F.sqrt(F.lit(k0) + F.rand(seed) * (k1 - k0))
    return df.withColumn("radius", r).withColumn("fov", 2 * F.degrees(F.asin(F.lit(half) / F.col("radius"))))


def camera_poses(views: DataFrame, distance: Column) -> DataFrame:
    """Camera position and rows of the world-to-camera matrix (x right, y down, z forward) looking at the origin."""
    px, py, pz = G.camera_position("yaw", "pitch", distance)
    v = views.withColumns({"px": px, "py": py, "pz": pz})
    sy, cy, sp, cp = F.sin("yaw"), F.cos("yaw"), F.sin("pitch"), F.cos("pitch")
    right = [-cy, sy, F.lit(0.0)]
    down = [sy * sp, cy * sp, -cp]
    ahead = [-sy * cp, -cy * cp, -sp]
    pos = [F.col("px"), F.col("py"), F.col("pz")]
    rows = [F.array(*r, -G.total(a * b for a, b in zip(r, pos, strict=True))) for r in (right, down, ahead)]
    return v.withColumns({f"e{i}": r for i, r in enumerate(rows)})


def to_cv_extrinsics(matrix: str) -> list[list[Column]]:
    """World-to-camera from a camera-to-world matrix column: second and third columns flipped, then inverted."""
    m = [[F.col(matrix)[i][j] * (-1.0 if j in (1, 2) else 1.0) for j in range(4)] for i in range(3)]
    return G.rotation_free_inverse(m)


def project(points: DataFrame, views: DataFrame, asset: str, focal: Column) -> DataFrame:
    """Each point in each view of its asset: uv in [-1, 1] (not clipped) and depth.

    Views are made by exploding, so Spark takes them for fewer than they are: they are merged, not broadcast.
    """
    j = points.join(views.hint("merge"), asset)
    cam = [G.total([F.col(f"e{i}")[k] * F.col(a) for k, a in enumerate(XYZ)]) + F.col(f"e{i}")[3] for i in range(3)]
    j = j.withColumns({"_x": cam[0], "_y": cam[1], "depth": cam[2]})
    uv = {n: (F.col(f"_{a}") / F.col("depth") * focal + 0.5) * 2 - 1 for n, a in (("u", "x"), ("v", "y"))}
    return j.withColumns(uv).drop("_x", "_y")


def token_grids(tokens: DataFrame, asset: str, size: int) -> DataFrame:
    """Per asset a map from each view to its flat token grid (row * size + col), zeros where no token is."""
    inside = tokens.where(f"row between 0 and {size - 1} and col between 0 and {size - 1}")
    cell = (F.col("row") * size + F.col("col")).cast("int")
    each = inside.groupBy(asset, "view", cell.alias("_k")).agg(F.sum("token").alias("_t"))
    held = each.groupBy(asset, "view").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_t"))).alias("_m"))
    flat = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)))
    return held.select(asset, F.struct("view", flat.alias("g")).alias("_e")).groupBy(asset).agg(F.map_from_entries(F.collect_list("_e")).alias("_grids"))


def fuse_views(projected: DataFrame, tokens: DataFrame, asset: str, point: str | list[str], size: int, half: bool = False) -> DataFrame:
    """Mean over views of the bilinear sample of each view's token grid (asset, view, row, col, token); zeros outside.

    ``point`` names one or several columns; with ``half`` the means are of half precision. The
    grids of an asset come to its points in one row, by a merge join: what an explode makes
    is larger than Spark's estimate of it, and must not be broadcast.
    """
    point = [point] if isinstance(point, str) else point
    at = {n: ((F.col(c) + 1) * size - 1) / 2 for n, c in (("_c", "u"), ("_r", "v"))}
    p = projected.select(asset, *point, "view", *[c.alias(n) for n, c in at.items()])
    p = p.join(token_grids(tokens, asset, size).hint("merge"), asset, "left")

    def tap(i: int, j: int) -> Column:
        row, col = F.floor("_r") + i, F.floor("_c") + j
        w = (1 - F.abs(F.col("_r") - F.floor("_r") - i)) * (1 - F.abs(F.col("_c") - F.floor("_c") - j))
        inside = row.between(0, size - 1) & col.between(0, size - 1)
        return w * F.coalesce(F.when(inside, F.get(F.try_element_at("_grids", F.col("view")), (row * size + col).cast("int"))), F.lit(0.0))

    rows = p.select(asset, *point, "view", G.total(tap(i, j) for i in (0, 1) for j in (0, 1)).alias("s"))
    per = rows.groupBy(asset, *point, "view").agg(F.sum("s").alias("s"))
    mean = G.to_half(F.avg("s")) if half else F.avg("s")
    return per.groupBy(asset, *point).agg(mean.alias("feature"), F.count("*").alias("views"))


def alpha_crop_box(pixels: DataFrame, asset: str, threshold: float, padding: float = 1.2) -> DataFrame:
    """Square box around pixels over the threshold, padded, truncated to whole pixels."""
    b = pixels.where(F.col("alpha") > threshold).groupBy(asset).agg(*[f(c).alias(n) for c, n, f in (("col", "x0", F.min), ("row", "y0", F.min), ("col", "x1", F.max), ("row", "y1", F.max))])
    size = (F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * padding).cast("int")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return b.select(asset, *[(c + s * size / 2).cast("int").alias(n) for c, s, n in ((cx, -1, "left"), (cy, -1, "top"), (cx, 1, "right"), (cy, 1, "bottom"))])


def _with_corners(grid: DataFrame, by: list[str]) -> DataFrame:
    """Each grid point with its right (b), lower (c) and diagonal (d) neighbour where they are valid."""
    base = grid.where("valid").select(*by, "row", "col", *XYZ)
    out = grid.select(*by, "row", "col", *XYZ, "valid")
    for name, i, j in (("b", 0, 1), ("c", 1, 0), ("d", 1, 1)):
        other = base.select(*by, (F.col("row") - i).alias("row"), (F.col("col") - j).alias("col"), F.struct(*XYZ).alias(name))
        out = out.join(other, [*by, "row", "col"], "left")
    return out.withColumn("a", F.when(F.col("valid"), F.struct(*XYZ)))


def densify_grid(grid: DataFrame, by: list[str]) -> DataFrame:
    """Valid points, centres of full quads, midpoints to the right and below; ``kind`` 0 to 3."""
    g = _with_corners(grid, by)
    mean = lambda *k: F.struct(*[(G.total(F.col(f"{c}.{a}") for c in k) / len(k)).alias(a) for a in XYZ])
    have = lambda *k: G.total(F.col(c).isNotNull().cast("int") for c in k) == len(k)
    parts = [("a",), ("a", "b", "c", "d"), ("a", "c"), ("a", "b")]
    rows = F.array(*[F.when(have(*k), F.struct(F.lit(i).alias("kind"), mean(*k).alias("p"))) for i, k in enumerate(parts)])
    out = g.select(*by, "row", "col", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r"))
    return out.select(*by, "row", "col", "r.kind", *[F.col(f"r.p.{a}").alias(a) for a in XYZ])


def triangulate_grid(grid: DataFrame, by: list[str]) -> DataFrame:
    """Triangles of each quad: two with four valid corners, one with three; corners as (row, col) offsets ids a, b, c, d."""
    g = _with_corners(grid, by)
    ok = {k: F.col(k).isNotNull() for k in "abcd"}
    tri = lambda *k: F.array(*[F.lit(x) for x in k])
    faces = (
        F.when(ok["a"] & ok["b"] & ok["c"] & ok["d"], F.array(tri("a", "b", "c"), tri("b", "d", "c")))
        .when(ok["a"] & ok["b"] & ok["c"], F.array(tri("a", "b", "c")))
        .when(ok["b"] & ok["d"] & ok["c"], F.array(tri("b", "d", "c")))
        .when(ok["a"] & ok["b"] & ok["d"], F.array(tri("a", "b", "d")))
        .when(ok["a"] & ok["d"] & ok["c"], F.array(tri("a", "d", "c")))
    )
    rows = g.select(*by, "row", "col", F.posexplode(faces).alias("k", "t"))
    at = {"a": (0, 0), "b": (0, 1), "c": (1, 0), "d": (1, 1)}
    key = lambda i: F.element_at(F.create_map(*[x for n, (r, c) in at.items() for x in (F.lit(n), F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")))]), F.col("t")[i])
    return rows.select(*by, "row", "col", "k", *[key(i).alias(f"v{i}") for i in range(3)])


def face_corners(faces: DataFrame, vertices: DataFrame, by: list[str]) -> DataFrame:
    """Positions p0, p1, p2 of each face's corners: faces (by, fid, i0, i1, i2), vertices (by, vid, x, y, z)."""
    out = faces
    for i in range(3):
        v = vertices.select(*by, F.col("vid").alias(f"i{i}"), F.struct(*XYZ).alias(f"p{i}"))
        out = out.join(v, [*by, f"i{i}"])
    return out


def face_normals(corners: DataFrame) -> DataFrame:
    """Cross product of two sides (nx, ny, nz), twice the area long."""
    e = lambda i: [F.col(f"p{i}.{a}") - F.col(f"p0.{a}") for a in XYZ]
    a, b = e(1), e(2)
    return corners.withColumns({"nx": a[1] * b[2] - a[2] * b[1], "ny": a[2] * b[0] - a[0] * b[2], "nz": a[0] * b[1] - a[1] * b[0]})


def vertex_normals(normals: DataFrame, by: list[str]) -> DataFrame:
    """Unit sum of the face normals around each vertex."""
    rows = normals.select(*by, F.explode(F.array("i0", "i1", "i2")).alias("vid"), "nx", "ny", "nz")
    s = rows.groupBy(*by, "vid").agg(*[F.sum(n).alias(n) for n in ("nx", "ny", "nz")], F.count("*").alias("faces"))
    length = F.greatest(F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2), F.lit(1e-12))
    return s.withColumn("_l", length).select(*by, "vid", "faces", *[(F.col(n) / F.col("_l")).alias(n) for n in ("nx", "ny", "nz")])


def mesh_edge_degree(faces: DataFrame, by: list[str]) -> DataFrame:
    """Undirected edges with the number of faces on them; 1 is a boundary."""
    pairs = F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in (("i0", "i1"), ("i1", "i2"), ("i2", "i0"))])
    e = faces.select(*by, F.explode(pairs).alias("e")).select(*by, "e.u", "e.v")
    return e.groupBy(*by, "u", "v").agg(F.count("*").alias("degree")).withColumn("boundary", F.col("degree") == 1)


def mesh_components(faces: DataFrame, by: list[str], task_faces: int = TASK_FACES) -> DataFrame:
    """Faces with ``component``: the least place, over all faces in order of ``by`` and corners, of those joined by edges.

    The dual graph links the faces of an edge in a chain, so an edge that many faces share
    brings as many links as faces. Faces that repeat are joined too. A mesh of at most
    ``task_faces`` faces is joined by one task, larger ones are a graph job.
    """
    corners = ["i0", "i1", "i2"]
    placed = cut(with_global_index(faces.select(*by, *corners), [*by, *corners], "face"))
    kinds = dict(placed.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, *corners)) + ", component long"

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("face")
        c = np.stack([t.column(i).to_numpy() for i in corners], axis=1)
        ends = np.concatenate([c[:, [0, 1]], c[:, [1, 2]], c[:, [2, 0]]])
        ends.sort(axis=1)
        order = np.lexsort((ends[:, 1], ends[:, 0]))
        same = (ends[order[1:]] == ends[order[:-1]]).all(axis=1)
        labels = local_labels(len(t), order[:-1][same] % len(t), order[1:][same] % len(t))
        return t.select([*by, *corners]).append_column("component", t.column("face").take(pa.array(labels)).cast(pa.int64()))

    many = cut(placed.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > task_faces).select(*by))
    if many.isEmpty():
        return placed.groupBy(*by).applyInArrow(run, schema)
    local = placed.join(many, by, "left_anti").groupBy(*by).applyInArrow(run, schema)
    placed = placed.join(many, by, "left_semi")
    pairs = F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in (("i0", "i1"), ("i1", "i2"), ("i2", "i0"))])
    sides = placed.select(*by, "face", F.explode(pairs).alias("e")).select(*by, "face", "e.u", "e.v")
    links = sides.withColumn("next", F.lead("face").over(Window.partitionBy(*by, "u", "v").orderBy("face"))).where("next is not null")
    found = connected_components(links.select(F.col("face").alias("u"), F.col("next").alias("v")))
    rest = placed.join(found.withColumnRenamed("node", "face"), "face", "left").withColumn("component", F.coalesce("component", "face").cast("long")).drop("face")
    return local.unionByName(rest)


def rasterize_polyline(points: DataFrame, by: list[str], order: list[str], res: int) -> DataFrame:
    """Voxels along each polyline: steps of at most half a voxel, max(2, ceil(length / step) + 1) points a segment."""
    w = Window.partitionBy(*by).orderBy(*order)
    seg = points.withColumns({f"n{a}": F.lead(a).over(w) for a in XYZ}).where("nx is not null")
    length = F.sqrt(G.total((F.col(f"n{a}") - F.col(a)) * (F.col(f"n{a}") - F.col(a)) for a in XYZ))
    seg = seg.withColumn("_l", length).where(~F.isnan("_l") & (F.col("_l") < float("inf")))
    steps = F.greatest(F.lit(2), F.ceil(F.col("_l") / (1.0 / res)) + 1).cast("int")
    p = seg.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    f = F.col("_i") / (F.col("_n") - 1)
    cells = [G.cell(F.col(a) + (F.col(f"n{a}") - F.col(a)) * f, res).alias(f"v{a}") for a in XYZ]
    return p.select(*by, *cells).distinct()


def time_schedule(df: DataFrame, steps: Column, rescale: float) -> DataFrame:
    """Consecutive (t, next) of ``steps`` steps from 1 to 0, rescaled."""
    rows = df.withColumn("_s", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    at = lambda i: G.rescale_time(1 - i / F.col("_s"), rescale)
    return rows.withColumn("t", at(F.col("i"))).withColumn("t_next", at(F.col("i") + 1)).drop("_s")
