"""Queries on voxels: ``lineitem`` rows are points, suppliers the assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.functions import geometry as G
from assetlake.operators import curation as Q
from assetlake.operators import manifest as M
from assetlake.operators import metrics as X
from assetlake.operators import points as P
from assetlake.operators import voxel as V
from assetlake.plans.registry import Registry, Tables, r6
from assetlake.session import spread, task_parts

RES = 14
_CELL = "greatest(0, least(13, CAST(floor((CAST({0} AS FLOAT)::DOUBLE + 1) / 2 * 14) AS INT)))"
_PTS = "SELECT l_suppkey AS asset, l_orderkey, l_linenumber, l_quantity, l_quantity / 25 - 1 AS x, l_discount * 20 - 1 AS y, 2 * (l_extendedprice - mn) / (mx - mn) - 1 AS z, l_returnflag || l_linestatus AS cls FROM lineitem, (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem)"
_CELLS = f"SELECT *, {_CELL.format('x')} AS vx, {_CELL.format('y')} AS vy, {_CELL.format('z')} AS vz FROM ({_PTS})"
_VOX = f"SELECT asset AS b, vx AS x, vy AS y, vz AS z, count(*)::DOUBLE AS n, sum(l_quantity) AS q FROM ({_CELLS}) GROUP BY ALL"
_OFF = "SELECT i, j, k FROM range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(k) WHERE NOT (i = 0 AND j = 0 AND k = 0)"
_COMP = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT DISTINCT b, x, y, z, x * 196 + y * 14 + z AS f FROM ({_VOX})),
e AS MATERIALIZED (SELECT v.b, v.f, w.f AS g FROM v, ({_OFF}) o JOIN v w ON w.b = v.b AND w.x = v.x + i AND w.y = v.y + j AND w.z = v.z + k),
r AS (SELECT b, f, f AS c FROM v UNION SELECT e.b, e.g, r.c FROM r JOIN e ON e.b = r.b AND e.f = r.f WHERE r.c < e.g),
comp AS (SELECT b, f, min(c) AS component FROM r GROUP BY b, f)"""
_METRICS = f"""{_COMP}, sizes AS (SELECT b, component, count(*) AS n FROM comp GROUP BY b, component),
m AS (SELECT s_suppkey AS b, count(n) AS component_count, coalesce(max(n), 0) AS largest_component_size, coalesce(sum(n), 0)::BIGINT AS total_voxels FROM supplier LEFT JOIN sizes ON b = s_suppkey GROUP BY 1),
met AS (SELECT *, CASE WHEN total_voxels > 0 THEN largest_component_size / total_voxels ELSE 0.0::DOUBLE END AS largest_component_ratio, CASE WHEN total_voxels > 0 THEN 1 - largest_component_size / total_voxels ELSE 0.0::DOUBLE END AS small_component_ratio FROM m)"""
_REASON = "CASE WHEN total_voxels = 0 THEN 'empty_voxel_grid' WHEN component_count > 20 THEN 'too_many_voxel_components' WHEN largest_component_ratio BETWEEN 0.25::DOUBLE AND 0.28::DOUBLE AND component_count >= 12 THEN 'low_largest_component_ratio' WHEN small_component_ratio > 0.7::DOUBLE THEN 'too_many_small_components' END"
_R6 = "round({0}, 6) + 0.0"

R = Registry(pts=_PTS, cells=_CELLS, vox=_VOX, off=_OFF, comp=_COMP, metrics=_METRICS, reason=_REASON)
QUERIES, ORACLES = R.queries, R.oracles


def points(t: Tables):
    span = t.lineitem.agg(F.min("l_extendedprice").alias("mn"), F.max("l_extendedprice").alias("mx"))
    li = t.lineitem.crossJoin(F.broadcast(span))  # one row
    z = 2 * (F.col("l_extendedprice") - F.col("mn")) / (F.col("mx") - F.col("mn")) - 1
    return li.select(F.col("l_suppkey").alias("asset"), "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_quantity") / 25 - 1).alias("x"), (F.col("l_discount") * 20 - 1).alias("y"), z.alias("z"), F.concat("l_returnflag", "l_linestatus").alias("cls"))


def voxels(t: Tables):
    """b, x, y, z and feats = [points, quantity]; an asset's voxels are in one part."""
    p = spread(V.cells(points(t), RES).select("asset", "vx", "vy", "vz", "l_quantity"), t.lineitem.count(), "asset")
    keys = [F.col("asset").alias("b"), *[F.col(f"v{a}").alias(a) for a in "xyz"]]
    return p.groupBy(*keys).agg(F.array(F.count("*").cast("double"), F.sum("l_quantity")).alias("feats"))


def wide(df, *names):
    return df.select(*[c for c in df.columns if c != "feats"], *[r6(F.col("feats")[i]).alias(n) for i, n in enumerate(names)])


@R.query("voxelize", "SELECT asset, vx AS x, vy AS y, vz AS z, count(*) AS n FROM (<cells>) GROUP BY ALL")
def voxelize(t):
    return V.voxelize(points(t), RES)


@R.query("voxel_groups", "SELECT asset, vx, vy, vz, cls, count(*) AS n, arg_min(round(z, 6) + 0.0, (l_orderkey, l_linenumber)) AS first_z FROM (<cells>) GROUP BY ALL")
def voxel_groups(t):
    g = V.group_points(points(t), RES, ["l_orderkey", "l_linenumber"])
    return g.select("asset", "vx", "vy", "vz", "cls", "n", r6(F.col("points")[0]["z"]).alias("first_z"))


CLASSES = ["AF", "AO", "NF", "NO", "RF", "RO"]


@R.query("majority_class", """WITH g AS (SELECT asset, vx, vy, vz, cls, count(*) AS n FROM (<cells>) WHERE cls <> 'AF' GROUP BY ALL), e AS (SELECT DISTINCT asset, vx, vy, vz FROM (<cells>) WHERE cls = 'AF'),
m AS (SELECT asset, vx, vy, vz, sum(n)::BIGINT AS n, first(cls ORDER BY n DESC, list_position(['AF', 'AO', 'NF', 'NO', 'RF', 'RO'], cls)) AS cls FROM g GROUP BY ALL)
SELECT m.asset, m.vx, m.vy, m.vz, m.n, CASE WHEN e.asset IS NOT NULL THEN 'AF' ELSE m.cls END AS cls FROM m LEFT JOIN e ON (e.asset, e.vx, e.vy, e.vz) = (m.asset, m.vx, m.vy, m.vz)""")
def majority_class(t):
    p = points(t)
    return V.majority_class(p.where("cls <> 'AF'"), RES, CLASSES, boundary=V.cells(p.where("cls = 'AF'"), RES)).select("asset", "vx", "vy", "vz", "n", "cls")


@R.query("voxel_center", "SELECT b, x, y, z, round((x + 0.5::DOUBLE) * 2 / 14 - 1, 6) + 0.0 AS cx, round((y + 0.5::DOUBLE) / 14 - 0.5, 6) + 0.0 AS cy, CAST(trunc(((z + 0.5::DOUBLE) / 14 - 0.5 + 0.5) * 14) AS INT) AS iz FROM (<vox>)")
def voxel_center(t):
    v = voxels(t)
    return v.select("b", "x", "y", "z", r6(G.voxel_center("x", RES)).alias("cx"), r6(G.voxel_center("y", RES, "unit")).alias("cy"), G.unit_cell(G.voxel_center("z", RES, "unit"), RES).alias("iz"))


@R.query("stencil26", "WITH v AS (<vox>) SELECT v.b, v.x, v.y, v.z, count(w.b) AS neighbours FROM v CROSS JOIN (<off>) o LEFT JOIN v w ON w.b = v.b AND w.x = v.x + i AND w.y = v.y + j AND w.z = v.z + k GROUP BY ALL")
def stencil26(t):
    v = voxels(t).select("b", "x", "y", "z")
    return V.neighbour_counts(v, task_parts(t.spark, t.lineitem.count()))


@R.query("components", "<comp> SELECT b, f AS node, component FROM comp")
def components(t):
    c = V.voxel_components(voxels(t).select("b", "x", "y", "z"), RES)
    return c.select("b", (F.col("x") * 196 + F.col("y") * 14 + F.col("z")).alias("node"), F.col("component").cast("int").alias("component"))


def metrics(t):
    v = V.cells(points(t), RES).select(F.col("asset").alias("b"), *[F.col(f"v{a}").alias(a) for a in "xyz"]).distinct()
    return V.component_metrics(v, t.supplier.select(F.col("s_suppkey").alias("b")), RES)


@R.query("component_metrics", "<metrics> SELECT b, component_count, largest_component_size, total_voxels, round(largest_component_ratio, 6) AS largest_component_ratio, round(small_component_ratio, 6) AS small_component_ratio FROM met")
def component_metrics(t):
    return metrics(t).withColumns({c: F.round(c, 6) for c in ("largest_component_ratio", "small_component_ratio")})


def _reasons(t):
    return metrics(t).select("b", Q.quality_reason(20, 0.7, (0.25, 0.28), 12).alias("reason"))


@R.query("quality_reason", "<metrics> SELECT b, <reason> AS reason FROM met")
def quality_reason(t):
    return _reasons(t)


@R.query("reason_counts", "<metrics>, q AS (SELECT b % 3 AS shard, coalesce(<reason>, 'kept') AS reason FROM met) SELECT shard, reason, count(*) AS n FROM q GROUP BY ROLLUP (shard, reason)")
def reason_counts(t):
    return Q.status_counts(_reasons(t).withColumn("shard", F.col("b") % 3), "shard", "reason")


@R.query("downsample", "SELECT b, x // 2 AS x, y // 2 AS y, z // 4 AS z, round(avg(n), 6) AS n, round(avg(q), 6) AS q FROM (<vox>) GROUP BY ALL")
def downsample(t):
    return wide(V.downsample(voxels(t), (2, 2, 4), 2), "n", "q")


@R.query("upsample", "WITH v AS (<vox>), p AS (SELECT b, x // 2 AS x, y // 2 AS y, z // 2 AS z, avg(n) AS n, avg(q) AS q FROM v GROUP BY ALL) SELECT v.b, v.x, v.y, v.z, round(p.n, 6) AS n, round(p.q, 6) AS q FROM v JOIN p ON p.b = v.b AND p.x = v.x // 2 AND p.y = v.y // 2 AND p.z = v.z // 2")
def upsample(t):
    v = voxels(t)
    return wide(V.upsample(v, V.downsample(v, (2, 2, 2), 2), 2), "n", "q")


@R.query("subdivide", "SELECT b, x * 2 + i AS x, y * 2 + j AS y, z * 2 + k AS z, n, q FROM (<vox>), range(2) a(i), range(2) e(j), range(2) c(k)", x="INT", y="INT", z="INT")
def subdivide(t):
    return wide(V.subdivide(voxels(t)), "n", "q")


@R.query("cube_verts", "SELECT b, x + i AS x, y + j AS y, z + k AS z, count(*) AS k, round(avg(n), 6) AS n, round(avg(q), 6) AS q, round(var_pop(n), 6) + 0.0 AS vn FROM (<vox>), range(2) a(i), range(2) e(j), range(2) c(k) GROUP BY ALL", x="INT", y="INT", z="INT")
def cube_verts(t):
    return wide(V.cubes_to_verts(voxels(t), 2).withColumn("vn", r6(F.col("variance")[0])).drop("variance"), "n", "q")


@R.query("batch_broadcast", "SELECT b, x, y, z, round(n * s_acctbal, 6) + 0.0 AS n, round(q * s_acctbal, 6) + 0.0 AS q FROM (<vox>) JOIN supplier ON s_suppkey = b")
def batch_broadcast(t):
    per = t.supplier.select(F.col("s_suppkey").alias("b"), "s_acctbal")
    return wide(V.batch_broadcast(voxels(t), per, "s_acctbal", lambda x, v: x * v), "n", "q")


@R.query("coord_elementwise", "WITH v AS (<vox>), w AS (SELECT b - 1 AS b, x, y, z, n, q FROM v) SELECT v.b, v.x, v.y, v.z, round(-(v.n + 2 * w.n), 6) + 0.0 AS n, round(-(v.q + 2 * w.q), 6) + 0.0 AS q FROM v JOIN w ON (w.b, w.x, w.y, w.z) = (v.b, v.x, v.y, v.z)")
def coord_elementwise(t):
    v = voxels(t)
    return wide(V.negate(V.elementwise(v, V.scalar(v.withColumn("b", F.col("b") - 1), 2.0, "mul"), "add")), "n", "q")


@R.query("full_grid", "SELECT b::INT AS b, x::INT AS x, y::INT AS y, z::INT AS z, 0.5::DOUBLE AS v FROM range((SELECT count(*) FROM supplier)) a(b), range(0, 4) c(x), range(1, 4) d(y), range(2, 4) e(z)")
def full_grid(t):
    batches = M.with_global_index(t.supplier.select("s_suppkey"), ["s_suppkey"], "b")
    return wide(V.full_grid_of(batches, (0, 1, 2), (3, 3, 3), 1, 0.5), "v")


@R.query("dense_roundtrip", "SELECT b, x, y, z, n FROM (<vox>)")
def dense_roundtrip(t):
    v = voxels(t)
    return wide(V.from_dense(V.to_dense(v, RES, F.col("feats")[0]), RES), "n")


@R.query("coalesce_voxels", "WITH v AS (<vox>) SELECT b % 5 AS b, x, y, z, sum(n) AS n, sum(q) AS q FROM v GROUP BY ALL")
def coalesce_voxels(t):
    return wide(V.coalesce_duplicates(voxels(t).withColumn("b", F.col("b") % 5), 2), "n", "q")


_TAP = "SELECT t::INT AS t, unnest([{'pos': CAST(floor(s) AS INT), 'w': 1 - (s - floor(s))}, {'pos': least(CAST(floor(s) AS INT) + 1, 13), 'w': s - floor(s)}], recursive := true) FROM (SELECT t, greatest((t + 0.5::DOUBLE) * (14 / 6) - 0.5, 0.0::DOUBLE) AS s FROM range(6) r(t))"


@R.query("regrid", f"""WITH v AS (<vox>), tap AS (SELECT t, pos, sum(w) AS w FROM ({_TAP}) GROUP BY t, pos)
SELECT v.b, a.t AS tx, c.t AS ty, d.t AS tz, round(sum(a.w * c.w * d.w * v.n), 5) + 0.0 AS v FROM v JOIN tap a ON a.pos = v.x JOIN tap c ON c.pos = v.y JOIN tap d ON d.pos = v.z WHERE a.w * c.w * d.w > 0 GROUP BY ALL""")
def regrid(t):
    return V.regrid(voxels(t), RES, 6, F.col("feats")[0]).where("v > 0").withColumn("v", F.round("v", 5) + F.lit(0.0))


_Z = " + ".join(f"((({{0}} >> {i}) & 1) << {{1}})".replace("{1}", str(3 * i)) for i in range(10))
_ZORDER = f"((({_Z.replace('{0}', 'x')}) << 2) + (({_Z.replace('{0}', 'y')}) << 1) + ({_Z.replace('{0}', 'z')}))"


@R.query("zorder", f"SELECT b, x, y, z, {_ZORDER} AS code FROM (<vox>)")
def zorder(t):
    return voxels(t).select("b", "x", "y", "z", G.zorder_code("x", "y", "z").alias("code"))


@R.query("serialize_windows", f"""WITH v AS (SELECT b, x, y, z, row_number() OVER (PARTITION BY b ORDER BY {_ZORDER}, x, y, z) - 1 AS position, count(*) OVER (PARTITION BY b) AS n FROM (<vox>)),
w AS (SELECT b, n, k, unnest(range(k)) AS win FROM (SELECT DISTINCT b, n, CAST(ceil(n / 32) AS BIGINT) AS k FROM v)),
s AS (SELECT b, n, win, k, floor(win * (n / k)) AS lo, floor((win + 1) * (n / k)) AS hi, CASE WHEN k = 1 THEN 0 ELSE floor((win + 0.5::DOUBLE) * (n / k) - 16) END AS begin, unnest(range(CASE WHEN k = 1 THEN n ELSE 32 END)) AS slot FROM w),
p AS (SELECT b, win, slot, CAST((begin + slot + n) % n AS BIGINT) AS position, k = 1 OR (begin + slot >= lo AND begin + slot < hi) AS valid FROM s)
SELECT p.b, p.win AS "window", p.slot, p.position, p.valid, v.x, v.y, v.z FROM p JOIN v USING (b, position)""", window="INT", slot="INT", position="INT")
def serialize_windows(t):
    v = voxels(t).select("b", "x", "y", "z")
    return V.serialize_windows(v, 32, G.zorder_code("x", "y", "z")).select("b", "window", "slot", "position", "valid", "x", "y", "z")


@R.query("window_partition", "SELECT b, x, y, z, (x + 2) // 4 AS wx, (y + 2) // 4 AS wy, (z + 2) // 4 AS wz, row_number() OVER (PARTITION BY b, (x + 2) // 4, (y + 2) // 4, (z + 2) // 4 ORDER BY x, y, z) - 1 AS slot, count(*) OVER (PARTITION BY b, (x + 2) // 4, (y + 2) // 4, (z + 2) // 4) AS rows FROM (<vox>)", slot="INT")
def window_partition(t):
    return V.window_partition(voxels(t), 4, 2)


@R.query("cat_batches", "WITH v AS (<vox>), m AS (SELECT max(b) + 1 AS m FROM v) SELECT b, x, y, z, n, q FROM v UNION ALL SELECT b + m, x, y, z, n, q FROM v, m WHERE z < 3")
def cat_batches(t):
    v = voxels(t)
    return wide(V.cat_batches([v, v.where("z < 3")]), "n", "q")


@R.query("cat_channels", "WITH v AS (<vox>) SELECT b, x, y, z, n AS c0, q AS c1, n AS c2, q AS c3 FROM v")
def cat_channels(t):
    v = voxels(t)
    return wide(V.cat_channels(v, v), "c0", "c1", "c2", "c3")


@R.query("select_batches", "SELECT CASE b WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS b, x, y, z, n AS channel0, q AS channel1 FROM (<vox>) WHERE b IN (7, 3, 5)")
def select_batches(t):
    u = V.unbind_channels(V.select_batches(voxels(t), [7, 3, 5]))
    return u.groupBy("b", "x", "y", "z").pivot("channel", [0, 1]).agg(F.first("value")).withColumnsRenamed({"0": "channel0", "1": "channel1"})


@R.query("collate", "WITH g AS (SELECT s_suppkey AS b, s_nationkey AS grp, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS batch FROM supplier) SELECT grp AS \"group\", batch, v.b, x, y, z, n, q FROM (<vox>) v JOIN g ON g.b = v.b", batch="INT")
def collate(t):
    g = t.supplier.select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("b"))
    return wide(V.collate(voxels(t), g), "n", "q")


@R.query("replicate", "SELECT i::INT AS b, x, y, z, n, q FROM (<vox>), range(3) r(i) WHERE b = 4")
def replicate(t):
    return wide(V.replicate(voxels(t).where("b = 4"), 3).select("b", "x", "y", "z", "feats"), "n", "q")


@R.query("replicate_all", "SELECT i::INT AS b, v.b AS was, x, y, z, n, q FROM (<vox>) v, range(3) r(i)")
def replicate_all(t):
    """Every batch three times."""
    return wide(V.replicate(voxels(t).withColumn("was", F.col("b")), 3).select("b", "was", "x", "y", "z", "feats"), "n", "q")


@R.query("batch_layout", "WITH c AS (SELECT i::INT AS b, count(v.b) AS n FROM range((SELECT max(b) + 1 FROM (<vox>))) r(i) LEFT JOIN (<vox>) v ON v.b = i GROUP BY 1) SELECT b, (sum(n) OVER (ORDER BY b) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY b))::BIGINT AS stop FROM c")
def batch_layout(t):
    return V.batch_layout(voxels(t))


@R.query("group_norm", "WITH v AS (<vox>), g AS (SELECT b, avg(n) AS mn, avg(q) AS mq, var_pop(n) AS vn, var_pop(q) AS vq FROM v GROUP BY b) SELECT v.b, x, y, z, round((n - mn) / sqrt(vn + 1e-5), 5) + 0.0 AS n, round((q - mq) / sqrt(vq + 1e-5), 5) + 0.0 AS q FROM v JOIN g ON g.b = v.b")
def group_norm(t):
    g = V.standardize_groups(voxels(t), 2, 2)
    return g.select("b", "x", "y", "z", (F.round(F.col("feats")[0], 5) + F.lit(0.0)).alias("n"), (F.round(F.col("feats")[1], 5) + F.lit(0.0)).alias("q"))


@R.query("octree_rollup", "SELECT b, d, x, y, z, sum(n) AS value, count(*) AS leaves, round(count(*) / any_value(pow(8.0, 4 - d)), 6) AS occupancy FROM (SELECT b, d::INT AS d, CAST(floor(x / pow(2, 4 - d)) AS INT) AS x, CAST(floor(y / pow(2, 4 - d)) AS INT) AS y, CAST(floor(z / pow(2, 4 - d)) AS INT) AS z, n FROM (<vox>), range(4) r(d)) GROUP BY b, d, x, y, z")
def octree_rollup(t):
    v = voxels(t).withColumn("value", F.col("feats")[0])
    return V.octree_rollup(v, 4).withColumn("occupancy", F.round("occupancy", 6))


@R.query("octree_children", """WITH v AS (<vox>), i AS (SELECT b, d::INT AS d, CAST(floor(x / pow(2, 4 - d)) AS INT) AS x, CAST(floor(y / pow(2, 4 - d)) AS INT) AS y, CAST(floor(z / pow(2, 4 - d)) AS INT) AS z, sum(n) AS value, false AS leaf FROM v, range(4) r(d) GROUP BY ALL),
a AS (SELECT * FROM i UNION ALL SELECT b, 4, x, y, z, n, true FROM v)
SELECT b, d - 1 AS d, x // 2 AS x, y // 2 AS y, z // 2 AS z, coalesce(sum(value) FILTER (leaf), 0)::DOUBLE AS leaf_sum, coalesce(sum(value) FILTER (NOT leaf), 0)::DOUBLE AS inner_sum, count(*) FILTER (leaf) AS leaves, count(*) FILTER (NOT leaf) AS inner_nodes FROM a WHERE d > 0 GROUP BY ALL""")
def octree_children(t):
    """Leaves at depth 4 and the inner nodes above them: what each parent gathers."""
    v = voxels(t).withColumn("value", F.col("feats")[0])
    inner = V.octree_rollup(v, 4).select("b", "d", "x", "y", "z", "value", F.lit(False).alias("leaf"))
    leaves = v.select("b", F.lit(4).alias("d"), "x", "y", "z", "value", F.lit(True).alias("leaf"))
    return V.octree_children(inner.unionByName(leaves))


@R.query("octree_refine", """WITH l AS (SELECT b, 4 AS d, x, y, z, n AS value, CASE WHEN x < 8 AND y < 8 THEN -1 WHEN n > 2 THEN 1 ELSE 0 END AS mask FROM (<vox>)),
p AS (SELECT *, count(*) FILTER (WHERE mask < 0) OVER w AS asks, sum(value) OVER w AS total FROM l WINDOW w AS (PARTITION BY b, x // 2, y // 2, z // 2))
SELECT DISTINCT b, 3 AS d, x // 2 AS x, y // 2 AS y, z // 2 AS z, total AS value FROM p WHERE mask < 0 AND asks = 8
UNION ALL SELECT b, 5, x * 2 + i, y * 2 + j, z * 2 + k, value FROM p, range(2) a(i), range(2) e(j), range(2) c(k) WHERE mask > 0
UNION ALL SELECT b, d, x, y, z, value FROM p WHERE mask = 0 OR (mask < 0 AND asks < 8)""", x="INT", y="INT", z="INT")
def octree_refine(t):
    n = F.col("feats")[0]
    mask = F.when((F.col("x") < 8) & (F.col("y") < 8), -1).when(n > 2, 1).otherwise(0)
    return V.octree_refine(voxels(t).select("b", F.lit(4).alias("d"), "x", "y", "z", n.alias("value"), mask.alias("mask")), 0, 6)


@R.query("point_union", "SELECT asset, x, y, z, 0 AS label FROM (<pts>) WHERE cls <> 'AF' UNION ALL SELECT asset, x, y, z, 1 FROM (<pts>) WHERE cls = 'AF'")
def point_union(t):
    p = points(t).select("asset", "x", "y", "z", "cls")
    return P.merge_point_sources(p.where("cls <> 'AF'"), p.where("cls = 'AF'"), ["asset", "x", "y", "z"])


@R.query("label_points", "WITH m AS (SELECT asset, vx, vy, vz, first(cls ORDER BY n DESC, cls) AS label FROM (SELECT asset, vx, vy, vz, cls, count(*) AS n FROM (<cells>) GROUP BY ALL) GROUP BY ALL) SELECT c.l_orderkey, c.l_linenumber, m.label FROM (<cells>) c JOIN m ON (m.asset, m.vx, m.vy, m.vz) = (c.asset, c.vx, c.vy, c.vz)")
def label_points(t):
    p = points(t)
    return V.label_points(p, V.majority_class(p, RES, CLASSES), RES, ["l_orderkey", "l_linenumber"])


@R.query("minmax", "SELECT b, x, y, z, round((n - min(n) OVER (PARTITION BY b)) / (max(n) OVER (PARTITION BY b) - min(n) OVER (PARTITION BY b) + 1e-8), 6) + 0.0 AS v, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (sqrt(n * n + q * q) - 10) / 90)).round(6) + 0.0 AS w FROM (<vox>)")
def minmax(t):
    n, q = F.col("feats")[0], F.col("feats")[1]
    fixed = X.minmax_scale(F.sqrt(n * n + q * q), bounds=(10, 100))
    return voxels(t).select("b", "x", "y", "z", r6(X.minmax_scale(n, ["b"])).alias("v"), r6(fixed).alias("w"))


@R.query("restore_world", "SELECT l_orderkey, l_linenumber, round(x * greatest(ex, greatest(ey, ez)) / 2 + cx, 6) + 0.0 AS wx, round(y * greatest(ex, greatest(ey, ez)) / 2 + cy, 6) + 0.0 AS wy, round(z * greatest(ex, greatest(ey, ez)) / 2 + cz, 6) + 0.0 AS wz FROM (<pts>) p JOIN (SELECT s_suppkey, s_nationkey + 1.0::DOUBLE AS ex, 2.0::DOUBLE AS ey, 0.5::DOUBLE AS ez, s_nationkey / 2 AS cx, 1.0::DOUBLE AS cy, -0.25::DOUBLE AS cz FROM supplier) s ON s_suppkey = asset")
def restore_world(t):
    k = F.col("s_nationkey").cast("double")
    box = t.supplier.select(F.col("s_suppkey").alias("asset"), (k / 2 - (k + 1) / 2).alias("lo_x"), F.lit(0.0).alias("lo_y"), F.lit(-0.5).alias("lo_z"), (k / 2 + (k + 1) / 2).alias("hi_x"), F.lit(2.0).alias("hi_y"), F.lit(0.0).alias("hi_z"))
    from assetlake.operators.points import restore_world as op

    return op(points(t), box, "asset").select("l_orderkey", "l_linenumber", *[r6(f"w{a}").alias(f"w{a}") for a in "xyz"])


_BOX = "SELECT asset, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM (<pts>) GROUP BY asset".replace("<pts>", _PTS)


@R.query("bounds", f"SELECT asset, round((x0 + x1) / 2, 6) + 0.0 AS cx, round((y0 + y1) / 2, 6) + 0.0 AS cy, round((z0 + z1) / 2, 6) + 0.0 AS cz, round(greatest(0.05::DOUBLE, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2 + (z1 - z0) ** 2) / 2), 6) AS radius, round(greatest(1e-3::DOUBLE, 0.55 * greatest(x1 - x0, greatest(y1 - y0, z1 - z0))), 6) AS cube FROM ({_BOX})")
def bounds(t):
    from assetlake.operators.points import bounds as op

    return op(points(t), "asset").select("asset", *[r6(c).alias(c) for c in ("cx", "cy", "cz", "radius", "cube")])


@R.query("unit_cube", f"SELECT l_orderkey, l_linenumber, round(least(0.499999::DOUBLE, greatest(-0.499999::DOUBLE, (p.x - (x0 + x1) / 2) / s)), 6) + 0.0 AS ux, round(least(0.499999::DOUBLE, greatest(-0.499999::DOUBLE, (p.z - (z0 + z1) / 2) / s)), 6) + 0.0 AS uz FROM (<pts>) p JOIN (SELECT *, greatest(x1 - x0, greatest(y1 - y0, z1 - z0)) AS s FROM ({_BOX})) b ON b.asset = p.asset")
def unit_cube(t):
    from assetlake.operators.points import normalize_unit_cube as op

    return op(points(t), "asset").select("l_orderkey", "l_linenumber", r6("ux").alias("ux"), r6("uz").alias("uz"))


@R.query("type_map", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN 'PLANE' WHEN 1 THEN 'CYLINDER' WHEN 2 THEN 'CONE' WHEN 3 THEN 'SPHERE' WHEN 4 THEN 'TORUS' ELSE 'BSPLINE_SURFACE' END AS face_type FROM lineitem")
def type_map(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", G.face_type_name(F.col("l_linenumber") % 7).alias("face_type"))


@R.query("crop_box", """WITH p AS (SELECT asset, vx AS r, vz AS c, count(*) AS a FROM (<cells>) GROUP BY ALL), b AS (SELECT asset, min(c) AS x0, min(r) AS y0, max(c) AS x1, max(r) AS y1 FROM p WHERE a > 2 GROUP BY asset),
s AS (SELECT asset, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, greatest(x1 - x0, y1 - y0) AS size FROM b)
SELECT asset, CAST(trunc(cx - trunc(size * 1.2::DOUBLE) / 2) AS INT) AS "left", CAST(trunc(cy - trunc(size * 1.2::DOUBLE) / 2) AS INT) AS top, CAST(trunc(cx + trunc(size * 1.2::DOUBLE) / 2) AS INT) AS "right", CAST(trunc(cy + trunc(size * 1.2::DOUBLE) / 2) AS INT) AS bottom FROM s""")
def crop_box(t):
    from assetlake.operators.views import alpha_crop_box as op

    pixels = V.cells(points(t), RES).groupBy("asset", F.col("vx").alias("row"), F.col("vz").alias("col")).agg(F.count("*").alias("alpha"))
    return op(pixels, "asset", 2)


@R.query("class_color", "SELECT cls, list_position(['AF', 'AO', 'NF', 'NO', 'RF', 'RO'], cls) - 1 AS class_id, count(*) AS n FROM (<pts>) GROUP BY ALL", class_id="BIGINT")
def class_color(t):
    ids = G.class_id(F.col("cls"), CLASSES)
    return points(t).groupBy("cls").agg(F.count("*").alias("n")).select("cls", ids.alias("class_id"), "n")


@R.query("prefilter_reason", """WITH i AS (SELECT l_suppkey AS solid, l_partkey % 5 AS face, l_orderkey % 4 AS edge, count(*) % 3 <> 0 AS hit FROM lineitem GROUP BY ALL),
f AS (SELECT solid, count(*) AS faces, bool_or(NOT a) AS bare FROM (SELECT solid, face, bool_or(hit) AS a FROM i GROUP BY ALL) GROUP BY 1), e AS (SELECT solid, count(*) AS edges, bool_or(k <> 2) AS non FROM (SELECT solid, edge, count(*) FILTER (WHERE hit) AS k FROM i GROUP BY ALL) GROUP BY 1)
SELECT s_suppkey AS solid, CASE WHEN s_suppkey % 11 = 0 THEN 'dataset_err' WHEN s_suppkey % 7 = 0 THEN 'scaled_unique_false' WHEN coalesce(faces, 0) = 0 THEN 'empty_face_edge_incidence' WHEN bare THEN 'face_without_edges' WHEN s_suppkey % 2 = 0 AND non THEN 'non_manifold_edge_incidence' WHEN edges > 3 AND s_suppkey % 3 = 0 THEN 'too_many_edges' WHEN s_acctbal < 2000 THEN 'degenerate_face_bbox' WHEN s_acctbal > 8000 THEN 'degenerate_edge_bbox' END AS reason
FROM supplier LEFT JOIN f ON f.solid = s_suppkey LEFT JOIN e ON e.solid = s_suppkey""")
def prefilter_reason(t):
    inc = t.lineitem.groupBy(F.col("l_suppkey").alias("solid"), (F.col("l_partkey") % 5).alias("face"), (F.col("l_orderkey") % 4).alias("edge")).agg((F.count("*") % 3 != 0).alias("on"))
    k = F.col("solid")
    s = t.supplier.select(F.col("s_suppkey").alias("solid"), "s_acctbal").join(Q.incidence_summary(inc), "solid", "left")
    s = s.withColumns({"err": k % 11 == 0, "scaled_unique": k % 7 != 0, "rank": F.lit(2), "flat_face": F.col("s_acctbal") < 2000, "flat_edge": F.col("s_acctbal") > 8000, "non_manifold": (k % 2 == 0) & F.col("non_manifold"), "edges": F.when(k % 3 == 0, F.col("edges")).otherwise(0)})
    return s.select("solid", Q.prefilter_reason(3).alias("reason"))
