"""Queries on point clouds: each embedding is an asset of 21 points."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlake.functions import geometry as G
from assetlake.operators import points as P
from assetlake.plans.registry import Registry, Tables, r6
from assetlake.session import cut, materialize

_PTS = "SELECT vec_id AS asset, s::INT AS slot, embedding[3*s+1]::DOUBLE AS x, embedding[3*s+2]::DOUBLE AS y, embedding[3*s+3]::DOUBLE AS z, (s % 3)::INT AS cls, label FROM embeddings, range(21) r(s)"
_KNN = f"SELECT * FROM (SELECT a.asset, a.slot, b.slot AS nid, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2, row_number() OVER (PARTITION BY a.asset, a.slot ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.slot) AS r FROM ({_PTS}) a JOIN ({_PTS}) b ON a.asset = b.asset) WHERE r <= 6"
_ANGLE = "degrees(acos(least(1.0::DOUBLE, abs(p.y*q.y + p.z*q.z + p.x*q.x) / (greatest(sqrt(p.y*p.y + p.z*p.z + p.x*p.x), 1e-12::DOUBLE) * greatest(sqrt(q.y*q.y + q.z*q.z + q.x*q.x), 1e-12::DOUBLE)))))"
_CELL = "CAST(floor((CAST({0} AS FLOAT)::DOUBLE + 1) / 2 * 14) AS INT)"
_CKNN = f"SELECT * FROM (SELECT a.asset, a.cls, a.slot, b.slot AS nid, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2, row_number() OVER (PARTITION BY a.asset, a.slot ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.slot) AS r FROM ({_PTS}) a JOIN ({_PTS}) b ON a.asset = b.asset AND a.cls = b.cls) WHERE r <= 5"
_EDGES = f"""k AS MATERIALIZED ({_CKNN}), sc AS (SELECT asset, slot, greatest(sqrt(max(d2)), 1e-6::DOUBLE) AS scale FROM k GROUP BY ALL),
pts AS ({_PTS}), edges AS MATERIALIZED (SELECT k.asset, k.cls, k.slot AS id, k.nid FROM k JOIN pts p ON p.asset = k.asset AND p.slot = k.slot JOIN pts q ON q.asset = k.asset AND q.slot = k.nid JOIN sc s1 ON s1.asset = k.asset AND s1.slot = k.slot JOIN sc s2 ON s2.asset = k.asset AND s2.slot = k.nid
WHERE k.nid > k.slot AND sqrt(d2) <= greatest(s1.scale, s2.scale) * 0.9::DOUBLE AND greatest(abs({_CELL.format('p.x')} - {_CELL.format('q.x')}), abs({_CELL.format('p.y')} - {_CELL.format('q.y')}), abs({_CELL.format('p.z')} - {_CELL.format('q.z')})) <= 3 AND {_ANGLE} <= 60
AND (k.cls <> 0 OR abs(abs(p.x) - abs(q.x)) <= 0.2::DOUBLE) AND (k.cls <> 1 OR abs(abs(p.y) - abs(q.y)) / greatest(abs(p.y), abs(q.y), 1e-6::DOUBLE) <= 0.9::DOUBLE))"""
_PATCH = f"""WITH RECURSIVE {_EDGES}, both_ AS (SELECT asset, id, nid FROM edges UNION ALL SELECT asset, nid, id FROM edges),
reach AS (SELECT asset, slot AS id, slot AS c FROM pts UNION SELECT r.asset, b.nid, r.c FROM reach r JOIN both_ b ON b.asset = r.asset AND b.id = r.id),
comp AS (SELECT asset, id, min(c) AS component FROM reach GROUP BY ALL), named AS (SELECT c.*, p.cls FROM comp c JOIN pts p ON p.asset = c.asset AND p.slot = c.id),
big AS (SELECT asset, cls, component, dense_rank() OVER (PARTITION BY asset ORDER BY cls, component) - 1 AS patch_id FROM named GROUP BY asset, cls, component HAVING count(*) >= 3),
patches AS (SELECT n.asset, n.cls, n.id, coalesce(b.patch_id, -1) AS patch_id FROM named n LEFT JOIN big b ON b.asset = n.asset AND b.component = n.component)"""

R = Registry(pts=_PTS, knn=_KNN, angle=_ANGLE, edges=_EDGES, patch=_PATCH)
QUERIES, ORACLES = R.queries, R.oracles


def points(t: Tables):
    e = t.embeddings.select(F.col("vec_id").alias("asset"), "embedding", "label", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("slot"))
    at = lambda i: F.col("embedding")[F.col("slot") * 3 + i].cast("double")
    return e.select("asset", "slot", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), (F.col("slot") % 3).alias("cls"), "label")


def cloud(t: Tables):
    """Points with id, normal (coordinates turned round), curvature, radius and cell."""
    p = points(t).withColumn("id", F.col("slot"))
    return p.withColumns({"normal": F.array("y", "z", "x"), "curvature": F.abs("x"), "radius": F.abs("y"), **{f"v{a}": F.floor((F.col(a).cast("float").cast("double") + 1) / 2 * 14).cast("int") for a in "xyz"}})


@R.query("flat_index", "SELECT asset, slot, f AS flat, f // 196 AS cx, (f // 14) % 14 AS cy, f % 14 AS cz FROM (SELECT asset, slot, greatest(0, least(13, {0})) * 196 + greatest(0, least(13, {1})) * 14 + greatest(0, least(13, {2})) AS f FROM (<pts>))".replace("{0}", _CELL.format("x")).replace("{1}", _CELL.format("y")).replace("{2}", _CELL.format("z")), flat="BIGINT")
def flat_index(t):
    p = points(t).withColumn("flat", G.flat_index("x", "y", "z", 14))
    x, y, z = G.flat_to_coords("flat", 14)
    return p.select("asset", "slot", "flat", x.alias("cx"), y.alias("cy"), z.alias("cz"))


@R.query("valid_points", "SELECT asset, slot FROM (<pts>) WHERE x BETWEEN -0.2::DOUBLE AND 0.2::DOUBLE AND y BETWEEN -0.2::DOUBLE AND 0.2::DOUBLE AND z BETWEEN -0.2::DOUBLE AND 0.2::DOUBLE")
def valid_points(t):
    return P.valid_points(points(t), 0.2).select("asset", "slot")


@R.query("in_bounds", "SELECT asset, slot, x, y, z FROM (SELECT asset, slot, CAST(floor(x * 40) AS INT) AS x, CAST(floor(y * 40) AS INT) AS y, CAST(floor(z * 40) AS INT) AS z FROM (<pts>)) WHERE x >= 0 AND x < 5 AND y >= 0 AND y < 5 AND z >= 0 AND z < 5")
def in_bounds(t):
    from assetlake.operators.voxel import in_bounds as op

    return op(points(t).select("asset", "slot", *[F.floor(F.col(a) * 40).cast("int").alias(a) for a in "xyz"]), 5)


@R.query("dedup_first", "SELECT asset, qx, qy, qz, min(slot) AS slot FROM (SELECT *, CAST(round_even(x / 0.25, 0) AS BIGINT) AS qx, CAST(round_even(y / 0.25, 0) AS BIGINT) AS qy, CAST(round_even(z / 0.25, 0) AS BIGINT) AS qz FROM (<pts>)) GROUP BY ALL")
def dedup_first(t):
    d = P.dedup_first(points(t), 0.25, ["asset"], ["slot"])
    return d.select("asset", *P.quantised(0.25), "slot")


@R.query("dedup_mean", """WITH p AS (SELECT *, CAST(round_even(x / 0.25, 0) AS BIGINT) AS qx, CAST(round_even(y / 0.25, 0) AS BIGINT) AS qy, CAST(round_even(z / 0.25, 0) AS BIGINT) AS qz, slot % 5 AS voxel FROM (<pts>)),
c AS (SELECT asset, qx, qy, qz, first(cls ORDER BY (cls <> 0) DESC, n DESC, cls) AS cls FROM (SELECT asset, qx, qy, qz, cls, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL), v AS (SELECT asset, qx, qy, qz, first(voxel ORDER BY n DESC, voxel) AS voxel FROM (SELECT asset, qx, qy, qz, voxel, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL)
SELECT p.asset, p.qx, p.qy, p.qz, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z, count(*) AS source_count, any_value(c.cls) AS cls, any_value(v.voxel) AS voxel FROM p JOIN c USING (asset, qx, qy, qz) JOIN v USING (asset, qx, qy, qz) GROUP BY p.asset, p.qx, p.qy, p.qz""")
def dedup_mean(t):
    m = P.merge_duplicates(points(t).withColumn("voxel", F.col("slot") % 5), 0.25, "asset")
    return m.withColumns({a: r6(a) for a in "xyz"})


@R.query("explode_samples", "SELECT asset, CAST(label AS INT) AS voxel, slot FROM (SELECT *, row_number() OVER (PARTITION BY asset, CAST(round_even(x / 0.05, 0) AS BIGINT), CAST(round_even(y / 0.05, 0) AS BIGINT), CAST(round_even(z / 0.05, 0) AS BIGINT) ORDER BY slot) AS k FROM (<pts>) WHERE abs(x) <= 0.3::DOUBLE AND abs(y) <= 0.3::DOUBLE AND abs(z) <= 0.3::DOUBLE) WHERE k = 1")
def explode_samples(t):
    p = points(t).withColumn("voxel", F.col("label").cast("int"))
    return P.explode_samples(p, 0.05, ["asset", "voxel"], "slot", 0.3).select("asset", "voxel", "slot")


@R.query("knn_embeddings", "SELECT asset, slot, nid, r, round(sqrt(d2), 6) AS dist FROM (<knn>)", r="INT")
def knn_embeddings(t):
    k = P.knn(points(t).withColumn("id", F.col("slot")), ["asset"], 6)
    return k.select("asset", F.col("id").alias("slot"), "nid", "r", F.round(F.sqrt("d2"), 6).alias("dist"))


_NN = "SELECT a.asset, a.cls, a.slot, arg_min(b.slot, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS nid, sqrt(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS dist FROM (<pts>) a JOIN (<pts>) b ON a.asset = b.asset AND a.cls = b.cls AND a.slot % 2 = 0 AND b.slot % 2 = 1 GROUP BY ALL".replace("<pts>", _PTS)


def nearest(t: Tables):
    p = cloud(t)
    return P.grid_knn(p.where("slot % 2 = 0"), p.where("slot % 2 = 1"), ["asset", "cls"], 1)


@R.query("nn_by_label", f"SELECT asset, cls, slot, nid, round(dist, 6) AS dist FROM ({_NN})")
def nn_by_label(t):
    return nearest(t).select("asset", "cls", F.col("id").alias("slot"), "nid", F.round(F.sqrt("d2"), 6).alias("dist"))


@R.query("angle_report", f"""WITH m AS (SELECT n.*, <angle> AS angle FROM ({_NN}) n JOIN (<pts>) p ON p.asset = n.asset AND p.slot = n.slot JOIN (<pts>) q ON q.asset = n.asset AND q.slot = n.nid), c AS (SELECT unnest([0, 1, 2, 3, NULL])::INT AS cls),
g AS (SELECT cls, count(*) AS n, round(avg(dist), 6) AS mean_dist, round(quantile_cont(angle, 0.5), 5) AS median_angle, round(avg((angle <= 5)::INT), 6) AS within_5, round(avg((angle <= 10)::INT), 6) AS within_10, round(avg((angle <= 20)::INT), 6) AS within_20 FROM m GROUP BY ROLLUP (cls))
SELECT c.cls, coalesce(n, 0) AS n, mean_dist, median_angle, within_5, within_10, within_20 FROM c LEFT JOIN g ON g.cls IS NOT DISTINCT FROM c.cls""")
def angle_report(t):
    m = P.with_attributes(nearest(t), cloud(t), ["asset", "cls"], ["normal"])
    m = m.select("cls", F.sqrt("d2").alias("dist"), G.vector_angle("normal", "n_normal").alias("angle"))
    return P.angle_report(m, [0, 1, 2, 3]).withColumns({"mean_dist": F.round("mean_dist", 6), "median_angle": F.round("median_angle", 5), **{c: F.round(c, 6) for c in ("within_5", "within_10", "within_20")}})


def edges(t: Tables):
    return P.patch_edges(cloud(t), ["asset", "cls"], 5, 0.9, 3, 60.0, (0, 0.2), ((1,), 0.9))


@R.query("patch_edges", "WITH <edges> SELECT asset, cls, id, nid FROM edges")
def patch_edges(t):
    return edges(t)


def patches(t: Tables):
    return P.grow_patches(cloud(t), edges(t), "asset", 3)


@R.query("grow_patches", "<patch> SELECT asset, cls, id, patch_id FROM patches", patch_id="INT")
def grow_patches(t):
    return patches(t)


@R.query("cluster_purity", "<patch>, n AS (SELECT asset, patch_id, id % 2 AS face, count(*) AS n FROM patches WHERE patch_id >= 0 GROUP BY ALL) SELECT asset, patch_id, first(face ORDER BY n DESC, face) AS face, max(n) AS top, sum(n)::BIGINT AS size, round(max(n) / sum(n), 6) AS purity FROM n GROUP BY ALL", patch_id="INT")
def cluster_purity(t):
    p = patches(t).withColumn("face", F.col("id") % 2)
    return P.patch_purity(p, ["asset"], "patch_id", "face").withColumn("purity", F.round("purity", 6))


@R.query("face_completeness", "<patch>, b AS (SELECT asset, face, max(n) AS best FROM (SELECT asset, patch_id, id % 2 AS face, count(*) AS n FROM patches WHERE patch_id >= 0 GROUP BY ALL) GROUP BY ALL), a AS (SELECT asset, id % 2 AS face, count(*) AS points FROM patches GROUP BY ALL) SELECT a.asset, a.face, a.points, round(coalesce(b.best / a.points, 0), 6) AS completeness FROM a LEFT JOIN b ON b.asset = a.asset AND b.face = a.face")
def face_completeness(t):
    p = cut(patches(t).withColumn("face", F.col("id") % 2))
    return P.face_completeness(p, p, ["asset"], "patch_id", "face").withColumn("completeness", F.round("completeness", 6))


@R.query("stage_summary", """<patch>, n AS (SELECT asset, count(*) AS patches, round(avg(n), 6) AS mean_patch, quantile_cont(n, 0.5)::DOUBLE AS median_patch FROM (SELECT asset, patch_id, count(*) AS n FROM patches WHERE patch_id >= 0 GROUP BY ALL) GROUP BY ALL)
SELECT p.asset, count(*) FILTER (WHERE p.cls = 0) AS class_0, count(*) FILTER (WHERE p.cls = 1) AS class_1, count(*) FILTER (WHERE p.cls = 2) AS class_2, count(*) FILTER (WHERE p.x > 0) AS valid_normals, avg(p.slot % 4)::DOUBLE.round(6) AS mean_sources, round(avg(abs(p.x)), 6) AS mean_curvature, round(avg(CASE WHEN p.slot <> 3 THEN abs(p.y) END), 6) AS mean_radius, coalesce(any_value(n.patches), 0) AS patches, any_value(n.mean_patch) AS mean_patch, any_value(n.median_patch) AS median_patch
FROM pts p LEFT JOIN n ON n.asset = p.asset GROUP BY p.asset""".replace("avg(p.slot % 4)::DOUBLE.round(6)", "round(avg(p.slot % 4), 6)"))
def stage_summary(t):
    p = cloud(t).join(patches(t).select("asset", "id", "patch_id"), ["asset", "id"])
    p = p.withColumns({"normal_valid": F.col("x") > 0, "source_count": F.col("slot") % 4, "radius": F.when(F.col("slot") == 3, float("nan")).otherwise(F.col("radius"))})
    out = P.stage_summary(p, "asset", [0, 1, 2])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_sources", "mean_curvature", "mean_radius", "mean_patch")})


@R.query("pca_normals")
def pca_normals(t):
    p = cloud(t)
    n = P.estimate_normals(p, P.knn(p, ["asset"], 8), ["asset"])
    return n.select("asset", F.col("id").alias("slot"), "k", F.round("curvature", 6).alias("curvature"), F.round(G.norm("normal"), 6).alias("length"))


@R.query("refined_normals")
def refined_normals(t):
    p = cloud(t)
    pairs = P.knn(p, ["asset"], 8)
    return P.refine_normals(p, pairs, ["asset"], (1, 2), 0.5).select("asset", "slot", F.round(G.norm(G.unit("normal")), 6).alias("length"))


@R.query("neighbour_trace", "SELECT k.asset, k.slot, round(var_samp(q.x) + var_samp(q.y) + var_samp(q.z), 6) AS trace FROM (<knn>) k JOIN (<pts>) q ON q.asset = k.asset AND q.slot = k.nid GROUP BY ALL")
def neighbour_trace(t):
    p = cloud(t)
    n = p.select("asset", F.col("id").alias("nid"), "x", "y", "z")
    return P.knn(p, ["asset"], 6).join(n, ["asset", "nid"]).groupBy("asset", F.col("id").alias("slot")).agg(F.round(F.var_samp("x") + F.var_samp("y") + F.var_samp("z"), 6).alias("trace"))


@R.query("chord_radius", "WITH j AS (SELECT k.asset, k.slot, sqrt(d2) AS d, <angle> AS a FROM (<knn>) k JOIN (<pts>) p ON p.asset = k.asset AND p.slot = k.slot JOIN (<pts>) q ON q.asset = k.asset AND q.slot = k.nid WHERE k.nid <> k.slot) SELECT asset, slot, round(quantile_cont(d / (2 * sin(radians(a) / 2)), 0.5), 5) AS radius FROM j WHERE a >= 3 GROUP BY ALL")
def chord_radius(t):
    p = cloud(t)
    return P.primitive_radius(p, P.knn(p, ["asset"], 6), ["asset"]).select("asset", F.col("id").alias("slot"), F.round("radius", 5).alias("radius"))


@R.query("vector_angle", "SELECT p.asset, p.slot, round(<angle>, 5) AS angle FROM (<pts>) p JOIN (<pts>) q ON q.asset = p.asset AND q.slot = (p.slot + 1) % 21")
def vector_angle(t):
    p = cloud(t)
    q = p.select("asset", ((F.col("slot") + 20) % 21).alias("slot"), F.col("normal").alias("other"))
    return p.join(q, ["asset", "slot"]).select("asset", "slot", F.round(G.vector_angle("normal", "other"), 5).alias("angle"))


@R.query("cap_centroid", """WITH m AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM (<pts>) GROUP BY label),
r AS (SELECT p.label, p.asset, p.slot, row_number() OVER (PARTITION BY p.label ORDER BY round((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz), 12), p.asset, p.slot) - 1 AS i, count(*) OVER (PARTITION BY p.label) AS n FROM (<pts>) p JOIN m ON m.label = p.label)
SELECT label, asset, slot FROM r WHERE n <= 64 OR i IN (SELECT CASE WHEN j = 63 THEN r.n - 1 ELSE CAST(floor(j * ((r.n - 1)::DOUBLE / 63)) AS BIGINT) END FROM range(64) s(j))""")
def cap_centroid(t):
    return P.cap_by_centroid(points(t), ["label"], 64, ["asset", "slot"]).select("label", "asset", "slot")


@R.query("even_subsample", """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber FROM r WHERE n <= 100 OR i IN (SELECT CASE WHEN j = 99 THEN r.n - 1 ELSE CAST(floor(j * ((r.n - 1)::DOUBLE / 99)) AS BIGINT) END FROM range(100) s(j))""")
def even_subsample(t):
    return P.even_subsample(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], ["l_orderkey", "l_linenumber"], 100)


@R.query("farthest_points", """WITH RECURSIVE a AS (SELECT asset, list(x ORDER BY slot) AS xs, list(y ORDER BY slot) AS ys, list(z ORDER BY slot) AS zs, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM (<pts>) GROUP BY asset),
d AS (SELECT *, list_transform(range(1, 22), lambda i: (xs[i] - mx) * (xs[i] - mx) + (ys[i] - my) * (ys[i] - my) + (zs[i] - mz) * (zs[i] - mz)) AS c FROM a),
f AS (SELECT asset, xs, ys, zs, 0 AS slot, list_transform(xs, lambda x: 1e9::DOUBLE) AS best, list_position(c, list_min(c)) AS k FROM d
  UNION ALL SELECT asset, xs, ys, zs, slot + 1, best, list_position(best, list_max(best)) FROM (
    SELECT asset, xs, ys, zs, slot, list_transform(best, lambda b, i: least(b, (xs[i] - xs[k]) * (xs[i] - xs[k]) + (ys[i] - ys[k]) * (ys[i] - ys[k]) + (zs[i] - zs[k]) * (zs[i] - zs[k]))) AS best FROM f WHERE slot < 7))
SELECT asset, slot, xs[k] AS x, ys[k] AS y, zs[k] AS z FROM f""")
def farthest_points(t):
    return P.farthest_points(points(t), ["asset"], 8, ["slot"])


@R.query("metric_summary", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, max(l_extendedprice) AS max FROM lineitem GROUP BY 1")
def metric_summary(t):
    s = P.summarize(t.lineitem, "l_extendedprice", ["l_returnflag"])
    return s.withColumns({c: F.round(c, 4) for c in ("mean", "median", "p90", "p95")})


@R.query("shape_reason", "SELECT vec_id AS stem, CASE WHEN vec_id % 29 = 0 THEN 'invalid_blob' WHEN vec_id % 13 = 0 THEN 'invalid_face_grid_shape' WHEN vec_id % 17 = 0 THEN 'invalid_edge_grid_shape' WHEN vec_id % 19 = 0 THEN 'invalid_face_bbox_shape' WHEN vec_id % 23 = 0 THEN 'invalid_face_mask_shape' WHEN vec_id % 11 = 0 THEN 'face_grid_count_mismatch' WHEN vec_id % 7 = 0 THEN 'edge_bbox_count_mismatch' WHEN vec_id % 5 = 0 THEN 'face_types_count_mismatch' WHEN NOT embedding[1] > 0 THEN 'empty_face_mask' END AS reason FROM embeddings")
def shape_reason(t):
    """Shapes as a vector's number has them, the mask from its first value."""
    from assetlake.operators.curation import shape_reason as op

    odd = lambda k: (F.col("vec_id") % k == 0).cast("int")
    one = lambda k, a, b: F.when(F.col("vec_id") % k == 0, F.array(*map(F.lit, a))).otherwise(F.array(*map(F.lit, b)))
    shapes = {
        "face_points": one(13, (4, 4, 3), (4, 4, 4, 3)), "edge_points": one(17, (3, 3), (3, 8, 3)), "face_bbox": F.array(F.lit(4), 6 - odd(19)), "edge_bbox": F.array(3 + odd(7), F.lit(6)),
        "face_edge": F.array(4 + odd(11), F.lit(3)), "face_mask": one(23, (4,), (4, 4, 4)), "face_types": F.array(4 - odd(5)),
    }
    rows = t.embeddings.select("vec_id", (F.col("vec_id") % 29 == 0).alias("invalid"), (F.col("embedding")[0] > 0).alias("any_mask"), *[s.alias(f"{n}_shape") for n, s in shapes.items()])
    return rows.select(F.col("vec_id").alias("stem"), op().alias("reason"))


_PARTS = "SELECT l_suppkey AS asset, l_orderkey * 8 + l_linenumber AS id, min(l_quantity)::DOUBLE AS x, min(l_discount * 100)::DOUBLE AS y, min(l_tax * 100)::DOUBLE AS z FROM lineitem GROUP BY ALL"


@R.query("knn_parts", f"WITH p AS ({_PARTS}), d AS (SELECT a.asset, a.id, b.id AS nid, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM p a JOIN p b ON a.asset = b.asset) SELECT asset, id, nid, r::INT AS r, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY asset, id ORDER BY d2, nid) AS r FROM d) WHERE r <= 4")
def knn_parts(t):
    """Groups of hundreds of points, many of them in one place."""
    at = [F.min(c).cast("double").alias(a) for c, a in ((F.col("l_quantity"), "x"), (F.col("l_discount") * 100, "y"), (F.col("l_tax") * 100, "z"))]
    p = materialize(t.lineitem.groupBy(F.col("l_suppkey").alias("asset"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).agg(*at), "parts")
    return P.knn(p, ["asset"], 4).select("asset", "id", "nid", "r", F.round("d2", 6).alias("d2"))
