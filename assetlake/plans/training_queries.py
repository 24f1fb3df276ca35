"""Queries on sampling, views and meshes, and the streaming jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from assetlake.functions import geometry as G
from assetlake.operators import resume as P
from assetlake.operators import sampling as S
from assetlake.operators import views as W
from assetlake.operators import voxel as V
from assetlake.plans.registry import Registry, Tables, r6
from assetlake.plans.voxel_queries import _CELLS, points
from assetlake.session import cut, shared_dir, spread
from assetlake.sources import archives as A
from assetlake.sources import datasource as D
from assetlake.streaming import jobs as J
from assetlake.streaming import ordered as O

_GRID = f"SELECT asset, vx AS row, vy AS col, vx / 7.0::DOUBLE AS x, vy / 7.0::DOUBLE AS y, sum(vz)::DOUBLE / 100 AS z, count(*) % 5 <> 0 AS valid FROM ({_CELLS}) GROUP BY ALL"
_CORNERS = f"""g AS ({_GRID}), q AS (SELECT a.*, b.z AS bz, c.z AS cz, d.z AS dz, a.valid AS va, b.row IS NOT NULL AS vb, c.row IS NOT NULL AS vc, d.row IS NOT NULL AS vd FROM g a LEFT JOIN g b ON b.asset = a.asset AND b.row = a.row AND b.col = a.col + 1 AND b.valid
LEFT JOIN g c ON c.asset = a.asset AND c.row = a.row + 1 AND c.col = a.col AND c.valid LEFT JOIN g d ON d.asset = a.asset AND d.row = a.row + 1 AND d.col = a.col + 1 AND d.valid)"""
_TRI = f"""{_CORNERS}, f AS (SELECT asset, row, col, unnest(CASE WHEN va AND vb AND vc AND vd THEN ['abc', 'bdc'] WHEN va AND vb AND vc THEN ['abc'] WHEN vb AND vd AND vc THEN ['bdc'] WHEN va AND vb AND vd THEN ['abd'] WHEN va AND vd AND vc THEN ['adc'] ELSE [] END) AS t FROM q),
faces AS (SELECT asset, row, col, t, {', '.join(f"(row + (t[{i+1}] IN ('c', 'd'))::INT) * 14 + col + (t[{i+1}] IN ('b', 'd'))::INT AS i{i}" for i in range(3))} FROM f)"""
_NORMALS = f"""{_TRI}, v AS (SELECT asset, row * 14 + col AS vid, x, y, z FROM g),
n AS (SELECT fa.*, (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) AS nx, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) AS ny, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) AS nz FROM faces fa JOIN v a ON a.asset = fa.asset AND a.vid = i0 JOIN v b ON b.asset = fa.asset AND b.vid = i1 JOIN v c ON c.asset = fa.asset AND c.vid = i2)"""
_MD5 = "md5('{0}|' || CAST({1} AS VARCHAR))"
R = Registry(grid=_GRID, corners=_CORNERS, tri=_TRI, normals=_NORMALS, cells=_CELLS)
QUERIES, ORACLES = R.queries, R.oracles


def grid(t: Tables):
    """A face grid per supplier: cells of its points, height from their number."""
    c = V.cells(points(t), 14)
    return c.groupBy("asset", F.col("vx").alias("row"), F.col("vy").alias("col")).agg((F.sum("vz").cast("double") / 100).alias("z"), (F.count("*") % 5 != 0).alias("valid")).select("asset", "row", "col", (F.col("row") / 7.0).alias("x"), (F.col("col") / 7.0).alias("y"), "z", "valid")


def faces(t: Tables):
    f = W.triangulate_grid(cut(grid(t)), ["asset"])
    return f.select("asset", "row", "col", *[(F.col(f"v{i}.row") * 14 + F.col(f"v{i}.col")).alias(f"i{i}") for i in range(3)])


@R.query("stratified_sample", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_MD5.format(7, 'doc_id')}, doc_id) AS k FROM documents) WHERE k <= 12")
def stratified_sample(t):
    return S.stratified_sample(t.documents.select("doc_id", "lang"), "lang", "doc_id", 12, 7)


@R.query("bucket_sample", """WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_discount >= 0.02::DOUBLE AND l_discount < 0.05::DOUBLE THEN 'ratio_0p02_to_0p05' WHEN l_discount >= 0.05::DOUBLE AND l_discount < 0.08::DOUBLE THEN 'ratio_0p05_to_0p08' WHEN l_discount >= 0.08::DOUBLE AND l_discount <= 0.1::DOUBLE THEN 'ratio_0p08_to_0p1' END AS bucket FROM lineitem)
SELECT id, bucket FROM (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5('5|' || CAST(id AS VARCHAR)), id) AS k FROM b WHERE bucket IS NOT NULL) WHERE k <= 40""")
def bucket_sample(t):
    df = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_discount")
    return S.bucket_sample(df, "l_discount", [0.02, 0.05, 0.08], 0.1, "id", 40, 5).select("id", "bucket")


@R.query("sample_epoch", f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {_MD5.format(13, 'doc_id')}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents), e AS (SELECT doc_id, pos FROM o UNION ALL SELECT doc_id, pos + n FROM o WHERE pos < (7 - n % 7) % 7)
SELECT doc_id, (pos % 7)::INT AS rank, pos // 7 AS slot FROM e WHERE pos // 7 >= 3""")
def sample_epoch(t):
    return S.sample_epoch(t.documents, "doc_id", 10, 3, 7, start=3)


_LPT = """k AS (SELECT grp, chunk, count(*) // 4 AS per FROM o GROUP BY ALL),
s AS (SELECT grp, chunk, per, 0::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS t, [0, 0, 0, 0]::BIGINT[] AS c, NULL::BIGINT AS doc_id, NULL::BIGINT AS load, NULL::INT AS g FROM k
  UNION ALL SELECT grp, chunk, per, i + 1, list_transform(t, lambda x, j: x + CASE WHEN j = pick THEN w ELSE 0 END), list_transform(c, lambda x, j: x + CASE WHEN j = pick THEN 1 ELSE 0 END), d, w, pick - 1 FROM (
    SELECT *, coalesce(list_position(m, list_min(m)), 1)::INT AS pick FROM (
      SELECT s.*, o.doc_id AS d, o.n_chars AS w, list_transform(t, lambda x, j: CASE WHEN per > 0 AND c[j] >= per THEN NULL ELSE x END) AS m FROM s JOIN o ON o.grp IS NOT DISTINCT FROM s.grp AND o.chunk = s.chunk AND o.i = s.i + 1)))"""


@R.query("balanced_batches", f"""WITH RECURSIVE p AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY {_MD5.format(4, 'doc_id')}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
o AS (SELECT 0 AS grp, pos // 64 AS chunk, doc_id, n_chars, row_number() OVER (PARTITION BY pos // 64 ORDER BY n_chars DESC, doc_id) AS i FROM p WHERE pos < n // 64 * 64), {_LPT}
SELECT chunk, doc_id, load AS n_chars, g AS rank FROM s WHERE doc_id IS NOT NULL""")
def balanced_batches(t):
    return S.balanced_batches(t.documents, "doc_id", "n_chars", 4, 16, 4)


@R.query("lpt_groups", f"""WITH RECURSIVE p AS (SELECT source, doc_id, n_chars, (row_number() OVER (PARTITION BY source ORDER BY {_MD5.format(3, 'doc_id')}, doc_id) - 1) // 150 AS chunk FROM documents),
o AS (SELECT source AS grp, chunk, doc_id, n_chars, row_number() OVER (PARTITION BY source, chunk ORDER BY n_chars DESC, doc_id) AS i FROM p), {_LPT}
SELECT grp AS source, chunk, doc_id, load AS n_chars, g AS "group" FROM s WHERE doc_id IS NOT NULL""")
def lpt_groups(t):
    return S.balance_chunks(t.documents.select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 4, seed=3, most=150)


@R.query("snake_groups", "SELECT doc_id, n_chars, (CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END)::INT AS \"group\" FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS p FROM documents)")
def snake_groups(t):
    return S.snake_groups(t.documents.select("doc_id", "n_chars"), "n_chars", "doc_id", 5)


@R.query("view_plan", "WITH v AS (SELECT s_suppkey AS asset, i::INT AS view, i / 24 AS u, list_sum(list_transform(range(30), lambda k: ((i >> k) & 1) / pow(2, k + 1))) AS w FROM supplier, range(24) r(i)) SELECT asset, view, round(w * 2 * pi(), 6) AS yaw, round(acos(1 - 2 * CASE WHEN u < 0.25 THEN 2 * u ELSE 2 * u / 3 + 1/3 END) - pi() / 2, 6) + 0.0 AS pitch FROM v")
def view_plan(t):
    v = W.view_plan(t.supplier.select(F.col("s_suppkey").alias("asset")), "asset", 24, remap=True)
    return v.select("asset", "view", F.round("yaw", 6).alias("yaw"), r6("pitch").alias("pitch"))


@R.query("camera_fit", "SELECT l_suppkey AS asset, round(greatest(1.0::DOUBLE, max(l_quantity) / 25 * 1.3::DOUBLE / tan(radians(40) / 2)), 6) AS distance FROM lineitem GROUP BY 1")
def camera_fit(t):
    from assetlake.functions import geometry as G

    r = t.lineitem.groupBy(F.col("l_suppkey").alias("asset")).agg((F.max("l_quantity") / 25).alias("r"))
    return r.select("asset", F.round(G.camera_distance(F.lit(40.0), "r"), 6).alias("distance"))


_POSE = """WITH s AS (SELECT s_suppkey AS asset, i::INT AS view, i * 0.7::DOUBLE AS yaw, (s_nationkey % 5) * 0.2::DOUBLE - 0.3::DOUBLE AS pitch, 2.0::DOUBLE AS r FROM supplier, range(4) k(i)),
p AS (SELECT *, r * sin(yaw) * cos(pitch) AS px, r * cos(yaw) * cos(pitch) AS py, r * sin(pitch) AS pz FROM s)"""


def views(t: Tables, n: int = 4):
    v = t.supplier.select(F.col("s_suppkey").alias("asset"), "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("view"))
    v = v.select("asset", "view", (F.col("view") * 0.7).alias("yaw"), ((F.col("s_nationkey") % 5) * 0.2 - 0.3).alias("pitch"))
    return W.camera_poses(v, F.lit(2.0))


@R.query("camera_pose", _POSE + " SELECT asset, view, round(px, 6) + 0.0 AS px, round(py, 6) + 0.0 AS py, round(pz, 6) + 0.0 AS pz, 2.0::DOUBLE AS depth FROM p")
def camera_pose(t):
    # the origin is as far ahead of the camera as the camera is away from it
    return views(t).select("asset", "view", *[r6(c).alias(c) for c in ("px", "py", "pz")], (F.round(F.col("e2")[3], 6) + F.lit(0.0)).alias("depth"))


_PROJ = _POSE + f""", q AS (SELECT c.asset, c.l_orderkey, c.l_linenumber, p.view, -cos(yaw) * (c.x - px) + sin(yaw) * (c.y - py) AS cx, sin(yaw) * sin(pitch) * (c.x - px) + cos(yaw) * sin(pitch) * (c.y - py) - cos(pitch) * (c.z - pz) AS cy, -sin(yaw) * cos(pitch) * (c.x - px) - cos(yaw) * cos(pitch) * (c.y - py) - sin(pitch) * (c.z - pz) AS cz FROM (<cells>) c JOIN p ON p.asset = c.asset WHERE c.l_linenumber = 1),
uv AS (SELECT *, (cx / cz * 0.8::DOUBLE + 0.5) * 2 - 1 AS u, (cy / cz * 0.8::DOUBLE + 0.5) * 2 - 1 AS v FROM q)"""


_PROJ_ALL = _PROJ.replace(" WHERE c.l_linenumber = 1", "")


def projected(t: Tables, every: bool = False):
    p = points(t).where(F.lit(every) | (F.col("l_linenumber") == 1)).select("asset", "l_orderkey", "l_linenumber", "x", "y", "z")
    p = spread(p, t.lineitem.count(), "asset")
    return W.project(p, views(t), "asset", F.lit(0.8))


@R.query("project_views", _PROJ + " SELECT asset, l_orderkey, view, round(u, 4) + 0.0 AS u, round(v, 4) + 0.0 AS v FROM uv WHERE cz > 0.5")
def project_views(t):
    return projected(t).where("depth > 0.5").select("asset", "l_orderkey", "view", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in "uv"])


@R.query("project_all_points", _PROJ_ALL + " SELECT asset, l_orderkey, l_linenumber, view, round(u, 4) + 0.0 AS u, round(v, 4) + 0.0 AS v FROM uv WHERE cz > 0.5")
def project_all_points(t):
    return projected(t, every=True).where("depth > 0.5").select("asset", "l_orderkey", "l_linenumber", "view", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in "uv"])


@R.query("fuse_views", _PROJ + """, k AS (SELECT *, ((u + 1) * 6 - 1) / 2 AS c, ((v + 1) * 6 - 1) / 2 AS r FROM uv WHERE cz > 0.5), tap AS (SELECT asset, l_orderkey, view, floor(r) + i AS row, floor(c) + j AS col, (1 - abs(r - floor(r) - i)) * (1 - abs(c - floor(c) - j)) AS w FROM k, range(2) a(i), range(2) b(j)),
fs AS (SELECT asset, l_orderkey, view, sum(w * CASE WHEN row BETWEEN 0 AND 5 AND col BETWEEN 0 AND 5 THEN row * 6 + col + view ELSE 0 END) AS s FROM tap GROUP BY ALL)
SELECT asset, l_orderkey, round(avg(s), 4) + 0.0 AS feature, count(*) AS views FROM fs GROUP BY ALL""")
def fuse_views(t):
    v = views(t).select("asset", "view")
    cell = F.explode(F.sequence(F.lit(0), F.lit(35)))
    tokens = v.withColumn("k", cell).select("asset", "view", F.expr("cast(k div 6 as int)").alias("row"), (F.col("k") % 6).alias("col"), (F.col("k") + F.col("view")).cast("double").alias("token"))
    f = W.fuse_views(projected(t).where("depth > 0.5"), tokens, "asset", "l_orderkey", 6)
    return f.withColumn("feature", F.round("feature", 4) + F.lit(0.0))


_HALF = """CASE WHEN f = 0 THEN f ELSE round_even(f / pow(2.0, greatest(e, -14) - 10), 0) * pow(2.0, greatest(e, -14) - 10) END"""


@R.query("fuse_all_views", _PROJ_ALL + f""", k AS (SELECT *, ((u + 1) * 6 - 1) / 2 AS c, ((v + 1) * 6 - 1) / 2 AS r FROM uv WHERE cz > 0.5), tap AS (SELECT asset, l_orderkey, l_linenumber, view, floor(r) + i AS row, floor(c) + j AS col, (1 - abs(r - floor(r) - i)) * (1 - abs(c - floor(c) - j)) AS w FROM k, range(2) a(i), range(2) b(j)),
fs AS (SELECT asset, l_orderkey, l_linenumber, view, sum(w * CASE WHEN row BETWEEN 0 AND 5 AND col BETWEEN 0 AND 5 THEN row * 6 + col + view ELSE 0 END) AS s FROM tap GROUP BY ALL),
h AS (SELECT asset, l_orderkey, l_linenumber, round(avg(s), 6) + 0.0 AS f, count(*) AS views FROM fs GROUP BY ALL), x AS (SELECT *, floor(log2(abs(nullif(f, 0))))::INT AS e FROM h)
SELECT asset, l_orderkey, l_linenumber, {_HALF} AS feature, views FROM x""")
def fuse_all_views(t):
    """Every point's features in half precision, rounded alike before."""
    v = views(t).select("asset", "view")
    cell = F.explode(F.sequence(F.lit(0), F.lit(35)))
    tokens = v.withColumn("k", cell).select("asset", "view", F.expr("cast(k div 6 as int)").alias("row"), (F.col("k") % 6).alias("col"), (F.col("k") + F.col("view")).cast("double").alias("token"))
    f = W.fuse_views(projected(t, every=True).where("depth > 0.5"), tokens, "asset", ["l_orderkey", "l_linenumber"], 6)
    return f.withColumn("feature", G.to_half(F.round("feature", 6) + F.lit(0.0)))


@R.query("densify_grid", "WITH <corners>, r AS (SELECT asset, row, col, 0 AS kind, z FROM q WHERE va UNION ALL SELECT asset, row, col, 1, (z + bz + cz + dz) / 4 FROM q WHERE va AND vb AND vc AND vd UNION ALL SELECT asset, row, col, 2, (z + cz) / 2 FROM q WHERE va AND vc UNION ALL SELECT asset, row, col, 3, (z + bz) / 2 FROM q WHERE va AND vb) SELECT asset, row, col, kind, round(z, 6) + 0.0 AS z FROM r")
def densify_grid(t):
    return W.densify_grid(cut(grid(t)), ["asset"]).select("asset", "row", "col", "kind", r6("z").alias("z"))


@R.query("triangulate", "WITH <tri> SELECT asset, row, col, i0, i1, i2 FROM faces")
def triangulate(t):
    return faces(t)


def normals(t: Tables):
    v = grid(t).select("asset", (F.col("row") * 14 + F.col("col")).alias("vid"), "x", "y", "z")
    return W.face_normals(W.face_corners(faces(t), v, ["asset"]))


@R.query("face_normals", "WITH <normals> SELECT asset, i0, i1, i2, round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz FROM n")
def face_normals(t):
    return normals(t).select("asset", "i0", "i1", "i2", *[r6(c).alias(c) for c in ("nx", "ny", "nz")])


@R.query("vertex_normals", "WITH <normals>, e AS (SELECT asset, unnest([i0, i1, i2]) AS vid, nx, ny, nz FROM n), s AS (SELECT asset, vid, count(*) AS faces, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM e GROUP BY ALL) SELECT asset, vid, faces, round(nx / greatest(sqrt(nx*nx+ny*ny+nz*nz), 1e-12), 5) + 0.0 AS nx, round(nz / greatest(sqrt(nx*nx+ny*ny+nz*nz), 1e-12), 5) + 0.0 AS nz FROM s")
def vertex_normals(t):
    v = W.vertex_normals(normals(t), ["asset"])
    return v.select("asset", "vid", "faces", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("nx", "nz")])


@R.query("mesh_edges", "WITH <tri>, e AS (SELECT asset, unnest([[least(i0, i1), greatest(i0, i1)], [least(i1, i2), greatest(i1, i2)], [least(i2, i0), greatest(i2, i0)]]) AS e FROM faces) SELECT asset, e[1] AS u, e[2] AS v, count(*) AS degree, count(*) = 1 AS boundary FROM e GROUP BY ALL")
def mesh_edges(t):
    return W.mesh_edge_degree(faces(t), ["asset"])


@R.query("mesh_components", """WITH RECURSIVE <tri>, fc AS (SELECT *, row_number() OVER (ORDER BY asset, i0, i1, i2) - 1 AS face FROM faces),
e AS (SELECT asset, face, unnest([[least(i0, i1), greatest(i0, i1)], [least(i1, i2), greatest(i1, i2)], [least(i2, i0), greatest(i2, i0)]]) AS e FROM fc),
l AS (SELECT DISTINCT x.face AS a, y.face AS b FROM e x JOIN e y ON x.asset = y.asset AND x.e = y.e AND x.face <> y.face),
reach AS (SELECT face AS node, face AS other FROM fc UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.other),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT asset, i0, i1, i2, component FROM fc JOIN c ON c.node = fc.face""")
def mesh_components(t):
    return W.mesh_components(faces(t), ["asset"])


@R.query("rasterize_polyline", """WITH p AS (SELECT user_id, value / 100 - 0.5 AS x, sin(event_id) * 0.8 AS y, cos(event_id) * 0.8 AS z, lead(value / 100 - 0.5) OVER w AS nx, lead(sin(event_id) * 0.8) OVER w AS ny, lead(cos(event_id) * 0.8) OVER w AS nz FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, greatest(2, CAST(ceil(sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y) + (nz-z)*(nz-z)) / (1.0::DOUBLE / 8)) AS INT) + 1) AS n FROM p WHERE nx IS NOT NULL), i AS (SELECT *, unnest(range(n)) AS i FROM s)
SELECT DISTINCT user_id, {x} AS vx, {y} AS vy, {z} AS vz FROM i""".format(**{a: f"greatest(0, least(7, CAST(floor((CAST({a} + (n{a} - {a}) * (i / (n - 1)) AS FLOAT)::DOUBLE + 1) / 2 * 8) AS INT)))" for a in "xyz"}))
def rasterize_polyline(t):
    e = t.events.select("user_id", "ts", "event_id", (F.col("value") / 100 - 0.5).alias("x"), (F.sin("event_id") * 0.8).alias("y"), (F.cos("event_id") * 0.8).alias("z"))
    return W.rasterize_polyline(e, ["user_id"], ["ts", "event_id"], 8)


@R.query("time_schedule", "SELECT p_partkey, i::INT AS i, round(3 * t / (1 + 2 * t), 6) AS t, round(3 * u / (1 + 2 * u), 6) AS t_next FROM (SELECT p_partkey, i, 1 - i / p_size AS t, 1 - (i + 1) / p_size AS u FROM (SELECT p_partkey, p_size, unnest(range(p_size)) AS i FROM part))")
def time_schedule(t):
    s = W.time_schedule(t.part.select("p_partkey", "p_size"), F.col("p_size"), 3.0)
    return s.select("p_partkey", "i", F.round("t", 6).alias("t"), F.round("t_next", 6).alias("t_next"))


def scratch(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/assetlake/{name}-{uuid.uuid4().hex}"


@R.query("stream_merge", "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 10 ELSE d.n_chars END AS n_chars, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def stream_merge(t):
    shards, table, ck = scratch(t, "shards"), scratch(t, "manifest"), scratch(t, "offsets")
    t.documents.select("doc_id", "n_chars", "lang").write.parquet(table)
    rec = t.labels.select("doc_id", F.when(F.col("quality") == 1, 10).cast("long").alias("n_chars"), F.lit(None).cast("string").alias("lang"))
    rec.repartition(3).write.option("header", True).csv(shards)
    J.stream_records(t.spark, shards, "doc_id long, n_chars long, lang string", table, "doc_id", ["n_chars", "lang"], ck)
    return t.spark.read.parquet(table)


def collected(t: Tables, stream, mode: str = "append"):
    """What a stream over all the data has put out when it is drained."""
    out, ck = scratch(t, "stream"), scratch(t, "offsets")
    J.drain(stream, lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out), ck, mode)
    return t.spark.read.parquet(out)


def event_stream(t: Tables):
    """The events as a stream; event time needs a zone, the session's."""
    rows = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def step_stream(t: Tables):
    """The events as norms of a run each, in files that come in two batches, and a row far behind that ends the wait."""
    path, schema = scratch(t, "norms"), "run string, step long, value double"
    log = t.events.select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value")
    log.repartitionByRange(3, "step").write.parquet(path)
    end = log.agg(F.lit("").alias("run"), (F.coalesce(F.max("step"), F.lit(0)) + 1_000_000).alias("step"), F.lit(None).cast("double").alias("value"))
    end.write.mode("append").parquet(path)
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)


@R.query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(t):
    got = collected(t, J.tumbling(event_stream(t), "ts", "event_type", "value", "1 hour"), "update")
    last = got.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "r.n", F.round("r.total", 4).alias("total"))


@R.query("tumbling_batch", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_batch(t):
    return J.tumbling(t.events, "ts", "event_type", "value", "1 hour").withColumn("total", F.round("total", 4))


@R.query("sliding_window", "SELECT start, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY ALL")
def sliding_window(t):
    return J.sliding(t.events, "ts", "event_type", "value", "1 hour", "30 minutes").withColumn("mean", F.round("mean", 4))


@R.query("session_windows", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(t):
    return J.sessions(t.events, "ts", "user_id", "2 hours")


@R.query("stream_best", "SELECT event_type AS run, arg_max(event_id, (value, -event_id)) AS step, max(value) AS best FROM events GROUP BY 1")
def stream_best(t):
    log = event_stream(t).select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value")
    got = collected(t, J.stream_best(log), "update")
    return got.groupBy("run").agg(F.max_by(F.struct("step", "best"), "batch").alias("r")).select("run", "r.step", "r.best")


@R.query("stream_clip", "WITH e AS (SELECT event_type AS run, event_id AS step, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) SELECT run, step, round(coalesce(lag(th) OVER (PARTITION BY run ORDER BY step), 100.0), 6) AS threshold FROM (SELECT run, step, CASE WHEN k >= 20 THEN least(quantile_cont(value, 0.9) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 100.0) ELSE 100.0 END AS th FROM e)")
def stream_clip(t):
    return collected(t, O.stream_clip(step_stream(t), 0.9, 20, 100.0)).select("run", "step", F.round("threshold", 6).alias("threshold"))


@R.query("stream_improvements", "SELECT run, step, best FROM (SELECT event_type AS run, event_id AS step, value AS best, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE before IS NULL OR best > before")
def stream_improvements(t):
    return collected(t, O.stream_improvements(step_stream(t))).drop("batch")


@R.query("stream_log_lines", "SELECT event_id AS step, 'loss' AS metric, value FROM events")
def stream_log_lines(t):
    """The events as text lines of a run log, read as a stream."""
    path = scratch(t, "runlog")
    t.events.select(F.concat(F.col("event_id").cast("string"), F.lit(": {'loss': "), F.col("value").cast("string"), F.lit("}")).alias("value")).write.text(path)
    return collected(t, J.log_lines(t.spark, path)).select("step", "metric", "value")


_LINES = "SELECT event_id AS step, unnest(['loss', 'grad_norm']) AS metric, unnest([value, value / 2]) AS value FROM events WHERE event_id % 97 <> 5"


@R.query("stream_step_windows", f"SELECT step // 100 AS \"window\", metric, round(avg(value), 6) AS mean, count(value) AS n FROM ({_LINES}) GROUP BY ALL")
def stream_step_windows(t):
    """Window means from the events as lines of a growing run log, some with NaN; each closed window comes once."""
    path = scratch(t, "runlog")
    loss = F.when(F.col("event_id") % 97 == 5, "nan").otherwise(F.col("value").cast("string"))
    line = F.concat(F.col("event_id").cast("string"), F.lit(": {'loss': "), loss, F.lit(", 'grad_norm': np.float64("), (F.col("value") / 2).cast("string"), F.lit(")}"))
    t.events.repartitionByRange(3, "event_id").select(line.alias("value")).write.text(path)
    t.events.agg(F.concat((F.coalesce(F.max("event_id"), F.lit(0)) + 1_000_000).cast("string"), F.lit(": {'loss': 0.0}")).alias("value")).write.mode("append").text(path)
    lines = t.spark.readStream.option("maxFilesPerTrigger", 2).text(path)
    return collected(t, O.step_windows(lines, 100)).select("window", "metric", F.round("mean", 6).alias("mean"), "n")


@R.query("resume_epoch", f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {_MD5.format(13, 'doc_id')}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
a AS (SELECT doc_id, pos FROM o UNION ALL SELECT doc_id, pos + n FROM o WHERE pos < (4 - (n - 140) % 4) % 4)
SELECT doc_id, 0::BIGINT AS epoch, pos, CASE WHEN pos < 140 THEN pos % 7 ELSE (pos - 140) % 4 END AS rank, CASE WHEN pos < 140 THEN pos // 7 ELSE 20 + (pos - 140) // 4 END AS slot FROM a""", rank="INT")
def resume_epoch(t):
    """One epoch: 20 slots of 7 ranks, and after a restart the rest with 4 ranks."""
    path = scratch(t, "epochs")
    args = (t.documents, "doc_id", path, "run-a", 13)
    first, second = P.next_batch(*args, 7, 20), P.next_batch(*args, 4, 1 << 40)
    return first if second is None else first.unionByName(second)


@R.query("pending_runs", """WITH r AS (SELECT doc_id, n_chars, unnest([1, 2, 3]) AS run FROM documents),
s AS (SELECT *, CASE WHEN n_chars < 60 THEN 'skip_prefilter' WHEN doc_id % 11 = 0 THEN 'empty' WHEN doc_id % 7 = 0 AND run < 3 THEN 'build_failed' ELSE 'success' END AS status FROM r)
SELECT doc_id, run, CASE WHEN status = 'success' AND (doc_id % 7 <> 0 AND run > 1) THEN 'cached' ELSE status END AS status, CASE WHEN status = 'build_failed' THEN 'run ' || run END AS error FROM s""", run="BIGINT")
def pending_runs(t):
    """Three runs over the documents, some of which fail until the third."""
    path = scratch(t, "runs")

    def build(run: int):
        failed = (F.col("doc_id") % 7 == 0) & F.lit(run < 3)
        status = F.when(F.col("n_chars") < 60, "skip_prefilter").when(F.col("doc_id") % 11 == 0, "empty").when(failed, "build_failed").otherwise("success")
        return lambda todo: todo.withColumn("status", status).select("doc_id", "status", F.when(F.col("status") == "build_failed", F.lit(f"run {run}")).alias("error"))

    runs = [P.run_pending(t.documents.select("doc_id", "n_chars"), "doc_id", build(run), path, run) for run in (1, 2, 3)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).select("doc_id", "run", "status", "error")


@R.query("source_npz", "SELECT vec_id AS asset, i::INT AS position, embedding[i+1]::DOUBLE AS value FROM embeddings, range(64) r(i)")
def source_npz(t):
    """Vectors written as NPZ files and read through the data source."""
    path = scratch(t, "npz")
    shape = F.array(F.lit(8), F.lit(8))
    D.write_npz(t.embeddings.select(F.col("vec_id").cast("string").alias("asset"), shape.alias("shape"), F.col("embedding").alias("values")), path, "mean").count()
    D.register(t.spark)
    rows = t.spark.read.format("assets").option("kind", "npz").option("field", "mean").load(path)
    return rows.select(F.col("asset").cast("long").alias("asset"), F.posexplode("values").alias("position", "v")).select("asset", "position", F.col("v").cast("double").alias("value"))


@R.query("tail_log", "SELECT event_id // 100 AS \"window\", 'loss' AS metric, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def tail_log(t):
    """Window means from run-log lines that the data source follows as they come: the log, then two lines that end it."""
    path, out, ck = scratch(t, "runlog"), scratch(t, "stream"), scratch(t, "offsets")
    line = F.concat(F.col("event_id").cast("string"), F.lit(": {'loss': "), F.col("value").cast("string"), F.lit("}"))
    after = lambda n: t.events.agg(F.concat((F.coalesce(F.max("event_id"), F.lit(0)) + n).cast("string"), F.lit(": {'loss': 0.0}")).alias("value"))
    D.register(t.spark)
    for part in (t.events.repartitionByRange(3, "event_id").select(line.alias("value")), after(1_000_000), after(1_000_001)):
        part.write.mode("append").text(path)
        lines = t.spark.readStream.format("assets").option("kind", "lines").load(path)
        J.drain(O.step_windows(lines.select("value"), 100), lambda batch, number: batch.write.mode("append").parquet(out), ck)
    return t.spark.read.parquet(out).select("window", "metric", F.round("mean", 6).alias("mean"), "n")


@R.query("archive_members", "SELECT doc_id || '.txt' AS member, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL")
def archive_members(t):
    """Every text in a zip, and those with a language found again by a list of members and read in their ranges."""
    path = scratch(t, "zips")
    member = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("member")
    texts = t.documents.where("doc_id is not null").select(member, F.coalesce("text", F.lit("")).alias("content"))
    zips = cut(A.write_zips(texts, path))
    names = A.list_members(t.spark, path, zips.select(F.element_at(F.split("archive", "/"), -1).alias("archive")))
    asked = names.join(t.documents.where("lang is not null").select(member), "member", "left_semi")
    return A.read_members(asked, path).select("member", "size", "sha256")
