"""What must hold at any size: no broadcast of exploded rows, parts that follow the input, blocks and groups of one task."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from assetlake.operators import metrics as M
from assetlake.operators import points as P
from assetlake.operators import views as W
from assetlake.operators import voxel as V
from assetlake.plans import catalogue
from assetlake.sources import datasource as D
from assetlake.sources import files as S
from tests.conftest import DATA

Q = catalogue.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_and_tokens_are_not_broadcast(spark):
    for name in ("fuse_views", "fuse_all_views", "project_all_points"):
        text = plan(Q[name](spark, DATA))
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text, name


def test_tokens_that_repeat_or_lie_outside(spark):
    p = spark.createDataFrame([(1, 7, 0, 0.0, 0.0), (1, 7, 1, 0.0, 0.0)], "a int, p int, view int, u double, v double")
    t = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 0, 0, 0, 2.0), (1, 0, 1, 1, 1.0), (1, 0, 5, 1, 9.0)], "a int, view int, row int, col int, token double")
    [r] = W.fuse_views(p, t, "a", "p", 2).collect()
    assert (r.feature, r.views) == (0.5, 2)  # view 0: (3 + 1) / 4, view 1 has no token


def test_components_across_blocks(spark):
    random.seed(3)
    cells = sorted({tuple(random.randrange(12) for _ in range(3)) for _ in range(260)})
    v = spark.createDataFrame([(b, *c) for b in (0, 3) for c in cells], "b int, x int, y int, z int")
    label = V.grid_labels(np.array(cells), 12)
    flat = [x * 144 + y * 12 + z for x, y, z in cells]
    want = {(b, c): flat[label[i]] for b in (0, 3) for i, c in enumerate(cells)}
    for block in (4, 12):
        got = {(r.b, (r.x, r.y, r.z)): r.component for r in V.voxel_components(v, 12, block).collect()}
        assert got == want


def test_one_block_needs_no_graph(spark):
    v = spark.createDataFrame([(0, 1, 1, 1), (0, 2, 2, 2)], "b int, x int, y int, z int")
    assert "FlatMapGroupsInArrow" in plan(V.voxel_components(v, 14)) and "Join" not in plan(V.voxel_components(v, 14))


def test_neighbour_counts_over_block_edges(spark):
    random.seed(4)
    cells = {tuple(random.randrange(-3, 6) for _ in range(3)) for _ in range(150)}
    v = spark.createDataFrame([(0, *c) for c in cells], "b int, x int, y int, z int")
    near = lambda c: sum(max(abs(p - q) for p, q in zip(c, d)) == 1 for d in cells)
    for block in (2, 32):
        got = {(r.x, r.y, r.z): r.neighbours for r in V.neighbour_counts(v, 3, block).collect()}
        assert got == {c: near(c) for c in cells}


def test_parts_follow_the_rows(spark, monkeypatch):
    from assetlake import session

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    for name in ("stencil26", "cube_verts", "octree_rollup", "octree_children", "hilbert_order"):
        text = plan(Q[name](spark, DATA))
        rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
        assert f", {-(-rows // 100)}), REPARTITION_BY_NUM" in text, name
        assert "ENSURE_REQUIREMENTS, [" not in text.replace("SinglePartition, ENSURE_REQUIREMENTS", ""), name


def test_groups_that_one_task_compares(spark):
    random.seed(5)
    rows = [(g, i, float(random.randrange(4)), float(random.randrange(4)), random.random() if g else 0.0) for g in (0, 1) for i in range(150)]
    p = spark.createDataFrame(rows, "g int, id long, x double, y double, z double")
    got = {(r.g, r.id, r.r): (r.nid, r.d2) for r in P.knn(p, ["g"], 4).collect()}
    want = {}
    for g, i, *a in rows:
        near = sorted((sum((a[n] - b[n]) * (a[n] - b[n]) for n in range(3)), j) for h, j, *b in rows if h == g)[:4]
        want |= {(g, i, n + 1): (j, d) for n, (d, j) in enumerate(near)}
    assert got == want
    assert "FlatMapCoGroupsInArrow" in plan(P.knn(p, ["g"], 4))


def test_rows_of_a_table_in_parts(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    for i, n in enumerate((3, 2, 4)):
        spark.range(10 * i, 10 * i + n).coalesce(1).write.parquet(f"{path}/{i}")
    got = sorted((r.id, r.parquet_index, r.row_index) for r in S.scan_table_rows(spark, path, ["id"]).collect())
    assert got == [(v, 0, i) for i, v in enumerate([0, 1, 2, 10, 11, 20, 21, 22, 23])]


def test_small_and_large_meshes(spark):
    faces = [(0, 0, 1, 2), (0, 1, 3, 2), (0, 7, 8, 9), (1, 5, 6, 7), (1, 0, 1, 2), (1, 0, 1, 2), (1, 6, 7, 8), (1, 1, 2, 9)]
    df = spark.createDataFrame(faces, "m int, i0 int, i1 int, i2 int")
    one = sorted(map(tuple, W.mesh_components(df, ["m"]).collect()))
    assert one == sorted(map(tuple, W.mesh_components(df, ["m"], task_faces=3).collect()))
    assert one == sorted(map(tuple, W.mesh_components(df, ["m"], task_faces=0).collect()))
    assert {r[-1] for r in one} == {0, 2, 3, 6}


def test_quantiles_and_ends_of_a_log(spark):
    random.seed(6)
    rows = [(m, s, random.choice([None, float(random.randrange(9)), random.random()])) for m in "abc" for s in range(40)] + [("d", 1, None), ("d", 2, None)]
    df = spark.createDataFrame(rows, "metric string, step long, value double")
    want = {r.metric: r.q for r in df.groupBy("metric").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).collect()}
    got = {r.metric: r for r in M.log_statistics(df, "metric", "value").collect()}
    assert set(got) == set("abcd") and all(np.allclose([got[m].q1, got[m].q2, got[m].q3], want[m]) for m in "abc") and got["d"].q2 is None
    for mode in ("max", "min"):
        steps = M.running_best(df, ["metric"], ["step"], "value", mode).groupBy("metric").agg(F.max("step").alias("step")).collect()
        assert sorted(steps) == sorted(M.last_improvement(df, ["metric"], "step", "value", mode).collect())
    assert sorted((r.metric, r.step) for r in M.last_rows(df, ["metric"], ["step"], 2).collect()) == [*[(m, s) for m in "abc" for s in (38, 39)], ("d", 1), ("d", 2)]


def test_artefacts_are_listed_by_tasks(spark, tmp_path):
    root = tmp_path / "out"
    for i, name in enumerate(("a.npz", "d e/b%20.npz", "d e/f/c+.npz", "k=1/_x=1.npz", "_h/d.npz", ".i/e.npz", "d e/_g.npz", "d e/.j.npz", "d e/h._COPYING_", "_metadata", "d e/empty.npz")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * ((i + 1) % 11))
    want = sorted(map(tuple, spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root)).select("path", "length").collect()))
    for path in (str(root), f"{root}/", f"file://{root}"):
        assert sorted(map(tuple, D.find_files(spark, path).collect())) == want and len(want) == 4
    listing = S.scan_artifacts(spark, str(root), r"([^/]+)\.npz$", "latent")
    assert sorted((r.key, r.length) for r in listing.collect()) == [("_x=1", 4), ("a", 1), ("b%20", 2), ("c+", 3)]
    assert "binaryFile" not in plan(listing)
    assert [r.key for r in S.scan_artifacts(spark, f"{root}/*.npz", r"([^/]+)\.npz$", "latent").collect()] == ["a"]
    (tmp_path / "none").mkdir()
    assert S.scan_artifacts(spark, str(tmp_path / "none"), "(.)", "latent").count() == 0


def test_a_file_an_asset_in_folders_of_bounded_number(spark, tmp_path):
    rows = spark.range(60).select(F.concat((F.col("id") % 50).cast("string"), F.lit(".txt")).alias("name"), F.lit("done").alias("content"))
    path = str(tmp_path / "w")
    assert D.write_files(rows, path, 4).agg(F.sum("bytes")).first()[0] == 240
    files = [p for p in (tmp_path / "w").rglob("*") if p.is_file()]
    assert sorted(p.name for p in files) == sorted(f"{i}.txt" for i in range(50)) and {p.read_text() for p in files} == {"done"}
    assert len({p.parent for p in files}) == 4
    assert D.write_files(rows.where("false"), str(tmp_path / "e")).count() == 0 and D.find_files(spark, str(tmp_path / "e")).count() == 0


def test_small_groups_are_compared_many_at_a_time(spark, monkeypatch):
    random.seed(7)
    rows = [(g, i, f"c{g}", float(random.randrange(3)), float(random.randrange(3)), random.random()) for g in range(40) for i in range(1 + g % 9)] + [(None, 1, "x", 0.0, 0.0, 0.0)]
    rows += [(99, i, "big", random.random(), random.random(), random.random()) for i in range(90)]
    p = spark.createDataFrame(rows, "g int, id long, name string, x double, y double, z double")
    want = {}
    for g, i, name, *a in rows:
        near = sorted((sum((a[n] - b[n]) * (a[n] - b[n]) for n in range(3)), j) for h, j, _, *b in rows if h == g and g is not None)[:3]
        want |= {(g, i, n + 1): (j, round(d, 12), name, name) for n, (d, j) in enumerate(near)}
    for most in (4096, 70, 3):
        monkeypatch.setattr(P, "TASK_GROUP", most)
        near = P.knn(p, ["g"], 3, own=("name",), other=("name",), far=True)
        found = near.collect()
        assert {(r.g, r.id, r.r): (r.nid, round(r.d2, 12), r["name"], r.n_name) for r in found} == want, most
        last = {(r.g, r.id): r.d2 for r in sorted(found, key=lambda r: r.r)}
        assert all((r.far, r.n_far) == (last[r.g, r.id], last[r.g, r.nid]) for r in found)
        text = plan(near)
        assert "FlatMapCoGroupsInArrow" in text and (most < 4096 or "Window" not in text)


def test_patches_are_joined_by_tasks_or_as_a_graph(spark, monkeypatch):
    random.seed(8)
    sizes = {a: 5 + 12 * (a % 3) for a in range(12)}
    points = spark.createDataFrame([(a, i % 2, i * 7) for a, n in sizes.items() for i in range(n)], "asset int, cls int, id long")
    links = [(a, i * 7, (i + 2 * random.randrange(1, 4)) * 7) for a, n in sizes.items() for i in range(n) if random.random() < 0.6]
    edges = spark.createDataFrame(links, "asset int, id long, nid long")  # some end at no point
    got = []
    for most in (200_000, 20, 0):
        monkeypatch.setattr(P, "TASK_POINTS", most)
        got.append(sorted(map(tuple, P.grow_patches(points, edges, "asset", 3, 1).collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) == sum(sizes.values()) and max(r[3] for r in got[0]) > 0
    used = []
    monkeypatch.setattr(P, "TASK_POINTS", 200_000)
    monkeypatch.setattr(P, "connected_components", lambda *a: used.append(a))
    P.grow_patches(points, edges, "asset", 3, 1).collect()
    assert not used


def test_samples_are_dealt_out_once(spark):
    p = spark.createDataFrame([(1, 0, s, s % 2, s // 4 * 1.0, 0.0, 0.0) for s in range(12)] + [(1, None, 20, 1, 0.0, 0.0, 0.0), (1, 5, 21, 1, float("nan"), 0.0, 0.0), (1, 5, 22, 1, None, 0.0, 0.0)], "asset int, voxel int, slot int, cls int, x double, y double, z double")
    dealt = p.repartition(3, "asset")
    assert plan(P.merge_duplicates(P.explode_samples(dealt, 1e-3, ["asset", "voxel"], "slot", 9.0), 1e-3, "asset")).count("Exchange") == 1
    got = {r.qx: (r.source_count, r.cls, r.voxel) for r in P.merge_duplicates(P.valid_points(p, 9.0), 1e-3, "asset").collect()}
    assert got == {0: (5, 1, 0), 1000: (4, 1, 0), 2000: (4, 1, 0)}
