"""Hand-computed cases, one per operator, and properties."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake.functions import geometry as G
from assetlake.operators import curation as Q
from assetlake.operators import manifest as M
from assetlake.operators import metrics as X
from assetlake.operators import points as P
from assetlake.operators import sampling as S
from assetlake.operators import views as W
from assetlake.operators import voxel as V
from assetlake.operators.graph import connected_components


def vox(spark, rows, schema="b long, x int, y int, z int, feats array<double>"):
    return spark.createDataFrame(rows, schema)


def test_flat_index(spark):
    p = spark.createDataFrame([(-1.0, -1.0, -1.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.49, -0.51, 0.0)], "x double, y double, z double")
    flat = p.select(G.flat_index("x", "y", "z", 4).alias("f"))
    assert [r.f for r in flat.collect()] == [0, 42, 63, 34]
    assert tuple(flat.where("f = 34").select(*G.flat_to_coords("f", 4)).first()) == (2, 0, 2)


def test_component_metrics(spark):
    v = vox(spark, [(1, 0, 0, 0, None), (1, 1, 1, 1, None), (1, 3, 3, 3, None)])
    rows = {r.b: r for r in V.component_metrics(v, spark.createDataFrame([(1,), (2,)], "b long"), 4).collect()}
    a, e = rows[1], rows[2]
    assert (a.component_count, a.largest_component_size, a.total_voxels) == (2, 2, 3) and a.largest_component_ratio == pytest.approx(2 / 3)
    assert (e.component_count, e.total_voxels, e.largest_component_ratio, e.small_component_ratio) == (0, 0, 0.0, 0.0)


def test_quality_reason(spark):
    rows = [(0, 0, 0.0, 0.0), (16, 100, 0.92, 0.08), (15, 100, 0.92, 0.08), (3, 100, 0.99, 0.01)]
    df = spark.createDataFrame(rows, "component_count int, total_voxels int, largest_component_ratio double, small_component_ratio double")
    got = [r.r for r in df.select(Q.quality_reason(0, 0.05, (0.9, 0.95), 16).alias("r")).collect()]
    assert got == ["empty_voxel_grid", "low_largest_component_ratio", "too_many_small_components", None]
    assert [r.r for r in df.select(Q.quality_reason().alias("r")).collect()] == ["empty_voxel_grid", None, None, None]


def test_prefilter_reason(spark):
    good = spark.createDataFrame([("a", 0, 0, True), ("a", 1, 0, True), ("b", 0, 0, True), ("b", 1, 0, False)], "solid string, face int, edge int, on boolean")
    s = Q.incidence_summary(good).withColumns({"err": F.lit(None).cast("boolean"), "scaled_unique": F.lit(None).cast("boolean"), "rank": F.lit(2), "flat_face": F.lit(False), "flat_edge": F.lit(False)})
    assert {r.solid: r.r for r in s.select("solid", Q.prefilter_reason(10).alias("r")).collect()} == {"a": None, "b": "face_without_edges"}


def test_majority_class_and_merge(spark):
    p = spark.createDataFrame([(1, i, 0.1, 0.1, 0.1, k) for i, k in enumerate(["CYLINDER"] * 3 + ["PLANE"] * 3)], "asset long, ord int, x double, y double, z double, cls string")
    assert V.majority_class(p, 4, list(G.CLASS_ORDER)).first().cls == "PLANE"
    q = spark.createDataFrame([(1, 0.1, 0.1, 0.1, k, 5) for k in (0, 0, 0, 4)], "asset long, x double, y double, z double, cls int, voxel int")
    r = P.merge_duplicates(q, 1e-3, "asset").first()
    assert (r.cls, r.source_count) == (4, 4)


def test_quantise_half_to_even(spark):
    df = spark.createDataFrame([(2.5, 0.5, -0.5)], "x double, y double, z double")
    assert tuple(df.select(*P.quantised(1.0)).first()) == (2, 0, 0)


def test_score_stats_and_summary(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 10)], "a string, v double")
    r = X.score_stats(df, "a", "v").first()
    assert r.median == 2 and r.std == pytest.approx(math.sqrt(50 / 3))
    s = P.summarize(df, "v").first()
    assert (s.median, s["max"]) == (2.5, 10) and (s.p90, s.p95) == pytest.approx((7.9, 8.95))
    assert P.summarize(df.where("v > 99"), "v").first().asDict() == {"n": 0, "mean": None, "median": None, "p90": None, "p95": None, "max": None}


def test_two_standard_deviations(spark):
    df = spark.createDataFrame([("A", 0, 1.0), ("A", 0, 3.0), ("B", 0, 2.0), ("B", 0, 2.0), ("B", 0, 8.0)], "asset string, channel int, value double")
    m = X.latent_moments(df, "asset").first()
    n = {r.channel: r for r in X.normalization_stats(df, "asset").collect()}[0]
    assert (m["mean"], n["mean"]) == (3.0, 3.0)
    assert m["std"] == pytest.approx(2.345208, abs=1e-6) and n["std"] == pytest.approx(1.914214, abs=1e-6)


def test_occupancy_and_losses(spark):
    pred, gt = (spark.createDataFrame([("s", k) for k in ks], "s string, k string") for ks in ("abc", "bcde"))
    r = X.occupancy_metrics(V.compare_voxels(pred, gt, ["s", "k"]), "s", 8).first()
    assert (r.iou, r.precision, r.recall) == pytest.approx((0.4, 2 / 3, 0.5))
    df = spark.createDataFrame(list(zip((0.9, 0.8, 0.3, 0.1), (1.0, 1.0, 0.0, 0.0))), "p double, g double")
    o = X.overlap_losses(df, F.col("p"), F.col("g"), 0.3, 0.7).first()
    assert (o.dice, o.tversky) == pytest.approx((0.137255, 0.108911), abs=1e-6)


def test_purity_and_completeness(spark):
    df = spark.createDataFrame([(1, 0, 7), (1, 0, 7), (1, 0, 9), (1, 1, 9)], "asset int, patch int, face int")
    rows = sorted((r.patch, r.purity, r.size) for r in P.patch_purity(df, ["asset"], "patch", "face").collect())
    assert [x[1] for x in rows] == pytest.approx([2 / 3, 1]) and sum(a * b for _, a, b in rows) / 4 == pytest.approx(0.75)
    gt = spark.createDataFrame([(1, 7)] * 4 + [(1, 9)] * 2, "asset int, face int")
    assert sorted((r.face, r.completeness) for r in P.face_completeness(df, gt, ["asset"], "patch", "face").collect()) == [(7, 0.5), (9, 0.5)]


def test_time_bins(spark):
    t = [0.0, 0.1, 0.3, 0.5, 0.6, 0.7, 0.99, 1.0]
    got = [r.b for r in spark.createDataFrame([(x,) for x in t], "t double").select(G.time_bin("t").alias("b")).collect()]
    assert got == [int(np.digitize(x, np.linspace(0, 1, 11))) - 1 for x in t]
    assert got == [0, 1, 2, 5, 5, 6, 9, 10]


def test_log_windows(spark):
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate((1, 2, 3, 4))], "run string, step int, v double")
    assert [r.a for r in X.moving_average(df, ["run"], ["step"], F.col("v"), 3, "a").orderBy("step").collect()] == [None, None, 2, 3]
    best = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate((0.1, 0.3, 0.3, 0.2, 0.5))], "run string, step int, v double")
    assert sorted(r.step for r in X.running_best(best, ["run"], ["step"], "v").collect()) == [1, 2, 5]


def test_even_subsample(spark):
    for n, k, want in ((10, 4, [0, 3, 6, 9]), (100, 7, [0, 16, 33, 49, 66, 82, 99]), (3, 5, [0, 1, 2])):
        df = spark.createDataFrame([("a", i) for i in range(n)], "g string, i int")
        assert sorted(r.i for r in P.even_subsample(df, ["g"], ["i"], k).collect()) == want


def test_serialize_windows(spark):
    v = vox(spark, [(0, i, 0, 0, None) for i in range(5)])
    w = V.serialize_windows(v, 2, F.col("x")).orderBy("window", "slot").collect()
    assert [(r.window, r.position) for r in w] == [(0, 4), (0, 0), (1, 1), (1, 2), (2, 3), (2, 4)]
    assert [r.position for r in w if r.valid] == [0, 1, 2, 3, 4]


def test_batch_layout(spark):
    v = vox(spark, [(0, 0, 0, 0, None), (0, 1, 0, 0, None), (2, 0, 0, 0, None)])
    assert sorted((r.b, r.start, r.stop) for r in V.batch_layout(v).collect()) == [(0, 0, 2), (1, 2, 2), (2, 2, 3)]


def test_sample_epoch(spark, monkeypatch):
    monkeypatch.setattr(S, "seeded", lambda seed, *cols: F.col(cols[0]))
    df = spark.createDataFrame([(i,) for i in range(5)], "k int")
    deal = lambda **kw: {rank: [r.k for r in S.sample_epoch(df, "k", 0, 0, 2, **kw).where(f"rank = {rank}").orderBy("slot").collect()] for rank in (0, 1)}
    assert deal() == {0: [0, 2, 4], 1: [1, 3, 0]}
    assert deal(drop_last=True) == {0: [0, 2], 1: [1, 3]}
    tiny = spark.createDataFrame([(1,), (2,)], "k int")
    assert S.sample_epoch(tiny, "k", 0, 0, 7).count() == 7


def test_balance():
    assert S.balance_loads([5, 3, 8, 1], 2, False) == [1, 1, 0, 0]
    assert S.balance_loads([5, 3, 8, 1], 2, True) == [1, 1, 0, 0]


def test_balanced_batches_properties(spark):
    df = spark.createDataFrame([(i, float(i % 13)) for i in range(103)], "k int, load double")
    rows = S.balanced_batches(df, "k", "load", 1, 8, 4).collect()
    assert len(rows) == 96 and len({r.k for r in rows}) == 96
    sizes = {}
    for r in rows:
        sizes[r.chunk, r["rank"]] = sizes.get((r.chunk, r["rank"]), 0) + 1
    assert set(sizes.values()) == {8}


def test_pick_cases_and_split(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "k int, s double")
    got = {(r.kind, r.place): r.k for r in X.pick_cases(df, [-F.col("s")], 1, 3, 2).collect()}
    assert got == {("best", 0): 9, ("middle", 0): 6, ("middle", 1): 5, ("middle", 2): 4, ("worst", 0): 0, ("worst", 1): 1}
    assert X.pick_cases(df, [-F.col("s")], 0, 0, 0).count() == 0
    ranks = spark.createDataFrame([(i,) for i in range(5)], "rank int")
    assert [r.split for r in M.split_by_rank(ranks, "rank", 4, 1).orderBy("rank").collect()] == ["val", "train", "train", "train", None]
    with pytest.raises(ValueError):
        M.split_by_rank(ranks, "rank", 2, 2)


def test_views(spark):
    a = spark.createDataFrame([(1,)], "asset int")
    rows = W.view_plan(a, "asset", 4).orderBy("view").collect()
    assert (rows[1].pitch, rows[1].yaw) == pytest.approx((-0.523599, math.pi), abs=1e-6)
    assert (rows[3].pitch, rows[3].yaw) == pytest.approx((0.523599, 3 * math.pi / 2), abs=1e-6)
    assert W.view_plan(a, "asset", 4, remap=True).where("view = 1").first().pitch == pytest.approx(0, abs=1e-9)
    s = W.time_schedule(a, F.lit(2), 3.0).orderBy("i").collect()
    assert [s[0].t, s[0].t_next, s[1].t_next] == pytest.approx([1.0, 0.75, 0.0])


def test_camera_matrix_is_rigid(spark):
    v = W.camera_poses(spark.createDataFrame([(0.7, 0.3)], "yaw double, pitch double"), F.lit(2.0)).first()
    r = np.array([v.e0, v.e1, v.e2])
    assert np.allclose(r[:, :3] @ r[:, :3].T, np.eye(3)) and np.isclose(np.linalg.det(r[:, :3]), 1)
    assert np.allclose(r @ [v.px, v.py, v.pz, 1], 0)


def test_bucket_sample(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.95), (3, 0.6), (4, float("nan")), (5, None)], "k int, v double")
    got = {r.k: r.bucket for r in S.bucket_sample(df, "v", [0.5, 0.9], 0.95, "k", 9, 1).collect()}
    assert got == {1: "ratio_0p9_to_0p95", 2: "ratio_0p9_to_0p95", 3: "ratio_0p5_to_0p9"}
    with pytest.raises(ValueError):
        S.bucket_sample(df, "v", [0.5, 0.4], 0.9, "k", 1, 1)


def test_merge_records(spark):
    m = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    r = spark.createDataFrame([("a", None, 1), ("b", 5, 1), ("c", 9, 1)], "k string, v int, o int")
    assert sorted(map(tuple, M.merge_records(m, r, "k", ["v"], ["o"]).collect())) == [("a", 1), ("b", 5)]


def test_downsample_and_subdivide(spark):
    v = vox(spark, [(0, 0, 0, 0, [1.0]), (0, 1, 1, 1, [3.0]), (0, 2, 0, 0, [5.0])])
    assert sorted((r.x, r.y, r.z, r.feats[0]) for r in V.downsample(v, (2, 2, 2), 1).collect()) == [(0, 0, 0, 2.0), (1, 0, 0, 5.0)]
    back = V.downsample(V.subdivide(v), (2, 2, 2), 1)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))


def test_rasterize(spark):
    p = spark.createDataFrame([(1, 0, -0.5, 0.1, 0.1), (1, 1, 0.5, 0.1, 0.1), (1, 2, float("nan"), 0.0, 0.0)], "a int, i int, x double, y double, z double")
    assert sorted(r.vx for r in W.rasterize_polyline(p, ["a"], ["i"], 4).collect()) == [1, 2, 3]


def test_components_of_a_long_path(spark):
    n = 300
    ids = np.random.default_rng(0).permutation(n).tolist()
    e = spark.createDataFrame(list(zip(ids[:-1], ids[1:])) + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert {got[i] for i in range(n)} == {0} and got[1001] == 1000


@pytest.mark.parametrize("seed", [1])
def test_components_with_hubs_kept_where_they_are(spark, seed):
    rng = random.Random(seed)
    pairs = [(0, i) for i in range(1, 200)] + [(500, 500 + i) for i in range(60)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(120)]
    names = list(range(2000))
    rng.shuffle(names)
    pairs = [(names[a], names[b]) for a, b in pairs] + [(None, 3), (4, None)]
    rng.shuffle(pairs)
    root = {n: n for p in pairs if None not in p for n in p}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    e = spark.createDataFrame(pairs, "u long, v long")
    for hub_edges in (5, 1 << 22):
        got = [(r.node, r.component) for r in connected_components(e, hub_edges=hub_edges).collect()]
        assert sorted(got) == sorted((n, top(n)) for n in root)
    assert connected_components(e.limit(0)).count() == 0 and connected_components(e.limit(0), hub_edges=0).count() == 0


def brute_hilbert(x, y, z, bits):
    a, m = [x, y, z], 1 << (bits - 1)
    q = m
    while q > 1:
        p = q - 1
        for i in range(3):
            if a[i] & q:
                a[0] ^= p
            else:
                t = (a[0] ^ a[i]) & p
                a[0] ^= t
                a[i] ^= t
        q >>= 1
    for i in (1, 2):
        a[i] ^= a[i - 1]
    t, q = 0, m
    while q > 1:
        if a[2] & q:
            t ^= q - 1
        q >>= 1
    a = [v ^ t for v in a]
    return sum(((a[i] >> k) & 1) << (3 * k + 2 - i) for k in range(bits) for i in range(3))


def test_curves(spark):
    cells = [(x, y, z) for x in range(4) for y in range(4) for z in range(4)]
    df = spark.createDataFrame(cells, "x int, y int, z int")
    rows = df.select("x", "y", "z", G.hilbert_code("x", "y", "z", 2).alias("h"), G.zorder_code("x", "y", "z").alias("m")).collect()
    assert all(r.h == brute_hilbert(r.x, r.y, r.z, 2) for r in rows)
    path = sorted(rows, key=lambda r: r.h)
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(path, path[1:]))
    assert sorted(r.m for r in rows) == list(range(64))


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal(0, 0.01, (60, 3)), rng.uniform(-5, 5, (60, 3)), [[90.0, 0, 0]]])
    rows = [(1, i, *map(float, p)) for i, p in enumerate(pts)] + [(2, i, float(i), 0.0, 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "a int, id int, x double, y double, z double")
    got = {}
    for r in P.knn(df, ["a"], 7).where("a = 1").collect():
        got.setdefault(r.id, {})[r.r] = r.nid
    assert P.knn(df, ["a"], 7).where("a = 2").count() == 16
    for i, p in enumerate(pts):
        d = ((pts - p) ** 2).sum(axis=1)
        assert [got[i][k + 1] for k in range(7)] == np.lexsort((np.arange(len(pts)), d))[:7].tolist()


def test_normals_of_a_plane(spark):
    rng = np.random.default_rng(5)
    rows = [(1, i, float(a), float(b), 0.0, 1) for i, (a, b) in enumerate(rng.random((80, 2)))]
    df = spark.createDataFrame(rows, "a int, id int, x double, y double, z double, cls int")
    for r in P.estimate_normals(df, P.knn(df, ["a"], 9), ["a"]).collect():
        assert abs(abs(r.normal[2]) - 1) < 1e-9 and abs(r.curvature) < 1e-9


def test_farthest_points(spark):
    corners = [(1, i, *map(float, p)) for i, p in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0.4, 0.4, 0), (1, 1, 0)])]
    df = spark.createDataFrame(corners, "a int, i int, x double, y double, z double")
    got = [(r.x, r.y) for r in P.farthest_points(df, ["a"], 7, ["i"]).orderBy("slot").collect()]
    assert got[0] == (0.4, 0.4) and len(set(got[:5])) == 5 and got[5:] == got[:2]


def test_refined_normals_keep_sign(spark):
    rng = np.random.default_rng(6)
    rows = [(1, i, float(a), float(b), 0.0, 1, [0.1, 0.0, -1.0], 1.0) for i, (a, b) in enumerate(rng.random((40, 2)))]
    df = spark.createDataFrame(rows, "a int, id int, x double, y double, z double, cls int, normal array<double>, radius double")
    for r in P.refine_normals(df, P.knn(df, ["a"], 8), ["a"], (1,), 0.1).collect():
        assert r.normal[2] < -0.999


def test_grid_labels_equal_the_graph_job(spark):
    rng = np.random.default_rng(11)
    cells = np.unique(rng.integers(0, 9, (150, 3)), axis=0)
    snake = np.array([(i, 0 if i % 2 else 1, 10) for i in range(12)])
    coords = np.concatenate([cells, snake])
    label = V.grid_labels(coords, 12)
    v = vox(spark, [(1, *map(int, c), None) for c in coords])
    other = {(r.x, r.y, r.z): r.component for r in V.voxel_components(v, 12).collect()}
    pairs = {(int(a), other[tuple(map(int, c))]) for a, c in zip(label, coords)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
