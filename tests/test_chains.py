"""Composite jobs, deep leaves, face components, rows by number and own reductions on small made cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake.functions import udf as U
from assetlake.operators import metrics as X
from assetlake.operators import points as P
from assetlake.operators import views as W
from assetlake.plans import jobs as J
from assetlake.sources import files as S


def test_leaves_at_any_depth(spark):
    texts = ['{"a":{"b":{"c":{"d":{"e":1,"l":[1,{"x":2}]}}},"s":"t/u"},"n":null,"z":{}}', "no json", "[1,2]", None, "{}", '{"k":1,"k":2}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    got = {(r.id, r.path): r.value for r in X.flatten_json(df, "id", "j").collect()}
    assert got == {(0, "a/b/c/d/e"): "1", (0, "a/b/c/d/l"): '[1,{"x":2}]', (0, "a/s"): "t/u", (0, "n"): None}
    assert X.flatten_json(df.where("id = 0"), "id", "j", ".").where("path = 'a.b.c.d.e'").count() == 1
    assert X.flatten_json(df.limit(0), "id", "j").count() == 0


@pytest.mark.parametrize(("left", "right", "ok"), [("a/b/c/d", "a/b/c/e", True), ("a/b/c", "a/b/c/d/e", False), ("a/b", "a/b/c", False), ("a/b/c/d", "a/b/c/d", False), ("a/bc", "a/b/c", True)])
def test_merged_leaves_conflict_at_every_level(spark, left, right, ok):
    leaf = lambda p: spark.createDataFrame([(1, p, "v")], "k int, path string, value string")
    merged = X.merge_leaves(leaf(left), leaf(right), "k")
    if ok:
        assert {r.path for r in merged.collect()} == {left, right}
    else:
        with pytest.raises(Exception, match="duplicate leaf"):
            merged.collect()


def test_faces_hang_together_over_edges_only(spark):
    fan = [("a", 0, 1, 2 + i) for i in range(40)]  # one edge with 40 faces
    rows = [*fan, ("a", 100, 101, 102), ("a", 102, 103, 104), ("a", 101, 102, 105), ("b", 0, 1, 2), ("b", 0, 1, 2)]
    got = W.mesh_components(spark.createDataFrame(rows, "m string, i0 int, i1 int, i2 int"), ["m"]).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.component, []).append((r.m, r.i0, r.i1, r.i2))
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, [fan, [("a", 100, 101, 102), ("a", 101, 102, 105)], [("a", 102, 103, 104)], [("b", 0, 1, 2)] * 2]))


def test_rows_are_read_from_their_files_only(spark, tmp_path):
    path = str(tmp_path / "my cad")
    spark.range(40).withColumn("v", F.col("id") * 2).repartitionByRange(8, "id").write.parquet(path)
    cad = S.scan_cad_parquet(spark, path, ["id"])
    wanted = cad.where("id in (3, 5, 33)").select("file_path", "row_index")
    wanted = spark.createDataFrame(wanted.collect(), wanted.schema)
    got = S.read_rows(spark, wanted.unionByName(wanted), ["id", "v"])
    assert sorted((r.id, r.v) for r in got.collect()) == [(3, 6), (5, 10), (33, 66)]
    assert len(got.inputFiles()) == wanted.select("file_path").distinct().count() < 8
    gone = wanted.withColumn("row_index", F.col("row_index") + 1000)
    with pytest.raises(ValueError, match="not there"):
        S.read_rows(spark, gone, ["id"])
    with pytest.raises(Exception, match="(?i)not.exist|not_found"):
        S.read_rows(spark, wanted.withColumn("file_path", F.concat("file_path", F.lit(".x"))), ["id"])
    with pytest.raises(ValueError):
        S.read_rows(spark, wanted.limit(0), ["id"])


def test_own_reductions_merge_their_states(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"p{i % 5}", float(i)) for i in range(500)] + [(1, "p0", None)], "step int, path string, value double").repartition(7)
    spread = U.UserAggregate(lambda: None, lambda s, steps, v: (v.min(), v.max()) if s is None else (min(s[0], v.min()), max(s[1], v.max())), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), lambda s: float(s[1] - s[0]))
    got = {r.path: r.value for r in U.reduce_leaves(rows, "path", "value", spread, {"p1": "max", "p2": spread}).collect()}
    assert got == {"p0": 495.0, "p1": 496.0, "p2": 495.0, "p3": 495.0, "p4": 495.0}
    got = {r.path: r.value for r in U.reduce_leaves(rows, "path", "value", "min", {"p3": spread}).collect()}
    assert got == {"p0": 0.0, "p1": 1.0, "p2": 2.0, "p3": 495.0, "p4": 4.0}


def test_the_line_takes_the_last_samples(spark):
    df = spark.createDataFrame([(i, float(i), 100.0 if i < 50 else 2.0 * i + 1) for i in range(100)], "step int, x double, y double")
    r = X.fit_line(df, F.col("y"), F.col("x"), 50, [F.col("step")]).first()
    assert (round(r.slope, 9), round(r.intercept, 9), r.n) == (2.0, 1.0, 50)


def angle(u, v):
    return np.degrees(np.arccos(min(1.0, abs(np.dot(u, v)) / (np.linalg.norm(u) * np.linalg.norm(v)))))


def normal(points):
    return np.linalg.eigh(np.cov(np.array(points).T))[1][:, 0]


def test_point_cloud_chain_by_brute_force(spark):
    """Two planes and the seam between them: every stage again in numpy."""
    rng = np.random.default_rng(5)
    rows, truth = [], []
    for i in range(9):
        for j in range(9):
            u, w = i / 10 + rng.uniform(0, 0.003), j / 10 + rng.uniform(0, 0.003)
            rows += [(1, i, j, 1, u + 0.1, w, 0.0), (1, 100 + i, j, 2, 0.0, w, u + 0.1)]
            truth += [(1, 1, 7, len(truth), u + 0.1, w, 0.001, [0.0, 0.0, 1.0]), (1, 2, 8, len(truth) + 1, 0.001, w, u + 0.1, [1.0, 0.0, 0.0])]
        rows.append((1, 200, i, 0, 0.0, i / 10, 0.0))
        truth.append((1, 0, 9, len(truth), 0.0, i / 10, 0.0, [1.0, 0.0, 1.0]))
    rows += [(1, 300, k, r[3], *r[4:]) for k, r in enumerate(rows[:5])] + [(1, 301, 0, 1, 5.0, 0.0, 0.0)]
    samples = spark.createDataFrame(rows, "asset int, voxel int, slot int, cls int, x double, y double, z double").repartition(3)
    faces = spark.createDataFrame(truth, "asset int, cls int, face int, id int, x double, y double, z double, normal array<double>")
    cfg = J.Cloud(k=6, boundary=0, boundary_k=9, round_classes=(5,), patch_k=5, patch_scale=1.5, patch_gap=50, patch_angle=20.0, min_patch=4, classes=(0, 1, 2))
    cloud = J.clean_cloud(samples, cfg).collect()
    assert len(cloud) == 171 and sorted(r.source_count for r in cloud)[-5:] == [2] * 5
    at = {r.id: np.array([r.x, r.y, r.z]) for r in cloud}
    cls = {r.id: r.cls for r in cloud}
    for r in cloud:
        pool = [i for i in at if r.cls == 0 or cls[i] == r.cls]
        near = sorted(pool, key=lambda i: (((at[i] - at[r.id]) ** 2).sum(), i))[: 9 if r.cls == 0 else 6]
        assert angle(normal([at[i] for i in near]), np.array(r.normal)) < 1e-3 or r.cls == 0
    assert any(abs(r.normal[0]) > 0.1 and abs(r.normal[2]) > 0.1 for r in cloud if r.cls == 0)  # the seam sees both planes
    report, angles = J.point_cloud_report(samples, faces, cfg)
    row = report.first()
    own = {r.id: min(truth, key=lambda t: (t[1] != r.cls, ((at[r.id] - np.array(t[4:7])) ** 2).sum(), t[3])) for r in cloud}
    dist = [np.linalg.norm(at[i] - np.array(t[4:7])) for i, t in own.items()]
    turned = {r.id: angle(np.array(r.normal), np.array(own[r.id][7])) for r in cloud}
    assert row.matched == 171 and abs(row.mean_dist - np.mean(dist)) < 1e-9 and abs(row.median_angle - np.median(list(turned.values()))) < 1e-5
    assert (row.class_0, row.class_1, row.class_2, row.valid_normals, row.patches) == (9, 81, 81, 171, 2)
    assert row.purity == 1.0 and abs(row.completeness - 162 / 171) < 1e-9  # the seam's face has no patch
    by = {r.cls: r for r in angles.collect()}
    assert (by[None].n, by[1].n, by[0].n) == (171, 81, 9) and by[1].within_5 == 1.0


def test_own_class_is_the_default_neighbourhood(spark):
    p = spark.createDataFrame([(1, i, i % 2, float(i), 0.0, 0.0) for i in range(8)], "asset int, id int, cls int, x double, y double, z double")
    pairs = lambda df: {(r.id, r.nid) for r in df.collect()}
    assert pairs(P.class_neighbours(p, "asset", 2)) == pairs(P.knn(p, ["asset", "cls"], 2))
    mixed = pairs(P.class_neighbours(p, "asset", 2, 0, 2))
    assert (4, 3) in mixed and (4, 2) not in mixed and (5, 3) in mixed and (5, 4) not in mixed


def test_half_precision_is_ieee(spark):
    from assetlake.functions import geometry as G

    rng = np.random.default_rng(1)
    values = [*(rng.normal(size=300) * 10.0 ** rng.integers(-8, 6, 300)).tolist(), 0.0, 65504.0, 65519.9, 65520.0, 1e9, -1e9, 2.0**-24, 2.0**-25, 2.0**-14, 8.0, 1023.75, float("inf"), float("nan"), *[2.0**k for k in range(-20, 16)]]
    got = [r.h for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", G.to_half(F.col("v")).alias("h")).orderBy("i").collect()]
    with np.errstate(over="ignore"):
        want = np.array(values).astype(np.float16).astype(float)
    assert np.array_equal(np.array(got), want, equal_nan=True)


def test_loads_go_to_the_lightest_open_group():
    from assetlake.operators.sampling import balance_loads

    rng = np.random.default_rng(2)
    for _ in range(200):
        loads, k, equal = rng.integers(0, 9, rng.integers(0, 30)).tolist(), int(rng.integers(1, 6)), bool(rng.integers(0, 2))
        total, size, want = [0.0] * k, [0] * k, [0] * len(loads)
        for i in sorted(range(len(loads)), key=lambda i: -loads[i]):
            open_ = [g for g in range(k) if not (equal and len(loads) >= k and size[g] >= len(loads) // k)]
            g = min(open_, key=lambda g: (total[g], g), default=0)
            want[i], total[g], size[g] = g, total[g] + loads[i], size[g] + 1
        assert balance_loads(loads, k, equal) == want


def test_chunks_of_a_large_group_are_bounded(spark):
    from assetlake.operators.sampling import balance_chunks

    df = spark.createDataFrame([("big", i, i % 17) for i in range(230)] + [(None, 1000 + i, None) for i in range(5)], "s string, k int, load int")
    rows = balance_chunks(df, "s", "k", "load", 4, most=50).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault((r.s, r.chunk), []).append(r.group)
    assert len(rows) == 235 and sorted(map(len, sizes.values())) == [5, 30, 50, 50, 50, 50]
    assert all(max(v.count(g) for g in range(4)) - len(v) // 4 <= 3 for v in sizes.values())


def test_a_tensor_without_a_known_layout_is_an_error(spark):
    from assetlake.operators import voxel as V

    t = spark.createDataFrame([(1, [3, 1, 1, 2], [1.0] * 6)], "asset int, shape array<int>, values array<float>")
    with pytest.raises(Exception, match="no channel layout"):
        V.from_layout(t).collect()
    eight = spark.createDataFrame([(1, [8, 1, 1, 2], [0.0] * 15 + [2.0]), (2, [1, 2, 1, 14], [0.0] * 14 + [3.0] + [0.0] * 13)], t.schema)
    got = {(r.b, r.x, r.y, r.z): r.feats for r in V.from_layout(eight).collect()}
    assert got == {(1, 0, 0, 1): [0.0] * 7 + [2.0], (2, 0, 1, 0): [3.0] + [0.0] * 13}


def test_balanced_shards_fill_every_batch(spark):
    df = spark.createDataFrame([(i, (i * 7) % 31 + 1, [float(i), 1.0]) for i in range(50)], "id long, load long, v array<double>").withColumns({"captions": F.lit('["a"]'), "plain": F.lit("p")})
    cfg = J.Shards(seed=1, world=3, batch=4, balanced=True, mean=(0.0, 1.0), std=(2.0, 1.0), per=1)
    dealt = J.training_shards({"one": df}, [("all", F.lit(True))], "id", cfg, "load")
    items, rows = J.fill_training_shards(dealt, "id", cfg, "v", "captions", "plain")
    assert items.count() == 48 and {r["count"] for r in items.groupBy("rank", "slot0").count().collect()} == {4}
    got = {(r.id, r.channel): r.value for r in rows.collect()}
    assert all(got[i, 0] == i / 2 and got[i, 1] == 0.0 for i, _ in got) and {r.caption for r in items.collect()} == {"a"}
