"""CAD jobs end to end on solids made here."""

from __future__ import annotations

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake.functions import geometry as G
from assetlake.operators import manifest as M
from assetlake.operators import metrics as X
from assetlake.operators import points as P
from assetlake.operators import voxel as V
from assetlake.plans import jobs as J


def npy(a):
    b = io.BytesIO()
    np.save(b, a)
    return b.getvalue()


def solid(kind: str):
    """Two square faces that share two edges."""
    u = np.linspace(-1, 1, 12)
    face = np.stack([*np.meshgrid(u, u, indexing="ij"), np.zeros((12, 12))], -1)
    faces = np.stack([face, face])
    mask = np.ones((2, 12, 12), bool)
    edges = np.stack([np.stack([u, u * 0, u * 0], -1)] * 2)
    box = np.array([[-0.5, -0.5, -0.5, 0.5, 0.5, 0.5], [-0.5, -0.5, -0.5, 0.5, 0.5, 0.5]])
    incidence = np.ones((2, 2), bool)
    if kind == "manifold":
        incidence = np.array([[True, True], [True, False]])
    if kind == "mask":
        mask[:] = False
    if kind == "parts":
        mask[:] = False
        mask[:, ::3, ::3] = True
    if kind == "box":
        box[0, 3:] = box[0, :3]
    blobs = [faces, mask, np.array([0, 9]), edges, box, box, incidence]
    return [npy(b) for b in blobs]


COLUMNS = "face_points_normalized binary, face_mask binary, face_types binary, edge_points_normalized binary, face_bbox_world binary, edge_bbox_world binary, face_edge_incidence binary"


@pytest.fixture(scope="module")
def cad(spark):
    kinds = ["good", "good", "manifold", "mask", "parts", "box", "good", "good", "good"]
    rows = [(f"s{i}", 0, i, "broken" if i == 6 else None, None if i != 7 else False, *solid(k)) for i, k in enumerate(kinds)]
    rows[8] = (*rows[8][:5], b"junk", *rows[8][6:])
    df = spark.createDataFrame(rows, f"stem string, parquet_index int, row_index int, err string, scaled_unique boolean, {COLUMNS}")
    return df.withColumn("err", F.col("err").isNotNull())


CFG = J.Curation(resolution=12, max_components=3)


def test_scan_build_finalize(spark, cad):
    found = {r.stem: r.reason for r in J.scan_candidates(cad, CFG).collect()}
    assert found == {"s0": None, "s1": None, "s2": "non_manifold_edge_incidence", "s3": "empty_face_mask", "s4": "too_many_voxel_components", "s5": "degenerate_face_bbox", "s6": "dataset_err", "s7": "scaled_unique_false", "s8": "invalid_blob"}
    candidates = J.scan_candidates(cad, CFG).where("reason is null").select("stem", "parquet_index", "row_index")
    selected = J.finalize_selection(candidates, 1, 1)
    assert sorted((r.stem, r["rank"]) for r in selected.collect()) == [("s0", 0), ("s1", 1)]
    voxels, status = J.build_voxels(cad, selected, CFG, samples=4)
    rows = voxels.where("asset = 's0'").collect()
    assert {r.status for r in status.collect()} == {"success"}
    assert {r.cls for r in rows} == {"BOUNDARY", "BSPLINE_SURFACE"} and all(len(r.samples) == 4 for r in rows)
    assert {r.vz for r in rows} == {6} and len(rows) == 49
    final = J.finalize_dataset(status, 2, 1).orderBy("rank").collect()
    assert [r.split for r in final] == ["val", "train"]


def test_too_few_candidates_fail(spark, cad):
    few = cad.select("stem", "parquet_index", "row_index").limit(2)
    with pytest.raises(Exception, match="too few"):
        J.finalize_selection(few, 2, 1).collect()


def test_stored_prune_can_be_run_again(spark, tmp_path):
    data, latents = str(tmp_path / "data"), str(tmp_path / "latents")
    rows = [(i, "val" if i % 3 == 0 else "train", i) for i in range(12)]
    spark.createDataFrame(rows, "k long, split string, rank long").write.parquet(data)
    spark.createDataFrame([(i,) for i in range(0, 12, 2)], "k long").write.parquet(latents)
    reasons = spark.createDataFrame([(i, "low" if i in (2, 3) else None) for i in range(12)], "k long, reason string")
    dry = J.prune_stored(spark, data, reasons, "k", "1", {"latents": latents})
    assert sorted(map(tuple, dry.collect())) == [("train", "low", 1), ("val", "low", 1)]
    assert spark.read.parquet(data).count() == 12
    for _ in range(2):
        live = J.prune_stored(spark, data, reasons, "k", "1", {"latents": latents}, dry_run=False)
        assert sorted(map(tuple, live.collect())) == sorted(map(tuple, dry.collect()))
        assert {r.k for r in spark.read.parquet(data).collect()} == set(range(12)) - {2, 3}
        assert {r.k for r in spark.read.parquet(latents).collect()} == {0, 4, 6, 8, 10}
    assert spark.read.parquet(f"{data}.backup-1").count() == 12


def test_choices_of_fields_and_reasons(spark):
    assert M.needs("a", "b, a") and M.needs("a", "all") and not M.needs("a", "b,ab")
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, reason string")
    assert [r.k for r in M.filter_reasons(df, ["y", "z"]).collect()] == [2]
    with pytest.raises(Exception, match="no row with reason z"):
        M.filter_reasons(df, ["z"]).collect()
    assert M.limit_samples(df, ["k"], 0).count() == 3


def test_merged_leaves_must_differ(spark):
    leaves = lambda *rows: spark.createDataFrame([(1, *r) for r in rows], "k long, path string, value string")
    got = X.merge_leaves(leaves(("a/x", "1")), leaves(("a/y", "2"), ("b", "3")), "k").collect()
    assert sorted((r.path, r.value) for r in got) == [("a/x", "1"), ("a/y", "2"), ("b", "3")]
    for other in (("a/x", "2"), ("a", "2")):
        with pytest.raises(Exception, match="duplicate leaf"):
            X.merge_leaves(leaves(("a/x", "1")), leaves(other), "k").collect()


def test_colours_of_classes(spark):
    one = lambda n, i: [float(j == i) for j in range(n)]
    df = spark.createDataFrame([(i, one(8, i)) for i in range(8)] + [(10 + i, one(7, i)) for i in range(7)], "k long, hot array<double>")
    got = {r.k: tuple(r.c) for r in df.select("k", G.class_color(F.col("hot")).alias("c")).collect()}
    assert all(got[i] == G.CLASS_COLORS[i] for i in range(8)) and all(got[10 + i] == G.CLASS_COLORS[i + 1] for i in range(7))


def test_large_grids_are_a_graph_job(spark):
    rng = random.Random(5)
    vox = spark.createDataFrame([(b, *(rng.randrange(9) for _ in range(3))) for b in range(3) for _ in range(90)], "b long, x int, y int, z int")
    one, two = (sorted(map(tuple, V.component_sizes(vox, 9, limit).collect())) for limit in (128, 8))
    assert one == two


def test_neighbours_in_clusters_with_outliers(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice((0.0, 5.0)) + rng.random() * 1e-3, rng.random() * 1e-3, 0.0) for i in range(300)]
    rows += [(300 + i, 1.0, 1.0, 1.0) for i in range(80)] + [(400, 1e6, 0.0, 0.0), (401, -1e5, 3.0, 0.0)]
    points = spark.createDataFrame([(7, *r) for r in rows], "asset long, id long, x double, y double, z double")
    got = {}
    for r in P.knn(points, ["asset"], 3).collect():
        got.setdefault(r.id, []).append((r.d2, r.nid))
    for i, *a in rows:
        d = sorted(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, j) for j, *b in rows)[:3]
        assert sorted(got[i])[0][1] == d[0][1] and [x for x, _ in sorted(got[i])] == pytest.approx([x for x, _ in d])
