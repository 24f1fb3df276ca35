"""Readers and writers on files made here: blobs, archives, logs, splits, replaced tables, streams."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assetlake.functions import udf as U
from assetlake.operators import curation as Q
from assetlake.operators import metrics as X
from assetlake.sources import files as S
from assetlake.streaming import jobs as J


def npy(a, **kw):
    b = io.BytesIO()
    np.save(b, a, **kw)
    return b.getvalue()


def test_npy_blobs(spark):
    rows = [("a", npy(np.arange(6.0).reshape(2, 3)), npy(np.array([True, False]))), ("b", b"junk", None), ("c", npy(np.array([{}], dtype=object), allow_pickle=True), npy(np.float32(3)))]
    df = spark.createDataFrame(rows, "stem string, p binary, q binary")
    got = {r.stem: r for r in S.decode_npy_blobs(df, "stem", ["p", "q"]).collect()}
    assert got["a"].p == [0, 1, 2, 3, 4, 5] and got["a"].p_shape == [2, 3] and got["a"].q == [1, 0]
    assert got["b"].p_error == got["b"].q_error == got["c"].p_error == "invalid_blob" and got["c"].q_shape == []


def test_shape_reason(spark):
    good = {"face_points": [2, 4, 4, 3], "edge_points": [3, 8, 3], "face_bbox": [2, 6], "edge_bbox": [3, 6], "face_edge": [2, 3], "face_mask": [2, 4, 4], "face_types": [2]}
    cases = [({}, None), ({"face_points": [2, 4, 3]}, "invalid_face_grid_shape"), ({"face_bbox": [2, 5]}, "invalid_face_bbox_shape"), ({"face_mask": [2]}, "invalid_face_mask_shape"), ({"face_types": [3]}, "face_types_count_mismatch"), ({"edge_bbox": [2, 6]}, "edge_bbox_count_mismatch")]
    schema = "i int, invalid boolean, any_mask boolean, " + ", ".join(f"{k}_shape array<int>" for k in good)
    rows = [(i, False, True, *(good | c).values()) for i, (c, _) in enumerate(cases)] + [(90, True, True, *good.values()), (91, False, False, *good.values())]
    got = {r.i: r.reason for r in spark.createDataFrame(rows, schema).select("i", Q.shape_reason().alias("reason")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    assert (got[90], got[91]) == ("invalid_blob", "empty_face_mask")


def test_npz_ply_views_archives(spark, tmp_path):
    (tmp_path / "z").mkdir()
    np.savez(tmp_path / "z/s1.npz", mean=np.ones((2, 2)), coords=np.zeros((1, 3), np.uint8))
    r = S.scan_npz(spark, str(tmp_path / "z"), "mean").first()
    assert (r.asset, r.shape, r["values"]) == ("s1", [2, 2], [1.0] * 4)
    assert S.scan_npz(spark, str(tmp_path / "z"), "feats").first().shape is None
    (tmp_path / "p").mkdir()
    head = "ply\nformat {}\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\n{}end_header\n"
    (tmp_path / "p/a.ply").write_text(head.format("ascii 1.0", "") + "0.1 0.2 0.3\n-0.5 0 0.25\n")
    (tmp_path / "p/b.ply").write_bytes(head.format("binary_little_endian 1.0", "property uchar red\nelement face 0\n").encode() + b"".join(np.array([v], [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1")]).tobytes() for v in [(1, 2, 3, 9), (4, 5, 6, 9)]))
    got = sorted((r.asset, r.point_id, round(r.x, 3), round(r.z, 3)) for r in S.scan_point_ply(spark, str(tmp_path / "p")).collect())
    assert got == [("a", 0, 0.1, 0.3), ("a", 1, -0.5, 0.25), ("b", 0, 1.0, 3.0), ("b", 1, 4.0, 6.0)]
    (tmp_path / "v/asset7").mkdir(parents=True)
    (tmp_path / "v/asset7/transforms.json").write_text(json.dumps({"frames": [{"file_path": "0.png", "camera_angle_x": 0.7, "transform_matrix": np.eye(4).tolist()}, {"file_path": "1.png", "camera_angle_x": 0.8, "transform_matrix": np.eye(4).tolist()}]}))
    v = S.scan_views(spark, str(tmp_path / "v")).orderBy("view").collect()
    assert [(x.asset, x.view, x.file_path, x.transform_matrix[3][3]) for x in v] == [("asset7", 0, "0.png", 1.0), ("asset7", 1, "1.png", 1.0)]
    (tmp_path / "ar").mkdir()
    with zipfile.ZipFile(tmp_path / "ar/x.zip", "w") as z:
        z.writestr("m/one.glb", b"abc")
        z.writestr("m/skip.txt", b"no")
    with tarfile.open(tmp_path / "ar/y.tar", "w") as z:
        info = tarfile.TarInfo("two.glb")
        info.size = 2
        z.addfile(info, io.BytesIO(b"hi"))
    m = sorted((r.member, r.size, r.sha256[:8]) for r in S.scan_archive_members(spark, str(tmp_path / "ar"), r"\.glb$").collect())
    assert m == [("m/one.glb", 3, "ba7816bf"), ("two.glb", 2, "8f434346")]
    assert S.content_sha256(spark, str(tmp_path / "ar")).count() == 2
    assert [r.key for r in S.scan_artifacts(spark, str(tmp_path / "z"), r"([^/]+)\.npz$", "latent").collect()] == ["s1"]


def test_bad_files_are_reported(spark, tmp_path):
    pq.write_table(pa.table({"a": [1, 2]}), tmp_path / "good.parquet")
    (tmp_path / "bad.parquet").write_bytes((tmp_path / "good.parquet").read_bytes()[:20])
    got = {r.path.rpartition("/")[2]: r.error for r in S.quarantine_bad_files(spark, str(tmp_path)).collect()}
    assert got["good.parquet"] is None and got["bad.parquet"]


def test_bad_files_keep_their_place_and_good_ones_are_not_read(spark, tmp_path, monkeypatch):
    for name, rows in (("a b+c", [1]), ("d", []), ("f", [2, 3])):
        pq.write_table(pa.table({"a": pa.array(rows, pa.int64())}), tmp_path / f"{name}.parquet")
    (tmp_path / "c.parquet").write_bytes(b"PAR1 not really")
    got = {r.path.rpartition("/")[2]: (r.parquet_index, r.error is None) for r in S.quarantine_bad_files(spark, str(tmp_path)).collect()}
    assert got == {"a b+c.parquet": (0, True), "c.parquet": (1, False), "d.parquet": (2, True), "f.parquet": (3, True)}
    monkeypatch.setattr(S, "MOST_CONTENT", 4)
    got = {r.path.rpartition("/")[2]: r.error for r in S.quarantine_bad_files(spark, str(tmp_path)).collect()}
    assert got["c.parquet"] == "unreadable footer" and got["f.parquet"] is None


def test_archives_by_manifest_and_in_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/x.glb", b"deep")
    for name in ("one", "two", "broken"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("x.glb", name.encode())
            z.writestr("y.glb", b"y")
            z.writestr("in.zip", inner.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"neither zip nor tar")
    wanted = spark.createDataFrame([("one.zip", "x.glb"), ("two.zip", "in.zip!/deep/x.glb"), ("gone.zip", "x.glb")], "archive string, member string")
    got = sorted((r.archive.rpartition("/")[2], r.member, r.size) for r in S.scan_archive_members(spark, str(tmp_path), "glb$", wanted, depth=1).collect())
    assert got == [("one.zip", "x.glb", 3), ("two.zip", "in.zip!/deep/x.glb", 4)]  # the broken one is not opened
    flat = S.scan_archive_members(spark, str(tmp_path), "in", wanted.where("archive = 'one.zip'")).count()
    assert flat == 0 and S.scan_archive_members(spark, str(tmp_path), "glb$", wanted.where("archive = 'gone.zip'")).count() == 0


def test_cad_index(spark, tmp_path):
    for n, v in (("b", [3, 4]), ("a", [1, 2])):
        pq.write_table(pa.table({"v": v}), tmp_path / f"{n}.parquet")
    got = sorted((r.v, r.parquet_index, r.row_index) for r in S.scan_cad_parquet(spark, str(tmp_path), ["v"]).collect())
    assert got == [(1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1)]
    assert S.scan_cad_parquet(spark, str(tmp_path), ["v"], max_files=1).count() == 2


def test_record_shards_are_told_apart(spark, tmp_path):
    for n in ("feature_dino_0.csv", "feature_dino_large_0.csv"):
        (tmp_path / n).write_text("sha256,done\nx,true\n")
    got = S.scan_record_shards(spark, str(tmp_path), S.stage_pattern("feature_dino"), "sha256 string, done boolean")
    assert [r.shard for r in got.collect()] == ["feature_dino_0.csv"]
    assert S.scan_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(ValueError):
        S.scan_published_manifest(spark, {"a": str(tmp_path)}, "b", "x int")


def test_run_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("10: {'time': {'step': 1.0}, 'loss': np.float64(0.5), 'bin_3': {'mse': np.float64(0.4)}, 'grad_norm': 2e-1}\n20: {'loss': nan}\nnoise\nValidation mIoU_occ: 0.25\nValidation mIoU: 0.75\n")
    got = {(r.step, r.metric): r.value for r in S.scan_run_log(spark, str(tmp_path)).collect()}
    assert got.pop((20, "loss")) != got.get((10, "loss"))
    assert got == {(10, "loss"): 0.5, (10, "grad_norm"): 0.2, (10, "bin_3"): 0.4, (None, "miou_occ"): 0.25, (None, "miou"): 0.75}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "val"), (2, "train"), (3, "train")], "k int, split string")
    S.write_split_dataset(df, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d/records")).where("split = 'train'").count() == 2
    assert json.loads(spark.read.text(str(tmp_path / "d/manifest")).first()[0])["rows"] == 3
    path = str(tmp_path / "t")
    df.write.parquet(path)
    old = S.replace_table(df.where("k > 1"), path, "001")
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(old).count() == 3
    counts = S.delete_artifacts(spark.read.parquet(path), spark.createDataFrame([(2,), (9,)], "k int"), "k", path, "002", dry_run=False)
    assert tuple(counts.first()) == (1, 1) and [r.k for r in spark.read.parquet(path).collect()] == [3]
    S.write_voxel_table(spark.createDataFrame([(1, 0, 0, 1), (1, 0, 0, 0)], "asset int, x int, y int, z int"), str(tmp_path / "v"))
    S.write_metric_csv(df, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 3
    files = spark.createDataFrame([("r", "a_step10.pt"), ("r", "best.pt"), ("r", "ema_step10.pt")], "run string, path string")
    assert S.preferred_file(files, "run", "path", ["^best", "^a_", "^ema"]).first().path == "best.pt"


def test_streamed_merge_equals_batch(spark, tmp_path):
    table, shards = str(tmp_path / "m"), tmp_path / "s"
    shards.mkdir()
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.parquet(table)
    (shards / "r_0.csv").write_text("k,v\na,\nb,5\n")
    args = (spark, str(shards), "k string, v int", table, "k", ["v"], str(tmp_path / "ck"))
    J.stream_records(*args)
    (shards / "r_1.csv").write_text("k,v\na,7\nc,9\n")
    J.stream_records(*args)
    J.stream_records(*args)
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [("a", 7), ("b", 5)]


def test_best_values_are_kept_between_runs(spark, tmp_path):
    src, out, schema = tmp_path / "in", str(tmp_path / "out"), "run string, step long, value double"
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 9.0]
    for k in (4, 0):
        spark.createDataFrame([("r", k + i, v) for i, v in enumerate(values[k : k + 4])], schema).coalesce(1).write.mode("append").parquet(str(src))
        J.drain(J.stream_best(spark.readStream.schema(schema).parquet(str(src))), lambda b, n: b.withColumn("n", F.lit(n)).write.mode("append").parquet(out), str(tmp_path / "ck"), "update")
    best = spark.read.parquet(out).orderBy(F.desc("n")).first()
    assert (best.step, best.best) == (5, 9.0)


def test_user_code(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None)], "k int, v array<double>")
    got = {r.k: r for r in U.map_assets(df, "k", lambda r: None if r["k"] == 2 else {"total": float(sum(r["v"]))}, "total double").collect()}
    assert got[1].total == 3.0 and 2 not in got and got[3].error.startswith("TypeError")
    enc = {r.k: r for r in U.encode_assets(df.where("v is not null"), "k", "v", lambda: lambda x: 1 / x).collect()}
    assert enc[1].encoded == [1.0, 0.5] and enc[2].error == "non-finite"
    steps = U.Funnel().register("a", F.col("k") > 1).register("b", F.col("v").isNotNull()).steps
    assert [n for n, _ in steps] == ["a", "b"]
    U.register_dataset("tiny", lambda s: df)
    assert U.dataset("tiny", spark).count() == 3
    with pytest.raises(KeyError):
        U.dataset("nope")
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (1, "b", 5.0), (2, "b", 6.0)], "step int, path string, value double")
    assert {r.path: r.value for r in U.reduce_leaves(rows, "path", "value", special={"b": "last"}).collect()} == {"a": 2.0, "b": 6.0}


def shard(spark, path, n):
    spark.createDataFrame([(n, 10 * n)], "k long, v long").coalesce(1).write.mode("append").option("header", True).csv(path)


@pytest.mark.parametrize("step", ["before", "between", "after"])
def test_streamed_merge_survives_a_crash_at_each_rename(spark, tmp_path, monkeypatch, step):
    table, shards, ck = (str(tmp_path / x) for x in ("manifest", "shards", "offsets"))
    spark.createDataFrame([(i, 0) for i in range(4)], "k long, v long").write.parquet(table)
    args = (spark, shards, "k long, v long", table, "k", ["v"], ck)
    shard(spark, shards, 1)
    J.stream_records(*args)
    shard(spark, shards, 2)
    whole = S._swap

    def stops(s, path, tag):
        (new, fs), (here, _), (old, _) = S._fs(s, f"{path}._staging-{tag}"), S._fs(s, path), S._fs(s, f"{path}.backup-{tag}")
        if step != "before":
            fs.rename(here, old)
        if step == "after":
            fs.rename(new, here)
        raise OSError("the driver is gone")

    monkeypatch.setattr(S, "_swap", stops)
    with pytest.raises(Exception, match="the driver is gone"):
        J.stream_records(*args)
    monkeypatch.setattr(S, "_swap", whole)
    J.stream_records(*args)
    shard(spark, shards, 3)
    J.stream_records(*args)
    assert sorted(tuple(r) for r in spark.read.parquet(table).collect()) == [(0, 0), (1, 10), (2, 20), (3, 30)]


def test_a_session_on_a_cluster_must_name_its_folder():
    from assetlake.session import shared_dir

    class Conf:
        def get(self, name, default):
            return default

    class Checkpoint:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        def sc(self):
            return self

        def getCheckpointDir(self):
            return Checkpoint()

    class Session:
        conf = Conf()
        sparkContext = Context()

    Session.sparkContext._jsc = Session.sparkContext
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_the_data_source_reads_what_is_asked_for(spark, tmp_path):
    from assetlake.sources import datasource as D

    D.register(spark)
    rows = spark.createDataFrame([(f"a{i}", [2, 2], [float(i), 1.0, 2.0, 3.0]) for i in range(9)], "asset string, shape array<int>, values array<float>")
    path = f"{tmp_path}/my arrays"
    assert D.write_npz(rows, path, "mean").count() == 9
    (tmp_path / "my arrays" / "broken.npz").write_bytes(b"no zip")
    read = lambda field="mean": spark.read.format("assets").option("kind", "npz").option("field", field).option("partitionBytes", "600").load(path)
    got = read().where("asset in ('a3', 'a5') and size(values) = 4").collect()  # the broken file is never opened
    assert sorted((r.asset, r.shape, r["values"]) for r in got) == [("a3", [2, 2], [3.0, 1.0, 2.0, 3.0]), ("a5", [2, 2], [5.0, 1.0, 2.0, 3.0])]
    assert read().where("asset = 'a1'").rdd.getNumPartitions() == 1 and read("other").where("asset = 'a1'").first().shape is None
    with pytest.raises(Exception, match="(?i)zip|pickle|magic"):
        read().collect()
    assert spark.read.format("assets").option("kind", "npz").load(f"{tmp_path}/nowhere").count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        spark.read.format("assets").option("kind", "jpeg").load(path)
    np_points = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n"
    (tmp_path / "c.ply").write_bytes(np_points)
    assert sorted(tuple(r) for r in spark.read.format("assets").option("kind", "ply").load(f"file://{tmp_path}").collect()) == [("c", 0, 1.0, 2.0, 3.0), ("c", 1, 4.0, 5.0, 6.0)]


@pytest.mark.parametrize("most", [7, 64, 1 << 20])
def test_ranges_of_lines_are_whole_and_come_once(spark, tmp_path, most):
    from assetlake.sources import datasource as D

    text = "".join(f"line {i} " + "x" * (i * 7 % 40) + "\n" for i in range(50)) + "\n\nlast\n"
    (tmp_path / "run.log").write_text(text)
    D.register(spark)
    got = sorted((r.offset, r.value) for r in spark.read.format("assets").option("kind", "lines").option("partitionBytes", str(most)).load(str(tmp_path)).collect())
    assert [v for _, v in got] == text.split("\n")[:-1] and all(text[o : o + len(v)] == v for o, v in got)


def test_a_log_is_followed_as_it_grows(spark, tmp_path):
    from assetlake.sources import datasource as D

    D.register(spark)
    src, out = tmp_path / "log", str(tmp_path / "out")
    src.mkdir()
    drain = lambda: J.drain(spark.readStream.format("assets").option("kind", "lines").load(str(src)), lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "ck"))
    (src / "a.txt").write_text("one\ntwo\nthr")
    drain()
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == ["one", "two"]  # a line without an end waits
    with open(src / "a.txt", "a") as f:
        f.write("ee\nfour\n")
    (src / "b.txt").write_text("new\n")
    drain()
    drain()
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == ["four", "new", "one", "three", "two"]
