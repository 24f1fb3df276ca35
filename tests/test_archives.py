"""Archives read in ranges: against the plain modules, by manifest, broken and damaged ones."""

from __future__ import annotations

import hashlib
import io
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from assetlake.sources import archives as A


def contents(seed: int = 1) -> dict[str, bytes]:
    rng = random.Random(seed)
    sizes = [0, 1, 29, 1000, 70_000, 2_500_000]
    return {f"d{i % 3}/m {i}.glb": bytes(rng.choices(b"abc", k=n)) if i % 2 else rng.randbytes(n) for i, n in enumerate(sizes)} | {"é/ü.glb": b"name", "skip.txt": b"no"}


def make(folder) -> dict[tuple[str, str], str]:
    """Archives of each kind, and the digest of every member."""
    want = {}
    for kind, seed in (("stored.zip", 1), ("packed.zip", 2), ("plain.tar", 3), ("squeezed.tar.gz", 4), ("sub/packed.zip", 5)):
        some = contents(seed)
        (folder / kind).parent.mkdir(exist_ok=True)
        if kind.endswith("zip"):
            with zipfile.ZipFile(folder / kind, "w", zipfile.ZIP_STORED if "stored" in kind else zipfile.ZIP_DEFLATED) as z:
                z.writestr("folder/", b"")
                for n, c in some.items():
                    z.writestr(n, c)
        else:
            with tarfile.open(folder / kind, "w" if kind.endswith(".tar") else "w:gz") as t:
                for n, c in some.items():
                    info = tarfile.TarInfo(n)
                    info.size = len(c)
                    t.addfile(info, io.BytesIO(c))
        want |= {(kind, n): hashlib.sha256(c).hexdigest() for n, c in some.items()}
    return want


@pytest.mark.parametrize("part_bytes", [200_000, 1 << 27])
def test_every_member_is_read_in_its_range(spark, tmp_path, part_bytes):
    want = make(tmp_path)
    rows = A.read_members(A.list_members(spark, str(tmp_path)), str(tmp_path), part_bytes).collect()
    assert {(r.archive[len(str(tmp_path)) + 1 :], r.member): r.sha256 for r in rows} == want and len(rows) == len(want)
    assert all(r.error is None for r in rows)
    glb = A.find_members(spark, f"file://{tmp_path}", r"\.glb$").collect()
    assert len(glb) == len(want) - 5 and not any(r.member == "skip.txt" for r in glb)


def test_a_directory_is_read_without_contents_and_an_archive_is_work_for_many_tasks(spark, tmp_path):
    make(tmp_path)
    found = A.list_members(spark, str(tmp_path))
    sizes = {r.member: r.size for r in found.where("archive like '%plain.tar'").collect()}
    assert sizes == {n: len(c) for n, c in contents(3).items()}
    some = A.read_members(found.where("archive like '%stored.zip'"), str(tmp_path), 20_000)  # three stretches hold a beginning
    tasks = some.withColumn("task", F.spark_partition_id()).agg(F.count_distinct("task")).first()[0]
    assert tasks > 1


def test_only_archives_of_the_manifest_are_opened(spark, tmp_path):
    want = make(tmp_path)
    (tmp_path / "broken.zip").write_bytes(b"neither")
    wanted = spark.createDataFrame([("sub/packed.zip", "d0/m 3.glb"), ("plain.tar", "d2/m 5.glb"), ("plain.tar", "not there.glb"), ("gone.zip", "d0/m 0.glb")] * 2, "archive string, member string")
    got = [(r.archive[len(str(tmp_path)) + 1 :], r.member, r.sha256, r.error) for r in A.find_members(spark, str(tmp_path), "glb$", wanted).collect()]
    assert sorted(got) == [(a, m, want[a, m], None) for a, m in (("plain.tar", "d2/m 5.glb"), ("sub/packed.zip", "d0/m 3.glb"))]


def test_broken_and_damaged_archives_are_told(spark, tmp_path):
    make(tmp_path)
    (tmp_path / "broken.zip").write_bytes(b"neither")
    (tmp_path / "empty.tar").write_bytes(b"")
    raw = bytearray((tmp_path / "stored.zip").read_bytes())
    raw[raw.index(contents(1)["d2/m 2.glb"]) + 3] ^= 1
    (tmp_path / "stored.zip").write_bytes(raw)
    gz = (tmp_path / "squeezed.tar.gz").read_bytes()
    (tmp_path / "squeezed.tar.gz").write_bytes(gz[: len(gz) // 2])
    rows = A.find_members(spark, str(tmp_path), ".").collect()
    bad = {(r.archive.rpartition("/")[2], r.member) for r in rows if r.error}
    assert {("broken.zip", None), ("empty.tar", None), ("stored.zip", "d2/m 2.glb"), ("squeezed.tar.gz", None)} <= bad
    assert all((r.sha256 is None) == (r.error is not None) for r in rows)
    assert {m for a, m in bad if a == "stored.zip"} == {"d2/m 2.glb"} and not any(a in ("packed.zip", "plain.tar") for a, _ in bad)
    assert A.find_members(spark, f"{tmp_path}/nowhere", ".").count() == 0


def test_zips_written_by_tasks_are_zips(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("member"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("content")).repartition(4)
    told = A.write_zips(rows, f"{tmp_path}/out").collect()
    seen = {}
    for r in told:
        with zipfile.ZipFile(r.archive) as z:
            assert len(z.namelist()) == r.members
            seen |= {n: z.read(n) for n in z.namelist()}
    assert seen == {f"{i}.txt": b"x" * i for i in range(50)} and len(list((tmp_path / "out").iterdir())) == len(told)
