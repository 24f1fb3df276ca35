"""Readers and writers of manifests, records, CAD shards, blobs, logs and tables.

Everything goes through Spark's readers, writers and file system, so any store that
Spark reaches will do; file contents are decoded in tasks. Artefacts are listed by tasks
where pyarrow's file systems reach them.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlake.sources.datasource import find_files, is_folder


def scan_manifest(spark: SparkSession, roots: str, schema: str, root_of: str | None = None) -> DataFrame:
    """CSV manifests of one or more comma-separated roots, tagged with their root.

    ``root_of`` names a partition folder (``name=value``) to take the root from.
    """
    paths = [p.strip() for p in roots.split(",") if p.strip()]
    raw = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(paths)
    file = F.col("_metadata.file_path")
    root = F.regexp_extract(file, f"{root_of}=([^/]+)/", 1) if root_of else F.regexp_extract(file, "^(.*)/[^/]+$", 1)
    return raw.select("*", root.alias("root"))


def scan_published_manifest(spark: SparkSession, paths: dict[str, str], subset: str, schema: str) -> DataFrame:
    """The manifest of a known subset; another name is an error."""
    if subset not in paths:
        raise ValueError(f"unknown subset {subset!r}; known: {sorted(paths)}")
    return scan_manifest(spark, paths[subset], schema)


def scan_record_shards(spark: SparkSession, path: str, pattern: str, schema: str) -> DataFrame:
    """Record shards whose file name matches the whole anchored pattern; bad files are skipped."""
    raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    return raw.select("*", name.alias("shard"), F.col("_metadata.file_block_start").alias("block")).where(F.col("shard").rlike(f"^(?:{pattern})"))


def stage_pattern(stage: str) -> str:
    """``{stage}_{rank}.csv`` and not the shards of a longer stage name."""
    return re.escape(stage) + r"_\d+\.csv$"


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped and a missing path is an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def scan_cad_parquet(spark: SparkSession, root: str, columns: list[str], max_files: int | None = None) -> DataFrame:
    """Pruned columns with ``file_path``, ``parquet_index`` (files in path order) and ``row_index``."""
    df = spark.read.option("recursiveFileLookup", True).parquet(root).select(*columns, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))
    files = df.select("file_path").distinct()  # a row per file
    files = files.withColumn("parquet_index", F.row_number().over(Window.orderBy("file_path")) - 1)
    if max_files:
        files = files.where(F.col("parquet_index") < max_files)
    return df.join(files, "file_path")


def scan_table_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``scan_cad_parquet`` of one table, whether it is a file or a folder of part files.

    ``file_path`` is the table's path and ``row_index`` goes on from part to part, in path order.
    """
    df = scan_cad_parquet(spark, path, columns)
    sizes = df.groupBy("parquet_index").agg((F.max("row_index") + 1).alias("_n"))  # a row per file
    before = Window.orderBy("parquet_index").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("parquet_index", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = [F.lit(path).alias("file_path"), F.lit(0).alias("parquet_index"), (F.col("_start") + F.col("row_index")).alias("row_index")]
    return df.join(F.broadcast(starts), "parquet_index").select(*columns, *place)


def fetch_rows(cad: DataFrame, wanted: DataFrame) -> DataFrame:
    """Exactly the requested (file_path, row_index) rows."""
    return cad.join(wanted, ["file_path", "row_index"], "left_semi")


def read_rows(spark: SparkSession, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """``file_path, row_index`` and the columns of exactly the wanted rows; a row that isn't there is an error.

    Only the files that are asked for are opened, by their own paths. Whether all rows
    exist is seen from row numbers alone before any column is read; a missing file is
    Spark's own error. Rows asked for twice come once.
    """
    wanted = wanted.select("file_path", "row_index").distinct()
    uri = spark.sparkContext._jvm.java.net.URI
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri(r.file_path)).toString() for r in wanted.select("file_path").distinct().collect()]  # a row per file
    place = [F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index")]
    if not paths:
        raise ValueError("no rows are asked for")
    files = spark.read.parquet(*paths)
    missing = wanted.join(files.select(*place), ["file_path", "row_index"], "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"rows that are not there: {[(r.file_path, r.row_index) for r in missing]}")
    return fetch_rows(files.select(*place, *columns), wanted)


#: Bytes of a file that ``binaryFile`` can hold in one row.
MOST_CONTENT = (1 << 31) - 16


def quarantine_bad_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, parquet_index, error`` for each Parquet file whose footer can't be read (null: good).

    Files are numbered in path order; files of no bytes are in no listing of Spark. Spark's reader opens the footers alone, and skips files
    that it can't; only files that gave no row are read whole, to tell why. Such a file that is
    too large for that is ``unreadable footer``.
    """
    parquet = {"pathGlobFilter": "*.parquet", "recursiveFileLookup": True}
    listed = spark.read.format("binaryFile").options(**parquet).load(path).select("path", "length")
    listed = listed.withColumn("parquet_index", F.row_number().over(Window.orderBy("path")) - 1)  # a row per file
    rows = spark.read.schema("_nothing int").options(**parquet, ignoreCorruptFiles=True).parquet(path)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    good = rows.select(plain(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).alias("_p")).distinct()
    odd = listed.join(good, plain(F.col("path")) == F.col("_p"), "left_anti")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for b in batches:
            errors = []
            for content in b["content"]:
                try:
                    pq.read_metadata(io.BytesIO(content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any failure is what is reported
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pd.DataFrame({"path": b["path"], "error": errors})

    names = [r.path for r in odd.where(F.col("length") <= MOST_CONTENT).select("path").collect()]  # bad and empty files only
    told = spark.createDataFrame([], "path string, error string")
    if names:
        told = spark.read.format("binaryFile").load(names).select("path", "content").mapInPandas(probe, "path string, error string")
    out = listed.join(told, "path", "left")
    large = odd.where(F.col("length") > MOST_CONTENT).select("path", F.lit("unreadable footer").alias("_large"))
    return out.join(large, "path", "left").select("path", "parquet_index", F.coalesce("error", "_large").alias("error"))


def decode_npy(blob: bytes | None) -> tuple[list[float] | None, list[int] | None, str | None]:
    try:
        a = np.load(io.BytesIO(blob), allow_pickle=False)
        return a.astype(np.float32).ravel().tolist(), list(a.shape), None
    except Exception:  # noqa: BLE001  the reason is the same for every failure
        return None, None, "invalid_blob"


def decode_npy_blobs(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Per column an array of floats and its shape; pickles and broken blobs give ``invalid_blob``."""
    kind = df.schema[key].dataType.simpleString()
    fields = ", ".join(f"`{c}` array<float>, `{c}_shape` array<int>, `{c}_error` string" for c in cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {key: b[key]}
            for c in cols:
                got = [decode_npy(x) for x in b[c]]
                for i, s in enumerate(("", "_shape", "_error")):
                    out[c + s] = [g[i] for g in got]
            yield pd.DataFrame(out)

    return df.select(key, *cols).mapInPandas(run, f"`{key}` {kind}, {fields}")


def decode_npz(files: DataFrame, field: str) -> DataFrame:
    """``asset, shape, values`` of one array in each NPZ content (``path, content``); a missing one gives nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"], strict=True):
                asset = re.sub(r".*/|\.npz$", "", name)
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    a = z[field] if field in z else None
                rows.append((asset, None if a is None else list(a.shape), None if a is None else a.astype(np.float32).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["asset", "shape", "values"])

    return files.select("path", "content").mapInPandas(run, "asset string, shape array<int>, values array<float>")


def scan_npz(spark: SparkSession, path: str, field: str) -> DataFrame:
    return decode_npz(spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path), field)


def _ply_vertices(content: bytes) -> np.ndarray:
    head, _, body = content.partition(b"end_header\n")
    lines = head.decode("ascii", "replace").split("\n")
    form = next(x.split()[1] for x in lines if x.startswith("format"))
    count, props, inside = 0, [], False
    for x in lines:
        if x.startswith("element"):
            inside = x.split()[1] == "vertex"
            count = int(x.split()[2]) if inside else count
        elif x.startswith("property") and inside:
            props.append((x.split()[2], x.split()[1]))
    names = [p[0] for p in props]
    if form == "ascii":
        rows = np.array([line.split()[: len(props)] for line in body.decode("ascii").split("\n")[:count]], float).reshape(count, len(props))
        return rows[:, [names.index(c) for c in "xyz"]]
    code = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "uchar": "u1", "uint8": "u1", "int": "i4", "int32": "i4", "short": "i2", "ushort": "u2", "uint": "u4", "char": "i1"}
    kind = np.dtype([(n, ("<" if form == "binary_little_endian" else ">") + code[k]) for n, k in props])
    a = np.frombuffer(body, kind, count)
    return np.stack([a[c].astype(float) for c in "xyz"], axis=1)


def scan_point_ply(spark: SparkSession, path: str) -> DataFrame:
    """``asset, point_id, x, y, z`` of every PLY vertex, ascii or binary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                v = _ply_vertices(content)
                yield pd.DataFrame({"asset": re.sub(r".*/|\.ply$", "", name), "point_id": np.arange(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "asset string, point_id long, x double, y double, z double")


def scan_views(spark: SparkSession, path: str) -> DataFrame:
    """One row per view of each ``transforms.json``: asset folder, view, file, fov, matrix."""
    schema = "frames array<struct<file_path:string, camera_angle_x:double, transform_matrix:array<array<double>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "transforms.json").json(path)
    asset = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1)
    rows = raw.select(asset.alias("asset"), F.posexplode("frames").alias("view", "f"))
    return rows.select("asset", "view", "f.file_path", "f.camera_angle_x", "f.transform_matrix")


def _members(content: bytes, depth: int, prefix: str = "") -> Iterator[tuple[str, Callable[[], bytes]]]:
    """Names of an archive's files with what reads them; archives inside are opened ``depth`` levels down, as ``outer!/inner``."""
    if zipfile.is_zipfile(io.BytesIO(content)):
        z = zipfile.ZipFile(io.BytesIO(content))
        found = [(m.filename, lambda m=m: z.read(m)) for m in z.infolist() if not m.is_dir()]
    else:
        t = tarfile.open(fileobj=io.BytesIO(content))
        found = [(m.name, lambda m=m: t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
    for name, read in found:
        if depth and re.search(r"\.(zip|tar|tgz|tar\.gz)$", name):
            yield from _members(read(), depth - 1, f"{prefix}{name}!/")
        else:
            yield prefix + name, read


def scan_archive_members(spark: SparkSession, path: str, pattern: str, wanted: DataFrame | None = None, depth: int = 0) -> DataFrame:
    """``archive, member, size, sha256`` of the files in archives whose name matches.

    ``wanted`` (``archive``: end of the archive's path, ``member``) is looked at before anything
    is read: only archives that it names are opened, and only its members extracted. Archives
    inside archives are opened ``depth`` levels down, their members named ``inner.zip!/file``.
    """
    options = {"pathGlobFilter": "*.{zip,tar,tgz,gz}", "recursiveFileLookup": True}
    files = spark.read.format("binaryFile").options(**options).load(path)
    asked = None
    if wanted is not None:
        listed = files.select("path")
        asked = wanted.groupBy("archive").agg(F.collect_set("member").alias("members"))
        asked = listed.join(asked, F.expr("endswith(path, '/' || archive)")).select("path", "members")
        names = [r.path for r in asked.select("path").distinct().collect()]  # a row per archive
        if not names:
            return spark.createDataFrame([], "archive string, member string, size long, sha256 string")
        files = spark.read.format("binaryFile").load(names)
    files = files.select("path", "content")
    files = files.withColumn("members", F.lit(None).cast("array<string>")) if asked is None else files.join(asked, "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            for name, content, some in zip(b["path"], b["content"], b["members"], strict=True):
                only = None if some is None else set(some)
                for member, read in _members(content, depth):
                    if re.search(pattern, member) and (only is None or member in only):
                        data = read()
                        yield pd.DataFrame([(name, member, len(data), hashlib.sha256(data).hexdigest())], columns=["archive", "member", "size", "sha256"])

    return files.mapInPandas(run, "archive string, member string, size long, sha256 string")


def content_sha256(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


def scan_artifacts(spark: SparkSession, path: str, pattern: str, stage: str) -> DataFrame:
    """``key, stage, length`` of files whose path matches; contents are not read.

    Tasks list the folders. Of a store that only Spark reaches, or a path with wildcards, the
    driver holds the list.
    """
    if is_folder(path):
        files = find_files(spark, path)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    key = F.regexp_extract("path", pattern, 1)
    return files.select(key.alias("key"), F.lit(stage).alias("stage"), "length").where("key <> ''")


#: Fixed patterns of run-log lines: a step with nested values, and validation lines (longer prefix first).
STEP_LINE = r"^(\d+):\s*\{"
NUMBER = r"(?:np\.float\d+\()?(-?(?:nan|inf|\d+(?:\.\d*)?(?:[eE][-+]?\d+)?))\)?"
VALIDATION = (("Validation mIoU_occ:", "miou_occ"), ("Validation mIoU:", "miou"))


def parse_run_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """``step, metric, value``: each metric of a line joins its own step; ``bin_i`` keeps its name."""
    step = F.when(F.col(text).rlike(STEP_LINE), F.regexp_extract(text, STEP_LINE, 1).cast("long"))
    flat = rf"'(loss|grad_norm|mse)':\s*{NUMBER}"
    binned = rf"'(bin_\d+)':\s*\{{'mse':\s*{NUMBER}"
    plain = F.regexp_replace(text, r"'bin_\d+':\s*\{[^}]*\}", "")

    def pairs(col, pattern):
        return F.arrays_zip(F.regexp_extract_all(col, F.lit(pattern), F.lit(1)).alias("metric"), F.regexp_extract_all(col, F.lit(pattern), F.lit(2)).alias("v"))

    found = lines.select(step.alias("step"), F.explode(F.concat(pairs(plain, flat), pairs(F.col(text), binned))).alias("p")).where("step is not null")
    rows = found.select("step", F.col("p.metric").alias("metric"), F.col("p.v").cast("double").alias("value"))
    chain = F.lit(None).cast("string")
    for prefix, name in reversed(VALIDATION):
        chain = F.when(F.col(text).startswith(prefix), name).otherwise(chain)
    valid = lines.select(F.lit(None).cast("long").alias("step"), chain.alias("metric"), F.regexp_extract(text, r":\s*(\S+)\s*$", 1).cast("double").alias("value")).where("metric is not null")
    return rows.unionByName(valid)


def scan_run_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_log(spark.read.text(path))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_summary_json(df: DataFrame, path: str) -> None:
    """A one-row summary as one JSON line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _swap(spark: SparkSession, path: str, tag: str) -> str:
    """The two renames of a replacement, each done unless it already is; returns where the old files are."""
    (new, fs), (here, _), (old, _) = _fs(spark, f"{path}._staging-{tag}"), _fs(spark, path), _fs(spark, f"{path}.backup-{tag}")
    if not fs.exists(old) and fs.exists(here) and not fs.rename(here, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(new, here):
        raise OSError(f"could not move the new files to {path}")
    return old.toString()


def finish_swap(spark: SparkSession, path: str, tag: str) -> bool:
    """Whether the replacement ``tag`` of a table is in place; one that stopped between its renames is finished.

    The backup comes to be only after all new files are written. While it exists and the
    table doesn't, the new files wait beside; with both there, the swap is done.
    """
    (here, fs), (old, _) = _fs(spark, path), _fs(spark, f"{path}.backup-{tag}")
    if not fs.exists(old):
        return False
    if not fs.exists(here):
        _swap(spark, path, tag)
    return True


def replace_table(df: DataFrame, path: str, tag: str, backup: bool = True) -> str | None:
    """Write beside, then swap by renames; the old files stay under ``path.backup-tag``.

    After a crash ``finish_swap`` with the same tag tells whether this must run again.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}._staging-{tag}")
    old = _swap(spark, path, tag)
    if not backup:
        p, fs = _fs(spark, old)
        fs.delete(p, True)
    return old if backup else None


def write_split_dataset(final: DataFrame, path: str, policy: str = "val first by rank") -> None:
    """``records/split=*``, key-only CSV per split, and a one-row manifest with the policy."""
    final.write.mode("overwrite").partitionBy("split").parquet(f"{path}/records")
    key = final.columns[0]
    final.select(key, "split").write.mode("overwrite").partitionBy("split").option("header", True).csv(f"{path}/metadata")
    write_summary_json(final.agg(F.count("*").alias("rows")).withColumn("policy", F.lit(policy)), f"{path}/manifest")


def write_voxel_table(df: DataFrame, path: str, asset: str = "asset") -> None:
    """COO rows clustered by asset and sorted inside."""
    df.repartition(asset).sortWithinPartitions(asset, "x", "y", "z").write.mode("overwrite").parquet(path)


def prune_counts(df: DataFrame, by: str, removed: Column, missing: Column, kept: Column) -> DataFrame:
    """What a deletion would remove, before anything is deleted."""
    return df.groupBy(by).agg(F.count_if(removed).alias("removed"), F.count_if(missing).alias("missing"), F.count_if(kept).alias("kept"))


def delete_artifacts(table: DataFrame, removed: DataFrame, key: str, path: str, tag: str, dry_run: bool = True) -> DataFrame:
    """Counts of removed and missing keys; without ``dry_run`` the table is rewritten without them."""
    hit = removed.select(key).distinct().join(table.select(key).distinct().withColumn("_have", F.lit(True)), key, "left")
    counts = hit.agg(F.count_if("_have").alias("removed"), F.count_if(F.col("_have").isNull()).alias("missing"))
    if not dry_run:
        from assetlake.session import cut

        counts = cut(counts)
        replace_table(table.join(removed.select(key), key, "left_anti"), path, tag)
    return counts


def views_json(df: DataFrame, asset: str, columns: list[str]) -> DataFrame:
    """A frame list per asset, in the order of the first column."""
    frames = F.sort_array(F.collect_list(F.struct(*columns)))
    return df.groupBy(asset).agg(F.to_json(F.struct(frames.alias("frames"))).alias("json"))


def write_metric_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def latest_step(files: DataFrame, path: str, run: str, step: str) -> DataFrame:
    """The largest step in the file names of each run."""
    return files.groupBy(F.regexp_extract(path, run, 1).alias("run")).agg(F.max(F.regexp_extract(path, step, 1).cast("long")).alias("step"))


def preferred_file(files: DataFrame, run: str, path: str, patterns: list[str]) -> DataFrame:
    """The file of each run that matches the earliest pattern (best metric, plain, averaged weights)."""
    rank = F.lit(len(patterns))
    for i, p in reversed(list(enumerate(patterns))):
        rank = F.when(F.col(path).rlike(p), i).otherwise(rank)
    return files.groupBy(run).agg(F.min_by(path, F.struct(rank.alias("r"), F.col(path).alias("p"))).alias(path))
