"""A Spark data source for asset files: NPZ arrays, PLY points and the lines of growing logs.

``spark.read.format("assets").option("kind", "npz").option("field", "mean").load(uri)``.
Files are listed on the driver and dealt to partitions by size; tasks open them by
themselves, at any place in them, through pyarrow's file systems (local and mounted
paths, and the stores that pyarrow is built for). A store that only Spark reaches is read
with ``sources.files`` instead. Filters on ``asset`` choose files before any is opened.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from assetlake.session import materialize, spread

#: Columns of each kind, and the file names that it takes.
SCHEMAS = {
    "npz": "asset string, shape array<int>, values array<float>",
    "ply": "asset string, point_id long, x double, y double, z double",
    "lines": "file string, offset long, value string",
}
NAMES = {"npz": r"\.npz$", "ply": r"\.ply$", "lines": r"(\.txt|\.log)$"}
#: Bytes of the files of one partition, about, and of one range of a log.
PARTITION_BYTES = 128 << 20


def _open(uri: str):
    """File system and path of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "/", uri))


def list_files(uri: str, pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files below, in path order; hidden ones are left out."""
    from pyarrow import fs

    store, root = _open(uri)
    if store.get_file_info(root).type == fs.FileType.NotFound:
        return []
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and re.search(pattern, f.path) and not re.search(r"(^|/)[._]", f.path[len(root) :]))


#: Names that Spark's readers leave out.
HIDDEN = r"^(\.|_[^=]*$)|\._COPYING_$"


def is_folder(uri: str) -> bool:
    """Whether it is a folder that pyarrow's file systems reach."""
    from pyarrow import fs

    try:
        store, root = _open(uri)
        return store.get_file_info(root).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def find_files(spark: SparkSession, uri: str) -> DataFrame:
    """``path, length`` of the files below a folder, as Spark's readers name them; empty ones are left out, as they do.

    Tasks list the folders, a level at a time, and write what they find: the driver holds no
    list. What lies in one folder is listed by one task.
    """
    from pyarrow import fs

    store, root = _open(uri)
    before = "file:" if isinstance(store, fs.LocalFileSystem) else uri.rstrip("/").removesuffix(root)

    def run(batches):
        store, _ = _open(uri)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = store.get_file_info(fs.FileSelector(folder.removeprefix(before), allow_not_found=True))
                found = [f for f in found if f.type in (fs.FileType.File, fs.FileType.Directory) and not re.search(HIDDEN, f.base_name)]
                yield pa.RecordBatch.from_arrays([pa.array([before + f.path for f in found], pa.string()), pa.array([f.size if f.is_file else None for f in found], pa.int64())], ["path", "length"])

    level, levels = spark.createDataFrame([(before + root,)], "path string").coalesce(1), []
    while level is not None:
        found = materialize(level.mapInArrow(run, "path string, length long"), "files")
        levels.append(found.where("length > 0"))
        folders = found.where("length is null").select("path")
        n = folders.count()
        level = folders.repartition(min(n, max(4 * spark.sparkContext.defaultParallelism, n // 1000)), "path") if n else None
    return reduce(DataFrame.unionByName, levels)


@dataclass
class Ranges(InputPartition):
    """(path, from byte, to byte) of what one task reads."""

    parts: list[tuple[str, int, int]]


def _dealt(files: list[tuple[str, int, int]], most: int) -> list[Ranges]:
    out: list[Ranges] = []
    room = 0
    for path, lo, hi in files:
        if room < hi - lo or not out:
            out.append(Ranges([]))
            room = most
        out[-1].parts.append((path, lo, hi))
        room -= hi - lo
    return out


def asset_of(path: str) -> str:
    return re.sub(r".*/|\.[^.]*$", "", path)


def _lines(store, path: str, lo: int, hi: int) -> Iterator[tuple[str, int, str]]:
    """Lines that begin in [lo, hi); the last may end behind it, and one without an end is not whole yet."""
    with store.open_input_file(path) as f:
        at = lo
        if lo:
            f.seek(lo - 1)
            first = b""
            while chunk := f.read(1 << 16):
                first += chunk
                if b"\n" in chunk:
                    break
            if b"\n" not in first:
                return
            at = lo + first.index(b"\n")
        f.seek(at)
        held = b""
        while at < hi:
            chunk = f.read(1 << 20)
            if not chunk:
                return
            held += chunk
            *whole, held = held.split(b"\n")
            for line in whole:
                if at >= hi:
                    return
                yield path, at, line.decode("utf-8", "replace")
                at += len(line) + 1


class AssetReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.path, self.field = options["kind"], options["path"], options.get("field", "")
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.assets: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.kind != "lines" and isinstance(f, (EqualTo, In)) and f.attribute == ("asset",):
                some = set(f.value) if isinstance(f, In) else {f.value}
                self.assets = some if self.assets is None else self.assets & some
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        files = [(p, 0, n) for p, n in list_files(self.path, NAMES[self.kind]) if self.assets is None or asset_of(p) in self.assets]
        if self.kind == "lines":
            files = [(p, lo, min(lo + self.most, n)) for p, _, n in files for lo in range(0, n, self.most)]
        return _dealt(files, self.most) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        from assetlake.sources.files import _ply_vertices

        store, _ = _open(self.path)
        for path, lo, hi in partition.parts:
            if self.kind == "lines":
                rows = list(_lines(store, path, lo, hi))
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            elif self.kind == "npz":
                with store.open_input_file(path) as f, np.load(f, allow_pickle=False) as z:  # reads the directory and this array alone
                    a = z[self.field] if self.field in z else None
                values = None if a is None else a.astype(np.float32).ravel()
                columns = [pa.array([asset_of(path)]), pa.array([None if a is None else list(a.shape)], pa.list_(pa.int32())), pa.array([values], pa.list_(pa.float32()))]
            else:
                with store.open_input_file(path) as f:
                    v = _ply_vertices(f.read())
                columns = [pa.array([asset_of(path)] * len(v), pa.string()), pa.array(np.arange(len(v))), *(pa.array(v[:, i]) for i in range(3))]
            names = [c.split()[0] for c in SCHEMAS[self.kind].split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names)


class Tail(DataSourceStreamReader):
    """New lines of files that are appended to, and of new files; the offset is how far each has been read."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {"read": "{}"}

    def latestOffset(self) -> dict:
        """The end of the last whole line of each file."""
        store, _ = _open(self.path)
        ends = {}
        for path, size in list_files(self.path, NAMES["lines"]):
            with store.open_input_file(path) as f:
                hi, end = size, 0
                while hi and not end:
                    lo = max(0, hi - (1 << 16))
                    f.seek(lo)
                    end = lo + f.read(hi - lo).rfind(b"\n") + 1
                    end, hi = (end, hi) if end > lo else (0, lo)
            ends[path] = end
        return {"read": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        was, now = json.loads(start["read"]), json.loads(end["read"])
        files = [(p, lo, min(lo + self.most, n)) for p, n in sorted(now.items()) for lo in range(was.get(p, 0), n, self.most)]
        return _dealt(files, self.most) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _ = _open(self.path)
        for path, lo, hi in partition.parts:
            yield from _lines(store, path, lo, hi)

    def commit(self, end: dict) -> None:
        pass


class AssetFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assets"

    def _checked(self) -> dict:
        kind = self.options.get("kind")
        if kind not in SCHEMAS:
            raise ValueError(f"unknown kind {kind!r}; known: {sorted(SCHEMAS)}")
        return {k: v for k, v in {"path": self.options.get("path"), "kind": kind, "field": self.options.get("field"), "partitionBytes": self.options.get("partitionBytes")}.items() if v is not None}

    def schema(self) -> str:
        return SCHEMAS[self._checked()["kind"]]

    def reader(self, schema) -> AssetReader:
        return AssetReader(self._checked())

    def streamReader(self, schema) -> Tail:
        if self._checked()["kind"] != "lines":
            raise ValueError("only lines are a stream")
        return Tail(self._checked())


def register(spark: SparkSession) -> None:
    """Make ``assets`` known to a session, filters pushed to it included."""
    spark.dataSource.register(AssetFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_npz(rows: DataFrame, path: str, field: str) -> DataFrame:
    """One ``<asset>.npz`` for each row ``asset, shape, values``, written by the tasks; gives ``asset, bytes``. Lazy."""

    def run(batches):
        import io

        store, root = _open(path)
        store.create_dir(root, recursive=True)
        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for name, shape, values in zip(names, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out = io.BytesIO()
                np.savez(out, **{field: np.asarray(values, np.float32).reshape(shape)})
                with store.open_output_stream(f"{root}/{name}.npz") as f:
                    f.write(out.getvalue())
                sizes.append(len(out.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["asset", "bytes"])

    return rows.select("asset", "shape", "values").mapInArrow(run, "asset string, bytes long")


def write_files(rows: DataFrame, path: str, folders: int = 1024) -> DataFrame:
    """One file for each row ``name, content``, in ``folders`` folders by a hash of the name, written by the tasks; gives ``name, bytes``. Lazy.

    A repeated task writes the same files again.
    """
    store, root = _open(path)
    store.create_dir(root, recursive=True)

    def run(batches):
        store, root = _open(path)
        made: set[str] = set()
        for b in batches:
            sizes = []
            for folder, name, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if folder not in made:
                    store.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{root}/{folder}/{name}") as f:
                    f.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(sizes, pa.int64())], ["name", "bytes"])

    folder = F.format_string("%04d", F.crc32(F.col("name").cast("binary")) % folders)
    dealt = spread(rows.select(folder.alias("folder"), "name", F.col("content").cast("binary").alias("content")), rows.count(), "folder")
    return dealt.mapInArrow(run, "name string, bytes long")
