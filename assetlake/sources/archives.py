"""Archives read in ranges: first the directory of members, then the members that are wanted.

``list_members`` reads headers alone (the central directory of a zip, the header blocks of a
tar), so choosing members is a filter or a join before any content is touched.
``read_members`` deals the chosen ones out by where they lie, so one large archive is work
for many tasks, and passes each through in pieces: neither archives nor members have a size
limit. Gzipped tars have no places to begin at: one task reads such an archive, also in
pieces. Files are opened through pyarrow's file systems, as ``datasource`` does; a store that only Spark
reaches, and archives inside archives, are read with ``files.scan_archive_members``.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.session import cut
from assetlake.sources.datasource import PARTITION_BYTES, _open, list_files

NAMES = r"\.(zip|npz|tar|tgz|tar\.gz)$"
#: Bytes held at a time, and rows of one batch.
PIECE, ROWS = 1 << 20, 10_000
MEMBERS = "archive string, member string, offset long, packed long, size long, method string, crc long, error string"
#: Fixed values of the zip format: stored and deflated members, and the first bytes of a local header.
ZIP_METHODS, ZIP_LOCAL = {0: "stored", 8: "deflated"}, b"PK\x03\x04"


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


def _tar_files(t: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    """The plain files of a tar, of which only the header at hand is held."""
    while (m := t.next()) is not None:
        t.members = []
        if m.isfile():
            yield m


def _directory(path: str, f) -> Iterator[tuple]:
    if re.search(r"(\.zip|\.npz)$", path):
        with zipfile.ZipFile(f) as z:
            for m in z.infolist():
                if not m.is_dir():
                    how = "encrypted" if m.flag_bits & 1 else ZIP_METHODS.get(m.compress_type, f"zip-{m.compress_type}")
                    yield path, m.filename, m.header_offset, m.compress_size, m.file_size, how, m.CRC, None
    else:
        plain = path.endswith(".tar")
        for m in _tar_files(tarfile.open(fileobj=f, mode="r:" if plain else "r|gz")):
            how = "sparse" if m.issparse() else "tar" if plain else "gzip"
            yield path, m.name, m.offset_data, m.size, m.size, how, None, None


def list_members(spark: SparkSession, path: str, archives: DataFrame | None = None) -> DataFrame:
    """One row per file in the archives below ``path``; contents are not read. Lazy.

    ``offset`` is where its header (zip) or content (tar) begins, ``packed`` its bytes there.
    An archive that can't be read to its end has a last row with an ``error`` and no member.
    ``archives`` (``archive``: end of the path, whole folder names) limits what is opened.
    """
    paths = [(p,) for p, _ in list_files(path, NAMES)]
    files = spark.createDataFrame(paths, "archive string").repartition(max(1, min(len(paths), 4096)))
    if archives is not None:
        tail = archives.select(F.col("archive").alias("_end")).distinct().withColumn("_name", F.element_at(F.split("_end", "/"), -1))
        named = files.withColumn("_name", F.element_at(F.split("archive", "/"), -1))
        files = named.join(tail, "_name").where(F.expr("endswith(archive, '/' || _end)")).select("archive").distinct()
    schema = _arrow(MEMBERS)

    def rows(batches) -> Iterator[tuple]:
        store, _ = _open(path)
        for b in batches:
            for p in b.column(0).to_pylist():
                try:
                    with store.open_input_file(p) as f:
                        yield from _directory(p, f)
                except (OSError, EOFError, ValueError, zipfile.BadZipFile, tarfile.TarError, zlib.error) as e:  # ArrowInvalid is a ValueError
                    yield p, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]

    return files.mapInArrow(lambda batches: _batches(rows(batches), schema), MEMBERS)


def _range(f, row: dict) -> Iterator[bytes]:
    """The content of one member, in pieces of bounded size."""
    at, left = row["offset"], row["packed"]
    if row["method"] != "tar":
        f.seek(at)
        head = f.read(30)
        if len(head) < 30 or head[:4] != ZIP_LOCAL:
            raise ValueError("no member begins here")
        at += 30 + sum(struct.unpack("<HH", head[26:]))
    inflate = zlib.decompressobj(-zlib.MAX_WBITS) if row["method"] == "deflated" else None
    f.seek(at)
    while left:
        chunk = f.read(min(PIECE, left))
        if not chunk:
            raise ValueError("the archive ends early")
        left -= len(chunk)
        while chunk and inflate:
            yield inflate.decompress(chunk, PIECE)
            chunk = inflate.unconsumed_tail
        if chunk:
            yield chunk
    if inflate:
        yield inflate.flush()


def _through(row: dict, pieces: Iterator[bytes]) -> tuple:
    size, crc, sha = 0, 0, hashlib.sha256()
    try:
        for p in pieces:
            size, crc = size + len(p), zlib.crc32(p, crc)
            sha.update(p)
        error = None if size == row["size"] and row["crc"] in (None, crc) else "damaged content"
    except (ValueError, OSError, EOFError, zlib.error, tarfile.TarError) as e:
        error = f"{type(e).__name__}: {e}"[:200]
    return row["archive"], row["member"], row["offset"], row["size"], None if error else sha.hexdigest(), error


def _streamed(f, wanted: list[dict]) -> Iterator[tuple]:
    """The wanted members of a gzipped tar, in the order they lie in."""
    waiting: dict[int, list[dict]] = {}
    for r in wanted:
        waiting.setdefault(r["offset"], []).append(r)
    try:
        t = tarfile.open(fileobj=f, mode="r|gz")
        for m in _tar_files(t):
            for r in waiting.pop(m.offset_data, []):
                file = t.extractfile(m)
                yield _through(r, iter(lambda: file.read(PIECE), b""))
            if not waiting:
                return
        error = "no member begins here"
    except (OSError, EOFError, ValueError, zlib.error, tarfile.TarError) as e:
        error = f"{type(e).__name__}: {e}"[:200]
    for r in itertools.chain.from_iterable(waiting.values()):
        yield r["archive"], r["member"], r["offset"], r["size"], None, error


def read_members(members: DataFrame, path: str, part_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``archive, member, offset, size, sha256, error`` of rows of ``list_members``.

    Each stretch of about ``part_bytes`` of an archive is dealt to tasks by itself. Content
    that is not what the directory says (length, checksum), or is packed in another way
    than stored or deflated, has an ``error`` and no digest. Rows without a member stay.
    Rows that are there twice come once.
    """
    columns = [c.split()[0] for c in MEMBERS.split(", ")]
    chosen = cut(members.select(*columns).distinct())
    n = chosen.agg(F.sum("packed")).first()[0] or 0
    part = F.when(F.col("method") == "gzip", 0).otherwise(F.floor(F.col("offset") / part_bytes))
    # a fixed number: the rows are few bytes, which the adaptive planner would put together
    dealt = chosen.repartition(int(min(n // part_bytes + 1, 100_000)), F.col("archive"), part).sortWithinPartitions("archive", "offset")
    fields = "archive string, member string, offset long, size long, sha256 string, error string"
    schema = _arrow(fields)

    def rows(batches) -> Iterator[tuple]:
        store, _ = _open(path)
        every = itertools.chain.from_iterable(b.to_pylist() for b in batches)
        for archive, some in itertools.groupby(every, lambda r: r["archive"]):
            broken, rest = [], []
            with store.open_input_file(archive) as f:
                for r in some:
                    if r["method"] in ("stored", "deflated", "tar"):
                        yield _through(r, _range(f, r))
                    elif r["method"] == "gzip":
                        rest.append(r)
                    else:
                        broken.append(r)
            if rest:
                with store.open_input_file(archive) as f:
                    yield from _streamed(f, rest)
            for r in broken:
                yield archive, r["member"], r["offset"], r["size"], None, r["error"] or f"method {r['method']}"

    return dealt.mapInArrow(lambda batches: _batches(rows(batches), schema), fields)


def find_members(spark: SparkSession, path: str, pattern: str, wanted: DataFrame | None = None, part_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Digests of the members whose name matches; with ``wanted`` (``archive``, ``member``) of those alone.

    Archives that ``wanted`` doesn't name are not opened. Broken archives have a row with an error.
    """
    found = list_members(spark, path, wanted)
    found = found.where(F.col("member").isNull() | F.col("member").rlike(pattern))
    if wanted is not None:
        asked = wanted.select(F.col("archive").alias("_end"), "member").distinct()
        named = found.where("member is not null").join(asked, "member").where(F.expr("endswith(archive, '/' || _end)")).select(found.columns)
        found = named.unionByName(found.where("member is null"))
    return read_members(found, path, part_bytes)


def write_zips(rows: DataFrame, path: str) -> DataFrame:
    """Each partition of (``member``, ``content``) as one deflated zip in ``path``; gives ``archive, members, bytes``. Lazy.

    A row is held at a time. A zip gets its name by one move once it is whole, always the
    same for a partition, so a repeated task leaves one.
    """

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _open(path)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():05d}.zip"
        beside, n = f"{root}/.{os.path.basename(name)}.{task.taskAttemptId()}", 0
        with store.open_output_stream(beside) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for member, content in zip(b.column(0).to_pylist(), b.column(1)):
                    z.writestr(member, content.as_py())
                    n += 1
        store.move(beside, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([store.get_file_info(name).size], pa.int64())], ["archive", "members", "bytes"])

    return rows.select("member", F.col("content").cast("binary").alias("content")).mapInArrow(run, "archive string, members long, bytes long")
