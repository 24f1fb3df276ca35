"""What several operators share: words as bytes, hashing, and session set-up.

A word is a run of bytes that are not ASCII white space (0x20, 0x09-0x0D); in
UTF-8 those bytes never occur inside another character, so ``bytes.split()`` cuts
exactly at ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.session import shared_dir, ship

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch: texts can be long, so batches are kept short.
BATCH_ROWS = 1000
#: Words whose hashes one Python worker remembers.
CACHE_WORDS = 500_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def prepare(spark: SparkSession) -> None:
    """Shared folder, worker path and short Arrow batches for whole texts."""
    shared_dir(spark)
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow text column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


class WordHash(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64's steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x = x ^ (x >> np.uint64(27))
    x = x * _M3
    return x ^ (x >> np.uint64(31))


def ngram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ hashes[i : i + n]) * _M1
            out ^= out >> np.uint64(29)
        return mix(out)


def row_key() -> Column:
    """Digest of id and text together: what tells a row of documents from others."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary")))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner", parts: int = 1024) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row per key and in ``size`` its number of rows.

    Of the ``total`` rows at most ``parts`` keys can have a ``parts``-th each: those are
    broadcast, and their rows stay where they are; the others meet in a shuffle, where
    no key brings a task more rows than that. With ``how="left"`` rows without a group
    stay, those with a null key unshuffled; otherwise ``how`` is an inner join.
    """
    bar = max(2, -(-total // parts))
    hot, cold = F.broadcast(groups.where(F.col(size) >= bar)), groups.where(F.col(size) < bar)
    some = rows.where(F.col(key).isNotNull())
    out = some.join(hot, key).unionByName(some.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how))
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def map_rows(df: DataFrame, make, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch to a dict of columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                cols = step(batch)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
