"""Operator 5: repeated passages by fixed-block anchors.

Two equal windows of 20 words always enclose one whole 10-word block that starts
at a multiple of 10 in its own document. So:

1. index the non-overlapping 10-word blocks of every document, and probe them with
   every rolling 10-word window of every document. Hashes travel as packed arrays
   per (batch of documents, hash bucket): 4 bytes and a position gap per probe. A
   hash seen twice in one batch is a hit at once and is sent as one index entry, so
   a passage with very many copies costs one entry per batch.
2. extend: a 20-word window is a candidate if it encloses a hit. Both members of
   every equal pair are candidates, so the first occurrence of each candidate, over
   (doc_id, start), is the true first one; all later ones are removed. Runs of
   removed windows are the maximal exact repeats.

Fingerprints that collide in step 1 only add candidates; step 2 compares 64 bits.

Buckets grow with the input, messages must not: a batch sends at most FAN of them. Beyond
FAN buckets they have levels. Coarse buckets travel first, hundreds of batches of one are
laid together where they arrive, and split again into FAN, until they are as fine as wanted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import WordHash, map_rows, ngram_hashes, prepare, raw_texts
from assetlake.session import materialize

WINDOW = 20
BLOCK = 10
#: Bytes of packed probes that one bucket (one task's group) should hold.
BUCKET_BYTES = 12_000_000
#: Words of the documents that are packed together: a task sends one message a bucket for so many.
BATCH_WORDS = 1_000_000
#: Buckets that a bucket is split into in one level, words that are split together, bytes of one task of a split.
FAN, SPLIT_WORDS, SPLIT_BYTES = 256, 2_000_000, 100_000_000
_PACKED = pa.schema([("k", pa.int32()), ("batch", pa.int64()), ("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_PACKED_DDL = "k int, batch long, kind tinyint, a binary, b binary, c binary, d binary"
#: Bits of a window's hash below those that choose its bucket.
_WINDOW_SHIFT = 40
_META, _PROBES, _ANCHORS, _HITS, _MANY, _WIDE_ANCHORS = 0, 1, 2, 3, 4, 5


def _levels(size: int, bucket_bytes: int) -> tuple[int, int, int]:
    """Buckets for so many bytes of text, into how many a level splits, and the number of levels."""
    buckets = max(32, -(-size // bucket_bytes))
    if buckets <= FAN:
        return buckets, buckets, 1
    levels = 1
    while FAN**levels < buckets:
        levels += 1
    fan = 2
    while fan**levels < buckets:
        fan += 1
    return fan**levels, fan, levels


def _many(k: int, origin: np.ndarray, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
    """A message with probes of several batches: hashes, two numbers each, and runs of batches."""
    heads = np.flatnonzero(np.r_[True, origin[1:] != origin[:-1]])
    runs = np.stack([origin[heads], np.diff(np.r_[heads, len(origin)])])
    return (k, 0, _MANY, h.tobytes(), _pack(np.diff(x, prepend=0)), _pack(np.diff(y, prepend=0)), _pack(runs))


def _opened(r: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(batch, hash, first number, second number) of each probe of such a message."""
    batch, n = _unpack(r[6], np.int64).reshape(2, -1)
    h = np.frombuffer(r[3], np.uint64 if len(r[3]) == 8 * n.sum() else np.uint32)
    return np.repeat(batch, n), h, np.cumsum(_unpack(r[4], np.int64)), np.cumsum(_unpack(r[5], np.int64))


def _split(plan: tuple[int, int, int], level: int, shift: int, narrow: bool):
    """Messages of one level, those of a bucket one after another, to the next; the last level's hashes are 32 bits if ``narrow``."""
    buckets, fan, levels = plan
    stride = fan ** (levels - 1 - level)
    shrink = narrow and level == levels - 1

    def local(h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) % np.uint64(buckets)).astype(np.int64) // stride - k * fan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = -1, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                origin, h, x, y = (np.concatenate(c) for c in zip(*held, strict=True))
                out = []
                for k, at in _split_by(local(h, now), fan):
                    out.append(_many(now * fan + k, origin[at], h[at].astype(np.uint32) if shrink else h[at], x[at], y[at]))
                yield from _rows(out, _PACKED).to_batches(max_chunksize=1000)

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(len(_PACKED))), strict=True):
                if r[2] == _MANY:
                    if r[0] != now or n >= SPLIT_WORDS:
                        yield from done()
                        now, held, n = r[0], [], 0
                    held.append(_opened(r))
                    n += len(held[-1][0])
                elif r[2] == _WIDE_ANCHORS:
                    h = np.frombuffer(r[3], np.uint64)
                    some = [(r[0] * fan + k, 0, _ANCHORS if shrink else _WIDE_ANCHORS, (h[at].astype(np.uint32) if shrink else h[at]).tobytes(), b"", b"", b"") for k, at in _split_by(local(h, r[0]), fan)]
                    yield from _rows(some, _PACKED).to_batches()
                else:
                    yield from _rows([r], _PACKED).to_batches()
        yield from done()

    return run


def _exchanged(packed: DataFrame, plan: tuple[int, int, int], size: int, shift: int, narrow: bool) -> DataFrame:
    """Messages in the finest buckets: nothing to do with one level, else one more exchange each."""
    for level in range(1, plan[2]):
        coarse = plan[1] ** level
        salts = max(1, -(-size // (coarse * SPLIT_BYTES)))
        dealt = packed.repartition(coarse * salts, "k", F.pmod(F.xxhash64("batch", "d"), F.lit(salts)))
        packed = dealt.sortWithinPartitions("k").mapInArrow(_split(plan, level, shift, narrow), _PACKED_DDL)
    return packed


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _repeated(h: np.ndarray) -> np.ndarray:
    """Which entries occur more than once."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _split_by(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), order[ends[k] : ends[k + 1]]


def _documents(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[list[tuple]]:
    """(doc_id, text key, words, marks) of all documents with a whole window, about BATCH_WORDS at a time."""
    unzip = zstandard.ZstdDecompressor()
    out: list[tuple] = []
    n = 0
    for b in batches:
        marks = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
        for doc, key, z, mark in zip(*(b.column(i).to_pylist() for i in range(3)), marks, strict=True):
            found = unzip.decompress(z).split()
            if len(found) >= window:
                out.append((doc, key, found, mark))
                n += len(found)
            if n >= BATCH_WORDS:
                yield out
                out, n = [], 0
    if out:
        yield out


def _meta(buckets: int, docs: list[tuple], first: list[int], mark: np.ndarray) -> tuple[int, tuple]:
    """Number of a batch, and the row that says where its documents lie and what is marked already."""
    ids, keys = (np.array([d[i] for d in docs], np.int64) for i in (0, 1))
    batch = xxhash.xxh3_64_intdigest(np.stack([ids, keys]).tobytes()) >> 1
    return batch, (-1 - batch % buckets, batch, _META, np.stack([ids, keys]).tobytes(), np.array(first, np.int64).tobytes(), _pack(np.packbits(mark)), b"")


def _probe_batches(plan: tuple[int, int, int], window: int, block: int):
    buckets, fan, levels = plan
    stride = fan ** (levels - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for docs in _documents(batches, window):
            hashes = [ngram_hashes(words.of(d[2]), block) for d in docs]
            first = [0, *np.cumsum([len(h) for h in hashes]).tolist()]
            h, own = np.concatenate(hashes), np.concatenate([np.arange(len(h)) % block == 0 for h in hashes])
            del hashes
            twice = _repeated(h)
            batch, meta = _meta(buckets, docs, first, twice)
            yield from _rows([meta], _PACKED).to_batches()
            out = []
            single = np.flatnonzero(~twice)
            for k, at in _split_by(((h[single] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) // stride, fan):
                at = single[at]
                if levels > 1:
                    out.append(_many(k, np.full(len(at), batch), h[at], at, own[at].astype(np.int64)))
                else:
                    out.append((k, batch, _PROBES, h[at].astype(np.uint32).tobytes(), _pack(np.diff(at, prepend=0).astype(np.uint32)), np.packbits(own[at]).tobytes(), b""))
            anchors = np.unique(h[twice & own])
            for k, at in _split_by(((anchors >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) // stride, fan):
                out.append((k, batch, _WIDE_ANCHORS, anchors[at].tobytes(), b"", b"", b"") if levels > 1 else (k, batch, _ANCHORS, anchors[at].astype(np.uint32).tobytes(), b"", b"", b""))
            yield from _rows(out, _PACKED).to_batches(max_chunksize=1000)

    return run


def _hits(batch: int | np.ndarray, at: np.ndarray, hit: np.ndarray) -> list[tuple]:
    """Marked places, one row for each batch (one, or that of each place)."""
    if not isinstance(batch, np.ndarray):
        return [(0, batch, _HITS, _pack(at[hit]), b"", b"", b"")]
    names, which = np.unique(batch[hit], return_inverse=True)
    return [(0, int(names[i]), _HITS, _pack(at[hit][some]), b"", b"", b"") for i, some in _split_by(which, len(names))]


def _match_bucket(t: pa.Table) -> pa.Table:
    """Probes of one bucket that meet a block of another place; META rows pass."""
    rows = list(zip(*(t.column(c).to_pylist() for c in _PACKED.names), strict=True))
    if rows[0][0] < 0:
        return _rows(rows, _PACKED)
    probes = []
    index = [np.frombuffer(r[3], np.uint32) for r in rows if r[2] == _ANCHORS]
    index += index  # a hash repeated in its batch stands for two places
    for r in rows:
        if r[2] == _PROBES:
            fp = np.frombuffer(r[3], np.uint32)
            own = np.unpackbits(np.frombuffer(r[5], np.uint8), count=len(fp)).astype(bool)
            probes.append((r[1], fp, own, r[4]))
            index.append(fp[own])
        elif r[2] == _MANY:
            origin, fp, at, own = _opened(r)
            probes.append((origin, fp, own.astype(bool), at))
            index.append(fp[own.astype(bool)])
    known, count = np.unique(np.concatenate(index), return_counts=True)
    out = []
    if len(known):
        for batch, fp, own, gaps in probes:
            at = np.searchsorted(known, fp)
            at[at == len(known)] = 0
            hit = (known[at] == fp) & (count[at] > own)
            if hit.any():
                out += _hits(batch, gaps if isinstance(gaps, np.ndarray) else np.cumsum(_unpack(gaps, np.uint32), dtype=np.int64), hit)
    return _rows(out, _PACKED)


_BY_DOC = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("marks", pa.binary())])


def _by_document(t: pa.Table) -> pa.Table:
    """All marks of one batch, as positions per document."""
    rows = list(zip(*(t.column(c).to_pylist() for c in _PACKED.names), strict=True))
    meta = next(r for r in rows if r[2] == _META)
    (ids, keys), first = np.frombuffer(meta[3], np.int64).reshape(2, -1), np.frombuffer(meta[4], np.int64)
    mark = np.unpackbits(_unpack(meta[5], np.uint8), count=int(first[-1])).astype(bool)
    for r in rows:
        if r[2] == _HITS:
            mark[_unpack(r[3], np.int64)] = True
    out = []
    for i, doc in enumerate(ids):
        at = np.flatnonzero(mark[first[i] : first[i + 1]])
        if len(at):
            out.append((int(doc), int(keys[i]), _pack(np.diff(at, prepend=0).astype(np.uint32))))
    return _rows(out, _BY_DOC)


def _candidates(marks: bytes, n: int, window: int, block: int) -> np.ndarray:
    """Starts of windows that enclose a marked block."""
    hit = np.zeros(n - block + 1 + 1, np.int64)
    hit[np.cumsum(_unpack(marks, np.uint32), dtype=np.int64) + 1] = 1
    total = np.cumsum(hit)
    starts = np.arange(n - window + 1)
    return starts[total[starts + window - block + 1] > total[starts]]


def _later(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which windows also start earlier: in a smaller doc_id, or before in the same document (``place``)."""
    order = np.lexsort((place, doc, h))
    hs, ds, ps = h[order], doc[order], place[order]
    start = np.r_[True, hs[1:] != hs[:-1]]
    out = np.zeros(len(h), bool)
    out[order] = (ds > ds[start][np.cumsum(start) - 1]) | np.r_[False, ~start[1:] & (ps[1:] == ps[:-1])]
    return out


def _window_batches(plan: tuple[int, int, int], window: int, block: int):
    """First occurrences of each candidate window within a batch, by bucket; later ones marked at once."""
    buckets, fan, levels = plan
    stride = fan ** (levels - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for docs in _documents(batches, window):
            starts = [_candidates(d[3], len(d[2]), window, block) for d in docs]
            some = [i for i, at in enumerate(starts) if len(at)]
            if not some:
                continue
            docs, starts = [docs[i] for i in some], [starts[i] for i in some]
            first = [0, *np.cumsum([len(d[2]) for d in docs]).tolist()]
            h = np.concatenate([ngram_hashes(words.of(d[2]), window)[at] for d, at in zip(docs, starts, strict=True)])
            pos = np.concatenate([at + f for at, f in zip(starts, first, strict=False)])
            place = np.repeat(np.arange(len(docs)), [len(at) for at in starts])
            doc = np.array([d[0] for d in docs], np.int64)[place]
            later = _later(h, doc, place)
            gone = np.zeros(first[-1], bool)
            gone[pos[later]] = True
            batch, meta = _meta(buckets, docs, first, gone)
            yield from _rows([meta], _PACKED).to_batches()
            keep, out = np.flatnonzero(~later), []
            for k, at in _split_by(((h[keep] >> np.uint64(_WINDOW_SHIFT)) % np.uint64(buckets)).astype(np.int64) // stride, fan):
                at = keep[at]
                if levels > 1:
                    out.append(_many(k, np.full(len(at), batch), h[at], doc[at], pos[at]))
                else:
                    out.append((k, batch, _PROBES, h[at].tobytes(), _pack(np.diff(doc[at], prepend=0)), _pack(np.diff(pos[at], prepend=0).astype(np.uint32)), b""))
            yield from _rows(out, _PACKED).to_batches(max_chunksize=1000)

    return run


def _later_in_bucket(t: pa.Table) -> pa.Table:
    rows = list(zip(*(t.column(c).to_pylist() for c in _PACKED.names), strict=True))
    if rows[0][0] < 0:
        return _rows(rows, _PACKED)
    parts = []
    for r in rows:
        if r[2] == _MANY:
            parts.append(_opened(r))
        else:
            h = np.frombuffer(r[3], np.uint64)
            parts.append((np.full(len(h), r[1]), h, np.cumsum(_unpack(r[4], np.int64)), np.cumsum(_unpack(r[5], np.uint32), dtype=np.int64)))
    origin, h, doc, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
    # of one document a batch sends each hash once, so smaller doc_ids alone are earlier
    return _rows([(0, b, _HITS, _pack(np.sort(_unpack(a, np.int64))), *rest) for _, b, _, a, *rest in _hits(origin, pos, _later(h, doc, np.arange(len(h))))], _PACKED)


def _finish(window: int):
    def make():
        unzip = zstandard.ZstdDecompressor()

        def step(b: pa.RecordBatch) -> dict:
            n, gone, sha, spans = [], [], [], []
            for z, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = unzip.decompress(z).split()
                cover = np.zeros(len(words) + 1, np.int64)
                if marks is not None:
                    at = np.cumsum(_unpack(marks, np.uint32), dtype=np.int64)
                    cover[at] += 1
                    cover[at + window] -= 1
                drop = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.r_[False, drop, False].astype(np.int8)))
                n.append(len(words))
                gone.append(int(drop.sum()))
                spans.append(edge.tolist())
                kept = [words[i] for i in np.flatnonzero(~drop)] if drop.any() else words
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            return {"doc_id": b.column(0), "n_words": n, "n_removed": gone, "kept_sha256": sha, "spans": spans}

        return step

    return make


def repeated_passages(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans`` for every row of ``docs``.

    A word goes if a window of ``window`` words covers it whose words also start
    earlier: in a smaller doc_id, or in the same document before. ``spans`` lists
    begin and end of each removed run of words. Null texts have no words; a null
    doc_id takes no part and loses nothing. A document is an id with a text: rows that
    repeat both are one document and share its result, and of several texts of one id
    none is earlier than another. Texts of any length are read whole. Extra columns are
    ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    block = window // 2
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = _levels(size, bucket_bytes)
    document = ["doc_id", "key"]

    def marks(packed: DataFrame, match, name: str, shift: int, narrow: bool) -> DataFrame:
        hits = _exchanged(packed, plan, size, shift, narrow).groupBy("k").applyInArrow(match, _PACKED_DDL).groupBy("batch").applyInArrow(_by_document, "doc_id long, key long, marks binary")
        return materialize(hits.dropDuplicates(document), name)

    def zipped():
        zip_ = zstandard.ZstdCompressor(level=3)

        def step(b: pa.RecordBatch) -> dict:
            texts = [x or b"" for x in raw_texts(b.column(1))]
            return {"doc_id": b.column(0), "key": [xxhash.xxh3_64_intdigest(x) >> 1 for x in texts], "z": [zip_.compress(x) for x in texts]}

        return step

    packed = map_rows(docs, zipped, "doc_id long, key long, z binary")
    once = packed.where("doc_id is not null").groupBy(document).agg(F.min("z").alias("z"))  # repeated rows are one document
    hits = marks(once.mapInArrow(_probe_batches(plan, window, block), _PACKED_DDL), _match_bucket, "block-hits", 32, True)
    # marks grow with the texts, so they are never broadcast: the plan is the same at every size
    some = once.join(hits.hint("merge"), document).select("doc_id", "key", "z", "marks")
    later = marks(some.mapInArrow(_window_batches(plan, window, block), _PACKED_DDL), _later_in_bucket, "later-windows", _WINDOW_SHIFT, False)
    return map_rows(packed.join(later.hint("merge"), document, "left").select("doc_id", "z", "marks"), _finish(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<int>")
