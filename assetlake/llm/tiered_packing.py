"""Operator 11: packing into several context sizes, and balanced step groups.

Documents are tokenised where they are read; whole windows of the longest size are
sequences at once. What is left of each document, at most that long, is dealt by hash
into groups of bounded size, and each group is packed by itself:

1. A piece goes to the tier of the smallest context size that holds it.
2. Tiers are packed from the longest down, longest pieces first. The gap of a window is
   filled from shorter tiers: always with the longest piece that fits, and when none
   fits, with the beginning of the longest shorter piece, whose rest stays in its tier.
   So windows are full, and a size that is a power of two needs no padding.
3. The one window that a group may leave open is cut at powers of two.
4. Sequences of one size are dealt into step groups of about equal numbers of tokens,
   the costliest first to the step that has least to do, so attention costs (the sum of
   squared segment lengths) are near equal too.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import prepare
from assetlake.llm.packing import LENGTH, MATRIX_SEQUENCES, _groups, id_type, token_pieces

#: Context sizes, powers of two, longest first; end id; tokens of one training step.
TIERS, END_ID, STEP_TOKENS = (LENGTH, LENGTH // 2, LENGTH // 4, LENGTH // 8), 2, 16 * LENGTH


def pack_tiers(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Segments (piece, start in it, length, window, offset), and the size of each window.

    Every window is full. ``tiers`` are powers of two, longest first; no piece is longer.
    """
    pool = sorted((s, i, 0) for i, s in enumerate(sizes))
    segments: list[tuple[int, int, int, int, int]] = []
    windows: list[int] = []
    here: list[tuple[int, int, int, int, int]] = []
    used = 0

    def take(at: int, length: int | None = None) -> int:
        """Place the piece at ``at`` of the pool, or the beginning of it, in the open window."""
        size, i, start = pool.pop(at)
        n = size if length is None else length
        here.append((i, start, n, len(windows), used))
        if n < size:
            insort(pool, (size - n, i, start + n))
        return n

    for tier, shorter in zip(tiers, (*tiers[1:], 0), strict=True):
        while pool and pool[-1][0] > shorter:
            here, used = [], 0
            used += take(-1)
            while used < tier and pool:
                gap = tier - used
                fits = bisect_right(pool, (gap, len(sizes), 0)) - 1
                if fits >= 0:
                    used += take(fits)
                else:  # all are longer than the gap: cut one of a shorter tier, or else the shortest of this one
                    used += take(max(0, bisect_right(pool, (shorter, len(sizes), 0)) - 1), gap)
            if used == tier:
                segments += here
                windows.append(tier)
    if here and here[0][3] == len(windows):
        ends = []
        for bit in reversed(range(used.bit_length())):
            if used >> bit & 1:
                ends.append((ends[-1] if ends else 0) + (1 << bit))
        first, at = len(windows), 0
        windows += [e - b for b, e in zip([0, *ends], ends, strict=False)]
        for i, start, n, _, offset in here:
            while n:
                part = min(n, ends[at] - offset)
                segments.append((i, start, part, first + at, offset - (ends[at - 1] if at else 0)))
                start, n, offset = start + part, n - part, offset + part
                at += offset == ends[at]
    return segments, windows


def step_groups(windows: list[int], costs: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Step of each window: windows of one size, numbers at most one apart, costs near equal."""
    out, first = [0] * len(windows), 0
    for size in sorted(set(windows), reverse=True):
        some = sorted((k for k, w in enumerate(windows) if w == size), key=lambda k: -costs[k])
        n = math.ceil(len(some) / max(1, step_tokens // size))
        least, more = divmod(len(some), n)
        heap, held = [(0, s) for s in range(n)], [0] * n
        for k in some:
            cost, s = heapq.heappop(heap)
            out[k] = first + s
            held[s] += 1
            if held[s] < least or (held[s] == least and more > 0):
                heapq.heappush(heap, (cost + costs[k], s))
            more -= held[s] == least + 1
            while heap and more == 0 and held[heap[0][1]] >= least:
                heapq.heappop(heap)
        first += n
    return out


_ROW = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, step_group long, ids binary"


def _packed(tiers: tuple[int, ...], step_tokens: int, kind: np.dtype, with_ids: bool):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        doc, begin, size, crc, total, ids = (t.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"))
        segments, windows = pack_tiers(size, tiers)
        costs = [0] * len(windows)
        for _, _, n, w, _ in segments:
            costs[w] += n * n
        step = step_groups(windows, costs, step_tokens)
        base = t.column("g")[0].as_py() << 32
        out: list[tuple] = []
        for i, start, n, w, offset in segments:
            part = ids[i]
            if n < size[i]:
                part = part[start * kind.itemsize : (start + n) * kind.itemsize]
                check = zlib.crc32(np.frombuffer(part, kind).astype("<u4").tobytes())
            else:
                check = crc[i]
            out.append((doc[i], begin[i] + start, n, check, total[i], base + w, offset, windows[w], base + step[w], part if with_ids else None))
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in _ROW.split(", ")]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def pack_hierarchy(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS, with_ids: bool = False, sequences: int = MATRIX_SEQUENCES) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group`` (and ``ids``).

    ``context`` is the size of the piece's sequence: one of ``tiers``, which are powers of
    two, or for the last sequences of a group a smaller power of two. Every sequence is
    full. ``step_group`` numbers steps of at most ``step_tokens`` tokens (or one sequence)
    of one size. Null and empty texts are the end id alone. Documents are cut without loss.
    Repeated rows are packed as often as they occur; null ids are ids like others. Texts of
    any length are read whole; with ``with_ids`` pieces carry their ids, but windows that one
    document fills are cut before the exchange either way. Extra columns are ignored; an
    empty table gives an empty result.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError(f"tiers must be powers of two, longest first: {tiers}")
    prepare(docs.sparkSession)
    groups = _groups(docs, tiers[0], sequences)
    pieces = token_pieces(docs, tokenizer, tiers[0], end_id)
    if not with_ids:
        pieces = pieces.withColumn("ids", F.when(F.col("length") < tiers[0], F.col("ids")))
    what = F.xxhash64("doc_id", "piece", "length", "ids_crc32", F.spark_partition_id())
    out = pieces.withColumn("g", F.pmod(what, F.lit(groups))).groupBy("g").applyInArrow(_packed(tiers, step_tokens, id_type(tokenizer), with_ids), _ROW)
    return out if with_ids else out.drop("ids")
