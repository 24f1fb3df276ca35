"""Operators 3 and 4: documents to token ids, packed into sequences of one length.

Documents are tokenised where they are read, closed with an end id and cut into
pieces of at most ``length`` ids. Full pieces are sequences of their own. The
others are dealt by hash into groups of about ``GROUP_SEQUENCES`` sequences, and
each group is packed by itself: the number of groups follows the input, a group's
size doesn't, and a group leaves at most about one sequence half empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import map_rows, prepare, raw_texts

LENGTH = 4096
END_ID = 1
#: Sequences that one group of pieces fills, about; fewer where groups carry the ids themselves.
GROUP_SEQUENCES, MATRIX_SEQUENCES = 1024, 384
#: UTF-8 bytes per token, to choose the number of groups.
BYTES_PER_TOKEN = 3.5
#: Runs that one worker remembers, some 60 MB.
CACHE_WORDS = 600_000


#: Texts of these characters only are the same after NFC, lower-case one by one, and hold no contraction.
_PLAIN = re.compile("[ \n!-&(-~À-ÖØ-öø-ÿ]*")
_RUNS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \n]+")
#: Texts that show whether a tokenizer joins across spaces, line feeds or tabs, and whether it cuts as ``_RUNS`` does.
_PROBES = (
    "Äpfel, x1y22 (straße)... FOO_bar|baz%% año!",
    "hello world, this is a test",
    "one\ntwo\n\nthree \n four",
    " begins  with two   or three blanks ",
    "a\tb\t\tc\r\nd e's we'll I'M 10,000.5",
)


def id_type(tokenizer: str) -> np.dtype:
    """Little-endian type that holds every id of a tokenizer: 16 bits, or 32 for a vocabulary beyond 65536."""
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(tokenizer).get_vocab().values(), default=0)
    return np.dtype("<u2" if most < 1 << 16 else "<u4")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordIds:
    """Ids of a text, as the tokenizer gives them, with what was met before remembered.

    A plain text is cut into runs of letters, digits and marks, as the tokenizer
    would cut it, and only runs not met before go to its model. Other texts are
    looked at word by word: plain words likewise, the rest by the tokenizer itself.
    If runs give other ids than the tokenizer on a probe, no text counts as plain;
    if words cut at spaces and line feeds do, every text is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.type = Tokenizer.from_file(path), id_type(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.at: dict[str, int] = {}
        self.plain, self.whole = True, False
        if not self._agrees():
            self.plain = False
            self.whole = not self._agrees()
        self.clear()

    def _agrees(self) -> bool:
        self.clear()
        return all(self(x.encode()).tolist() == self._encode(x) for x in _PROBES)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.at.clear()
        self.ids = np.empty(1 << 16, self.type)
        self.ends = np.zeros(1 << 12, np.int64)
        self.n = 0

    def _is_plain(self, text: str) -> bool:
        return self.plain and "<|" not in text and _PLAIN.fullmatch(text) is not None

    def _parts(self, text: str) -> list[str]:
        """Runs of a plain text; of another, words that the tokenizer must see are marked with a blank."""
        if self._is_plain(text):
            return _RUNS.findall(text.lower())
        out: list[str] = []
        for word in text.replace("\n", " ").split(" "):
            out += _RUNS.findall(word.lower()) if self._is_plain(word) else [" " + word]
        return out

    def _learn(self, parts: list[str]) -> None:
        found: list[int] = []
        ends = []
        begin = int(self.ends[self.n])
        for n, part in enumerate(parts, self.n):
            if part[0] == " ":
                found += self._encode(part[1:])
            else:
                text = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
                found += [x.id for x in self.model.tokenize(text)]
            self.at[part] = n
            ends.append(begin + len(found))
        while begin + len(found) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.n + len(parts) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[begin : begin + len(found)] = found
        self.ends[self.n + 1 : self.n + 1 + len(parts)] = ends
        self.n += len(parts)

    def __call__(self, raw: bytes) -> np.ndarray:
        text = raw.decode("utf-8", "replace")
        if self.whole:
            return np.array(self._encode(text), self.type)
        parts = self._parts(text)
        if self.n > CACHE_WORDS:
            self.clear()
        if not parts:
            return np.empty(0, self.type)
        k = np.fromiter(map(self.at.get, parts, repeat(-1)), np.int64, len(parts))
        if k.min() < 0:
            self._learn(list(dict.fromkeys([parts[i] for i in np.flatnonzero(k < 0)])))
            k = np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts))
        begin = self.ends[k]
        size = self.ends[k + 1] - begin
        step = np.cumsum(size)
        return self.ids[np.arange(step[-1]) + np.repeat(begin - step + size, size)]


_encoders: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The encoder of this worker, which remembers its runs from task to task."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def best_fit_decreasing(sizes: np.ndarray, length: int) -> np.ndarray:
    """Bin of each piece: longest first, into the fullest bin that takes it.

    Bins are grouped by the room they have left; a segment tree over rooms 0 to
    ``length`` holds which rooms occur, and a descent finds the least room that is
    enough.
    """
    width = 1
    while width <= length:
        width *= 2
    tree = [0] * (2 * width)

    def add(room: int, by: int) -> None:
        i = room + width
        while i:
            tree[i] += by
            i //= 2

    def least(room: int) -> int:
        """Smallest occurring room >= ``room``, or -1."""
        i = room + width
        if tree[i]:
            return room
        while i > 1:
            if i % 2 == 0 and tree[i + 1]:
                i += 1
                while i < width:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - width
            i //= 2
        return -1

    open_: list[list[int]] = [[] for _ in range(length + 1)]
    out, n = np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        room = least(size)
        if room < 0:
            b, room, n = n, length, n + 1
        else:
            b = open_[room].pop()
            add(room, -1)
        out[i] = b
        open_[room - size].append(b)
        add(room - size, 1)
    return out


def sum_of_squares(sizes: np.ndarray, length: int, compete: bool = False) -> np.ndarray:
    """Bin of each piece: where the sum over gaps of (open bins with that gap)^2 gets least.

    Pieces come longest first; the fullest of equal bins wins. With ``compete`` a new bin
    is a choice like the open ones; without, it is opened when no open bin takes the piece,
    which leaves fewer bins half empty at the end.
    """
    count = np.zeros(length + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(length + 1)]
    out, n = np.empty(len(sizes), np.int64), 0
    never = np.iinfo(np.int64).max
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        # moving a bin from gap g to g - size changes the sum by 2 (N[g - size] - N[g] + 1); a full bin counts no more
        gaps = count[size:]
        to = count[: length + 1 - size]
        cost = 2 * (to - gaps + 1)
        cost[0] = 1 - 2 * gaps[0]
        cost = np.where(gaps > 0, cost, never)
        g = int(np.argmin(cost))
        new = 2 * int(count[length - size]) + 1 if size < length else 0
        if gaps[g] > 0 and not (compete and new < cost[g]):
            room = g + size
            b = open_[room].pop()
            count[room] -= 1
        else:
            b, room, n = n, length, n + 1
        out[i] = b
        if room > size:
            open_[room - size].append(b)
            count[room - size] += 1
    return out


def sum_of_squares_competing(sizes: np.ndarray, length: int) -> np.ndarray:
    return sum_of_squares(sizes, length, compete=True)


PACKERS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "best_fit_decreasing": best_fit_decreasing,
    "sum_of_squares": sum_of_squares,
    "sum_of_squares_competing": sum_of_squares_competing,
}


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, doc_tokens, ids``: every document's ids and the end id, cut.

    ``ids`` are of the tokenizer's ``id_type``, the digest is of 32-bit ids whatever that is.
    """
    kind = id_type(tokenizer)
    if end_id > np.iinfo(kind).max:
        raise ValueError(f"end id {end_id} is beyond the ids of {tokenizer}")

    def make():
        encode = word_ids(tokenizer)

        def step(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc, raw in zip(b.column(0).to_pylist(), raw_texts(b.column(1)), strict=True):
                ids = np.append(encode(raw or b"").astype("<u4"), np.uint32(end_id))
                for k, start in enumerate(range(0, len(ids), length)):
                    part = ids[start : start + length]
                    row = (doc, k, start, len(part), zlib.crc32(part.tobytes()), len(ids), part.astype(kind).tobytes() if with_ids else None)
                    for c, v in zip(out.values(), row, strict=True):
                        c.append(v)
            return out

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def _groups(docs: DataFrame, length: int, sequences: int) -> int:
    size = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    return max(1, round(((size[0] or 0) / BYTES_PER_TOKEN + size[1]) / (length * sequences)))


def _dealt(pieces: DataFrame, length: int, groups: int) -> DataFrame:
    """Pieces with their group ``g``: by hash of what a piece is and of the partition it lies in.

    So rows of one id, or of none, are spread like any others, and rows alike in everything
    meet only if one partition holds them. Full pieces, which need no packing, have small
    groups of their own.
    """
    what = F.xxhash64("doc_id", "piece", "length", "ids_crc32", F.spark_partition_id())
    g = F.pmod(what, F.lit(groups))
    return pieces.withColumn("g", F.when(F.col("length") < length, g).otherwise(F.lit(groups) + g))


def _assigned(length: int, method: str):
    """One group's pieces with sequence and offset; the least row names a sequence."""
    place = PACKERS[method]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        size = t.column("length").to_numpy()
        b = place(size, length)
        order = np.lexsort((np.arange(len(b)), b))
        used = np.cumsum(size[order]) - size[order]
        head = np.r_[True, b[order][1:] != b[order][:-1]] if len(b) else np.empty(0, bool)
        offset = np.empty(len(b), np.int64)
        offset[order] = used - used[head][np.cumsum(head) - 1] if len(b) else used
        group = t.column("g").to_numpy()
        return t.append_column("sequence_id", pa.array(group.astype(np.int64) * (1 << 32) + b)).append_column("offset", pa.array(offset))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, method: str = "sum_of_squares", end_id: int = END_ID, with_ids: bool = False, sequences: int = GROUP_SEQUENCES) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    Null and empty texts are the end id alone. Only documents longer than ``length``
    are cut, without loss. Repeated rows are packed as often as they occur. Offsets
    in a sequence are gapless from 0. Null or repeated ids don't matter to the packing;
    texts of any length are read whole. Extra columns are ignored; an empty table gives
    an empty result.
    """
    prepare(docs.sparkSession)
    groups = _groups(docs, length, sequences)
    pieces = token_pieces(docs, tokenizer, length, end_id, with_ids).drop("doc_tokens")
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, g long, sequence_id long, offset long"
    out = _dealt(pieces, length, groups).groupBy("g").applyInArrow(_assigned(length, method), ddl)
    return out.drop("g") if with_ids else out.drop("g", "ids")


_SEQUENCE = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, ids binary, position_ids binary"


def packed_matrix(docs: DataFrame, tokenizer: str, length: int = LENGTH, method: str = "best_fit_decreasing", end_id: int = END_ID, pad_id: int = 0, sequences: int = MATRIX_SEQUENCES) -> DataFrame:
    """One row per sequence: the id row padded to ``length``, cumulative segment lengths, positions.

    ``ids`` are of the tokenizer's ``id_type``, ``position_ids`` little-endian 16-bit, 32-bit
    for ``length`` beyond 65536; positions start again at 0 in each segment. ``cu_seqlens`` runs from 0 to the tokens used. Null and empty texts
    are the end id alone, overlong ones are cut without loss, repeated rows and null ids
    are segments like others. Extra columns are ignored; an empty table gives an empty
    result.
    """
    prepare(docs.sparkSession)
    groups = _groups(docs, length, sequences)
    pieces = token_pieces(docs, tokenizer, length, end_id).drop("doc_tokens")
    assign, kind, place = _assigned(length, method), id_type(tokenizer), "<u2" if length <= 1 << 16 else "<u4"

    def rows(t: pa.Table) -> pa.Table:
        t = assign(t).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        seq, size = t.column("sequence_id").to_numpy(), t.column("length").to_numpy()
        docs_, piece, ids = t.column("doc_id").to_pylist(), t.column("piece").to_pylist(), t.column("ids").to_pylist()
        heads = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]]) if len(seq) else np.empty(0, np.int64)
        out: dict[str, list] = {k: [] for k in ("sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "ids", "position_ids")}
        for lo, hi in zip(heads, [*heads[1:], len(seq)], strict=True):
            cu = np.r_[0, np.cumsum(size[lo:hi])].astype(np.int32)
            n = int(cu[-1])
            row, pos = np.full(length, pad_id, kind), np.zeros(length, place)
            row[:n] = np.frombuffer(b"".join(ids[lo:hi]), kind)
            pos[:n] = np.arange(n) - np.repeat(cu[:-1], np.diff(cu))
            for k, v in zip(out, (int(seq[lo]), n, docs_[lo:hi], piece[lo:hi], cu.tolist(), row.tobytes(), pos.tobytes()), strict=True):
                out[k].append(v)
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(v, ty) for v, ty in zip(out.values(), types, strict=True)], names=list(out))

    return _dealt(pieces, length, groups).groupBy("g").applyInArrow(rows, _SEQUENCE)


def write_matrix(packed: DataFrame, path: str) -> None:
    """Packed sequences as Parquet: one binary id row and position row of fixed length each."""
    packed.write.option("compression", "zstd").parquet(path)
