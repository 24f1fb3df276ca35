"""Operator 7: language by bit-sliced Bloom filters over character n-grams.

One table of words serves all languages: bit l of word p says whether position p is
set in language l's filter. Looking an n-gram up is the AND of its positions' words,
a mask of every language that (perhaps) has it. Counting a text's masks bit by bit
gives each language's hits; hits expected from false positives are taken off, and
the language that covers most of the text's n-grams is the answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlake.llm.common import held_out, map_rows, mix, prepare, raw_texts

GRAMS = (3, 4)
#: Positions of the filter table (a power of 2) and positions per n-gram.
POSITIONS, HASHES = 1 << 18, 3
#: The filter of a language holds its most frequent n-grams, at most so many.
GRAMS_PER_LANGUAGE = 8192
#: Documents of one language that the filters are learned from, at most about.
TRAIN_DOCS = 4000
#: Code points of text handled at once.
CHUNK = 1 << 20

_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_table: list[np.ndarray] = []


def has_letter(text: str) -> bool:
    """The pattern also finds number signs such as superscripts, which are no letters."""
    return any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text))


def _letters() -> np.ndarray:
    """Per code point: itself if a letter, else a blank."""
    if not _table:
        cp = np.arange(0x110000, dtype=np.uint32)
        cp[[i for i in range(0x110000) if not chr(i).isalpha()]] = 32
        _table.append(cp)
    return _table[0]


def gram_hashes(text: str, sizes: tuple[int, ...] = GRAMS) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of the lower-cased letters, words parted by one blank.

    The text is taken in pieces of CHUNK code points; each carries on from the last
    code points of the one before, so every n-gram comes once wherever pieces end.
    """
    text = f" {text.lower()} "
    tail = np.empty(0, np.uint64)
    for lo in range(0, len(text), CHUNK):
        cp = _letters()[np.frombuffer(text[lo : lo + CHUNK].encode("utf-32-le", "replace"), np.uint32)]
        blank = cp == 32
        after_blank = np.r_[bool(len(tail)) and tail[-1] == 32, blank[:-1]]
        cp = np.concatenate([tail, cp[~(blank & after_blank)].astype(np.uint64)])
        for n in sizes:
            part = cp[max(0, len(tail) - n + 1) :]
            if len(part) >= n:
                h = np.full(len(part) - n + 1, np.uint64(n))
                for i in range(n):
                    h = h * np.uint64(0x100000001B3) + part[i : i + len(h)]
                yield mix(h)
        tail = cp[-(max(sizes) - 1) :]


def _positions(h: np.ndarray) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + step * np.uint64(i)) & np.uint64(POSITIONS - 1)).astype(np.int64) for i in range(HASHES)]


class BitSliced:
    """Languages, the table of masks (one column of 64 bits per 64 languages) and false-positive rates."""

    def __init__(self, grams: dict[str, np.ndarray], fallback: str | None = None):
        self.langs = sorted(grams)
        self.fallback = fallback or (self.langs[0] if self.langs else "und")
        columns = -(-max(1, len(self.langs)) // 64)
        self.table = np.zeros((POSITIONS, columns), np.uint64)
        for i, lang in enumerate(self.langs):
            for p in _positions(grams[lang]):
                self.table[p, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        fill = [((self.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.langs))]
        self.false = np.array(fill) ** HASHES

    def hits(self, h: np.ndarray) -> np.ndarray:
        at = _positions(h)
        out = np.zeros(len(self.langs))
        for c in range(self.table.shape[1]):
            column = self.table[:, c]
            mask = column[at[0]]
            for p in at[1:]:
                mask = mask & column[p]
            for i in range(64 * c, min(64 * c + 64, len(self.langs))):
                out[i] = np.count_nonzero(mask & (np.uint64(1) << np.uint64(i % 64)))
        return out

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (0 to 1: best against runner-up), share of n-grams covered."""
        if not self.langs or text is None or not has_letter(text):
            return "und", 0.0, 0.0
        n, hits = 0, np.zeros(len(self.langs))
        for h in gram_hashes(text):
            n += len(h)
            hits += self.hits(h)
        share = np.clip((hits - n * self.false) / (1 - self.false), 0, None) / max(1, n)
        best = int(np.argmax(share))
        if share[best] <= 0:
            return self.fallback, 0.0, 0.0
        second = np.partition(share, -2)[-2] if len(share) > 1 else 0.0
        return self.langs[best], float(share[best] / (share[best] + second)), float(min(1.0, share[best]))


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, per_language: int = GRAMS_PER_LANGUAGE) -> BitSliced:
    """Filters from rows with a language that are not held out; a bounded sample a language.

    Every language that occurs is learned: the mask table has as many columns as they need.
    """
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False)))
    have = rows.groupBy("lang").agg(F.count("*").alias("k"))
    most = have.orderBy(F.desc("k"), "lang").first()
    if most is None:
        return BitSliced({})
    share = F.least(F.lit(1.0), F.lit(train_docs) / F.col("k"))
    some = rows.join(have.hint("broadcast"), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000).select("text", "lang")  # one short row a language

    def make():
        def step(b: pa.RecordBatch) -> dict:
            by: dict[str, list] = {}
            for raw, lang in zip(raw_texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).extend(gram_hashes(raw.decode("utf-8", "replace")))
            out: dict[str, list] = {"lang": [], "gram": [], "n": []}
            for lang, parts in by.items():
                if not parts:
                    continue
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                out["lang"] += [lang] * len(gram)
                out["gram"] += gram.view(np.int64).tolist()
                out["n"] += n.tolist()
            return out

        return step

    counts = map_rows(some, make, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= per_language)
    got = top.select("lang", "gram").toArrow()
    lang, gram = np.array(got.column(0).to_pylist(), object), got.column(1).to_numpy().view(np.uint64)
    return BitSliced({k: gram[lang == k] for k in {*lang.tolist()}}, most["lang"])


def identify(docs: DataFrame, model: BitSliced | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, coverage`` for every row of ``docs``.

    ``und`` with score 0 where the text is null or has no letter, or nothing could be
    learned. A text with letters of which no filter knows an n-gram gets the most
    frequent language and score 0. Whole texts of any length are read, in pieces.
    Repeated rows are separate rows; extra columns are ignored; an empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))  # 2 MB per 64 languages

    def make():
        model = shared.value

        def step(b: pa.RecordBatch) -> dict:
            got = [model.predict(None if x is None else x.decode("utf-8", "replace")) for x in raw_texts(b.column(2))]
            return {"doc_id": b.column(0), "held_out": b.column(1), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "coverage": [g[2] for g in got]}

        return step

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return map_rows(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, coverage double")


def keep_identified(docs: DataFrame, min_coverage: float = 0.2) -> DataFrame:
    """``docs`` without rows of no language: undetermined, or hardly an n-gram that any filter knows.

    So null texts and texts without a letter go. Where ``lang`` is null throughout and
    nothing can be learned, every text with a letter stays. Each row is judged by its
    text alone: null or repeated ids, and columns of any name, come back unchanged; an
    empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        model = shared.value
        if not model.langs:
            return pd.Series([x is not None and has_letter(x) for x in texts], dtype=bool)
        got = [model.predict(x) for x in texts]
        return pd.Series([g[0] != "und" and g[2] >= min_coverage for g in got], dtype=bool)

    return docs.where(known("text"))
