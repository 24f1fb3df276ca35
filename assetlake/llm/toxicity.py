"""Operator 8: toxicity by a factorization machine over hashed terms.

A document is the set of its lower-cased terms, hashed: its words, and the beginnings
of words at each rate that they reach in the text, so that an inflected word shares
terms with its other forms and a beginning that a language uses now and then differs
from one that fills the text. A bounded sample of labelled rows gives document counts
per class; the terms that stand out more than the best of so many would by chance make
the model, a weight and a short vector per term: the score of a text is the logistic of
all weights plus all pairwise products of vectors, so that two terms together can say
more than the sum of both.
"""

from __future__ import annotations

import string
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import held_out, map_rows, prepare, raw_texts
from assetlake.session import materialize

THRESHOLD = 0.7
#: Labelled rows that the model is fitted on, at most about.
TRAIN_ROWS = 20_000
#: Buckets of the term hash, length of the vectors.
BUCKETS, FACTORS = 1 << 22, 8
EPOCHS, BATCH, RATE, L2 = 40, 256, 0.1, 0.1
#: One training row in so many is kept apart to choose the number of epochs.
VALIDATION = 5
CACHE_WORDS = 500_000
#: Bytes of the texts whose terms are found together, about.
BATCH_BYTES = 4_000_000
#: Lengths of the beginnings of words that are terms, and the rates that make a term each.
STEMS, RATES = range(3, 9), (1 / 1024, 1 / 256, 1 / 64)
_RATE_STEP = 0x9E3779B1
_EDGES = string.punctuation + "“”‘’«»…–—"


def _bucket(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key.encode()) % BUCKETS


class Terms(dict):
    """Word (bytes) to its own term and its beginnings; with an index, those of the model only. Remembered."""

    def __init__(self, index: dict[int, int] | None = None):
        super().__init__()
        self.index = index
        #: Beginnings that may be terms of the model at some rate.
        self.stems = {(k - i * _RATE_STEP) % BUCKETS for k in index for i in range(len(RATES))} if index is not None else set()

    def __missing__(self, word: bytes) -> tuple[tuple[int, ...], tuple[int, ...]]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = self.found(word)
        return got

    def found(self, word: bytes) -> tuple[tuple[int, ...], tuple[int, ...]]:
        term = word.decode("utf-8", "replace").lower().strip(_EDGES)
        raw, digest = term.encode(), xxhash.xxh3_64_intdigest
        own = (digest(raw) % BUCKETS,) if term else ()
        if len(raw) == len(term):
            stems = [digest(raw[:n] + b"\0") % BUCKETS for n in range(STEMS.start, min(STEMS.stop, len(raw) + 1))]
        else:
            stems = [digest(term[:n].encode() + b"\0") % BUCKETS for n in range(STEMS.start, min(STEMS.stop, len(term) + 1))]
        if self.index is None:
            return own, tuple(stems)
        known = self.stems
        return tuple(self.index[k] for k in own if k in self.index), tuple([s for s in stems if s in known])

    @staticmethod
    def rated(stem: int, level: int) -> int:
        return (stem + level * _RATE_STEP) % BUCKETS

    def of(self, raw: bytes | None) -> list[int]:
        """The terms of one text, in order."""
        words = (raw or b"").split()
        found: set[int] = set()
        count: dict[int, int] = {}
        for word, k in Counter(words).items():
            own, stems = self[word]
            found.update(own)
            for s in stems:
                count[s] = count.get(s, 0) + k
        for s, k in count.items():
            for level, rate in enumerate(RATES):
                if k >= rate * len(words):
                    term = self.rated(s, level)
                    if self.index is None:
                        found.add(term)
                    elif term in self.index:
                        found.add(self.index[term])
        return sorted(found)


class BatchTerms(dict):
    """The model's terms of many texts at once, as ``Terms.of`` finds them in each.

    A word has a number, or -1 when it has no term of the model; its own term and its
    beginnings lie in flat arrays. Words are counted, and beginnings added up, for all
    texts of a batch together.
    """

    def __init__(self, index: dict[int, int]):
        super().__init__()
        self.terms = Terms(index)
        keys = np.array(sorted(index), np.int64)
        self.keys, self.places = keys, np.array([index[k] for k in keys.tolist()], np.int64)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.own, self.stems, self.ends = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)
        self.new: list[tuple[tuple[int, ...], tuple[int, ...]]] = []

    def __missing__(self, word: bytes) -> int:
        got = self.terms.found(word)
        if got == ((), ()):
            number = -1
        else:
            number = len(self.own) + len(self.new)
            self.new.append(got)
        self[word] = number
        return number

    def _grow(self) -> None:
        if self.new:
            own = np.array([o[0] if o else -1 for o, _ in self.new], np.int64)
            size = np.array([len(x) for _, x in self.new], np.int64)
            stems = np.fromiter((x for _, some in self.new for x in some), np.int64, int(size.sum()))
            self.own, self.stems = np.concatenate([self.own, own]), np.concatenate([self.stems, stems])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
            self.new = []

    def of(self, raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(term, text) pairs, by text and then by term."""
        if len(self) >= CACHE_WORDS:
            self.forget()
        words = [(raw or b"").split() for raw in raws]
        n = np.array([len(w) for w in words], np.int64)
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        self._grow()
        text = np.repeat(np.arange(len(raws)), n)[number >= 0]
        wide = max(1, len(self.own))
        pair, times = np.unique(text * wide + number[number >= 0], return_counts=True)
        text, number = pair // wide, pair % wide
        own = self.own[number]
        found = [(own[own >= 0], text[own >= 0])]
        size = self.ends[number + 1] - self.ends[number]
        at = np.repeat(self.ends[number] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        stem, which = np.unique(np.repeat(text, size) * BUCKETS + self.stems[at], return_inverse=True)
        count = np.bincount(which, np.repeat(times, size), len(stem))
        text, stem = stem // BUCKETS, stem % BUCKETS
        for level, rate in enumerate(RATES):
            often = count >= rate * n[text]
            key = (stem[often] + level * _RATE_STEP) % BUCKETS
            place = np.searchsorted(self.keys, key)
            known = place < len(self.keys)
            known[known] = self.keys[place[known]] == key[known]
            found.append((self.places[place[known]], text[often][known]))
        wide = max(1, len(self.keys))
        pair = np.unique(np.concatenate([y * wide + x for x, y in found]))
        return pair % wide, pair // wide


_kept: dict[bytes, BatchTerms] = {}


def batch_terms(terms: np.ndarray) -> BatchTerms:
    """The finder of this worker for a model's terms, which remembers its words from task to task."""
    key = xxhash.xxh3_128_digest(terms.tobytes())
    if key not in _kept:
        _kept.clear()
        _kept[key] = BatchTerms({int(t): i for i, t in enumerate(terms)})
    return _kept[key]


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All terms of some rows, and the row of each."""
    return np.fromiter((t for r in rows for t in r), np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


class FactorizationMachine:
    """Logistic of bias + sum of w x + sum over pairs of (v, v') x x', x being the term's value where it occurs."""

    def __init__(self, terms: np.ndarray, value: np.ndarray | None = None, seed: int = 7):
        self.terms = terms
        n = len(terms)
        self.x = np.ones(n) if value is None else value
        self.bias, self.w = 0.0, np.zeros(n)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (n, FACTORS))

    def raw(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and each row's sum of vectors; a row's sums see that row alone."""
        return self.raw_flat(*_flat(rows), len(rows))

    def raw_flat(self, idx: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``raw`` of n rows given as (term, row) pairs."""
        total = lambda x: np.bincount(row, x, n)
        v = self.v[idx] * self.x[idx, None]
        s = np.stack([total(v[:, f]) for f in range(FACTORS)], axis=1)
        squares = np.stack([total(v[:, f] ** 2) for f in range(FACTORS)], axis=1)
        return self.bias + total(self.w[idx] * self.x[idx]) + 0.5 * (s**2 - squares).sum(axis=1), s

    def _steps(self, rows: list[list[int]], y: np.ndarray, epochs: int, seed: int, after=None) -> None:
        """Adaptive gradient steps on the logistic loss plus L2 a training set."""
        rng = np.random.default_rng(seed)
        n = len(self.w)
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        gw, gv, gb = np.full(n, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        decay = L2 / len(rows)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(rows), BATCH):
                pick = order[lo : lo + BATCH]
                part = [rows[i] for i in pick]
                idx, row = _flat(part)
                z, s = self.raw(part)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
                each = err[row] * self.x[idx]
                near = s[row] - self.v[idx] * self.x[idx, None]
                dw = np.bincount(idx, each, n) + decay * self.w
                dv = np.stack([np.bincount(idx, each * near[:, f], n) for f in range(FACTORS)], axis=1) + decay * self.v
                gw, gv, gb = gw + dw**2, gv + dv**2, gb + err.sum() ** 2
                self.w -= RATE * dw / np.sqrt(gw)
                self.v -= RATE * dv / np.sqrt(gv) * 0.3
                self.bias -= RATE * err.sum() / np.sqrt(gb)
            if after:
                after()

    def fit(self, rows: list[list[int]], y: np.ndarray, seed: int = 7) -> "FactorizationMachine":
        """Fit on all rows, with as many epochs as suit rows kept apart best."""
        apart = np.arange(len(rows)) % VALIDATION == 0
        epochs = EPOCHS // 2
        if len(set(y[apart])) == len(set(y[~apart])) == 2:
            trial, losses = FactorizationMachine(self.terms, self.x, seed), []
            held, truth = [r for r, a in zip(rows, apart, strict=True) if a], y[apart]

            def loss():
                z = np.clip(trial.raw(held)[0], -30, 30)
                losses.append(float(np.mean(np.log1p(np.exp(z)) - truth * z)))

            trial._steps([r for r, a in zip(rows, apart, strict=True) if not a], y[~apart], EPOCHS, seed, loss)
            epochs = int(np.argmin(losses)) + 1
        self._steps(rows, y, epochs, seed)
        return self

    def score(self, rows: list[list[int]]) -> np.ndarray:
        return self.score_flat(*_flat(rows), len(rows))

    def score_flat(self, idx: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw_flat(idx, row, n)[0], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """Fit on labelled rows that are not held out; ties between labels of one document go to 1.

    How far a term stands out is counted in standard deviations of its documents' labels
    from the average, less half a document. The best of M terms reaches sqrt(2 log M) by
    chance: there a term has value 1, below it the square of its part, and below half of
    it it is no term of the model. So the model grows with what the labels show, and no
    number of terms is set.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    share = min(1.0, train_rows / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)  # `train_rows` ids, about
    some = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")

    def make():
        known = Terms()
        return lambda b: {"toxic": b.column(1), "terms": [known.of(x) for x in raw_texts(b.column(0))]}

    rows = materialize(map_rows(some, make, "toxic int, terms array<int>"), "toxic-terms")
    n1, n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not n1 or n1 == n:
        return FactorizationMachine(np.empty(0, np.int64)).fit([[]] * n, np.full(n, float(bool(n1)))) if n else FactorizationMachine(np.empty(0, np.int64))
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("k"), F.count("*").alias("m")).where("m > 2")
    counts = materialize(counts, "toxic-counts")
    p, m = F.lit(n1 / n), F.col("m")
    z = F.greatest(F.abs(F.col("k") - m * p) - 0.5, F.lit(0.0)) / F.sqrt(m * p * (1 - p))
    bar = float(np.sqrt(2 * np.log(max(2, counts.count()))))
    best = counts.select("term", (z / bar).alias("z")).where("z >= 0.5").orderBy("term").toArrow()
    top = best.column(0).to_numpy().astype(np.int64)

    def within():
        def step(b: pa.RecordBatch) -> dict:
            terms = b.column(1)
            ends, flat = terms.offsets.to_numpy(), terms.values.to_numpy()
            at = np.minimum(np.searchsorted(top, flat), max(0, len(top) - 1))
            mine = [at[lo:hi][top[at[lo:hi]] == flat[lo:hi]] if len(top) else at[:0] for lo, hi in zip(ends, ends[1:])]
            return {"toxic": b.column(0), "t": mine, "o": [xxhash.xxh3_64_intdigest(flat[lo:hi].tobytes()) >> 1 for lo, hi in zip(ends, ends[1:])]}

        return step

    got = map_rows(rows, within, "toxic int, t array<long>, o long").toArrow()  # bounded by train_rows
    toxic, order = got.column(0).to_numpy(), np.lexsort((got.column(0).to_numpy(), got.column(2).to_numpy()))
    terms = got.column(1).to_pylist()
    model = FactorizationMachine(top, np.minimum(1.0, best.column(1).to_numpy()) ** 2)
    return model.fit([terms[i] for i in order], toxic[order].astype(float))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: FactorizationMachine | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts score the model's bias. Whole texts of any length are read.
    Without labels of both kinds every score is the only label's share. Repeated rows are
    separate rows; extra columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs, labels))  # FACTORS + 2 numbers a term of the bounded sample

    def make():
        model = shared.value
        known = batch_terms(model.terms)

        def step(b: pa.RecordBatch) -> dict:
            texts = raw_texts(b.column(2))
            ends = np.cumsum([len(x or b"") for x in texts]) // BATCH_BYTES
            parts = np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1)
            score = np.concatenate([model.score_flat(*known.of([texts[i] for i in part]), len(part)) for part in parts])
            return {"doc_id": b.column(0), "held_out": b.column(1), "score": score, "predicted": (score >= threshold).astype(np.int32)}

        return step

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")
