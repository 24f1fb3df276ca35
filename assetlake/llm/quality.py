"""Operator 1: quality by boosted trees over document statistics.

Statistics of each whole text are taken in one pass. Trees are grown on binned
values of a bounded sample of labelled rows; where a feature is declared monotonic,
a split is allowed only if the side that should be better is, and the middle of both
bounds everything below, so the score can't turn against the feature. The finished
trees lie in flat arrays: scoring walks all rows of a batch down one level at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import map_rows, prepare, raw_texts

SYMBOLS = b"#*$%&|<>"
#: Fixed limits of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Labelled rows that the trees are grown on, at most about.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, MIN_CHILD = 60, 4, 32, 0.15, 2.0, 0.5
THRESHOLD = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees, and their direction: -1 more is worse, 1 more is better, 0 either.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "upper_share": 0, "digit_share": 0, "mark_share": 0, "short_share": 0, "bang_share": -1, "words_per_line": 0,
}


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of ``width`` words that the text has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    at: dict[bytes, int] = {}
    code = np.fromiter((at.setdefault(w, len(at)) for w in words), np.int64, n)
    key = code[: n - width + 1]
    for i in range(1, width):
        if i > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(at) + code[i : i + len(key)]
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[which] > 1
    cover = np.zeros(n, bool)
    for i in range(width):
        cover[i : i + len(twice)] |= twice
    return int(cover.sum())


def statistics(raw: bytes | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts, and the features of the trees."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    glued = b"".join(words)
    chars = len(glued.decode("utf-8", "replace"))
    symbols = len(glued) - len(glued.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    share = lambda drop: (len(glued) - len(glued.translate(None, drop))) / max(1, chars)
    short = sum(1 for w in words if len(w) <= 3)
    features = (
        np.log1p(n), chars / max(1, n), symbols / max(1, chars), dup / max(1, lines), repeat / max(1, n), len(set(words)) / max(1, n),
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b".,;:?()'\"-"), short / max(1, n), share(b"!"), n / max(1, lines),
    )
    return (n, chars, symbols, dup, repeat), features


class Trees:
    """Boosted trees in flat arrays: a leaf points to itself."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.value = (np.empty(0, t) for t in (np.int32, float, np.int32, np.int32, float))
        self.roots: list[int] = []
        self.base = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, monotone: list[int]) -> "Trees":
        n, k = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        flat = binned + np.arange(k) * BINS
        nodes: list[list] = []
        self.base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        z = np.full(n, self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            root = len(nodes)
            self.roots.append(root)
            nodes.append([0, np.inf, root, root, 0.0])
            work = [(root, np.arange(n), -np.inf, np.inf, 0)]
            while work:
                node, rows, lo, hi, depth = work.pop()
                value = float(np.clip(g[rows].sum() / (h[rows].sum() + L2), lo, hi))
                best = self._split(flat[rows], g[rows], h[rows], k, monotone, lo, hi) if depth < DEPTH and len(rows) > 1 else None
                if best is None:
                    nodes[node][4] = RATE * value
                    z[rows] += RATE * value
                    continue
                j, b, vl, vr = best
                goes = binned[rows, j] <= b
                left, right = len(nodes), len(nodes) + 1
                nodes[node][:4] = [j, float(edges[j][b]), left, right]
                nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
                mid = (vl + vr) / 2
                bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[monotone[j]]
                work += [(left, rows[goes], *bounds[0], depth + 1), (right, rows[~goes], *bounds[1], depth + 1)]
        self.feature, self.threshold, self.left, self.right, self.value = (np.array(c, t) for c, t in zip(zip(*nodes, strict=True), (np.int32, float, np.int32, np.int32, float), strict=True))
        return self

    @staticmethod
    def _split(flat, g, h, k, monotone, lo, hi):
        """Feature, last bin of the left side, and both sides' values; None if nothing gains."""
        gs = np.bincount(flat.ravel(), np.repeat(g, k), k * BINS).reshape(k, BINS)
        hs = np.bincount(flat.ravel(), np.repeat(h, k), k * BINS).reshape(k, BINS)
        gl, hl = gs.cumsum(axis=1)[:, :-1], hs.cumsum(axis=1)[:, :-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        vl, vr = np.clip(gl / (hl + L2), lo, hi), np.clip(gr / (hr + L2), lo, hi)
        value = lambda v, a, b: v * a - 0.5 * v**2 * (b + L2)
        whole = np.clip(g.sum() / (h.sum() + L2), lo, hi)
        gain = value(vl, gl, hl) + value(vr, gr, hr) - value(whole, g.sum(), h.sum())
        sign = np.array(monotone)[:, None]
        gain = np.where((hl >= MIN_CHILD) & (hr >= MIN_CHILD) & (sign * (vr - vl) >= 0), gain, -np.inf)
        j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        return (int(j), int(b), float(vl[j, b]), float(vr[j, b])) if gain[j, b] > 1e-3 else None


def _features(rows: DataFrame) -> DataFrame:
    def make():
        return lambda b: {"y": b.column(1), "x": [list(map(float, statistics(t)[1])) for t in raw_texts(b.column(0))]}

    return map_rows(rows, make, "y int, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees from labelled documents; of several labels of one document the least counts, of several texts too."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    share = min(1.0, train_rows / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)  # `train_rows` ids, about
    some = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id").select("text", "y")
    got = _features(some).toArrow()
    if not got.num_rows:
        return Trees()
    return Trees().fit(np.array(got.column(1).to_pylist()), got.column(0).to_numpy().astype(float), list(FEATURES.values()))


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Trees | None = None) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed, score, kept`` for every row of ``docs``.

    Null and wordless texts have zeros everywhere and fail the base rules. A document
    is kept if the base rules pass and the trees give at least ``threshold``; without
    labels the trees say 0.5 to all. Repeated rows are separate rows; extra columns
    are ignored.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs, labels))  # TREES * 2^(DEPTH + 1) nodes at most

    def make():
        model = shared.value

        def step(b: pa.RecordBatch) -> dict:
            found = [statistics(x) for x in raw_texts(b.column(1))]
            base = np.array([f[0] for f in found], np.int64)
            score = model.score(np.array([f[1] for f in found], float))
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
            return {"doc_id": b.column(0), **dict(zip(BASE, base.T, strict=True)), "base_failed": failed, "score": score, "kept": ~failed & (score >= threshold)}

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean")
