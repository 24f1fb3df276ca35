"""Operator 12: spelling variants, by composing the vocabulary acceptor with one edit and itself.

A vocabulary of any size is composed partition by partition. A partition is an initial
state: the words that have read the same beginning and, from the other end, the same
ending, so that only a region between them can hold the edit. Regions are halved, and
what lies in the other half must be the same in both words: every pair at one edit
meets in one partition. Partitions that are still large are halved again, at most down
to one place, where a partition has no more words than there are letters, or pairs of
letters with the longer words.

Within a task all partitions share one minimised acceptor, built from their sorted
regions by merging states with the same future. The composition acceptor, one-edit
transducer, acceptor walks pairs of states: both copies step together until the edit,
and step together after it. Its accepted paths are the pairs; results are remembered per
pair of states, so what partitions have in common is composed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import prepare
from assetlake.session import materialize

LETTERS = r"A-Za-zÀ-ÿ"
#: Least code points and least occurrences of a word, how much more frequent a form is, and the typing error rate.
LEAST_LENGTH, LEAST_N, TIMES, SLIPS = 6, 5, 5, 199
#: Words of a partition that is halved again; words that one task composes at a time.
PARTITION, TASK_WORDS = 2048, 60_000
#: States that one task's acceptor holds before it starts a new one.
STATES = 400_000


class Acceptor:
    """Minimised acceptors of sorted word lists that share their states, and their composition with one edit.

    ``arcs[q]`` lists (letter, target, accepted words of earlier arcs), so a path also
    gives the place of its word in the sorted list.
    """

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.arcs: list[list[tuple[str, int, int]]] = []
        self.count: list[int] = []
        self._same: dict[tuple[int, int], list] = {}
        self._replaced: dict[int, list] = {}
        self._longer: dict[tuple[int, int], list] = {}

    def state(self, words: list[str], lo: int = 0, hi: int | None = None, at: int = 0) -> int:
        """The state that accepts what follows place ``at`` in the sorted distinct words[lo:hi]."""
        hi = len(words) if hi is None else hi
        final = lo < hi and len(words[lo]) == at
        arcs, n = [], int(final)
        i = lo + n
        while i < hi:
            letter, j = words[i][at], i + 1
            while j < hi and words[j][at] == letter:
                j += 1
            arcs.append((letter, self.state(words, i, j, at + 1)))
            i = j
        key = (final, *arcs)
        q = self.known.get(key)
        if q is None:
            q = self.known[key] = len(self.arcs)
            out = []
            for letter, to in arcs:
                out.append((letter, to, n))
                n += self.count[to]
            self.arcs.append(out)
            self.count.append(n)
        return q

    def same(self, p: int, q: int) -> list[tuple[int, int]]:
        """Places of the words that both states accept: both copies step together to the end."""
        if p == q:
            return [(i, i) for i in range(self.count[p])]
        key = (p, q)
        out = self._same.get(key)
        if out is None:
            out = self._same[key] = []
            a, b = self.arcs[p], self.arcs[q]
            if self.count[p] - sum(self.count[t] for _, t, _ in a) and self.count[q] - sum(self.count[t] for _, t, _ in b):
                out.append((0, 0))
            other = {c: (t, o) for c, t, o in b}
            for c, t, o in a:
                if c in other:
                    u, v = other[c]
                    out += [(o + i, v + j) for i, j in self.same(t, u)]
        return out

    def replaced(self, q: int) -> list[tuple[int, int]]:
        """Pairs of accepted words, the smaller first, that differ in one letter."""
        out = self._replaced.get(q)
        if out is None:
            out = self._replaced[q] = []
            arcs = self.arcs[q]
            for k, (_, t, o) in enumerate(arcs):
                out += [(o + i, o + j) for i, j in self.replaced(t)]
                for _, u, v in arcs[k + 1 :]:
                    out += [(o + i, v + j) for i, j in self.same(t, u)]
        return out

    def longer(self, p: int, q: int) -> list[tuple[int, int]]:
        """Pairs (word of p, word of q) where deleting one letter of the first gives the second."""
        key = (p, q)
        out = self._longer.get(key)
        if out is None:
            found: dict[tuple[int, int], None] = {}
            other = {c: (t, o) for c, t, o in self.arcs[q]}
            for c, t, o in self.arcs[p]:
                found |= {(o + i, j): None for i, j in self.same(t, q)}
                if c in other:
                    u, v = other[c]
                    found |= {(o + i, v + j): None for i, j in self.longer(t, u)}
            out = self._longer[key] = list(found)
        return out


def near_pairs(acceptor: Acceptor, short: list[str], long: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs at one edit in sorted distinct words of two lengths: (short, short) replaced, (long, short) deleted."""
    s = acceptor.state(short)
    replaced = acceptor.replaced(s) if len(short) > 1 else []
    return replaced, acceptor.longer(acceptor.state(long), s) if long else []


def _composed(t: pa.Table) -> pa.Table:
    """Neighbours of each word in the partitions of one task: ``word, near, less, form`` (``less``: minus the form's count)."""
    out: dict[str, list] = {c: [] for c in ("word", "near", "less", "form")}
    rows = []
    for m, lo, hi, word, n in zip(*(t.column(c).to_pylist() for c in ("m", "lo", "hi", "word", "n")), strict=True):
        end = hi + len(word) - m
        rows.append((m, lo, hi, word[:lo], word[end:], len(word) > m, word[lo:end], word, n))
    rows.sort()
    acceptor = Acceptor()
    for (m, _, hi, _, _), some in groupby(rows, key=lambda r: r[:5]):
        some = list(some)
        cut = next((i for i, r in enumerate(some) if r[5]), len(some))
        if len(some) < 2 or not cut:
            continue
        if len(acceptor.arcs) > STATES:
            acceptor = Acceptor()
        short, long = some[:cut], some[cut:]
        replaced, longer = near_pairs(acceptor, [r[6] for r in short], [r[6] for r in long])
        pairs = [(short[i], short[j]) for i, j in replaced]
        # where the letter left out may as well be the one behind the region, the pair belongs to the region behind
        pairs += [(long[i], short[j]) for i, j in longer if hi == m or long[i][6][:-1] != short[j][6]]
        best: dict[str, list] = {}
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                form = (-y[8], y[7])
                held = best.get(x[7])
                if held is None:
                    best[x[7]] = [1, form]
                else:
                    held[0] += 1
                    held[1] = min(held[1], form)
        for word, (near, (less, form)) in best.items():
            for c, v in zip(out.values(), (word, near, less, form), strict=True):
                c.append(v)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, slips: int = SLIPS) -> DataFrame:
    """``word, n`` of all whole texts: letter runs, lower-cased in A-Z only, some with a letter left out.

    Of a run whose crc32 with its doc_id ``slips`` divides, the letter at crc32 modulo its
    length goes. A null doc_id is written as nothing, a null text has no runs.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    runs = runs.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.col("h") % F.length("run")
    slip = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
    words = runs.select(F.when(F.col("h") % slips == 0, slip).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _halves(rows: DataFrame) -> DataFrame:
    mid = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))
    return rows.select("word", "n", "m", F.explode(parts).alias("r")).select("word", "n", "m", "r.lo", "r.hi")


def _partition() -> Column:
    """Hash of the initial state: lengths, place of the region, and what is outside it."""
    end = F.col("hi") + F.length("word") - F.col("m")
    return F.xxhash64("m", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", end + 1, F.length("word")))


def _partitions(words: DataFrame, least_length: int, most: int) -> DataFrame:
    """``word, n, m, lo, hi, part``: each word in the partitions where its neighbours are; ``m`` is the shorter length."""
    m = F.explode(F.when(F.length("word") > least_length, F.array(F.length("word"), F.length("word") - 1)).otherwise(F.array(F.length("word"))))
    rows = _halves(words.select("word", "n", m.alias("m")).select("word", "n", "m", F.lit(0).alias("lo"), F.col("m").alias("hi")))
    done: list[DataFrame] = []
    while True:
        rows = materialize(rows.withColumn("part", _partition()), "regions")
        crowd = rows.where("hi - lo > 1").groupBy("part").agg(F.count("*").alias("size")).where(F.col("size") > most).select("part")
        crowd = materialize(crowd, "crowded")
        if crowd.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(crowd, "part", "left_anti").select(rows.columns))
        rows = _halves(rows.join(crowd, "part", "left_semi"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def neighbours(words: DataFrame, least_length: int = 1, most: int = PARTITION, task_words: int = TASK_WORDS) -> DataFrame:
    """``word, n_near, form, form_n``: near words of every word of ``word, n`` that has one, and the most frequent.

    Two words are near if one inserted, deleted or replaced code point makes one of the
    other. Equal counts go to the smaller word. Words are distinct and not null.
    """
    prepare(words.sparkSession)
    rows = _partitions(words, least_length, most)
    tasks = max(1, -(-rows.count() // task_words))
    found = rows.withColumn("task", F.pmod("part", F.lit(tasks))).groupBy("task").applyInArrow(_composed, "word string, near long, less long, form string")
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """``word, root`` from ``word, form``: forms followed to the last, twice as far in every round."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return at


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N, times: int = TIMES, slips: int = SLIPS, most: int = PARTITION) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary.

    ``form`` is the most frequent near word, if it is at least ``times`` as frequent, else
    null; of equal ones the first by code points. ``root`` is where forms lead, the word
    itself without one: counts grow with each step, so the largest count bounds the steps.
    Null texts and texts without letters have no words; repeated rows count again; extra
    columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    words = materialize(vocabulary(docs, least_length, least_n, slips), "vocabulary")
    near = neighbours(words, least_length, most)
    all_ = words.join(near, "word", "left")
    good = F.col("form_n") >= times * F.col("n")
    all_ = all_.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    all_ = materialize(all_, "forms")
    top = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(top, 2), max(times, 2))) + 1)
    root = roots(all_.where("form is not null"), math.ceil(math.log2(steps)) + 1)
    return all_.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
