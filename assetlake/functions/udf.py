"""User code in jobs: per-asset functions, batch inference, named steps and readers, aggregates."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_assets(df: DataFrame, key: str, fn: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """``key, <schema>, error``: fn of each row; failures become error rows, null results are dropped."""
    kind = df.schema[key].dataType.simpleString()
    names = [f.strip().split()[0].strip("`") for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.to_dict("records"):
                try:
                    got = fn(row)
                    if got is not None:
                        rows.append((row[key], *[got.get(n) for n in names], None))
                except Exception as e:  # noqa: BLE001  whatever fails is reported
                    rows.append((row[key], *[None] * len(names), f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=[key, *names, "error"])

    return df.mapInPandas(run, f"`{key}` {kind}, {schema}, error string")


def encode_assets(df: DataFrame, key: str, vector: str, model: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """``key, encoded, error``: the model is built once per partition and fed whole batches; non-finite results are errors."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model()
        for b in batches:
            if len(b):
                out = encode(np.stack(b[vector].to_numpy()).astype(np.float32))
                good = np.isfinite(out).all(axis=1)
                yield pd.DataFrame({key: b[key], "encoded": [v if g else None for v, g in zip(out.tolist(), good, strict=True)], "error": [None if g else "non-finite" for g in good]})

    return df.select(key, vector).mapInPandas(run, f"`{key}` {kind}, encoded array<float>, error string")


class Funnel:
    """Ordered named predicates; mixins add theirs behind."""

    def __init__(self, steps: list[tuple[str, Column]] | None = None):
        self.steps = list(steps or [])

    def register(self, name: str, predicate: Column) -> "Funnel":
        return Funnel([*self.steps, (name, predicate)])


#: Readers of datasets by name.
_DATASETS: dict[str, Callable[..., DataFrame]] = {}


def register_dataset(name: str, reader: Callable[..., DataFrame]) -> None:
    _DATASETS[name] = reader


def dataset(name: str, *args, **kwargs) -> DataFrame:
    if name not in _DATASETS:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(_DATASETS)}")
    return _DATASETS[name](*args, **kwargs)


#: Reductions by name.
REDUCTIONS: dict[str, Callable[[str], Column]] = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.max_by(c, "step"), "count": F.count}


@dataclass(frozen=True)
class UserAggregate:
    """A reduction of one's own in two phases: ``add`` and ``merge`` fold, ``finish`` gives the value.

    ``init()`` makes a state, ``add(state, steps, values)`` takes arrays of a batch, in any
    order, ``merge(a, b)`` joins two states; states must be picklable and small.
    """

    init: Callable[[], object]
    add: Callable[[object, np.ndarray, np.ndarray], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], float | None]


#: Paths whose states one task holds before it hands them on.
HELD_PATHS = 10_000


def _states(path: str, value: str, of: Callable[[str], UserAggregate]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, object] = {}
        for b in batches:
            for p, some in b.groupby(path, sort=False):
                agg = of(p)
                held[p] = agg.add(held[p] if p in held else agg.init(), some["step"].to_numpy(), some[value].to_numpy(float))
            if len(held) > HELD_PATHS:
                yield pd.DataFrame({path: list(held), "state": [pickle.dumps(s) for s in held.values()]})
                held = {}
        if held:
            yield pd.DataFrame({path: list(held), "state": [pickle.dumps(s) for s in held.values()]})

    return run


def reduce_leaves(rows: DataFrame, path: str, value: str, default: str | UserAggregate = "mean", special: dict[str, str | UserAggregate] | None = None) -> DataFrame:
    """One value per path of (step, path, value) rows; some paths by another reduction than the default.

    Reductions are names of REDUCTIONS, or a ``UserAggregate``: each task folds its rows of
    a path into one state, only states are shuffled, and merged per path.
    """
    special = special or {}
    own = {p: a for p, a in special.items() if isinstance(a, UserAggregate)}
    named = {p: n for p, n in special.items() if p not in own}
    if isinstance(default, UserAggregate):
        theirs, rest = ~F.col(path).isin(*named) if named else F.lit(True), F.col(path).isin(*named) if named else F.lit(False)
    else:
        theirs, rest = F.col(path).isin(*own) if own else F.lit(False), ~F.col(path).isin(*own) if own else F.lit(True)
    parts = []
    if named or isinstance(default, str):
        used = {*([default] if isinstance(default, str) else []), *named.values()}
        got = rows.where(rest).groupBy(path).agg(*[REDUCTIONS[n](value).cast("double").alias(n) for n in sorted(used)])
        pick = F.col(default) if isinstance(default, str) else F.lit(None).cast("double")
        for p, n in named.items():
            pick = F.when(F.col(path) == p, F.col(n)).otherwise(pick)
        parts.append(got.select(path, pick.alias(value)))
    if own or isinstance(default, UserAggregate):
        of = lambda p: own.get(p, default)

        def merged(pdf: pd.DataFrame) -> pd.DataFrame:
            p = pdf[path].iloc[0]
            state = reduce(of(p).merge, map(pickle.loads, pdf["state"]))
            return pd.DataFrame({path: [p], value: [of(p).finish(state)]})

        states = rows.where(theirs & F.col(value).isNotNull()).select(path, "step", value).mapInPandas(_states(path, value, of), f"`{path}` string, state binary")
        parts.append(states.groupBy(path).applyInPandas(merged, f"`{path}` string, `{value}` double"))
    return reduce(DataFrame.unionByName, parts)
