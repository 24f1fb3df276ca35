"""All registered queries of the library with their SQL, gathered by module."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("manifest_queries", "voxel_queries", "point_queries", "metric_queries", "training_queries", "job_queries")


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"assetlake.plans.{name}").QUERIES
    return out


def oracles() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"assetlake.plans.{name}").ORACLES
    return out
