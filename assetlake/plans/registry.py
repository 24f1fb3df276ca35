"""How a module of queries registers them next to the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.session import table


class Tables:
    """The given tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Registry:
    def __init__(self, **sql: str):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}
        self.sql = sql  # named fragments, put in for <name>

    def query(self, name: str, sql: str | None = None, **kinds: str):
        """Register a query with its SQL; ``kinds`` names SQL types that some columns of it take."""

        def add(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                text = sql
                for k, v in self.sql.items():
                    text = text.replace(f"<{k}>", v)
                if kinds:
                    text = f"SELECT * REPLACE ({', '.join(f'CAST(\"{c}\" AS {k}) AS \"{c}\"' for c, k in kinds.items())}) FROM ({text})"
                self.oracles[name] = text
            return f

        return add


def r6(c: Column | str) -> Column:
    """Six decimals, no negative zero."""
    return F.round(c, 6) + F.lit(0.0)
