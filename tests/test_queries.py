"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from assetlake.plans import catalogue
from tests.compare import duck_rows, spark_rows
from tests.conftest import DATA

QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        assert spark_rows(df) == duck_rows(duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_views_take_every_point(spark):
    key = ["l_suppkey", "l_orderkey", "l_linenumber"]
    got = QUERIES["project_all_points"](spark, DATA).withColumnRenamed("asset", "l_suppkey").select(*key).distinct().count()
    assert got == spark.read.parquet(f"{DATA}/lineitem.parquet").select(*key).distinct().count()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
