"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as contract
from tests.compare import compare, connection
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


#: The queries of the optional part have tests of their own.
KEYS = sorted({**contract.READS, **contract.RULES, **contract.CHANGES})


def test_every_query_has_sql():
    assert set(KEYS) <= set(contract.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, con, key):
    assert compare(spark, con, key, SMALL) == ""


def test_entry(spark):
    df = contract.entry(spark)
    assert isinstance(df, DataFrame)
    assert df.columns == ["nombre_reto", "nombre_retador", "concepto", "puntaje", "total"]
    assert df.count() > 0
