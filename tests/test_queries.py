"""Every registered query of the library against its oracle SQL in DuckDB, on the small tables."""

import math

import duckdb
import pandas as pd
import pytest

from tests.conftest import DATA
from tamarack.plans import analytics, assistant, corpus, indexed, ingestion, multipass, planning, questions, records, registry, retrieval, routing, sql_functions, stored, upkeep  # noqa: F401

SF = DATA / "sf0.001"


def rows(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{float(v):.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, str(SF)).toPandas()
    if name in registry.ORACLE:
        want = duck.execute(registry.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns) > 0
