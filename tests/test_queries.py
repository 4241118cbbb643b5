"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from ashlar.plans import registry

SF = "/root/testdata/sf0.001"


def canonical(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 6) if isinstance(v, float) else list(v) if hasattr(v, "__iter__") and not isinstance(v, str) else v

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got)


def test_entry_without_training_operators(spark):
    import __spark_entry__

    assert {"byte_entropy", "format_counts"} <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
