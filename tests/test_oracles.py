"""Every query with SQL, held against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pytest

from tracewell import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


def table(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iuf":
            df[c] = df[c].astype(float).round(6) + 0.0
        else:
            df[c] = df[c].map(lambda v: "" if v is None or (isinstance(v, float) and np.isnan(v)) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, duck, sf, name):
    ours, sql = table(plans.queries()[name](spark, sf).toPandas()), table(duck.execute(plans.oracle_sql()[name]).df())
    assert list(ours.columns) == list(sql.columns)
    assert len(ours) == len(sql)
    assert ((ours == sql) | (ours.isna() & sql.isna())).all().all()


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, sf, name):
    assert plans.queries()[name](spark, sf).count() > 0


def test_entry_has_no_hard_need_of_the_subpackage(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
