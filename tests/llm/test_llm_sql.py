"""The SQL of the text queries against the queries themselves, on the smallest tables."""

import duckdb
import pytest

from tracewell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    key = ["query_id", "rank"] if name == "op11_topk_search" else ["doc_id"]
    sql = c.execute(queries.ORACLE_SQL[name]).df().set_index(key).sort_index()
    ours = queries.QUERIES[name](spark, sf).toPandas().set_index(key).sort_index()[list(sql.columns)]
    assert len(ours) == len(sql)
    for column in sql.columns:
        a, b = ours[column].astype(object).fillna("-"), sql[column].astype(object).fillna("-")
        assert (a == b).all(), column


def test_all_are_registered():
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op")} == set(range(1, 14))
    assert "pipeline" in queries.QUERIES
