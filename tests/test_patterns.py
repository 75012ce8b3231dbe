from functools import reduce
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from tracewell import plans
from tracewell.operators import profiles as pf
from tracewell.plans.trace_queries import _features


def test_patterns_do_not_depend_on_the_order_of_the_sums(spark, sf):
    ratios = [1 / 9, 2 / 3, 1 / 3, 2 / 9, 1 / 6]  # 3 / 10 on average
    means = {reduce(lambda a, b: a + b, p) / 5 for p in permutations(ratios)}
    assert max(means) > 0.3  # some orders give a little more
    one = pf.profile_means(_features(spark, sf)).limit(1).drop("profile_id", "browse_ratio")
    rows = spark.createDataFrame([*enumerate(sorted(means)), (99, 0.3 + 1e-6)], "profile_id long, browse_ratio double").crossJoin(one)
    found = pf.patterns(rows).where(F.array_contains("patterns", "READING: often browses")).collect()
    assert [r.profile_id for r in found] == [99]


def test_reads_per_file_at_the_thresholds_as_sql(spark, tmp_path):
    """6 reads of 4 files and 11 of 10, in three sessions each: the means are thirds, their ratio 1.5 and a little under 1.1."""
    weeks = [(1, 0, [0, 0, 1]), (1, 1, [0, 0, 1]), (1, 2, []), (2, 0, [0, 0, 1, 2, 3]), (2, 1, [0, 1, 2]), (2, 2, [0, 1, 2])]
    rows = [(user, week, "view", k) for user, week, ks in weeks for k in ks] + [(user, week, "purchase", 1) for user, week, _ in weeks]
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    c.execute("CREATE TABLE given (i BIGINT, u BIGINT, week INT, kind VARCHAR, k INT)")
    c.executemany("INSERT INTO given VALUES (?, ?, ?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    c.execute("CREATE VIEW events AS SELECT i AS event_id, TIMESTAMP '2024-01-02 00:00:00' + to_days(7 * week) + to_seconds(i) AS ts, u AS user_id, kind AS event_type, 10.0::DOUBLE AS value, '{\"k\": ' || k || '}' AS props FROM given")
    c.execute(f"COPY (SELECT * FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    sql = dict(c.execute(plans.oracle_sql()["behaviour_patterns"]).fetchall())
    assert "READING: deep" not in sql and sql["READING: shallow"] == 1
    assert {r.pattern: r.n for r in plans.queries()["behaviour_patterns"](spark, str(tmp_path)).collect()} == sql
