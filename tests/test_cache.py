"""The ingest cache makes anew what has changed, and nothing else."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import storage
from tracewell.operators.cache import IngestCache, fingerprints

SCHEMA = "profile_id long, task_id int, event_id long, path string, value double"
ROWS = [(p, t, 100 * p + 10 * t + i, f"/f{i}", None if i == 1 else i / 2) for p in range(5) for t in range(2) for i in range(3)]


@pytest.fixture
def cache(spark):
    return IngestCache(spark, storage.scratch(spark, "cache"), "sums")


def ingest(spark, cache, rows):
    """(state by profile, profiles that were made)."""
    made = []

    def make(df):
        made.extend(sorted(r[0] for r in df.select("profile_id").distinct().collect()))
        return df.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    got = cache.ingest(spark.createDataFrame(rows, SCHEMA), make)
    return {r["profile_id"]: (r["n"], r["total"], r["run"]) for r in got.collect()}, made


def test_one_changed_session_makes_one_profile_anew(spark, cache):
    assert cache.load() is None
    first, made = ingest(spark, cache, ROWS)
    assert made == [0, 1, 2, 3, 4] and {r for _, _, r in first.values()} == {1}
    again, made = ingest(spark, cache, list(reversed(ROWS)))
    assert made == [] and again == first
    more = [*ROWS, (3, 1, 399, "/new", 7.0)]
    second, made = ingest(spark, cache, more)
    assert made == [3] and second == first | {3: (7, first[3][1] + 7.0, 3)}
    other = IngestCache(spark, storage.scratch(spark, "cache"), "sums")
    assert {k: v[:2] for k, v in ingest(spark, other, more)[0].items()} == {k: v[:2] for k, v in second.items()}
    third, made = ingest(spark, cache, [r for r in ROWS if r[0] != 1])  # profile 1 is gone, 3 is as it was first
    assert made == [3] and set(third) == {0, 2, 3, 4} and third[3][:2] == first[3][:2]


def test_a_run_that_fails_leaves_the_last_one(spark, cache):
    first, _ = ingest(spark, cache, ROWS)
    changed = [*ROWS, (2, 0, 299, "/x", 1.0)]

    def broken(df):
        raise OSError("no model today")

    with pytest.raises(OSError, match="no model"):
        cache.ingest(spark.createDataFrame(changed, SCHEMA), broken)
    assert {r["profile_id"]: (r["n"], r["total"], r["run"]) for r in cache.load().collect()} == first
    second, made = ingest(spark, cache, changed)
    assert made == [2] and second[2] == (7, first[2][1] + 1.0, 3)


def test_fingerprints_tell_rows_apart(spark):
    def of(rows):
        return {r[0]: r[1] for r in fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}.get(1)

    one, two, null = (1, 0, 1, "/a", 1.0), (1, 0, 2, "/a", 1.0), (1, 0, 1, None, None)
    prints = [of(x) for x in ([one], [one, one], [one, two], [two], [null], [one, null], [(1, 0, 1, "", None)])]
    assert len(set(prints)) == len(prints) and of([two, one]) == of([one, two]) and of([]) is None
