"""Scans of sessions in blocks against windows over whole sessions."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import joins as jn
from tracewell.operators import scans as sc
from tracewell.operators import sequences as sq

KEY = ["profile_id", "task_id"]
KINDS = ["file_read", "file_read", "file_write", "file_edit", "dir_create", "error_encounter", "file_search"]


@pytest.fixture(scope="module")
def rows(spark):
    """A session of 900 events, one of 7 and one of 1."""
    rng = random.Random(6)
    out = [(p, t, rng.randrange(10**6), i, rng.choice(KINDS), f"/f{rng.randrange(4)}") for p, t, n in ((1, 0, 900), (1, 1, 7), (2, 0, 1)) for i in range(n)]
    rng.shuffle(out)
    return spark.createDataFrame(out, "profile_id long, task_id int, ts_ms long, event_id long, event_type string, file_path string").cache()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(map(tuple, a.select(columns).collect()), key=str) == sorted(map(tuple, b.select(columns).collect()), key=str)


def test_as_windows(rows):
    wide = sc.placed(rows, KEY, ["ts_ms", "event_id"], size=16).cache()
    one = wide.drop("block")
    w = sq.W.partitionBy(*KEY).orderBy("ts_ms", "event_id")
    same(one, rows.withColumn("seq", F.row_number().over(w).cast("long")))
    assert wide.groupBy(*KEY, "block").count().agg(F.max("count")).first()[0] == 16
    same(sc.transitions(wide, KEY), sq.transitions(one).withColumn("seq", F.col("seq") + 1))
    same(sc.phases(wide, KEY, size=8), sq.phases(one))
    same(sc.context_switches(wide, KEY), sq.context_switches(one).withColumn("switch_count", F.col("switch_count").cast("long")))
    same(sc.running_number(wide, KEY, "file_edit").drop("block"), sq.running_number(one, "file_edit"))
    start, tool, failed = F.col("event_type") == "dir_create", F.col("event_type") == "file_write", F.col("event_type") == "error_encounter"
    same(sc.iterations(wide, KEY, start, tool, failed), sq.iterations(one, start, tool, failed))
    same(sc.recoveries(wide, KEY, failed, ~failed, F.col("file_path")), jn.recoveries(one, failed, ~failed, F.col("file_path")))


def test_blocks_that_a_filter_empties(spark):
    rows = spark.createDataFrame([(1, i, "file_read" if i in (3, 50, 51, 99) else "file_edit", f"/{i % 2}") for i in range(1, 101)], "s int, seq long, event_type string, file_path string")
    got = sc.context_switches(sc.blocks_of(rows, 4), ["s"]).collect()
    assert sorted((r["seq"], r["from_file"], r["to_file"], r["switch_count"]) for r in got) == [(50, "/1", "/0", 1), (51, "/0", "/1", 2)]
    late = sc.latest(sc.blocks_of(rows, 4), ["s"], F.when(F.col("event_type") == "file_read", F.col("seq")), "at").where("seq in (2, 49, 98, 100)").orderBy("seq").collect()
    assert [r["at"] for r in late] == [None, 3, 51, 99]


def test_no_rows(rows):
    none = sc.placed(rows.limit(0), KEY, ["ts_ms", "event_id"])
    assert sc.phases(none, KEY).collect() == sc.transitions(none, KEY).collect() == sc.context_switches(none, KEY).collect() == []
