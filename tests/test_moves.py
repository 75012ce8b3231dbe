"""Births through moves, against the rows read one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import joins
from tracewell.operators import storage

SCHEMA = "profile_id long, event_id long, ts_ms long, event_type string, operation string, file_path string, target_file string"


def plain(rows):
    births, out = {}, []
    for profile, event, at, kind, operation, path, target in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if path is None:
            continue
        if kind == "file_write" and operation == "create":
            births[profile, path] = at
        elif kind == "file_delete":
            born = births.pop((profile, path), None)
            out.append((profile, event, path, None if born is None else at - born))
        elif kind == "file_move" and target is not None and (profile, path) in births:
            births[profile, target] = births.pop((profile, path))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_moves(spark, seed):
    rng = random.Random(seed)
    paths = [f"p{i}" for i in range(6)]
    rows = []
    for i in range(600):
        kind, operation = rng.choice([("file_write", "create"), ("file_write", "overwrite"), ("file_move", None), ("file_move", None), ("file_move", None), ("file_delete", None)])
        rows.append((rng.randrange(3), i, rng.randrange(300), kind, operation, rng.choice([*paths, None]), rng.choice([*paths, None]) if kind == "file_move" else None))
    got = joins.delete_ages(spark.createDataFrame(rows, SCHEMA).withColumns({"life": F.lit(1), "of": F.lit(2)}))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 300
    rows = [(1, 0, 0, "file_write", "create", "p0", None)] + [(1, i, i, "file_move", None, f"p{i - 1}", f"p{i}") for i in range(1, n)] + [(1, n, n, "file_delete", None, f"p{n - 1}", None), (1, n + 1, n + 1, "file_delete", None, "p0", None)]
    written = []
    monkeypatch.setattr(joins, "settled", lambda df, name: (written.append(name), storage.settled(df, name))[1])
    assert sorted(map(tuple, joins.delete_ages(spark.createDataFrame(rows, SCHEMA)).collect())) == [(1, n, f"p{n - 1}", n), (1, n + 1, "p0", None)]
    assert written.count("leads") <= 10 and written.count("births") <= 11  # 2 ** 9 > 300


def test_no_rows_and_no_moves(spark):
    assert joins.delete_ages(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 1, 5, "file_write", "create", "a", None), (1, 2, 9, "file_delete", None, "a", None), (1, 3, 11, "file_delete", None, "a", None)]
    assert sorted(map(tuple, joins.delete_ages(spark.createDataFrame(rows, SCHEMA)).collect())) == [(1, 2, "a", 4), (1, 3, "a", None)]
