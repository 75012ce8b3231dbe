"""The core method reads its trace once, and its passes take many groups at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import features as ft
from tracewell.operators import similarity as sm
from tracewell.plans import methods
from tracewell.plans.text_queries import _view


def test_tables_are_read_once(spark, sf):
    out = methods.METHODS["channels"](_view(spark, sf, content=True))
    assert out.inputFiles() and not [f for f in out.inputFiles() if "/root/testdata" in f]
    assert out.count() == out.select("profile_id").distinct().count() > 0


def nearest_merged(m, most):
    groups = [[i] for i in range(len(m))]
    while len(groups) > most:
        pairs = [(np.linalg.norm(m[a].mean(0) - m[b].mean(0)), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    return {k: c for c, g in enumerate(sorted(groups, key=lambda x: (-len(x), min(x)))) for k in g}


@pytest.mark.parametrize("size", [3, 10_000])
def test_clusters_of_many_groups(spark, size):
    rng = np.random.default_rng(5)
    rows = [(g if g else None, i, rng.random(3).tolist()) for g in range(9) for i in rng.permutation(1 + g).tolist()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)  # groups that begin in one batch and end in another
    try:
        got = {(r[0], r[1]): r[2] for r in sm.centroid_clusters(spark.createDataFrame(rows, "group int, id int, vector array<double>").coalesce(1)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g in {r[0] for r in rows}:
        members = sorted((r[1], r[2]) for r in rows if r[0] == g)
        labels = nearest_merged(np.array([v for _, v in members]), 3)
        want |= {(g, i): labels[k] for k, (i, _) in enumerate(members)}
    assert got == want


def test_samples_of_a_group_do_not_depend_on_others(spark):
    rows = [(g if g else None, t, kind, kinds, kinds * (5 + (g * 7 + t * 3 + k) % 11), 1.0 + t) for g in range(6) for t in range(1 + g) for kind in ("create", "minor_edit") for k, kinds in enumerate(("md", "csv")) if (g + t + k) % 3]
    files = spark.createDataFrame([*rows, (7, None, "create", "md", "lost", 1.0)], "group int, task_id int, kind string, file_type string, content string, importance double")
    pick = lambda df: {tuple(r) for r in sm.sample_contents(df, budget=60, least=10).collect()}
    alone = [pick(files.where(F.col("group").eqNullSafe(F.lit(g)))) for g in (None, 1, 2, 3, 4, 5, 7)]
    assert pick(files) == set().union(*alone) and all(alone[1:6]) and all(len(r) <= 60 for g in alone for *_, r in g)


def test_features_by_sets_are_the_same(spark, sf):
    trace = _view(spark, sf, content=True)
    one, two = (ft.trajectory_features(trace, sets=s) for s in (False, True))
    assert one.dtypes == two.dtypes
    places = [F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in one.dtypes]
    assert sorted(map(tuple, one.select(*places).collect())) == sorted(map(tuple, two.select(*places).collect()))
    assert "Expand" not in two._jdf.queryExecution().executedPlan().toString()
