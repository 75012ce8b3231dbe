"""Diffs between versions: what a worker holds, and texts that are missing."""

from tracewell.operators import parsing as ps


def test_workers_take_few_texts_at_once(spark):
    rows = spark.createDataFrame([(1, 0, i, "f", f"a\n{i}") for i in range(250)], "profile_id int, task_id int, seq int, file_path string, content string")
    out = ps.diffs(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "InPandas" not in plan and "Arrow" not in plan  # batches of 100 rows, not of 10,000
    assert [r["lines_modified"] for r in out.orderBy("seq").collect()] == [None] + [1] * 249


def test_missing_texts_and_paths(spark):
    texts = [None, None, "a", "", None, "a\nb", "a\nb"]
    rows = spark.createDataFrame([(1, 0, i, None, t) for i, t in enumerate(texts)], "profile_id int, task_id int, seq int, file_path string, content string")
    out = ps.diffs(rows).orderBy("seq").collect()
    assert [r["is_create"] for r in out] == [True] + [False] * 6
    assert [(r["lines_added"], r["lines_deleted"], r["lines_modified"], r["lines_modified_by_counts"]) for r in out] == [(None,) * 4, (None,) * 4, (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 0), (2, 0, 0, 0), (None,) * 4]
    assert out[2]["diff"].startswith("--- a/None\n+++ b/None\n") and out[4]["diff"] == "" and out[6]["diff"] is None
