"""Parsers by file type, embedders, questions and summaries, by hand."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import evaluation as ev
from tracewell.operators import parsing as ps
from tracewell.operators import rendering as rd
from tracewell.operators import similarity as sm
from tracewell.plans import methods
from tracewell.plans.text_queries import _view


def test_parsers_by_file_type(spark, monkeypatch):
    monkeypatch.setattr(ps, "_PARSERS", {})
    df = spark.createDataFrame([("csv", "a,b", "/x.csv"), ("TSV", "c", "/y.tsv"), ("md", "text", "/n.md"), ("png", None, "/d/p.png")], "kind string, content string, name string")
    shown = lambda: [r[0] for r in df.select(ps.parsed_content(F.col("kind"), F.col("content"), F.col("name"))).collect()]
    before = shown()
    ps.register_parser("csv", "tsv")(lambda content, name: F.concat(F.lit("table "), content))
    assert shown() == ["table a,b", "table c", *before[2:]]
    ps.register_parser("CSV")(lambda content, name: name)
    assert shown() == ["/x.csv", "table c", *before[2:]] and before[2:] == ["text", "[PNG: p.png]"]


@pytest.mark.parametrize("name", ["naive_rag", "visrag", "mma", "evermemos"])
def test_methods_take_an_embedder(spark, sf, name):
    asked = []

    def embed(texts, column):
        asked.append(column)
        return sm.embed(texts, column, size=8)

    trace = _view(spark, sf, content=True).where("profile_id < 2")
    assert methods.METHODS[name](trace, embed=embed).count() == 2 and asked


def test_rag_without_vectors_looks_for_parts_of_the_query(spark, sf):
    trace = _view(spark, sf).where("profile_id = 1")
    path = trace.where("event_type = 'file_read'").orderBy("task_id", "seq").first()["file_path"].rpartition("/")[2]
    prompt = methods.METHODS["naive_rag"](trace, query=f"zzz, {path.upper()}", k=1, embed=None).first()["prompt"]
    assert path in prompt


def test_distractors_are_near_different_and_drawn(spark):
    df = spark.createDataFrame([(f"q{i}", i) for i in range(40)], "question_id string, answer long")
    rows = ev.choices(df).collect()
    for r in rows:
        assert len(set(r["options"])) == 4 and r["options"]["ABCD".index(r["correct"])] == r["answer"]
        assert all(x >= 0 and abs(x - r["answer"]) in (0, 1, 2, 3, 5) for x in r["options"])
    assert {r["correct"] for r in rows} == set("ABCD")
    assert {x - r["answer"] for r in rows for x in r["options"]} == {0, 1, -1, 2, -2, 3, -3, 5}
    assert ev.choices(df, seed="7").collect() != rows


def test_question_sets_keep_to_both_limits(spark):
    df = spark.createDataFrame([(1, t, f"q{i}") for t in (1, 2, 3, 4, 5, None) for i in range(6)] + [(2, 1, "q0")], "profile_id long, task_id int, question string")
    rows = ev.question_set(df, 2, 9).collect()
    of = lambda t: sum(r["profile_id"] == 1 and r["task_id"] == t for r in rows)
    assert sorted(r["place"] for r in rows if r["profile_id"] == 1) == list(range(1, 10)) and all(of(t) <= 2 for t in range(1, 6))
    assert [r["place"] for r in rows if r["profile_id"] == 2] == [1]


def test_a_rich_summary(spark):
    features = spark.createDataFrame([(1, 2, 5, 0.25), (1, 1, None, None)], "profile_id long, task_id int, total_reads long, revisit_ratio double")
    files = spark.createDataFrame([(1, 1, i, f"/d/f{i}.md", "one\ntwo " if i else None) for i in range(5)], "profile_id long, task_id int, seq long, file_path string, preview string")
    patterns = spark.createDataFrame([(1, ["reads first", "edits little"])], "profile_id long, patterns array<string>")
    entries = spark.createDataFrame([(1, 2, ["/new"]), (1, 1, [])], "profile_id long, task_id int, entries array<string>")
    assert rd.rich_summary(features, files, patterns, entries).collect()[0]["text"] == "\n".join((
        "## Session 1", "  Reading: reads 0, revisit ratio 0.000", "  Created: f0.md, f1.md, f2.md, f3.md, f4.md", "  Start of f1.md: one two...", "  Start of f2.md: one two...", "",
        "## Session 2", "  Reading: reads 5, revisit ratio 0.250", "  New: /new", "", "## Patterns across sessions", "  - reads first", "  - edits little",
    ))


def test_votes_against_the_truth(spark):
    ratings = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 1), (2, "b", 1), (3, "a", 0)], "item int, rater string, label int")
    assert tuple(ev.vote_accuracy(ratings, spark.createDataFrame([(1, 0), (2, 0), (9, 1)], "item int, label int")).first()) == (0.5, 2)
