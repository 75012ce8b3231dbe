import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm.common import read

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = read(spark, SF, "documents")
    n, ids = docs.count(), {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert 0 < out.count() <= n
        n = out.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()} <= ids


def test_planted_cases(docs_of, spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    bench = " ".join(f"b{i}" for i in range(12))
    texts = [" ".join(words), " ".join([*words[:59], "z"]), "mail me@x.org " + " ".join(words[::-1]), " ".join(f"c{i}" for i in range(30)) + " " + bench]
    docs = docs_of(texts)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    got = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == {0, 2, 3}
    assert got[2].startswith("mail [EMAIL] ") and "b1 " not in got[3] and got[0] == texts[0]


CLASHES = ("_text", "_base", "_more", "_found", "_seen", "_spans", "_email", "_row", "_new", "_changed", "_hit_of", "_hit_spans", "_hit_items", "_hit_spans_", "spans", "n_words", "items", "rep", "root", "sig", "kept", "component_id", "score", "toxic", "_RANK", "length", "row", "text_crc32")


@pytest.fixture(scope="module")
def models(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (1, 1, 0), (6, 0, 1), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages_keep_awkward_rows_and_any_columns(spark, docs_of, awkward, models, name, stage):
    """Every column that a caller may bring comes back as it was, and changes nothing in the rows."""
    rows = [*awkward, (11, "write to a.b@x.org or one two"), (12, "one two")]
    plain = docs_of(rows)
    marked = plain.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASHES})
    want = sorted(map(tuple, stage(spark, plain, models).collect()), key=str)
    got = stage(spark, marked, models)
    assert got.columns == marked.columns and got.dtypes == marked.dtypes
    got = got.collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    assert all(tuple(r)[5:] == tuple(f"{c}:{'?' if r.doc_id is None else r.doc_id}" for c in CLASHES) for r in got)
    # which rows stay, and with what text
    kept = sorted(((r.doc_id, r.text) for r in got), key=str)
    same = [(i, t) for i, t in rows if not (name == "decontamination" and i in (3, 12))]
    if name == "pii":
        same = [(i, (t or "").replace("a.b@x.org", "[EMAIL]") if t else t) for i, t in same]
    if name == "decontamination":
        same = [(i, t.replace("one two", "") if t else t) for i, t in same]
    if name == "near_duplicates":
        same = [(i, t) for i, t in same if i != 12]
    assert kept == sorted(same, key=str)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(spark, docs_of, models, name, stage):
    docs = docs_of([])
    out = stage(spark, docs, models)
    assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


def test_packing_takes_any_columns(spark, docs_of, awkward, models):
    plain, stage = docs_of(awkward), corpus_pipeline.STAGES[-1][1]
    marked = plain.withColumns({c: F.lit("x") for c in CLASHES})
    one, two = (stage(spark, d, models) for d in (plain, marked))
    parts = lambda df: sorted(tuple(r) for r in df.select(F.coalesce("doc_id", F.lit(-1)), "piece", "start", "length", "ids_crc32").collect())
    assert parts(one) == parts(two) and len(parts(one)) >= len(awkward)
