"""Keyword search over the index of character runs, against every text held against every word."""

import random

import duckdb
import pytest

from tracewell import plans
from tracewell.operators import similarity as sm


def plain(texts, queries, k, sure=None):
    out = []
    for q, words in queries:
        scored = []
        for i, t in texts:
            if t is not None:
                hits = sum(w in t.lower() for w in words)
                if hits or sure:
                    scored.append((-(hits * 0.6 + sure[i] * 0.4 if sure else hits), i, hits))
        out += [(q, i, hits, r) for r, (_, i, hits) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("weighted", [False, True])
def test_same_as_every_text_against_every_word(spark, weighted):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abAB éx. ") for _ in range(n))
    texts = [(i, make(rng.randrange(40))) for i in range(80)] + [(80, None), (81, ""), (82, "ab" * 3000)]
    queries = [(q, [make(rng.randrange(1, 6)).lower() for _ in range(rng.randrange(1, 5))]) for q in range(25)]
    queries += [(30, ["zzz"]), (31, ["zzz", "abx"] * 2), (32, ["", "ab"]), (33, [""]), (34, []), (35, ["a", "é", "b."])]
    sure = {i: i % 7 / 7 for i, _ in texts}
    df = spark.createDataFrame([(i, t, sure[i]) for i, t in texts], "id long, text string, sure double")
    got = sm.keyword_hits(df, spark.createDataFrame(queries, "query_id int, words array<string>"), "text", 4, "sure" if weighted else None)
    assert sorted((r["query_id"], r["id"], r["hits"], r["rank"]) for r in got.collect()) == plain(texts, queries, 4, sure if weighted else None)


def test_no_texts_and_no_queries(spark):
    texts, queries = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1, ["a"])], "query_id int, words array<string>")
    assert sm.keyword_hits(texts, queries, "text").collect() == []
    assert sm.keyword_hits(texts, queries.limit(0), "text").collect() == []


def test_keywords_of_a_query(spark):
    df = spark.createDataFrame([("Read  a, WRITE, a,  b c, a", )], "t string")
    assert df.select(sm.keywords_of(df.t)).first()[0] == ["read", "a,", "write,", "b", "c,", "a"]
    assert df.select(sm.keywords_of(df.t, by_commas=True)).first()[0] == ["read  a", "write", "a", "b c"]


@pytest.mark.parametrize("few", [0, 10_000])
def test_found_words_by_rarest_run_or_one_by_one(few):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("ab éx.") for _ in range(n))
    texts, words = [make(rng.randrange(60)) for _ in range(70)] + [""], ["", "a", *{make(rng.randrange(1, 6)) for _ in range(60)}]
    assert [sorted(f) for f in sm._found(texts, words, few=few)] == [[j for j, w in enumerate(words) if w in t] for t in texts]


def test_blocks_of_texts_and_queries(spark, monkeypatch):
    """Many pairs of small blocks give the rows of one."""
    monkeypatch.setattr(sm, "CHARS", 500)
    monkeypatch.setattr(sm, "BLOCK", 7)
    test_same_as_every_text_against_every_word(spark, False)
    test_same_as_every_text_against_every_word(spark, True)


@pytest.mark.parametrize("short", [0, 3, 24])
def test_words_of_texts_by_their_parts(short):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("ab éx.\n ") for _ in range(n))
    texts, words = [make(rng.randrange(60)) for _ in range(70)] + ["", None, "ab" * 40], ["", " ", "a", "ab" * 20, *{make(rng.randrange(1, 6)) for _ in range(60)}]
    assert [sorted(f) for f in sm._contained(texts, words, short)] == [[j for j, w in enumerate(words) if t is not None and w in t] for t in texts]


def test_more_words_than_a_matrix_takes(spark, monkeypatch):
    monkeypatch.setattr(sm, "CELLS", 100)
    test_same_as_every_text_against_every_word(spark, False)
    test_same_as_every_text_against_every_word(spark, True)


@pytest.mark.parametrize("name", ["keyword_retrieval", "keyword_retrieval_by_commas", "keyword_retrieval_weighted"])
def test_every_item_asks_as_in_sql(spark, tmp_path, name):
    """All items of the benchmark are queries, not only some ids; null and empty texts among the documents."""
    c = duckdb.connect()
    c.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (1, 'Read a File, then'), (2, 'zzz qqq'), (50, 'the end.'), (77, 'a  note')) t(item_id, text)")
    c.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'A file to READ'), (2, ''), (3, 'zzz'), (5, 'the note ends'), (9, NULL), (19, NULL), (20, 'afile')) t(doc_id, text)")
    for t in ("benchmark", "documents"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    sql = c.execute(plans.oracle_sql()[name]).df()
    assert set(sql["query_id"]) == {1, 2, 50, 77}
    ours = plans.queries()[name](spark, str(tmp_path)).toPandas()
    order = ["query_id", "rank"]
    assert ours.sort_values(order)[list(sql)].values.tolist() == sql.sort_values(order).values.tolist()
