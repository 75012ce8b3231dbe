"""Queries for joins, retrieval, neighbour graphs, text operators and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import evaluation as ev
from tracewell.operators import features as ft
from tracewell.operators import joins as jn
from tracewell.operators import profiles as pf
from tracewell.operators import pruning
from tracewell.operators import sequences as sq
from tracewell.operators import similarity as sm
from tracewell.operators import storage as st
from tracewell.plans.trace_queries import COPIES, DELETE_AGES, FEATURES, TIERS, TRACE, _features, events, rounded
from tracewell.sources.traces import KEY, behavioural, with_targets

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# joins over the trace


@query(COPIES)
def copy_detection(spark: SparkSession, sf: str) -> DataFrame:
    return jn.copies(events(spark, sf), clock=10_000)


@query("WITH " + TRACE + ", t AS (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY profile_id, task_id ORDER BY seq), '') AS prev FROM tr), e AS (SELECT *, CASE WHEN event_type = 'error_encounter' THEN prev ELSE event_type END AS tool FROM t), p AS (SELECT *, max(CASE WHEN event_type = 'error_encounter' THEN seq END) OVER (PARTITION BY profile_id, task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pending FROM e), r AS (SELECT * FROM p WHERE event_type <> 'error_encounter' AND pending IS NOT NULL QUALIFY row_number() OVER (PARTITION BY profile_id, task_id, pending ORDER BY seq) = 1) SELECT r.profile_id, r.task_id, r.pending AS error_seq, r.seq, CASE WHEN x.tool = r.tool THEN 'retry' ELSE 'rethink' END AS strategy, r.ts_ms - x.ts_ms AS latency_ms FROM r JOIN e x ON x.profile_id = r.profile_id AND x.task_id = r.task_id AND x.seq = r.pending")
def error_recovery(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W

    t = events(spark, sf)
    error = F.col("event_type") == "error_encounter"
    before = F.coalesce(F.lag("event_type").over(W.partitionBy(*KEY).orderBy("seq")), F.lit(""))
    t = t.withColumn("tool_name", F.when(error, before).otherwise(F.col("event_type")))
    return long(jn.recoveries(t, error, ~error, F.col("tool_name")), "error_seq", "seq")


@query(DELETE_AGES)
def delete_ages(spark: SparkSession, sf: str) -> DataFrame:
    return jn.delete_ages(with_targets(events(spark, sf)))


@query("WITH " + TRACE + ", a AS (SELECT profile_id, event_id, event_type, file_path, ts_ms, ts_ms // 1000000 AS now, lead(event_type) OVER w AS ne, lead(ts_ms // 1000000) OVER w AS nn FROM tr WHERE event_type IN ('file_delete', 'file_write') WINDOW w AS (PARTITION BY profile_id, file_path ORDER BY ts_ms, event_id)) SELECT profile_id, event_id, file_path, ts_ms FROM a WHERE event_type = 'file_delete' AND NOT coalesce(ne = 'file_write' AND nn - now <= 500, false)")
def settled_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return jn.settled_deletes(events(spark, sf), clock=1_000_000)


@query("WITH " + TRACE + ", d AS (SELECT DISTINCT profile_id, task_id FROM tr), n AS (SELECT *, dense_rank() OVER (PARTITION BY profile_id ORDER BY task_id) AS r FROM d) SELECT profile_id, count(*) AS n FROM tr JOIN n USING (profile_id, task_id) WHERE r <= 3 GROUP BY profile_id")
def first_three_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return jn.first_tasks(events(spark, sf), 3).groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + TRACE + ", s AS (SELECT DISTINCT profile_id, task_id FROM tr WHERE event_type = 'error_encounter') SELECT t.profile_id, t.task_id, count(*) AS n FROM tr t ANTI JOIN s USING (profile_id, task_id) GROUP BY ALL")
def unfinished_sessions(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf)
    done = t.where(F.col("event_type") == "error_encounter")
    return jn.not_yet(t, done, list(KEY)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + TIERS + ", v AS (SELECT \"A\" || \"B\" || \"C\" || \"D\" || \"E\" || \"F\" AS tiers, count(*) AS n FROM t GROUP BY 1) SELECT x.tiers AS a, y.tiers AS b, x.n AS profiles_a, y.n AS profiles_b, len(list_filter(range(1, 7), lambda i: x.tiers[i] <> y.tiers[i])) AS differing FROM v x JOIN v y ON x.tiers < y.tiers")
def profile_distances(spark: SparkSession, sf: str) -> DataFrame:
    return pf.class_distances(pf.tiers(pf.profile_means(_features(spark, sf))))


@query("WITH " + TRACE + ", e AS (SELECT event_type AS src, file_type AS dst, operation AS relation FROM tr WHERE operation IS NOT NULL), n AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT relation) FROM e) AS relations, (SELECT count(DISTINCT node) FROM n) AS nodes")
def entity_graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf).where(F.col("operation").isNotNull())
    return pf.graph_stats(t.select(F.col("event_type").alias("src"), F.col("file_type").alias("dst"), F.col("operation").alias("relation")))


@query("WITH " + TRACE + ", e AS (SELECT profile_id, CAST(profile_id AS VARCHAR) AS src, file_path AS dst FROM tr WHERE file_path IS NOT NULL), n AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) SELECT node, count(*) AS degree FROM n GROUP BY node ORDER BY degree DESC, node LIMIT 10")
def top_degrees(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf).where(F.col("file_path").isNotNull())
    return pf.degrees(t.select(F.col("profile_id").cast("string").alias("src"), F.col("file_path").alias("dst")))


@query("WITH " + TRACE + ", c AS (SELECT profile_id, event_type, count(DISTINCT task_id) AS n FROM b GROUP BY ALL) SELECT profile_id, event_type, n, CASE WHEN n >= 3 THEN 'high' WHEN n = 2 THEN 'medium' ELSE 'low' END AS confidence, count(*) OVER (PARTITION BY profile_id) - 1 AS contradictions FROM c QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, event_type) = 1")
def pattern_evidence(spark: SparkSession, sf: str) -> DataFrame:
    counts = behavioural(events(spark, sf)).groupBy("profile_id", "event_type").agg(F.count_distinct("task_id").alias("n"))
    return pf.evidence(counts, ["profile_id"], "event_type")


# vectors


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").alias("vector"))


SIM_SQL = "list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))"


@query(f"WITH s AS (SELECT y.vec_id AS query_id, x.vec_id AS id, {SIM_SQL} AS similarity FROM embeddings x JOIN embeddings y ON y.vec_id % 50 = 0 AND x.vec_id <> y.vec_id) SELECT query_id, id, round(similarity, 3) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 5")
def topk_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    out = sm.top_chunks(v, v.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "vector"))
    return long(rounded(out.select("query_id", "id", "similarity", "rank"), "similarity", places=3), "rank")


@query(f"WITH s AS (SELECT y.vec_id AS query_id, x.vec_id AS id, x.label / 10.0 AS confidence, {SIM_SQL} AS similarity FROM embeddings x JOIN embeddings y ON y.vec_id % 50 = 0 AND x.vec_id <> y.vec_id), a AS (SELECT *, 0.6 * similarity + 0.4 * confidence AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) <= 24) SELECT query_id, id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM a QUALIFY rank <= 8")
def two_stage_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    scored = sm.top_chunks(v, v.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "vector"), k=24)
    scored = scored.join(v.select("id", (F.col("group") / 10.0).alias("confidence")), "id")
    return long(rounded(sm.two_stage(scored, "confidence").select("query_id", "id", "score", "rank"), "score"), "rank")


KNN = f"WITH p AS (SELECT x.label AS grp, x.vec_id AS id, y.vec_id AS other, {SIM_SQL} AS similarity FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id), k AS (SELECT * FROM p WHERE similarity > 0.3 QUALIFY row_number() OVER (PARTITION BY grp, id ORDER BY similarity DESC, other) <= 5)"


@query(KNN + " SELECT grp AS \"group\", id, other, round(similarity, 4) AS similarity, row_number() OVER (PARTITION BY grp, id ORDER BY similarity DESC, other) AS rank FROM k")
def knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    return long(rounded(sm.neighbours(_vectors(spark, sf)), "similarity"), "rank")


@query(KNN + " SELECT grp AS \"group\", id, other, round(similarity, 4) AS similarity, row_number() OVER (PARTITION BY grp, id ORDER BY similarity DESC, other) AS rank FROM k")
def knn_graph_by_pivots(spark: SparkSession, sf: str) -> DataFrame:
    return long(rounded(pruning.neighbours(_vectors(spark, sf)), "similarity"), "rank")


@query(KNN + """, i AS (SELECT vec_id AS id, label / 10.0 AS source, power(0.5, (count(*) OVER () - row_number() OVER (ORDER BY vec_id)) / 200) AS time FROM embeddings),
 c1 AS (SELECT i.id, greatest(0, least(1, 0.4 * source + 0.3 * time + 0.3 * coalesce(n.cons, 0))) AS c FROM i LEFT JOIN (SELECT id, greatest(-1, least(1, sum(similarity * 0.5 * similarity) / nullif(sum(similarity), 0))) AS cons FROM k GROUP BY id) n USING (id)),
 c2 AS (SELECT i.id, greatest(0, least(1, 0.4 * source + 0.3 * time + 0.3 * coalesce(n.cons, 0))) AS c FROM i LEFT JOIN (SELECT k.id, greatest(-1, least(1, sum(similarity * c1.c * similarity) / nullif(sum(similarity), 0))) AS cons FROM k JOIN c1 ON c1.id = k.other GROUP BY k.id) n USING (id))
 SELECT id, round(c, 4) AS confidence FROM c2""")
def knn_confidence(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    n = v.count()
    order = _ranked(v.select("id", "group"))
    items = order.select("id", (F.col("group") / 10.0).alias("source"), F.pow(F.lit(0.5), (F.lit(n) - F.col("_r")) / 200).alias("time"))
    return rounded(sm.propagate_confidence(items, sm.neighbours(v)).select("id", "confidence"), "confidence")


def _ranked(df: DataFrame) -> DataFrame:
    """Rank by id over the whole table without one task ordering it: ranks within ranges of ids, plus the counts of lower ranges."""
    from pyspark.sql import Window as W

    rows = df.withColumn("_range", F.floor(F.col("id") / 1024))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return rows.join(first, "_range").withColumn("_r", F.col("_first") + F.row_number().over(W.partitionBy("_range").orderBy("id"))).drop("_range", "_first")


@query("SELECT vec_id AS id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm, round(1.0, 4) AS unit FROM embeddings")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return rounded(v.select("id", sm.norm(F.col("vector")).alias("norm"), sm.norm(sm.normalised(F.col("vector"))).alias("unit")), "norm", "unit")


@query(None)
def leader_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return sm.leader_clusters(_vectors(spark, sf))


@query(None)
def linkage_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return sm.linkage_clusters(_vectors(spark, sf))


@query(None)
def session_clusters(spark: SparkSession, sf: str) -> DataFrame:
    fp = pf.fingerprint(_features(spark, sf))
    return sm.centroid_clusters(fp.select(F.col("profile_id").alias("group"), F.col("task_id").alias("id"), F.col("fingerprint").alias("vector")))


# texts


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("WITH q AS (SELECT item_id AS query_id, string_split_regex(lower(text), '[^a-z]+') AS words FROM benchmark), s AS (SELECT query_id, doc_id AS id, len(list_filter(words, lambda w: contains(lower(text), w))) AS hits FROM documents, q) SELECT query_id, id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank FROM s WHERE hits > 0 QUALIFY rank <= 5")
def keyword_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf}/benchmark.parquet")
    asked = asked.select(F.col("item_id").alias("query_id"), F.split(F.lower("text"), "[^a-z]+").alias("words"))
    return long(sm.keyword_hits(_docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), asked, "text"), "hits", "rank")


@query("WITH q AS (SELECT item_id AS query_id, list_transform(list_distinct(string_split(replace(lower(text), ' ', ',  '), ', ')), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS words FROM benchmark), s AS (SELECT query_id, doc_id AS id, len(list_filter(words, lambda w: contains(lower(text), w))) AS hits FROM documents, q) SELECT query_id, id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank FROM s WHERE hits > 0 QUALIFY rank <= 5")
def keyword_retrieval_by_commas(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf}/benchmark.parquet")
    asked = asked.select(F.col("item_id").alias("query_id"), sm.keywords_of(F.replace("text", F.lit(" "), F.lit(",  ")), by_commas=True).alias("words"))
    return long(sm.keyword_hits(_docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), asked, "text"), "hits", "rank")


@query("WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS words FROM benchmark), s AS (SELECT query_id, doc_id AS id, len(list_filter(words, lambda w: contains(lower(text), w))) AS hits, doc_id % 10 / 10.0::DOUBLE AS sure FROM documents, q), c AS (SELECT *, hits * 0.6::DOUBLE + sure * 0.4::DOUBLE AS combined FROM s) SELECT query_id, id, hits, round(combined, 4) AS combined, row_number() OVER (PARTITION BY query_id ORDER BY c.combined DESC, id) AS rank FROM c QUALIFY rank <= 5")
def keyword_retrieval_weighted(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), sm.keywords_of(F.col("text")).alias("words"))
    texts = _docs(spark, sf).select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 10 / 10.0).alias("sure"))
    return long(rounded(sm.keyword_hits(texts, asked, "text", confidence="sure"), "combined"), "hits", "rank")


@query("WITH c AS (SELECT doc_id, text, unnest(range(0, greatest((length(text) - 1) // 800, 0) + 1)) AS chunk_no FROM documents), s AS (SELECT doc_id, chunk_no, regexp_replace(substr(text, chunk_no * 800 + 1, 800), '^\\s+|\\s+$', '', 'g') AS chunk FROM c) SELECT doc_id, chunk_no, length(chunk) AS n, md5(chunk) AS digest FROM s WHERE length(chunk) >= 50")
def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    out = sq.text_chunks(_docs(spark, sf), "doc_id", "text")
    return out.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("n"), F.md5("chunk").alias("digest"))


@query("WITH a AS (SELECT source, doc_id, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT source, doc_id, length(substr(text, 1, CAST(20000 - before AS BIGINT))) AS n FROM a WHERE before < 20000")
def prompt_budget(spark: SparkSession, sf: str) -> DataFrame:
    out = sq.within_budget(_docs(spark, sf).select("source", "doc_id", "text"), ["source"], ["doc_id"], "text", budget=20_000)
    return out.select("source", "doc_id", F.length("text").cast("long").alias("n"))


@query("WITH a AS (SELECT source, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 30000 AS batch FROM documents) SELECT source, CAST(batch AS BIGINT) AS batch, count(*) AS n FROM a GROUP BY ALL")
def narrative_batches(spark: SparkSession, sf: str) -> DataFrame:
    out = sq.batches_of(_docs(spark, sf).select("source", "doc_id", "text"), ["source"], ["doc_id"], "text", 30_000)
    return out.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("WITH h AS (SELECT substr(sha256(text), 1, 16) AS hash, doc_id FROM documents) SELECT hash, count(*) AS \"references\", min(doc_id) AS first_doc FROM h GROUP BY hash")
def content_store(spark: SparkSession, sf: str) -> DataFrame:
    return st.store(_docs(spark, sf).select("doc_id", F.col("text").alias("content")), [], "doc_id").select("hash", "references", F.col("first").alias("first_doc"))


@query("WITH h AS (SELECT substr(sha256(text), 1, 16) AS hash, count(*) AS n, max(strlen(text)) AS size FROM documents GROUP BY 1) SELECT count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(n - 1) AS BIGINT) AS saved FROM h")
def content_store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return st.stats(st.store(_docs(spark, sf).select("doc_id", F.col("text").alias("content")), [], "doc_id"))


@query("SELECT source, count(*) FILTER (regexp_matches(text, '[一-鿿]')) AS cjk, count(*) AS n FROM documents GROUP BY source")
def cjk_by_source(spark: SparkSession, sf: str) -> DataFrame:
    from tracewell.functions.paths import has_cjk

    return _docs(spark, sf).groupBy("source").agg(F.count_if(has_cjk(F.col("text"))).alias("cjk"), F.count(F.lit(1)).alias("n"))


@query("WITH " + TRACE + ", n AS (SELECT count(*) AS n FROM documents), c AS (SELECT tr.profile_id, tr.task_id, d.text FROM tr, n JOIN documents d ON d.doc_id = tr.event_id % n.n WHERE operation = 'create') SELECT profile_id, task_id, CAST(sum(len(regexp_extract_all(text, '(?m)^\\|.*\\|'))) AS BIGINT) AS table_rows, CAST(sum(len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))) AS BIGINT) AS words FROM c WHERE text <> '' GROUP BY ALL")
def tone_features(spark: SparkSession, sf: str) -> DataFrame:
    return ft.tone(events(spark, sf, content=True)).select(*KEY, "table_rows", "words")


# conversations


@query("WITH t AS (SELECT conv_id, turn, role, length(text) // 4 AS tokens FROM conversations), u AS (SELECT *, sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS users FROM t), p AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS total FROM u WHERE users >= 2), o AS (SELECT * FROM p WHERE total > 100), s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS saved FROM o) SELECT conv_id, turn, tokens, CAST(saved AS BIGINT) AS saved FROM s WHERE saved > 50")
def pruning_candidates(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = sq.pruning_candidates(turns, "conv_id", "turn", "role", F.floor(F.length("text") / 4), protect=100, least=50)
    return out.select("conv_id", "turn", F.col("tokens").cast("long").alias("tokens"), "saved")


@query("SELECT role, count(*) AS calls, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def prompt_costs(spark: SparkSession, sf: str) -> DataFrame:
    return st.costs(spark.read.parquet(f"{sf}/conversations.parquet"), "role", "text")


# evaluation

SCORES = "WITH s AS (SELECT event_type AS method, user_id AS profile_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 AS attr, CAST(floor(value) AS INT) % 6 AS score FROM events)"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.col("event_type").alias("method"), F.col("user_id").alias("profile_id"), (F.regexp_extract("props", r"(\d+)", 1).cast("int") % 5).alias("attr"), (F.floor("value").cast("int") % 6).alias("score"))


@query(SCORES + " SELECT method, profile_id, round(avg(score) FILTER (score > 0), 4) AS overall FROM s GROUP BY ALL")
def overall_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.overall(_scores(spark, sf), ["method", "profile_id"]), "overall")


@query(SCORES + " SELECT method, attr, round(avg(score), 4) AS mean, median(score) AS median, round(coalesce(stddev_samp(score), 0), 4) AS std, min(score) AS min, max(score) AS max, count(score) AS n FROM s GROUP BY ALL")
def method_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.method_summary(_scores(spark, sf)), "mean", "std")


@query(SCORES + ", m AS (SELECT method, attr, avg(score) AS mean FROM s GROUP BY ALL), o AS (SELECT method, avg(mean) AS overall FROM m GROUP BY method) SELECT method, round(overall, 4) AS overall, row_number() OVER (ORDER BY overall DESC, method) AS rank FROM o")
def method_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return long(rounded(ev.ranking(_scores(spark, sf)), "overall"), "rank")


@query(SCORES + ", m AS (SELECT method, attr, avg(score) AS mean FROM s GROUP BY ALL) SELECT method, " + ", ".join(f"round(max(mean) FILTER (attr = {i}), 4) AS a{i}" for i in range(5)) + ", round(avg(mean), 4) AS overall FROM m GROUP BY method")
def comparison_table(spark: SparkSession, sf: str) -> DataFrame:
    out = ev.comparison(_scores(spark, sf), [0, 1, 2, 3, 4]).withColumnsRenamed({str(i): f"a{i}" for i in range(5)})
    return rounded(out, *(f"a{i}" for i in range(5)), "overall")


@query(SCORES + ", g AS (SELECT unnest([0, 1, 2, 3, 4]) AS attr, unnest(['x', 'x', 'y', 'y', 'z']) AS channel), mp AS (SELECT DISTINCT method, profile_id FROM s), f AS (SELECT mp.method, g.channel, coalesce(s.score, 0) AS score FROM mp CROSS JOIN g LEFT JOIN s ON s.method = mp.method AND s.profile_id = mp.profile_id AND s.attr = g.attr) SELECT method, channel, round(avg(score), 4) AS mean FROM f GROUP BY ALL")
def channel_means(spark: SparkSession, sf: str) -> DataFrame:
    groups = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, "y"), (4, "z")], "attr int, channel string")
    return rounded(ev.group_means(_scores(spark, sf), groups), "mean")


@query("WITH s AS (SELECT event_type AS method, user_id AS profile_id, [1, 3, 5][CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3 + 1] AS n, CAST(floor(value) AS INT) % 6 AS score FROM events), p AS (SELECT method, n, profile_id, avg(score) FILTER (score > 0) AS s FROM s GROUP BY ALL) SELECT method, n, round(avg(s), 4) AS mean, count(*) AS profiles FROM p WHERE s > 0 GROUP BY ALL")
def learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    rows = e.select(F.col("event_type").alias("method"), F.col("user_id").alias("profile_id"), F.element_at(F.array(F.lit(1), F.lit(3), F.lit(5)), k % 3 + 1).alias("n"), (F.floor("value").cast("int") % 6).alias("score"))
    return rounded(ev.learning_curve(rows), "mean")


TIER_PAIRS = "WITH p AS (SELECT user_id % 6 AS dim, ['L', 'M', 'R', '?'][CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 + 1] AS truth, ['L', 'M', 'R'][CAST(floor(value) AS INT) % 3 + 1] AS predicted FROM events)"


def _tier_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i + 1)
    return e.select((F.col("user_id") % 6).alias("dim"), pick("LMR?", k % 4).alias("truth"), pick("LMR", F.floor("value").cast("int") % 3).alias("predicted"))


@query(TIER_PAIRS + " SELECT dim, round(avg(CAST(truth = predicted AS INT)), 4) AS accuracy, count(*) AS n FROM p WHERE truth <> '?' GROUP BY dim")
def tier_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.accuracy(_tier_pairs(spark, sf), ["dim"]), "accuracy")


@query(TIER_PAIRS + " SELECT round(avg(CAST(truth = predicted AS INT)), 4) AS accuracy, count(*) AS n FROM p WHERE truth <> '?'")
def pooled_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.accuracy(_tier_pairs(spark, sf), []), "accuracy")


@query(TIER_PAIRS + " SELECT truth, count(*) FILTER (predicted = 'L') AS \"L\", count(*) FILTER (predicted = 'M') AS \"M\", count(*) FILTER (predicted = 'R') AS \"R\" FROM p WHERE truth <> '?' GROUP BY truth")
def tier_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion(_tier_pairs(spark, sf).where(F.col("truth") != "?"), list("LMR"))


@query("WITH a AS (SELECT count(*) AS n, avg(CAST(quality = toxic AS INT)) AS po, avg(CAST(quality = 0 AS INT)) * avg(CAST(toxic = 0 AS INT)) + avg(CAST(quality = 1 AS INT)) * avg(CAST(toxic = 1 AS INT)) AS pe FROM labels) SELECT n, round(po, 4) AS po, round(pe, 4) AS pe, round((po - pe) / (1 - pe), 4) AS kappa FROM a")
def cohens_kappa(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("quality").alias("one"), F.col("toxic").alias("two"))
    return rounded(ev.cohens_kappa(pairs, [0, 1]), "po", "pe", "kappa")


RATINGS = "WITH r AS (SELECT doc_id AS item, 'a' AS rater, quality AS label FROM labels UNION ALL SELECT doc_id, 'b', toxic FROM labels UNION ALL SELECT doc_id, 'c', CAST(doc_id % 2 AS INT) FROM labels WHERE doc_id % 5 <> 0)"


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.read.parquet(f"{sf}/labels.parquet")
    rate = lambda name, label, df=x: df.select(F.col("doc_id").alias("item"), F.lit(name).alias("rater"), label.cast("int").alias("label"))
    return rate("a", F.col("quality")).union(rate("b", F.col("toxic"))).union(rate("c", F.col("doc_id") % 2, x.where(F.col("doc_id") % 5 != 0)))


@query(RATINGS + ", f AS (SELECT item FROM r GROUP BY item HAVING count(DISTINCT rater) = 3), c AS (SELECT item, label, count(*) AS n FROM r WHERE item IN (SELECT item FROM f) GROUP BY ALL), i AS (SELECT item, (sum(n * n) - 3) / 6 AS p FROM c GROUP BY item), t AS (SELECT count(*) AS items, avg(p) AS po FROM i), e AS (SELECT sum(power(n / (items * 3), 2)) AS pe FROM (SELECT label, sum(n) AS n FROM c GROUP BY label), t) SELECT items, round(po, 4) AS po, round(pe, 4) AS pe, round((po - pe) / (1 - pe), 4) AS kappa FROM t, e")
def fleiss_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.fleiss_kappa(_ratings(spark, sf), 3), "po", "pe", "kappa")


@query(RATINGS + ", c AS (SELECT item, label, count(*) AS n, min(rater) AS fr FROM r GROUP BY ALL) SELECT item, label, n FROM c QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC, fr, label) = 1")
def majority_votes(spark: SparkSession, sf: str) -> DataFrame:
    return ev.majority(_ratings(spark, sf))


@query(RATINGS + ", c AS (SELECT item, label, count(*) AS n, min(rater) AS fr FROM r GROUP BY ALL), v AS (SELECT item, label FROM c QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC, fr, label) = 1) SELECT round(avg(CAST(v.label = l.quality AS INT)), 4) AS accuracy, count(*) AS n FROM v JOIN labels l ON l.doc_id = v.item")
def vote_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    truth = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("item"), F.col("quality").alias("label"))
    return rounded(ev.vote_accuracy(_ratings(spark, sf), truth), "accuracy")


@query(RATINGS + " SELECT item AS profile_id FROM r GROUP BY item HAVING count(DISTINCT rater) = (SELECT count(DISTINCT rater) FROM r)")
def rated_by_all(spark: SparkSession, sf: str) -> DataFrame:
    return jn.rated_by_all(_ratings(spark, sf).withColumnRenamed("item", "profile_id"))


FACTS = "WITH " + FEATURES + ", x AS (SELECT f.*, a.first_action FROM f LEFT JOIN (SELECT profile_id, task_id, arg_min(event_type, seq) AS first_action FROM b GROUP BY ALL) a USING (profile_id, task_id)), q AS (" + " UNION ALL ".join((
    "SELECT profile_id, task_id, 'reads' AS question, 'reading_strategy' AS category, CAST(unique_files_read AS VARCHAR) AS answer FROM x WHERE unique_files_read >= 2",
    "SELECT profile_id, task_id, 'first_action', 'reading_strategy', first_action FROM x WHERE first_action IN ('file_read', 'file_browse', 'file_search', 'file_write', 'dir_create', 'file_edit')",
    "SELECT profile_id, task_id, 'dirs', 'directory_style', CAST(dirs_created AS VARCHAR) FROM x WHERE dirs_created >= 1",
    "SELECT profile_id, task_id, 'depth', 'directory_style', CAST(max_dir_depth AS VARCHAR) FROM x WHERE dirs_created >= 1",
    "SELECT profile_id, task_id, 'creates', 'output_detail', CAST(files_created AS VARCHAR) FROM x WHERE files_created >= 1",
    "SELECT profile_id, task_id, 'edits', 'edit_strategy', CAST(total_edits AS VARCHAR) FROM x WHERE total_edits >= 1",
    "SELECT profile_id, task_id, 'edit_size', 'edit_strategy', CASE WHEN avg_lines_changed < 5 THEN 'small' WHEN avg_lines_changed < 20 THEN 'medium' ELSE 'large' END FROM x WHERE total_edits >= 1",
    "SELECT profile_id, task_id, 'search_or_browse', 'reading_strategy', CASE WHEN total_searches > total_browses THEN 'search' WHEN total_searches < total_browses THEN 'browse' ELSE 'equal' END FROM x WHERE total_searches + total_browses >= 1",
    "SELECT profile_id, task_id, 'backups', 'version_strategy', CASE WHEN backup_copies > 0 THEN 'yes' ELSE 'no' END FROM x WHERE total_copies + total_overwrites >= 1",
)) + ") SELECT * FROM q"


@query(FACTS)
def question_facts(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf)
    return ev.facts(ft.trajectory_features(t), sq.first_action(behavioural(t)))


@query("WITH " + TRACE + ", m AS (SELECT profile_id, task_id, min(ts_ms) FILTER (event_type = 'file_read') AS r, min(ts_ms) FILTER (event_type = 'file_write') AS w FROM tr GROUP BY ALL) SELECT profile_id, task_id, r < w AS read_first FROM m WHERE r IS NOT NULL AND w IS NOT NULL")
def read_before_write(spark: SparkSession, sf: str) -> DataFrame:
    return ev.read_before_write(events(spark, sf))


@query("WITH " + TRACE + ", a AS (SELECT profile_id, task_id, arg_min(event_type, seq) AS first_action FROM b GROUP BY ALL), c AS (SELECT profile_id, first_action, count(*) AS n, min(task_id) AS since FROM a GROUP BY ALL) SELECT profile_id, first_action, n FROM c QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, since) = 1")
def usual_first_actions(spark: SparkSession, sf: str) -> DataFrame:
    return ev.usual_first_action(sq.first_action(behavioural(events(spark, sf))))


@query("WITH " + FEATURES + ", m AS (SELECT profile_id, avg(dirs_created) AS d FROM f GROUP BY profile_id) SELECT profile_id, CASE WHEN d < 1 THEN '0' WHEN d < 3 THEN '1-2' WHEN d < 6 THEN '3-5' ELSE '6+' END AS bucket FROM m")
def directory_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return pf.profile_means(_features(spark, sf)).select("profile_id", ev.directory_bucket(F.col("dirs_created")).alias("bucket"))


@query("WITH " + FEATURES + """, n AS (SELECT profile_id || '_' || task_id || '_reads' AS question_id, unique_files_read AS answer FROM f WHERE unique_files_read >= 2),
 c AS (SELECT question_id, answer, answer + unnest([-3, -2, -1, 1, 2, 3, 5]) AS v FROM n), d AS (SELECT * FROM c WHERE v >= 0 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY md5('42/draw/' || question_id || '/' || v)) <= 3),
 o AS (SELECT question_id, answer, v FROM d UNION ALL SELECT question_id, answer, answer FROM n),
 r AS (SELECT question_id, answer, v, row_number() OVER w AS p, string_agg(v, ',') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS options FROM o WINDOW w AS (PARTITION BY question_id ORDER BY md5('42/order/' || question_id || '/' || v)))
 SELECT question_id, answer, options, substr('ABCD', CAST(p AS INT), 1) AS correct FROM r WHERE v = answer""")
def question_choices(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf).where(F.col("unique_files_read") >= 2)
    numeric = f.select(F.concat_ws("_", F.col("profile_id").cast("string"), F.col("task_id").cast("string"), F.lit("reads")).alias("question_id"), F.col("unique_files_read").alias("answer"))
    return ev.choices(numeric).select("question_id", "answer", F.array_join(F.transform("options", lambda x: x.cast("string")), ",").alias("options"), "correct")


@query(FACTS.replace(" SELECT * FROM q", """, h AS (SELECT *, md5('42/' || profile_id || '/' || task_id || '/' || question) AS hash FROM q), s AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY profile_id, task_id ORDER BY hash, question) <= 3)
 SELECT profile_id, task_id, question, row_number() OVER (PARTITION BY profile_id ORDER BY hash, task_id, question) AS place FROM s QUALIFY place <= 10"""))
def question_sets(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf)
    asked = ev.question_set(ev.facts(ft.trajectory_features(t), sq.first_action(behavioural(t))))
    return long(asked.select(*KEY, "question", "place"), "place")


@query("WITH " + TRACE + ", s AS (SELECT profile_id, task_id, count(*) AS n, max(ts_ms) - min(ts_ms) AS d, bool_or(event_type = 'error_encounter') AS bad FROM tr GROUP BY ALL) SELECT CASE WHEN bad THEN 'error' ELSE 'success' END AS status, count(*) AS sessions, round(avg(n), 4) AS mean_events, round(avg(d), 2) AS mean_duration_ms FROM s GROUP BY 1")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = pf.session_summary(events(spark, sf))
    out = s.groupBy(F.when(F.col("errors") > 0, "error").otherwise("success").alias("status")).agg(F.count(F.lit(1)).alias("sessions"), F.avg("total_events").alias("mean_events"), F.avg("duration_ms").alias("mean_duration_ms"))
    return rounded(rounded(out, "mean_events"), "mean_duration_ms", places=2)
