"""Queries for set operations, coverage, rankings within clusters and results kept up to date, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import paths as pa
from tracewell.operators import features as ft
from tracewell.operators import joins as jn
from tracewell.operators import profiles as pf
from tracewell.operators import sequences as sq
from tracewell.operators import similarity as sm
from tracewell.operators import storage as st
from tracewell.plans.trace_queries import FEATURES, TRACE, _features, events, rounded
from tracewell.sources.traces import KEY, behavioural
from tracewell.streaming import live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query("WITH " + TRACE + ", r AS (SELECT profile_id, event_type, task_id, event_id, content_length, row_number() OVER (PARTITION BY profile_id, event_type, task_id ORDER BY content_length DESC, event_id) > 1 AS again FROM b) SELECT profile_id, event_type, event_id, row_number() OVER (PARTITION BY profile_id, event_type ORDER BY again, content_length DESC, event_id) AS rank FROM r QUALIFY rank <= 3")
def distinct_first(spark: SparkSession, sf: str) -> DataFrame:
    out = sm.distinct_first(behavioural(events(spark, sf)), ["profile_id", "event_type"], ["task_id"], [F.desc("content_length"), F.col("event_id")], 3)
    return out.select("profile_id", "event_type", "event_id", F.col("rank").cast("long").alias("rank"))


@query("WITH " + TRACE + ", x AS (SELECT profile_id, task_id, file_path, min(task_id) OVER (PARTITION BY profile_id) AS first_task, max(task_id) OVER (PARTITION BY profile_id) AS last_task FROM tr WHERE file_path IS NOT NULL), s AS (SELECT profile_id, list(DISTINCT file_path) FILTER (task_id = first_task) AS a, list(DISTINCT file_path) FILTER (task_id = last_task) AS z FROM x GROUP BY profile_id), n AS (SELECT profile_id, list_sort(list_filter(z, lambda x: NOT list_contains(a, x))) AS fresh FROM s) SELECT profile_id, len(fresh) AS n, array_to_string(fresh, ',') AS entries FROM n WHERE len(fresh) > 0")
def new_entries(spark: SparkSession, sf: str) -> DataFrame:
    """What each profile's last session has and its first hasn't."""
    seen = events(spark, sf).where(F.col("file_path").isNotNull()).groupBy(*KEY).agg(F.collect_set("file_path").alias("files"))
    ends = seen.groupBy("profile_id").agg(F.min_by("files", "task_id").alias("first"), F.max_by("files", "task_id").alias("last"))
    rows = ends.select("profile_id", ft.new_directories(F.col("first"), F.col("last")).alias("fresh")).where(F.size("fresh") > 0)
    return rows.select("profile_id", F.size("fresh").cast("long").alias("n"), F.array_join("fresh", ",").alias("entries"))


@query("WITH " + TRACE + " SELECT profile_id, task_id, count(*) FILTER (event_type = 'error_encounter') AS total_iterations, coalesce(avg(k % 4) FILTER (event_type = 'error_encounter'), 0) AS avg_tools_per_iteration, coalesce(avg(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) FILTER (event_type = 'error_encounter'), 0) AS error_rate, count(*) FILTER (event_type = 'file_browse') AS total_context_switches FROM tr GROUP BY ALL")
def work_rhythm(spark: SparkSession, sf: str) -> DataFrame:
    """The table has neither iterations nor switches: errors stand for the ends of iterations, browsing for switches."""
    t = events(spark, sf)
    kind = F.when(F.col("event_type") == "error_encounter", "iteration_end").when(F.col("event_type") == "file_browse", "context_switch").otherwise(F.col("event_type"))
    return ft.work_rhythm(t.withColumns({"event_type": kind, "tools_called": F.col("k") % 4, "has_tool_error": F.when(F.col("k") % 3 == 0, True)}))


CJK_NAMES = "CASE WHEN k % 10 < profile_id % 9 THEN '\u6587\u4ef6' ELSE '' END"


@query("WITH " + TRACE + f", s AS (SELECT profile_id, avg(CAST(regexp_matches({CJK_NAMES}, '[一-鿿]') AS INT)) AS share FROM tr WHERE file_path IS NOT NULL GROUP BY profile_id) SELECT profile_id, round(share, 4) AS cjk_share, CASE WHEN share > 0.6 THEN 'chinese' WHEN share > 0.2 THEN 'mixed' ELSE 'english' END AS language FROM s")
def naming_language(spark: SparkSession, sf: str) -> DataFrame:
    named = events(spark, sf).where(F.col("file_path").isNotNull()).withColumn("name", F.concat("file_path", F.expr(CJK_NAMES)))
    return rounded(pf.naming_language(named, "name"), "cjk_share")


@query("WITH " + TRACE + " SELECT event_type, count(DISTINCT task_id) AS tasks FROM b GROUP BY event_type HAVING count(DISTINCT task_id) >= 2")
def task_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return behavioural(events(spark, sf)).groupBy("event_type").agg(F.count_distinct("task_id").alias("tasks")).where(F.col("tasks") >= 2)


@query("WITH " + TRACE + ", l AS (SELECT DISTINCT profile_id, task_id FROM tr) SELECT profile_id, task_id, 'T' || dense_rank() OVER (PARTITION BY profile_id ORDER BY task_id) AS label FROM l")
def trajectory_labels(spark: SparkSession, sf: str) -> DataFrame:
    return pf.labelled_by_trajectory(events(spark, sf).select(*KEY).distinct())


@query("WITH " + TRACE + " SELECT profile_id, task_id, seq, regexp_replace(file_path, '^/sandbox/[^/]+/', '') AS path, regexp_extract(file_path, '\\.([^.]+)$', 1) AS ext, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]+$', '') AS stem, len(string_split(file_path, '/')) - 4 AS depth FROM tr WHERE file_path IS NOT NULL")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf).where(F.col("file_path").isNotNull())
    p = F.col("file_path")
    base = F.concat(F.lit("/sandbox/u"), F.col("profile_id"))
    return t.select(*KEY, F.col("seq").cast("long").alias("seq"), pa.anonymised(p).alias("path"), pa.extension(p).alias("ext"), pa.stem(p).alias("stem"), pa.depth_below(p, base).cast("long").alias("depth"))


@query("WITH " + TRACE + " SELECT file_type, count(*) AS n, count(*) FILTER (file_type IN ('csv', 'json')) > 0 AS is_structured, count(*) FILTER (file_type IN ('md', 'txt')) > 0 AS is_primary, count(*) FILTER (file_type = 'png') > 0 AS is_image, count(*) FILTER (file_type IN ('md', 'csv', 'json', 'txt')) > 0 AS is_text, count(*) FILTER (file_type = 'png') > 0 AS is_multimodal FROM tr GROUP BY file_type")
def type_classes(spark: SparkSession, sf: str) -> DataFrame:
    counts = events(spark, sf).groupBy("file_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("file_type", "n", *(c.alias(k) for k, c in pa.type_class(F.col("file_type")).items()))


@query("WITH " + TRACE + ", r AS (SELECT profile_id, event_id, content_length, power(0.5, (count(*) OVER (PARTITION BY profile_id) - row_number() OVER (PARTITION BY profile_id ORDER BY ts_ms, event_id)) / 200) AS recency FROM b) SELECT profile_id, event_id, round(recency, 6) AS recency FROM r")
def recency_weights(spark: SparkSession, sf: str) -> DataFrame:
    out = sq.recency(behavioural(events(spark, sf)), ["profile_id"], ["ts_ms", "event_id"])
    return rounded(out.select("profile_id", "event_id", "recency"), "recency", places=6)


@query("WITH " + TRACE + ", u AS (SELECT profile_id, file_path, ts_ms, event_id, content_length FROM tr WHERE event_type = 'file_write') SELECT profile_id, file_path, event_id, content_length FROM u QUALIFY row_number() OVER (PARTITION BY profile_id, file_path ORDER BY ts_ms DESC, event_id DESC) = 1")
def latest_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).where(F.col("event_type") == "file_write").select("profile_id", "file_path", "ts_ms", "event_id", "content_length")
    out = st.upsert(rows.where(F.col("ts_ms") < 1705500000000), rows.where(F.col("ts_ms") >= 1705500000000), ["profile_id", "file_path"], "ts_ms", "event_id")
    return out.drop("ts_ms")


@query("WITH " + TRACE + ", w AS (SELECT DISTINCT task_id FROM tr WHERE event_type = 'dir_create' AND k > 90) SELECT profile_id, count(*) AS n FROM tr SEMI JOIN w USING (task_id) GROUP BY profile_id")
def of_chosen_tasks(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf)
    return jn.of_tasks(t, t.where((F.col("event_type") == "dir_create") & (F.col("k") > 90))).groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + FEATURES + ", q AS (SELECT profile_id, task_id, 'reads' AS category, unique_files_read >= 3 AS correct FROM f UNION ALL SELECT profile_id, task_id, 'edits', total_edits >= 1 FROM f) SELECT category, round(avg(CAST(correct AS INT)), 4) AS accuracy, count(*) AS n FROM q GROUP BY category")
def question_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    rows = f.select(F.explode(F.array(F.struct(F.lit("reads").alias("category"), (F.col("unique_files_read") >= 3).alias("correct")), F.struct(F.lit("edits").alias("category"), (F.col("total_edits") >= 1).alias("correct")))).alias("q")).select("q.*")
    return rounded(rows.groupBy("category").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n")), "accuracy")


@query("WITH " + TRACE + ", m AS (SELECT *, file_path || CASE WHEN k % 3 = 0 THEN '.sb-1' ELSE '' END AS source, file_path || CASE WHEN k % 5 = 0 THEN '.sb-2' ELSE '' END AS target FROM tr WHERE event_type IN ('file_move', 'file_edit')), c AS (SELECT CASE WHEN event_type = 'file_move' AND source LIKE '%.sb-%' THEN 'file_edit' ELSE event_type END AS event_type FROM m WHERE NOT (event_type = 'file_move' AND target LIKE '%.sb-%')) SELECT event_type, count(*) AS n FROM c GROUP BY 1")
def atomic_saves(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf).where(F.col("event_type").isin("file_move", "file_edit"))
    end = lambda by, text: F.concat("file_path", F.when(F.col("k") % by == 0, text).otherwise(""))
    t = t.withColumn("source_file", end(3, ".sb-1")).withColumn("target_file", end(5, ".sb-2"))
    return live.collapsed_saves(t).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
