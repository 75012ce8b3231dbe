"""Queries over the table ``events`` (seen as a trace), each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.config import CONSISTENCY_KEYS, FINGERPRINT, FINGERPRINT_DIMENSIONS, SIMULATION_TYPES
from tracewell.operators import features as ft
from tracewell.operators import profiles as pf
from tracewell.operators import scans as sc
from tracewell.operators import sequences as sq
from tracewell.sources.traces import KEY, behavioural, mapped, trace_of_events

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf: str, content: bool = False, head: int | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet") if content else None
    return trace_of_events(spark.read.parquet(f"{sf}/events.parquet"), docs, head)


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


SIM = ", ".join(f"'{x}'" for x in SIMULATION_TYPES)
TRACE = """
raw AS (
  SELECT event_id, user_id AS profile_id, value, event_type AS raw, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, epoch_us(ts) // 1000 AS ts_ms FROM events
), typed AS (
  SELECT *, CAST(floor((ts_ms / 1000.0 - 1704067200) / 604800) AS INT) AS task_id,
    CASE raw WHEN 'view' THEN 'file_read' WHEN 'click' THEN CASE WHEN k < 50 THEN 'file_browse' ELSE 'file_search' END
      WHEN 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'file_edit' ELSE 'file_write' END
      WHEN 'signup' THEN ['dir_create', 'file_copy', 'file_delete', 'file_move'][k % 4 + 1] ELSE 'error_encounter' END AS event_type,
    ['md', 'csv', 'json', 'png', 'txt'][k % 5 + 1] AS file_type
  FROM raw
), placed AS (
  SELECT event_id, profile_id, task_id, ts_ms, event_type, k, file_type,
    row_number() OVER (PARTITION BY profile_id, task_id ORDER BY ts_ms, event_id) AS seq,
    CASE WHEN event_type = 'file_write' THEN CASE WHEN k % 3 = 1 THEN 'create' ELSE 'overwrite' END END AS operation,
    CASE WHEN event_type NOT IN ('file_browse', 'file_search', 'dir_create') THEN '/sandbox/u' || profile_id || '/d' || (k % 5) || '/file_' || (k % 20) || '.' || file_type END AS file_path,
    CAST(floor(value * 100) AS BIGINT) AS content_length, k AS lines_added, CAST(floor(value) AS INT) % 7 AS lines_deleted, k % 4 AS depth, k % 8 = 1 AS is_backup,
    CASE WHEN event_type IN ('file_write', 'file_edit') THEN k % 10 END AS content_hash
  FROM typed
), tr AS (
  SELECT *, CASE WHEN event_type = 'file_read' THEN row_number() OVER (PARTITION BY profile_id, task_id, file_path, event_type ORDER BY seq) ELSE 0 END AS view_count FROM placed
), b AS (SELECT * FROM tr WHERE event_type NOT IN (""" + SIM + """))
"""
#: Where moves of the trace go (see ``with_targets``).
TARGET = "CASE WHEN event_type = 'file_move' THEN '/sandbox/u' || profile_id || '/d' || ((k * 3 + 7) % 20 % 5) || '/file_' || ((k * 3 + 7) % 20) || '.' || ['md', 'csv', 'json', 'png', 'txt'][(k * 3 + 7) % 20 % 5 + 1] END"
#: Ages of deleted files: the rows of a profile one by one, with a map of the births.
DELETE_AGES = "WITH RECURSIVE " + TRACE + ", n AS (SELECT profile_id, event_id, event_type, file_path, " + TARGET + """ AS target, ts_ms, row_number() OVER (PARTITION BY profile_id ORDER BY ts_ms, event_id) AS i FROM tr WHERE operation = 'create' OR event_type IN ('file_delete', 'file_move')),
 r AS (SELECT profile_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS file_path, CAST(NULL AS BIGINT) AS file_age_ms, CAST(map_from_entries([]) AS MAP(VARCHAR, BIGINT)) AS births FROM (SELECT DISTINCT profile_id FROM n)
  UNION ALL SELECT n.profile_id, n.i, CASE WHEN event_type = 'file_delete' THEN n.event_id END, n.file_path, CASE WHEN event_type = 'file_delete' THEN ts_ms - births[n.file_path] END,
   CASE WHEN event_type = 'file_write' THEN map_concat(births, map([n.file_path], [ts_ms]))
    WHEN event_type = 'file_move' AND births[n.file_path] IS NOT NULL THEN map_concat(map_from_entries(list_filter(map_entries(births), lambda e: e.key <> n.file_path)), map([n.target], [births[n.file_path]]))
    WHEN event_type = 'file_delete' THEN map_from_entries(list_filter(map_entries(births), lambda e: e.key <> n.file_path)) ELSE births END
  FROM r JOIN n ON n.profile_id = r.profile_id AND n.i = r.i + 1)
SELECT profile_id, event_id, file_path, file_age_ms FROM r WHERE event_id IS NOT NULL"""
#: Copies, where what registers depends on the hits before.
COPIES = "WITH RECURSIVE " + TRACE + ", n AS (SELECT profile_id, content_hash, event_id, file_path, ts_ms // 10000 AS now, row_number() OVER (PARTITION BY profile_id, content_hash ORDER BY ts_ms, event_id) AS i FROM tr WHERE content_hash IS NOT NULL), r AS (SELECT profile_id, content_hash, event_id, file_path, i, file_path AS held, now AS since, false AS hit, CAST(NULL AS VARCHAR) AS source, CAST(0 AS BIGINT) AS age FROM n WHERE i = 1 UNION ALL SELECT profile_id, content_hash, event_id, file_path, i, CASE WHEN h THEN held ELSE file_path END, CASE WHEN h THEN since ELSE now END, h, held, now - since FROM (SELECT n.*, r.held, r.since, n.now - r.since < 10000 AND r.held <> n.file_path AS h FROM r JOIN n ON n.profile_id = r.profile_id AND n.content_hash = r.content_hash AND n.i = r.i + 1)) SELECT profile_id, event_id, source AS source_path, file_path AS dest_path, age AS age_ms FROM r WHERE hit"
FEATURES = TRACE + """, g AS (
  SELECT profile_id, task_id,
    count(*) FILTER (event_type = 'file_read') AS total_reads, count(*) FILTER (event_type = 'file_browse') AS total_browses,
    count(*) FILTER (event_type = 'file_search') AS total_searches, count(*) FILTER (event_type = 'file_read' AND view_count > 1) AS revisits,
    coalesce(avg(content_length) FILTER (event_type = 'file_read'), 0) AS avg_content_length, count(DISTINCT file_path) FILTER (event_type = 'file_read') AS unique_files_read,
    count(*) FILTER (operation = 'create') AS files_created, CAST(coalesce(sum(content_length) FILTER (operation = 'create'), 0) AS BIGINT) AS total_output_chars,
    coalesce(avg(content_length) FILTER (operation = 'create'), 0) AS avg_output_length, coalesce(max(content_length) FILTER (operation = 'create'), 0) AS max_output_length,
    coalesce(stddev_samp(content_length) FILTER (operation = 'create'), 0) AS output_length_std,
    count(DISTINCT file_type) FILTER (operation = 'create') AS distinct_file_types, coalesce(bool_or(operation = 'create' AND file_type = 'md'), false) AS has_markdown,
    count(*) FILTER (operation = 'create' AND file_type IN ('json', 'yaml', 'csv', 'xml')) > 0 AS has_structured_data,
    count(*) FILTER (event_type = 'dir_create') AS dirs_created, coalesce(max(depth) FILTER (event_type = 'dir_create'), 0) AS max_dir_depth,
    coalesce(avg(depth) FILTER (event_type = 'dir_create'), 0) AS avg_dir_depth, count(*) FILTER (event_type = 'file_move') AS files_moved,
    count(*) FILTER (event_type = 'file_edit') AS total_edits, coalesce(avg(lines_added + lines_deleted) FILTER (event_type = 'file_edit'), 0) AS avg_lines_changed,
    coalesce(max(lines_added + lines_deleted) FILTER (event_type = 'file_edit'), 0) AS max_lines_changed, count(DISTINCT file_path) FILTER (event_type = 'file_edit') AS edited,
    count(*) FILTER (event_type = 'file_edit' AND lines_added + lines_deleted < 10) AS small_edits,
    count(*) FILTER (event_type = 'file_copy') AS total_copies, count(*) FILTER (event_type = 'file_copy' AND is_backup) AS backup_copies,
    count(*) FILTER (event_type = 'file_delete') AS total_deletes, count(*) FILTER (operation = 'overwrite') AS total_overwrites,
    count(*) FILTER (operation = 'create' AND file_type IN ('csv', 'json', 'xlsx', 'yaml', 'xml', 'tsv')) AS structured_files_created,
    count(*) FILTER (operation = 'create' AND file_type IN ('md', 'txt', 'docx', 'pdf')) AS primary_files_created,
    count(*) FILTER (operation = 'create' AND file_type IN ('png', 'jpg', 'jpeg', 'svg', 'gif')) AS image_files_created,
    coalesce(avg(length(regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]+$', ''))) FILTER (operation = 'create'), 0) AS avg_filename_length,
    coalesce(bool_or(operation = 'create' AND file_path LIKE '%\\_%' ESCAPE '\\'), false) AS has_underscores,
    count(*) FILTER (event_type NOT IN (""" + SIM + """)) AS n_behavioural, count(*) AS n_events
  FROM tr GROUP BY ALL
), f AS (
  SELECT *, 0 AS markdown_table_rows, false AS has_date_prefix, false AS has_numeric_prefix, backup_copies > 0 AS has_backup_behavior, structured_files_created > 0 AS has_tables_or_data, image_files_created > 0 AS has_images,
    total_browses / greatest(total_reads + total_browses + total_searches, 1) AS browse_ratio, total_searches / greatest(total_reads + total_browses + total_searches, 1) AS search_ratio,
    total_reads / greatest(total_reads + total_browses + total_searches, 1) AS read_ratio, revisits / greatest(total_reads, 1) AS revisit_ratio,
    total_edits / greatest(edited, 1) AS edits_per_file, small_edits / greatest(total_edits, 1) AS small_edit_ratio,
    total_deletes / greatest(files_created, 1) AS delete_to_create_ratio, structured_files_created / greatest(files_created, 1) AS supplementary_ratio
  FROM g
)
"""
MEANS = FEATURES + ", m AS (SELECT profile_id, count(*) AS n_trajectories, " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}" for c in ("search_ratio", "browse_ratio", "read_ratio", "revisit_ratio", "total_reads", "unique_files_read", "total_searches", "avg_output_length", "files_created", "total_output_chars", "dirs_created", "max_dir_depth", "files_moved", "total_edits", "avg_lines_changed", "small_edit_ratio", "total_deletes", "total_overwrites", "backup_copies", "delete_to_create_ratio", "image_files_created", "structured_files_created", "has_underscores")) + ", avg(CAST(has_backup_behavior AS INT)) AS has_backup_behavior, avg(CAST(has_tables_or_data AS INT)) AS has_tables_or_data, avg(CAST(has_images AS INT)) AS has_images FROM f GROUP BY profile_id)\n"
TIERS = MEANS + """, r AS (SELECT profile_id, """ + ", ".join(f"round({c}, 3) AS {c}" for c in ("search_ratio", "browse_ratio", "revisit_ratio", "total_reads", "avg_output_length", "files_created", "total_output_chars", "dirs_created", "max_dir_depth", "total_edits", "avg_lines_changed", "small_edit_ratio", "total_deletes", "delete_to_create_ratio", "image_files_created", "structured_files_created")) + """ FROM m), t AS (
  SELECT profile_id,
    CASE WHEN search_ratio >= 0.15 THEN 'M' WHEN browse_ratio >= 0.15 OR (revisit_ratio < 0.05 AND total_reads < 15) THEN 'R' ELSE 'L' END AS "A",
    CASE WHEN total_output_chars >= 8000 OR (avg_output_length >= 3000 AND files_created >= 3) THEN 'L' WHEN total_output_chars <= 3000 OR (avg_output_length <= 1500 AND files_created <= 1.5) THEN 'R' ELSE 'M' END AS "B",
    CASE WHEN dirs_created >= 2 AND max_dir_depth >= 2 THEN 'L' WHEN dirs_created <= 0.5 AND max_dir_depth <= 0.5 THEN 'R' ELSE 'M' END AS "C",
    CASE WHEN total_edits >= 3 AND (small_edit_ratio >= 0.5 OR avg_lines_changed <= 15) THEN 'L' WHEN total_edits <= 1 OR avg_lines_changed >= 30 THEN 'R' ELSE 'M' END AS "D",
    CASE WHEN total_deletes * 0.7 + delete_to_create_ratio * 0.3 >= 0.15 THEN 'L' WHEN total_deletes * 0.7 + delete_to_create_ratio * 0.3 <= 0.05 THEN 'R' ELSE 'M' END AS "E",
    CASE WHEN image_files_created + structured_files_created >= 1.5 OR image_files_created >= 0.5 THEN 'L' WHEN image_files_created < 0.1 THEN 'R' ELSE 'M' END AS "F"
  FROM r)
"""

INTS = ("total_reads", "total_browses", "total_searches", "unique_files_read", "files_created", "total_output_chars", "max_output_length", "distinct_file_types", "dirs_created", "max_dir_depth", "files_moved", "total_edits", "max_lines_changed", "total_copies", "backup_copies", "total_deletes", "total_overwrites", "structured_files_created", "primary_files_created", "image_files_created", "n_behavioural", "n_events")
DOUBLES = ("avg_content_length", "avg_output_length", "output_length_std", "avg_dir_depth", "avg_lines_changed", "browse_ratio", "search_ratio", "read_ratio", "revisit_ratio", "edits_per_file", "small_edit_ratio", "delete_to_create_ratio", "supplementary_ratio", "avg_filename_length")
BOOLS = ("has_markdown", "has_structured_data", "has_backup_behavior", "has_tables_or_data", "has_images", "has_underscores")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return ft.trajectory_features(events(spark, sf), recorded_views=False)


@query("WITH " + FEATURES + "SELECT profile_id, task_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in INTS) + ", " + ", ".join(f"round({c}, 4) AS {c}" for c in DOUBLES) + ", " + ", ".join(BOOLS) + " FROM f")
def trajectory_features(spark: SparkSession, sf: str) -> DataFrame:
    df = _features(spark, sf).select(*KEY, *INTS, *DOUBLES, *BOOLS)
    return rounded(df, *DOUBLES).withColumns({c: F.col(c).cast("long") for c in INTS})


@query("WITH " + TIERS + "SELECT dim, tier, count(*) AS n FROM (UNPIVOT t ON \"A\", \"B\", \"C\", \"D\", \"E\", \"F\" INTO NAME dim VALUE tier) GROUP BY ALL")
def tier_classification(spark: SparkSession, sf: str) -> DataFrame:
    tiers = pf.tiers_long(pf.tiers(pf.profile_means(_features(spark, sf))))
    return tiers.groupBy("dim", "tier").agg(F.count(F.lit(1)).alias("n"))


AGG_KEYS = ["total_reads", "search_ratio", "avg_output_length", "total_edits", "has_images"]


@query("WITH " + FEATURES + ", l AS (UNPIVOT (SELECT profile_id, task_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in AGG_KEYS) + " FROM f) ON " + ", ".join(AGG_KEYS) + " INTO NAME key VALUE value) SELECT profile_id, key, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max, count(*) AS n FROM l GROUP BY ALL")
def profile_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pf.aggregate_features(_features(spark, sf), AGG_KEYS), "mean", "median", "std", "min", "max")


@query("WITH " + TRACE + "SELECT profile_id, file_type, count(*) AS n FROM tr WHERE operation = 'create' GROUP BY ALL")
def file_type_counters(spark: SparkSession, sf: str) -> DataFrame:
    return pf.merge_counters(ft.file_type_histogram(events(spark, sf)))


@query("WITH " + TRACE + ", c AS (SELECT profile_id, file_type, count(*) AS n FROM tr WHERE operation = 'create' GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, file_type) AS rank FROM c) WHERE rank <= 4")
def top_file_types(spark: SparkSession, sf: str) -> DataFrame:
    return pf.top_types(pf.merge_counters(ft.file_type_histogram(events(spark, sf)))).withColumn("rank", F.col("rank").cast("long"))


_FP = [c for c in FINGERPRINT if c != "markdown_table_rows"]
Z = FEATURES + ", z AS (SELECT profile_id, task_id, count(*) OVER w AS n, " + ", ".join(f"CASE WHEN count(*) OVER w < 2 THEN CAST({c} AS DOUBLE) WHEN stddev_samp({c}) OVER w = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w END AS {c}" for c in FINGERPRINT) + " FROM f WINDOW w AS (PARTITION BY profile_id)), d0 AS (SELECT *, round(sqrt(" + " + ".join(f"power({c} - avg({c}) OVER w, 2)" for c in FINGERPRINT) + "), 4) AS distance FROM z WINDOW w AS (PARTITION BY profile_id)), d AS (SELECT *, n >= 3 AND coalesce(distance > avg(distance) OVER w + 1.5 * stddev_samp(distance) OVER w, false) AS is_deviant FROM d0 WINDOW w AS (PARTITION BY profile_id))\n"


@query("WITH " + Z + "SELECT profile_id, task_id, round(distance, 2) AS distance, is_deviant FROM d")
def fingerprint_deviation(spark: SparkSession, sf: str) -> DataFrame:
    out = pf.deviations(pf.z_scores(_features(spark, sf)))
    return rounded(out.select(*KEY, "distance", "is_deviant"), "distance", places=2)


_UNP = " UNION ALL ".join(f"SELECT profile_id, task_id, is_deviant, {i} AS pos, '{c}' AS feature, '{d}' AS dimension, round(abs({c} - avg({c}) OVER (PARTITION BY profile_id)), 3) AS delta FROM d" for i, (c, d) in enumerate(zip(FINGERPRINT, FINGERPRINT_DIMENSIONS, strict=True)))


@query("WITH " + Z + ", p AS (" + _UNP + ") SELECT profile_id, task_id, rank, feature, dimension, round(delta, 3) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, task_id ORDER BY delta DESC, pos) AS rank FROM p WHERE is_deviant) WHERE rank <= 3")
def shifted_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return pf.shifted_dimensions(pf.deviations(pf.z_scores(_features(spark, sf)))).withColumn("rank", F.col("rank").cast("long"))


@query("WITH " + Z + ", w AS (SELECT f.profile_id, f.total_reads FROM f JOIN d USING (profile_id, task_id), range(CASE WHEN d.is_deviant THEN 1 ELSE 2 END)) SELECT profile_id, round(avg(total_reads), 4) AS mean, round(median(total_reads), 4) AS median, round(stddev_samp(total_reads), 4) AS std, count(*) AS n FROM w GROUP BY profile_id")
def deviation_weighting(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    agg = pf.aggregate_features(pf.weighted_by_deviation(f, pf.deviations(pf.z_scores(f))), ["total_reads"])
    return rounded(agg.select("profile_id", "mean", "median", "std", "n"), "mean", "median", "std")


_CV = [k for k in CONSISTENCY_KEYS if k not in ("heading_count", "heading_max_depth", "prose_to_structure_ratio")]


@query("WITH " + FEATURES + ", l AS (UNPIVOT (SELECT profile_id, task_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _CV) + " FROM f) ON " + ", ".join(_CV) + " INTO NAME key VALUE value), s AS (SELECT profile_id, key, avg(value) AS mean, stddev_samp(value) AS sd FROM l GROUP BY ALL HAVING count(*) >= 2) SELECT profile_id, key, round(mean, 4) AS mean, round(CASE WHEN mean = 0 THEN 0 ELSE sd / abs(mean) END, 4) AS cv, (CASE WHEN mean = 0 THEN 0 ELSE sd / abs(mean) END) < 0.3 AS stable FROM s")
def consistency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pf.consistency(_features(spark, sf), tuple(_CV)), "mean", "cv")


@query("WITH " + FEATURES + ", a AS (SELECT profile_id, " + ", ".join(f"bool_and({c} = 0) AS {k}" for k, c in pf.ABSENCES.items()) + " FROM f GROUP BY profile_id) SELECT profile_id, absence FROM (UNPIVOT a ON " + ", ".join(pf.ABSENCES) + " INTO NAME absence VALUE holds) WHERE holds")
def absences(spark: SparkSession, sf: str) -> DataFrame:
    return pf.absences(_features(spark, sf))


@query("WITH " + FEATURES + ", a AS (SELECT profile_id, bool_and(total_searches = 0) AS never_search, bool_and(dirs_created = 0) AS never_dirs, bool_and(dirs_created >= 2) AS always_dirs, bool_and(total_edits = 0) AS never_edit FROM f GROUP BY profile_id HAVING count(*) >= 2) SELECT profile_id, statement FROM (UNPIVOT a ON never_search, never_dirs, always_dirs, never_edit INTO NAME statement VALUE holds) WHERE holds")
def consistency_statements(spark: SparkSession, sf: str) -> DataFrame:
    return pf.consistency_statements(_features(spark, sf))


@query("WITH " + MEANS + """, p AS (SELECT unnest([
  CASE WHEN search_ratio < 0.05 THEN 'READING: rarely searches' END, CASE WHEN search_ratio > 0.2 THEN 'READING: searches heavily' END,
  CASE WHEN revisit_ratio > 0.25 THEN 'READING: often revisits' END, CASE WHEN revisit_ratio < 0.05 THEN 'READING: rarely revisits' END,
  CASE WHEN browse_ratio > 0.3 THEN 'READING: often browses' END,
  CASE WHEN total_reads > 0 AND unique_files_read > 0 AND total_reads / unique_files_read > 1.5 THEN 'READING: deep' END, CASE WHEN total_reads > 0 AND unique_files_read > 0 AND total_reads / unique_files_read < 1.1 THEN 'READING: shallow' END,
  CASE WHEN avg_output_length > 3000 THEN 'OUTPUT: detailed' END, CASE WHEN avg_output_length < 800 THEN 'OUTPUT: concise' END,
  CASE WHEN files_created > 3 THEN 'OUTPUT: many files' END, CASE WHEN files_created <= 1.5 THEN 'OUTPUT: few files' END,
  CASE WHEN dirs_created >= 3 THEN 'ORGANIZATION: many directories' END, CASE WHEN dirs_created < 0.5 THEN 'ORGANIZATION: few directories' END, CASE WHEN files_moved > 1 THEN 'ORGANIZATION: moves files' END,
  CASE WHEN total_edits > 3 AND small_edit_ratio > 0.6 THEN 'EDITING: many small edits' WHEN total_edits <= 1 THEN 'EDITING: rarely edits' END, CASE WHEN avg_lines_changed > 30 THEN 'EDITING: large edits' END,
  CASE WHEN has_backup_behavior > 0.5 THEN 'VERSIONING: backs up' WHEN total_overwrites > 0.5 AND backup_copies < 0.1 THEN 'VERSIONING: overwrites' END, CASE WHEN total_deletes > 1 THEN 'VERSIONING: deletes' END,
  CASE WHEN has_tables_or_data > 0.5 THEN 'CROSS-MODAL: tables' END, CASE WHEN has_images > 0.3 THEN 'CROSS-MODAL: images' END, CASE WHEN structured_files_created > 0.5 THEN 'CROSS-MODAL: structured data' END,
  CASE WHEN has_tables_or_data < 0.2 AND has_images < 0.1 AND structured_files_created < 0.2 THEN 'CROSS-MODAL: text only' END]) AS pattern FROM m)
SELECT pattern, count(*) AS n FROM p WHERE pattern IS NOT NULL GROUP BY pattern""")
def behaviour_patterns(spark: SparkSession, sf: str) -> DataFrame:
    found = pf.patterns(pf.profile_means(_features(spark, sf)))
    return found.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + MEANS + "SELECT profile_id, has_underscores > 0.7 AS underscores, false AS date_prefixes, false AS numeric_prefixes FROM m")
def naming_flags(spark: SparkSession, sf: str) -> DataFrame:
    return pf.naming_flags(pf.profile_means(_features(spark, sf)))


@query("WITH " + FEATURES + "SELECT profile_id, task_id, round(n_behavioural / greatest(n_events, 1) * (1 + (CAST(total_reads > 0 OR total_browses > 0 OR total_searches > 0 AS INT) + CAST(files_created > 0 OR total_output_chars > 0 AS INT) + CAST(distinct_file_types > 0 AS INT) + CAST(dirs_created > 0 OR files_moved > 0 AS INT) + CAST(avg_filename_length > 0 AS INT) + CAST(total_edits > 0 AS INT) + CAST(total_copies > 0 OR total_deletes > 0 OR total_overwrites > 0 AS INT) + CAST(structured_files_created > 0 OR primary_files_created > 0 OR image_files_created > 0 AS INT)) / 9), 4) AS importance FROM f")
def importance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ft.importance(_features(spark, sf)).select(*KEY, "importance"), "importance")


@query("WITH " + TRACE + ", p AS (SELECT event_type AS from_type, lead(event_type) OVER (PARTITION BY profile_id, task_id ORDER BY seq) AS to_type FROM b) SELECT from_type, to_type, count(*) AS n FROM p WHERE to_type IS NOT NULL GROUP BY ALL")
def transition_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return sq.transition_counts(behavioural(events(spark, sf)))


@query("WITH " + TRACE + ", p AS (SELECT profile_id, task_id, seq, event_type AS from_type, lead(event_type) OVER (PARTITION BY profile_id, task_id ORDER BY seq) AS to_type FROM b), c AS (SELECT profile_id, task_id, from_type, to_type, count(*) AS n, min(seq) AS pair_at FROM p WHERE to_type IS NOT NULL GROUP BY ALL), d AS (SELECT *, min(pair_at) OVER (PARTITION BY profile_id, task_id, from_type) AS from_at FROM c) SELECT profile_id, task_id, from_type, to_type, n FROM d QUALIFY row_number() OVER (PARTITION BY profile_id, task_id ORDER BY n DESC, from_at, pair_at) = 1")
def dominant_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return sq.dominant_transition(behavioural(events(spark, sf)))


PHASES = TRACE + """, c AS (SELECT profile_id, task_id, seq, CASE WHEN event_type IN ('file_read', 'file_browse', 'file_search') THEN 'exploration' WHEN event_type IN ('file_write', 'file_edit') THEN 'production' WHEN event_type IN ('file_move', 'file_rename', 'dir_create', 'file_delete', 'file_copy') THEN 'organization' ELSE 'other' END AS phase,
  (row_number() OVER (PARTITION BY profile_id, task_id ORDER BY seq) - 1) // 5 AS block FROM b),
 n AS (SELECT profile_id, task_id, block, phase, count(*) AS n, min(seq) AS since FROM c GROUP BY ALL),
 k AS (SELECT *, sum(n) OVER (PARTITION BY profile_id, task_id, block) AS events FROM n QUALIFY row_number() OVER (PARTITION BY profile_id, task_id, block ORDER BY CAST(phase = 'other' AS INT), n DESC, since) = 1),
 i AS (SELECT *, CASE WHEN lag(phase) OVER w = phase THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY profile_id, task_id ORDER BY block)),
 j AS (SELECT *, sum(fresh) OVER (PARTITION BY profile_id, task_id ORDER BY block) AS phase_no FROM i),
 ph AS (SELECT profile_id, task_id, CAST(phase_no AS BIGINT) AS phase_no, phase, CAST(sum(events) AS BIGINT) AS events, count(*) AS blocks FROM j GROUP BY ALL)
"""


@query("WITH " + PHASES + "SELECT * FROM ph")
def phase_islands(spark: SparkSession, sf: str) -> DataFrame:
    return sq.phases(behavioural(events(spark, sf)))


#: Two sessions of half of all events each.
HALVES = TRACE + ", o AS (SELECT CAST(profile_id % 2 AS INTEGER) AS half, event_type, file_path, row_number() OVER (PARTITION BY profile_id % 2 ORDER BY ts_ms, event_id) AS seq FROM b)"


def _halves(spark: SparkSession, sf: str) -> DataFrame:
    rows = behavioural(mapped(spark.read.parquet(f"{sf}/events.parquet")))
    return sc.placed(rows.withColumn("half", (F.col("profile_id") % 2).cast("int")), ["half"], ["ts_ms", "event_id"])


@query("WITH " + HALVES + ", p AS (SELECT half, lag(event_type) OVER (PARTITION BY half ORDER BY seq) AS from_type, event_type AS to_type FROM o) SELECT half, from_type, to_type, count(*) AS n FROM p WHERE from_type IS NOT NULL GROUP BY ALL")
def long_session_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return sc.transitions(_halves(spark, sf), ["half"]).groupBy("half", "from_type", "to_type").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + HALVES + """, c AS (SELECT half, seq, CASE WHEN event_type IN ('file_read', 'file_browse', 'file_search') THEN 'exploration' WHEN event_type IN ('file_write', 'file_edit') THEN 'production' WHEN event_type IN ('file_move', 'file_rename', 'dir_create', 'file_delete', 'file_copy') THEN 'organization' ELSE 'other' END AS phase, (seq - 1) // 5 AS five FROM o),
 n AS (SELECT half, five, phase, count(*) AS n, min(seq) AS since FROM c GROUP BY ALL),
 k AS (SELECT *, sum(n) OVER (PARTITION BY half, five) AS events FROM n QUALIFY row_number() OVER (PARTITION BY half, five ORDER BY CAST(phase = 'other' AS INT), n DESC, since) = 1),
 i AS (SELECT *, CASE WHEN lag(phase) OVER (PARTITION BY half ORDER BY five) = phase THEN 0 ELSE 1 END AS fresh FROM k),
 j AS (SELECT *, sum(fresh) OVER (PARTITION BY half ORDER BY five) AS phase_no FROM i)
 SELECT half, CAST(phase_no AS BIGINT) AS phase_no, phase, CAST(sum(events) AS BIGINT) AS events, count(*) AS blocks FROM j GROUP BY ALL""")
def long_session_phases(spark: SparkSession, sf: str) -> DataFrame:
    return sc.phases(_halves(spark, sf), ["half"])


@query("WITH " + HALVES + ", r AS (SELECT half, seq, file_path AS to_file, lag(file_path) OVER (PARTITION BY half ORDER BY seq) AS from_file FROM o WHERE event_type = 'file_read') SELECT half, seq, from_file, to_file, row_number() OVER (PARTITION BY half ORDER BY seq) AS switch_count FROM r WHERE from_file <> to_file")
def long_session_switches(spark: SparkSession, sf: str) -> DataFrame:
    return sc.context_switches(_halves(spark, sf), ["half"])


@query("WITH " + PHASES + "SELECT profile_id, task_id, count(*) AS n_phases, string_agg(phase, ' -> ' ORDER BY phase_no) AS pattern FROM ph GROUP BY ALL")
def phase_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return sq.phase_summary(sq.phases(behavioural(events(spark, sf))))


@query("WITH " + PHASES + ", s AS (SELECT profile_id, phase, CAST(sum(events) AS BIGINT) AS events FROM ph GROUP BY ALL) SELECT * FROM s")
def phase_totals(spark: SparkSession, sf: str) -> DataFrame:
    return sq.phases(behavioural(events(spark, sf))).groupBy("profile_id", "phase").agg(F.sum("events").alias("events"))


@query("WITH " + TRACE + ", e AS (SELECT profile_id, task_id, seq, file_path AS dst, lag(file_path) OVER (PARTITION BY profile_id, task_id ORDER BY seq) AS src FROM b WHERE file_path IS NOT NULL) SELECT profile_id, src, dst, count(*) AS n FROM e WHERE src <> dst GROUP BY ALL")
def file_access_edges(spark: SparkSession, sf: str) -> DataFrame:
    return sq.access_edges(behavioural(events(spark, sf))).groupBy("profile_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + TRACE + "SELECT profile_id, task_id, seq, file_path, row_number() OVER w AS views, ts_ms - lag(ts_ms) OVER w AS revisit_ms FROM tr WHERE event_type = 'file_read' WINDOW w AS (PARTITION BY profile_id, task_id, file_path ORDER BY seq)")
def view_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sq.views(events(spark, sf)).withColumns({c: F.col(c).cast("long") for c in ("seq", "views")})


@query("WITH " + TRACE + ", r AS (SELECT profile_id, task_id, seq, file_path AS to_file, lag(file_path) OVER (PARTITION BY profile_id, task_id ORDER BY seq) AS from_file FROM tr WHERE event_type = 'file_read') SELECT *, row_number() OVER (PARTITION BY profile_id, task_id ORDER BY seq) AS switch_count FROM r WHERE from_file <> to_file")
def context_switches(spark: SparkSession, sf: str) -> DataFrame:
    return sq.context_switches(events(spark, sf)).withColumns({c: F.col(c).cast("long") for c in ("seq", "switch_count")})


@query("WITH " + TRACE + ", r AS (SELECT profile_id, task_id, seq, event_type, file_path, ts_ms // 10000 AS now FROM tr WHERE event_type IN ('file_read', 'file_edit')), l AS (SELECT *, lag(event_type) OVER w AS le, lag(file_path) OVER w AS lp, lag(now) OVER w AS ln FROM r WINDOW w AS (PARTITION BY profile_id, task_id ORDER BY seq)) SELECT profile_id, task_id, seq, lp AS source_file, file_path AS target_file, CASE WHEN le = 'file_read' AND event_type = 'file_edit' THEN 'read_then_edit' ELSE 'sequential_access' END AS reference_type, now - ln AS interval_ms FROM l WHERE lp <> file_path AND now - ln <= 30000")
def cross_file_references(spark: SparkSession, sf: str) -> DataFrame:
    return sq.cross_file_references(events(spark, sf), clock=10_000).withColumn("seq", F.col("seq").cast("long"))


@query("WITH " + TRACE + ", i AS (SELECT *, sum(CAST(event_type = 'file_browse' AS INT)) OVER (PARTITION BY profile_id, task_id ORDER BY seq) AS iteration FROM tr) SELECT profile_id, task_id, CAST(iteration AS BIGINT) AS iteration, count(*) FILTER (event_type = 'file_read') AS tools_called, coalesce(bool_or(event_type = 'error_encounter'), false) AS has_error FROM i GROUP BY ALL")
def iteration_counters(spark: SparkSession, sf: str) -> DataFrame:
    is_ = lambda k: F.col("event_type") == k
    return sq.iterations(events(spark, sf), is_("file_browse"), is_("file_read"), is_("error_encounter"))


@query("WITH " + TRACE + "SELECT profile_id, task_id, seq, row_number() OVER (PARTITION BY profile_id, task_id ORDER BY seq) AS sequence_position FROM tr WHERE event_type = 'file_search'")
def sequence_positions(spark: SparkSession, sf: str) -> DataFrame:
    return sq.running_number(events(spark, sf), "file_search").select(*KEY, F.col("seq").cast("long").alias("seq"), F.col("sequence_position").cast("long").alias("sequence_position"))


@query("WITH " + TRACE + ", c AS (SELECT profile_id, task_id, seq, (row_number() OVER (PARTITION BY profile_id, task_id ORDER BY seq) - 1) // 20 AS chunk FROM b) SELECT profile_id, task_id, chunk, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM c GROUP BY ALL")
def event_chunks(spark: SparkSession, sf: str) -> DataFrame:
    out = sq.chunks(behavioural(events(spark, sf))).groupBy(*KEY, "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("seq").cast("long").alias("first_seq"), F.max("seq").cast("long").alias("last_seq"))
    return out


@query("WITH " + TRACE + ", a AS (SELECT profile_id, task_id, seq, row_number() OVER (PARTITION BY profile_id, task_id ORDER BY seq) - 1 AS pos FROM b), w AS (SELECT *, unnest(range(greatest(0, CAST(ceil((pos - 29) / 27) AS BIGINT)), pos // 27 + 1)) AS window_no FROM a) SELECT profile_id, task_id, window_no, count(*) AS n, min(seq) AS first_seq FROM w GROUP BY ALL")
def overlapping_windows(spark: SparkSession, sf: str) -> DataFrame:
    return sq.overlapping(behavioural(events(spark, sf))).groupBy(*KEY, "window_no").agg(F.count(F.lit(1)).alias("n"), F.min("seq").cast("long").alias("first_seq"))


@query("WITH " + TRACE + ", a AS (SELECT *, sum(CAST(event_type = 'file_search' AS INT)) OVER (PARTITION BY profile_id, task_id ORDER BY seq) AS r FROM b), s AS (SELECT *, min(r) OVER (PARTITION BY profile_id, task_id) AS r0, count(*) OVER (PARTITION BY profile_id, task_id, r) AS size, lag(r) OVER (PARTITION BY profile_id, task_id ORDER BY seq) AS lr FROM a), o AS (SELECT *, CASE WHEN lr <> r AND r <> r0 AND size >= 3 THEN 1 ELSE 0 END AS opens FROM s), g AS (SELECT *, least(sum(opens) OVER (PARTITION BY profile_id, task_id ORDER BY seq), 4) AS segment FROM o) SELECT profile_id, task_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(seq) AS first_seq FROM g GROUP BY ALL")
def boundary_segments(spark: SparkSession, sf: str) -> DataFrame:
    out = sq.segments(behavioural(events(spark, sf)), F.col("event_type") == "file_search")
    return out.groupBy(*KEY, "segment").agg(F.count(F.lit(1)).alias("n"), F.min("seq").cast("long").alias("first_seq"))


@query("WITH " + TRACE + ", a AS (SELECT *, sum(CAST(event_type = 'file_search' AS INT)) OVER (PARTITION BY profile_id, task_id ORDER BY seq) AS r FROM tr), g AS (SELECT *, dense_rank() OVER (PARTITION BY profile_id, task_id ORDER BY r) - 1 AS segment FROM a WHERE event_type <> 'file_search') SELECT profile_id, task_id, segment, count(*) AS n FROM g GROUP BY ALL")
def switch_segments(spark: SparkSession, sf: str) -> DataFrame:
    return sq.split_at(events(spark, sf), "file_search").groupBy(*KEY, F.col("segment").cast("long").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + TRACE + "SELECT profile_id, task_id, arg_min(event_type, seq) AS first_action FROM b GROUP BY ALL")
def first_actions(spark: SparkSession, sf: str) -> DataFrame:
    return sq.first_action(behavioural(events(spark, sf)))


@query("WITH " + TRACE + "SELECT profile_id, task_id, count(*) AS total_events, max(ts_ms) - min(ts_ms) AS duration_ms, count(DISTINCT file_path) FILTER (event_type = 'file_read') AS files_read, count(DISTINCT file_path) FILTER (event_type IN ('file_edit', 'file_write')) AS files_modified, count(*) FILTER (operation = 'create') AS files_created, count(*) FILTER (event_type = 'file_delete') AS files_deleted, count(*) FILTER (event_type IN ('file_rename', 'file_move')) AS files_renamed, CAST(coalesce(sum(lines_added) FILTER (event_type = 'file_edit'), 0) AS BIGINT) AS lines_added, CAST(coalesce(sum(lines_deleted) FILTER (event_type = 'file_edit'), 0) AS BIGINT) AS lines_deleted, count(*) FILTER (event_type = 'error_encounter') AS errors FROM tr GROUP BY ALL")
def session_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return pf.session_summary(events(spark, sf))


@query("WITH " + TRACE + ", p AS (SELECT DISTINCT profile_id, file_path FROM tr WHERE file_path IS NOT NULL) SELECT profile_id, count(*) AS total_files, max(len(list_filter(string_split(file_path, '/'), lambda x: x <> '')) - 1) AS max_depth, count(DISTINCT regexp_extract(file_path, '\\.([^.]+)$', 1)) AS types FROM p GROUP BY profile_id")
def snapshot_totals(spark: SparkSession, sf: str) -> DataFrame:
    return pf.snapshot(events(spark, sf), ["profile_id"]).withColumn("max_depth", F.col("max_depth").cast("long"))


@query("WITH " + TRACE + ", s AS (SELECT profile_id, file_path, min(ts_ms) AS first_at FROM b WHERE file_path IS NOT NULL GROUP BY ALL) SELECT profile_id, file_path, first_at, row_number() OVER (PARTITION BY profile_id ORDER BY first_at, file_path) AS position FROM s")
def first_seen_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = behavioural(events(spark, sf)).where(F.col("file_path").isNotNull())
    return pf.first_seen(rows, ["profile_id"], "file_path", "ts_ms").withColumn("position", F.col("position").cast("long"))
