"""Features of trajectories: one wide conditional aggregation per table, in one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.config import IMAGE_TYPES, PRIMARY_TYPES, SIMULATION_TYPES, STRUCTURED_OUTPUT_TYPES, STRUCTURED_TYPES
from tracewell.functions.paths import stem
from tracewell.sources.traces import KEY

TABLE_ROW = r"(?md)^\|.*\|"


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _per(x: Column, n: Column) -> Column:
    return x / F.greatest(n, F.lit(1))


def created() -> Column:
    return _is("file_write") & (F.col("operation") == "create")


def changed() -> Column:
    return F.col("lines_added") + F.col("lines_deleted")


def kind_of() -> Column:
    return F.coalesce(F.nullif(F.col("file_type"), F.lit("")), F.lit("unknown"))


def distinct(x: Column) -> Column:
    """Distinct values within a group: a set per group costs less here than a second aggregation with its expansion of rows."""
    return F.size(F.collect_set(x)).cast("long")


def _listed(kinds) -> str:  # noqa: ANN001
    return ", ".join(f"'{k}'" for k in sorted(kinds))


def aggregates(sets: bool = False) -> dict[str, str]:
    """Columns of ``trajectory_features`` before ratios, in SQL (a call each to the JVM, where columns would take hundreds); all over one pass of a trajectory's rows."""
    created, changed, kind = "event_type = 'file_write' AND operation = 'create'", "lines_added + lines_deleted", "coalesce(nullif(file_type, ''), 'unknown')"
    n = lambda c: f"count_if({c})"
    is_ = lambda k: f"event_type = '{k}'"
    of = lambda f, c, x, empty: f"coalesce({f}(CASE WHEN {c} THEN {x} END), {empty})"
    distinct = lambda c, x: (f"CAST(size(collect_set(CASE WHEN {c} THEN {x} END)) AS BIGINT)" if sets else f"count(DISTINCT CASE WHEN {c} THEN {x} END)")
    return {
        "total_reads": n(is_("file_read")),
        "total_browses": n(is_("file_browse")),
        "total_searches": n(is_("file_search")),
        "_revisits": n(is_("file_read") + " AND view_count > 1"),
        "_switches": n(is_("context_switch")),
        "avg_content_length": of("avg", is_("file_read"), "content_length", "0.0D"),
        "unique_files_read": distinct(is_("file_read"), "file_path"),
        "files_created": n(created),
        "total_output_chars": of("sum", created, "content_length", "0"),
        "avg_output_length": of("avg", created, "content_length", "0.0D"),
        "max_output_length": of("max", created, "content_length", "0"),
        "output_length_std": of("stddev_samp", created, "content_length", "0.0D"),
        "has_markdown": f"coalesce(bool_or({created} AND {kind} = 'md'), false)",
        "_structured_kinds": n(f"{created} AND {kind} IN ({_listed(STRUCTURED_OUTPUT_TYPES)})"),
        "distinct_file_types": distinct(created, kind),
        "markdown_table_rows": of("sum", created, f"regexp_count(content, r'{TABLE_ROW}')", "0"),
        "dirs_created": n(is_("dir_create")),
        "max_dir_depth": of("max", is_("dir_create"), "depth", "0"),
        "avg_dir_depth": of("avg", is_("dir_create"), "depth", "0.0D"),
        "files_moved": n(is_("file_move")),
        "avg_filename_length": "coalesce(avg(length(_name)), 0.0D)",
        "has_date_prefix": r"coalesce(bool_or(regexp_like(_name, r'^\d{4}[-_]?\d{2}[-_]?\d{2}')), false)",
        "has_numeric_prefix": r"coalesce(bool_or(regexp_like(_name, r'^\d{1,3}[-_]')), false)",
        "has_underscores": "coalesce(bool_or(contains(_name, '_')), false)",
        "has_hyphens": "coalesce(bool_or(contains(_name, '-')), false)",
        "avg_word_count": r"coalesce(avg(CASE WHEN _name IS NOT NULL THEN size(filter(split(_name, r'[-_.\s]+'), w -> w <> '')) END), 0.0D)",
        "total_renames": n(is_("file_rename")),
        "total_edits": n(is_("file_edit")),
        "avg_lines_changed": of("avg", is_("file_edit"), changed, "0.0D"),
        "max_lines_changed": of("max", is_("file_edit"), changed, "0"),
        "_edited": distinct(is_("file_edit"), "file_path"),
        "_small": n(f"{is_('file_edit')} AND {changed} < 10"),
        "total_copies": n(is_("file_copy")),
        "backup_copies": n(is_("file_copy") + " AND is_backup"),
        "total_deletes": n(is_("file_delete")),
        "total_overwrites": n("event_type = 'file_write' AND operation = 'overwrite'"),
        "structured_files_created": n(f"{created} AND {kind} IN ({_listed(STRUCTURED_TYPES)})"),
        "primary_files_created": n(f"{created} AND {kind} IN ({_listed(PRIMARY_TYPES)})"),
        "image_files_created": n(f"{created} AND {kind} IN ({_listed(IMAGE_TYPES)})"),
        "n_behavioural": n(f"event_type NOT IN ({_listed(SIMULATION_TYPES)})"),
        "n_events": "count(1)",
    }


#: Columns that come of the aggregates of one trajectory.
DERIVED = {
    "browse_ratio": "total_browses / greatest(total_reads + total_browses + total_searches, 1)",
    "search_ratio": "total_searches / greatest(total_reads + total_browses + total_searches, 1)",
    "read_ratio": "total_reads / greatest(total_reads + total_browses + total_searches, 1)",
    "revisit_ratio": "_revisits / greatest(total_reads, 1)",
    "context_switch_rate": "_switches / greatest(total_reads, 1)",
    "has_structured_data": "_structured_kinds > 0 OR markdown_table_rows > 0",
    "has_markdown_tables": "markdown_table_rows > 0",
    "edits_per_file": "total_edits / greatest(_edited, 1)",
    "small_edit_ratio": "_small / greatest(total_edits, 1)",
    "has_backup_behavior": "backup_copies > 0",
    "delete_to_create_ratio": "total_deletes / greatest(files_created, 1)",
    "supplementary_ratio": "structured_files_created / greatest(files_created, 1)",
    "has_tables_or_data": "structured_files_created > 0 OR markdown_table_rows > 0",
    "has_images": "image_files_created > 0",
    "verbosity": "total_output_chars / greatest(files_created, 1)",
}


def trajectory_features(trace: DataFrame, recorded_views: bool = True, sets: bool = False) -> DataFrame:
    """All counting features of each trajectory; simulation events count in n_events only.

    Revisits are reads with a view_count above 1. Without ``recorded_views`` all
    reads of a path but its first count, which is the same where view_count was
    counted from the trace itself, and needs no order of the rows. With
    ``sets``, the paths of a trajectory are held in a set, which takes half the
    time of a second aggregation with its expansion of rows.
    """
    made = aggregates(sets)
    if not recorded_views:
        made["_revisits"] = f"{made['total_reads']} - count_if(event_type = 'file_read' AND file_path IS NULL) - {made['unique_files_read']}"
    rows = trace.withColumn("_name", F.when(created() & (F.col("file_path") != ""), stem(F.col("file_path"))))
    df = rows.groupBy(*KEY).agg(*(F.expr(c).alias(k) for k, c in made.items()))
    kept = [*KEY, *(k for k in made if not k.startswith("_"))]
    return df.selectExpr(*kept, *(f"{c} AS {k}" for k, c in DERIVED.items()))


def work_rhythm(events: DataFrame) -> DataFrame:
    """Iterations, mean tools and share with errors, and context switches, over all events."""
    end = _is("iteration_end")
    return events.groupBy(*KEY).agg(
        F.count_if(end).alias("total_iterations"),
        F.coalesce(F.avg(F.when(end, F.coalesce("tools_called", F.lit(0)))), F.lit(0.0)).alias("avg_tools_per_iteration"),
        F.coalesce(F.avg(F.when(end, F.coalesce("has_tool_error", F.lit(False)).cast("int"))), F.lit(0.0)).alias("error_rate"),
        F.count_if(_is("context_switch")).alias("total_context_switches"),
    )


def file_type_histogram(trace: DataFrame) -> DataFrame:
    """(profile_id, task_id, file_type, n) of created files."""
    return trace.where(created()).groupBy(*KEY, kind_of().alias("file_type")).agg(F.count(F.lit(1)).alias("n"))


def tone(trace: DataFrame, text: str = "content") -> DataFrame:
    """Headings, tables, lists and prose of created texts, per trajectory."""
    x = F.col(text)
    lines = F.split(x, "\n")
    trimmed = lambda c: F.trim(c)
    lead = r"^([-*+]|\d+\.)\s"
    prose = F.size(F.filter(lines, lambda s: (F.length(trimmed(s)) > 20) & ~F.startswith(trimmed(s), F.lit("#")) & ~F.startswith(trimmed(s), F.lit("|")) & ~F.regexp_like(trimmed(s), F.lit(lead))))
    rows = trace.where(created() & x.isNotNull() & (x != "")).select(
        *KEY,
        F.regexp_count(x, F.lit(r"(?md)^(#{1,6})\s")).alias("headings"),
        F.coalesce(F.array_max(F.transform(F.regexp_extract_all(x, F.lit(r"(?md)^(#{1,6})\s"), F.lit(1)), F.length)), F.lit(0)).alias("depth"),
        F.regexp_count(x, F.lit(TABLE_ROW)).alias("tables"),
        (F.regexp_count(x, F.lit(r"(?md)^\s*[-*+]\s")) + F.regexp_count(x, F.lit(r"(?md)^\s*\d+\.\s"))).alias("lists"),
        F.size(F.filter(F.split(x, r"[.!?。！？]\s"), lambda s: F.trim(s) != "")).alias("sentences"),
        F.size(F.filter(F.split(x, r"\s+"), lambda s: s != "")).alias("words"),
        prose.alias("prose"),
    )
    out = rows.groupBy(*KEY).agg(*(F.sum(c).alias(n) for c, n in (("headings", "heading_count"), ("tables", "table_rows"), ("lists", "list_items"), ("sentences", "sentences"), ("words", "words"), ("prose", "prose_lines"))), F.max("depth").alias("heading_max_depth"))
    structure = F.col("heading_count") + F.col("table_rows") + F.col("list_items")
    return out.withColumn("words_per_sentence", _per(F.col("words"), F.col("sentences"))).withColumn("prose_to_structure_ratio", _per(F.col("prose_lines"), structure))


def created_files(trace: DataFrame, preview: int = 500) -> DataFrame:
    """Semantic channel, created files: path, length, preview and full text."""
    return trace.where(created()).select(*KEY, "seq", "file_path", "content_length", F.substring("content", 1, preview).alias("preview"), "content")


def edit_previews(trace: DataFrame, preview: int = 300) -> DataFrame:
    """Semantic channel, edits: the stored diff if there is one, else the content."""
    text = F.coalesce(F.col("diff"), F.col("content")) if "diff" in trace.columns else F.col("content")
    return trace.where(_is("file_edit")).select(*KEY, "seq", "file_path", F.substring(text, 1, preview).alias("preview"))


def new_directories(first: Column, last: Column) -> Column:
    """Entries of the last snapshot that the first hasn't, sorted."""
    return F.array_sort(F.array_except(last, first))


def cross_references(trace: DataFrame) -> DataFrame:
    return trace.where(_is("cross_file_reference")).select(*KEY, "seq", "source_file", "target_file", "reference_type")


def importance(features: DataFrame) -> DataFrame:
    """Density of behavioural events times one plus the share of the nine attributes with anything above 0."""
    groups = {
        "reading_strategy": ("total_reads", "total_browses", "total_searches"),
        "output_detail": ("files_created", "total_output_chars"),
        "output_structure": ("distinct_file_types", "markdown_table_rows"),
        "directory_style": ("dirs_created", "files_moved"),
        "naming": ("avg_filename_length", "total_renames"),
        "edit_strategy": ("total_edits",),
        "version_strategy": ("total_copies", "total_deletes", "total_overwrites"),
        "tone": ("heading_count", "words"),
        "cross_modal_behavior": ("structured_files_created", "primary_files_created", "image_files_created", "markdown_table_rows"),
    }
    active = F.lit(0)
    for columns in groups.values():
        there = [F.coalesce(F.col(c), F.lit(0)) > 0 for c in columns if c in features.columns]
        if there:
            any_ = there[0]
            for x in there[1:]:
                any_ = any_ | x
            active = active + any_.cast("int")
    return features.withColumn("importance", F.col("n_behavioural") / F.greatest("n_events", F.lit(1)) * (1 + active / 9))
