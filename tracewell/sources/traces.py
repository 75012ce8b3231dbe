"""Trace tables: from session folders of JSON files, or from any event table by a spec.

The canonical trace has one row per event: profile_id, task_id, seq (position
within the trajectory, assigned before any filter), ts_ms, event_type and the
payload columns of ``PAYLOAD``, nulls replaced by defaults where a type has any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import ACCEPTED_TYPES, SIMULATION_TYPES
from tracewell.functions.paths import extension

REF = "struct<type:string,hash:string,path:string>"
EVENT = f"""
    event_id string, event_type string, timestamp double, session_id string, profile_id string, message_id string,
    model_provider string, model_name string, file_path string, file_type string, directory_depth int, view_count int,
    view_range array<int>, content_length long, revisit_interval_ms long, operation string, before_hash string, after_hash string,
    media_ref {REF}, media_ref_old {REF}, media_ref_new {REF}, media_ref_diff {REF}, diff_media {REF},
    edit_tool string, lines_added int, lines_deleted int, lines_modified int, diff_summary string,
    search_type string, query string, files_matched int, files_opened_after array<string>,
    directory_path string, files_listed int, depth int, old_path string, new_path string, naming_pattern_change string,
    destination_directory_depth int, dir_path string, sibling_count int, file_age_ms long, was_temporary boolean,
    source_path string, dest_path string, is_backup boolean, file_count_by_type map<string,int>, max_depth int, total_files int,
    directory_tree string, from_file string, to_file string, trigger string, switch_count int, source_file string, target_file string,
    reference_type string, interval_ms long, tool_name string, tool_parameters string, execution_time_ms double, success boolean,
    error_type string, error_message string, retry_count int, sequence_position int, iteration_number int, duration_ms double,
    tools_called int, has_tool_error boolean, response_time_ms double, input_tokens long, output_tokens long, stop_reason string,
    context string, severity string, strategy string, latency_ms double, resolution_successful boolean
"""
KEY = ("profile_id", "task_id")


def _session(df: DataFrame) -> DataFrame:
    """Adds profile_id and task_id from the folder, ``{profile}_{task}``; tasks hold no underscore but in names like t01_x."""
    folder = F.regexp_extract(F.col("_file"), r"([^/=]+)/[^/]+$", 1)  # the value alone of folders like of=p1_t3
    return df.withColumn("_profile", F.regexp_extract(folder, r"^(.*?)_(t?\d+.*)$", 1)).withColumn("_task", F.regexp_extract(folder, r"^(.*?)_(t?\d+.*)$", 2)).withColumn("trajectory_id", folder)


def packed_files(spark: SparkSession, root: str, name: str | None = None, start: str = "") -> DataFrame:
    """(_file, value) of the files called ``name`` whose path begins with ``start``, from a packed folder (see ``storage.pack``)."""
    rows = spark.read.schema("path string, value string").parquet(root)
    if start:
        rows = rows.where(F.startswith("path", F.lit(start)))
    if name:
        rows = rows.where(F.endswith("path", F.lit(f"/{name}")))
    return rows.select(F.col("path").alias("_file"), "value")


def _objects(spark: SparkSession, path: str, schema: str, packed: bool) -> DataFrame:
    """The JSON objects of files of one each, with the columns of ``schema``."""
    if packed:
        return packed_files(spark, path).select(F.from_json("value", schema).alias("o")).select("o.*")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_events(spark: SparkSession, root: str, profile_id: str | None = None, name: str = "events.json", packed: bool = False) -> DataFrame:
    """Events of all sessions below ``root``, or one profile's; array position becomes seq.

    A folder for each session is how they are recorded; the driver lists them
    all, so that many sessions are better ``packed`` first.
    """
    if packed:
        raw = packed_files(spark, root, name, f"{profile_id}_" if profile_id else "")
    else:
        path = f"{root}/{f'{{,*=}}{profile_id}_' if profile_id else ''}*/{name}"
        raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    rows = _session(raw).select("_profile", "_task", "trajectory_id", F.posexplode(F.from_json("value", f"array<struct<{_fields()}>>", {"mode": "PERMISSIVE"})).alias("seq", "e"))
    return rows.select(F.col("_profile").alias("profile_id"), F.col("_task").alias("task_id"), "trajectory_id", "seq", *(F.col(f"e.{c}").alias(c) for c in _names() if c != "profile_id"))


def _fields() -> str:
    return ",".join(f"{a.split(None, 1)[0]}:{a.split(None, 1)[1]}" for a in _columns())


def _columns() -> list[str]:
    out, depth, now = [], 0, ""
    for c in " ".join(EVENT.split()):
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def _names() -> list[str]:
    return [c.split()[0] for c in _columns()]


def read_session_files(spark: SparkSession, root: str, name: str, schema: str, packed: bool = False) -> DataFrame:
    """One JSON object per session (summary.json, perturbation.json, manifest.json), with its keys; absent files give no row."""
    if packed:
        df = packed_files(spark, root, name).select(F.regexp_replace("_file", "/media/manifest.json$", "/manifest.json").alias("_file"), F.from_json("value", schema).alias("o")).select("_file", "o.*")
        return _session(df).drop("_file").withColumnsRenamed({"_profile": "profile_id", "_task": "task_id"})
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", name.rsplit("/", 1)[-1]).option("recursiveFileLookup", True).json(root)
    df = df.withColumn("_file", F.regexp_replace(F.col("_metadata.file_path"), "/media/manifest.json$", "/manifest.json"))
    return _session(df).drop("_file").withColumnsRenamed({"_profile": "profile_id", "_task": "task_id"})


def read_media(spark: SparkSession, root: str) -> DataFrame:
    """(trajectory_id, path, text) of stored blobs and diffs; bytes that are no UTF-8 give null."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{blob,diff}").load(root)
    return df.select(F.regexp_extract("path", r"([^/]+)/media/", 1).alias("trajectory_id"), F.regexp_extract("path", r"[^/]+/(media/.*)$", 1).alias("path"), F.expr("try_validate_utf8(content)").alias("text"))


def resolve_media(events: DataFrame, media: DataFrame) -> DataFrame:
    """Joins referenced texts: content, content_old, content_new and diff (of either producer's name)."""
    refs = {"content": "media_ref", "content_old": "media_ref_old", "content_new": "media_ref_new", "diff": "media_ref_diff"}
    for out, ref in refs.items():
        at = F.coalesce(F.col("media_ref_diff.path"), F.col("diff_media.path")) if ref == "media_ref_diff" else F.col(f"{ref}.path")
        side = media.select(F.col("trajectory_id"), F.col("path").alias("_path"), F.col("text").alias(out))
        events = events.withColumn("_path", at).join(side, ["trajectory_id", "_path"], "left").drop("_path")
    return events


def filtered(events: DataFrame, summaries: DataFrame, perturbations: DataFrame, with_perturbed: bool = True, strip_content: bool = False) -> DataFrame:
    """Events of complete trajectories (no summary counts as complete), flagged by perturbation."""
    done = summaries.select(*KEY, F.coalesce("completed", F.lit(True)).alias("completed"))
    out = events.join(done, list(KEY), "left").where(F.coalesce("completed", F.lit(True))).drop("completed")
    out = with_labels(out, perturbations)
    if not with_perturbed:
        out = out.where(~F.col("is_perturbed"))
    return out.drop("content", "content_old", "content_new", "diff") if strip_content else out


def with_labels(events: DataFrame, perturbations: DataFrame) -> DataFrame:
    """Left join of the perturbation labels; none means not perturbed."""
    labels = perturbations.select(*KEY, F.col("applied").alias("is_perturbed"))
    return events.join(labels, list(KEY), "left").withColumn("is_perturbed", F.coalesce("is_perturbed", F.lit(False)))


def complete_sessions(events: DataFrame) -> DataFrame:
    """Keys of the trajectories with a session_end event."""
    return events.where(F.col("event_type") == "session_end").select(*KEY).distinct()


def profile_matrix(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(profile_id, dim, tier) of a profile matrix file."""
    df = _objects(spark, path, "profiles map<string,struct<name:string,role:string,language:string,dimensions:map<string,string>>>", packed)
    return df.select(F.explode("profiles").alias("profile_id", "p")).select("profile_id", F.explode("p.dimensions").alias("dim", "tier"))


def tasks(spark: SparkSession, path: str) -> DataFrame:
    schema = "task_id string, type string, dimensions array<string>, observable_attributes map<string,string>, expected_file_ops int, depends_on string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def annotations(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(rater, profile_id, dim, tier, confidence) of annotation files; confidence may be null."""
    df = _objects(spark, path, "annotator string, profile_id string, dimensions map<string,struct<value:string,confidence:int>>", packed)
    return df.select(F.col("annotator").alias("rater"), "profile_id", F.explode("dimensions").alias("dim", "d")).select("rater", "profile_id", "dim", F.col("d.value").alias("tier"), F.col("d.confidence").alias("confidence"))


def ground_truth(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """(profile_id, attribute, value) of profile documents (parsed YAML, a few dozen); output_detail falls back to verbosity."""
    rows = []
    for d in documents:
        flat = {k: v for section in (d.get("basic", {}), d.get("personality", {}), d.get("work_habits", {})) for k, v in section.items() if isinstance(v, str)}
        flat.setdefault("output_detail", flat.get("verbosity"))
        rows += [(d["profile_id"], k, v) for k, v in flat.items() if v is not None]
    return spark.createDataFrame(rows, "profile_id string, attribute string, value string")


def profile_documents(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(profile_id, attribute, value) of profile documents of two levels in YAML, any number of files.

    Values of the sections basic, personality and work_habits that are plain
    or quoted strings; lists, and what follows a `` #``, are left out.
    output_detail falls back to verbosity.
    """
    texts = packed_files(spark, path) if packed else spark.read.text(path, wholetext=True)
    lines = texts.select(F.monotonically_increasing_id().alias("_doc"), F.split("value", "\\r?\\n").alias("lines"))
    head = r"^profile_id:\s*(\S+)"
    name = F.element_at(F.filter(F.transform("lines", lambda x: F.regexp_extract(x, head, 1)), lambda x: x != ""), 1)
    step = F.struct(F.lit("").alias("section"), F.array().cast("array<struct<attribute:string,value:string>>").alias("found"))

    def read(acc: Column, x: Column) -> Column:
        section = F.regexp_extract(x, r"^(\w+):", 1)
        key = F.regexp_extract(x, r"^\s+(\w+):\s*\S", 1)
        raw = F.trim(F.regexp_replace(F.regexp_extract(x, r"^\s+\w+:\s*(.*)$", 1), r"\s+#.*$", ""))
        value = F.regexp_replace(raw, "^([\"'])(.*)\\1$", "$2")
        here = acc["section"].isin("basic", "personality", "work_habits") & (key != "") & ~F.startswith(raw, F.lit("["))
        found = F.when(here, F.concat(acc["found"], F.array(F.struct(key.alias("attribute"), value.alias("value"))))).otherwise(acc["found"])
        return F.struct(F.when(section != "", section).otherwise(acc["section"]).alias("section"), found.alias("found"))

    rows = lines.select(name.alias("profile_id"), F.aggregate("lines", step, read, lambda acc: acc["found"]).alias("found"))
    given = F.filter("found", lambda x: x["attribute"] == "output_detail")
    fallback = F.transform(F.filter("found", lambda x: x["attribute"] == "verbosity"), lambda x: F.struct(F.lit("output_detail").alias("attribute"), x["value"].alias("value")))
    every = F.when(F.size(given) > 0, F.col("found")).otherwise(F.concat("found", fallback))
    return rows.select("profile_id", F.explode(every).alias("a")).select("profile_id", "a.attribute", "a.value")


def normalise(events: DataFrame) -> DataFrame:
    """Accepted event types with unified paths and defaults; seq must be there already. Null and missing are alike."""
    df = events.where(F.col("event_type").isin(*ACCEPTED_TYPES))
    path = F.coalesce("file_path", "directory_path", "dir_path", "new_path", "dest_path", F.lit(""))
    kind = F.coalesce(F.nullif(F.col("file_type"), F.lit("")), F.lit("unknown"))
    return df.withColumns({
        "source_file": F.coalesce("source_file", "source_path", "old_path", F.lit("")),
        "target_file": F.coalesce("target_file", "dest_path", "new_path", F.lit("")),
        "file_path": path,
        "file_type": kind,
        "operation": F.coalesce("operation", F.lit("")),
        **{c: F.coalesce(c, F.lit(0)) for c in ("content_length", "view_count", "lines_added", "lines_deleted", "files_matched", "files_listed", "depth", "max_depth", "tools_called")},
        **{c: F.coalesce(c, F.lit(False)) for c in ("is_backup", "has_tool_error", "was_temporary")},
    })


def behavioural(trace: DataFrame) -> DataFrame:
    return trace.where(~F.col("event_type").isin(*SIMULATION_TYPES))


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without time zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / 1000)


def mapped(events: DataFrame) -> DataFrame:
    """The rows of ``events`` in the model's columns, without order; works on streams too."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    df = events.select("event_id", "user_id", "value", F.col("event_type").alias("raw"), k.alias("k"), millis(F.col("ts")).alias("ts_ms"))
    signup = F.element_at(F.array(*map(F.lit, ("dir_create", "file_copy", "file_delete", "file_move"))), F.col("k") % 4 + 1)
    kind = F.when(F.col("raw") == "view", "file_read").when(F.col("raw") == "click", F.when(F.col("k") < 50, "file_browse").otherwise("file_search"))
    kind = kind.when(F.col("raw") == "purchase", F.when(F.col("k") % 3 == 0, "file_edit").otherwise("file_write")).when(F.col("raw") == "signup", signup).otherwise("error_encounter")
    df = df.withColumns({"event_type": kind, "profile_id": F.col("user_id"), "task_id": F.floor((F.col("ts_ms") / 1000 - 1704067200) / 604800).cast("int")})
    name = F.element_at(F.array(*map(F.lit, ("md", "csv", "json", "png", "txt"))), F.col("k") % 5 + 1)
    path = F.concat(F.lit("/sandbox/u"), F.col("user_id"), F.lit("/d"), F.col("k") % 5, F.lit("/file_"), F.col("k") % 20, F.lit("."), name)
    df = df.withColumns({
        "operation": F.when(F.col("event_type") == "file_write", F.when(F.col("k") % 3 == 1, "create").otherwise("overwrite")),
        "file_type": name,
        "file_path": F.when(~F.col("event_type").isin("file_browse", "file_search", "dir_create"), path),
        "content_length": F.floor(F.col("value") * 100),
        "lines_added": F.col("k"),
        "lines_deleted": (F.floor("value") % 7).cast("int"),
        "depth": F.col("k") % 4,
        "is_backup": F.col("k") % 8 == 1,
        "content_hash": F.when(F.col("event_type").isin("file_write", "file_edit"), F.col("k") % 10),
    })
    return df.drop("raw", "user_id", "value")


def with_targets(trace: DataFrame) -> DataFrame:
    """Adds target_file to the moves of a trace of ``events``: another of its profile's twenty paths, so that moves chain and meet files."""
    j = (F.col("k") * 3 + 7) % 20
    name = F.element_at(F.array(*map(F.lit, ("md", "csv", "json", "png", "txt"))), j % 5 + 1)
    path = F.concat(F.lit("/sandbox/u"), F.col("profile_id"), F.lit("/d"), j % 5, F.lit("/file_"), j, F.lit("."), name)
    return trace.withColumn("target_file", F.when(F.col("event_type") == "file_move", path))


def trace_of_events(events: DataFrame, documents: DataFrame | None = None, head: int | None = None) -> DataFrame:
    """The canonical trace of the table ``events``: a spec that maps its five event types to the model's.

    With ``documents``, creates carry the text of document event_id modulo
    their number; without, content is null and no join is planned. With
    ``head``, content is the start of that many characters, beside the whole
    text's content_chars and content_digest, so that no whole text is moved.
    """
    ordered = W.partitionBy(*KEY).orderBy("ts_ms", "event_id")
    df = mapped(events).withColumn("seq", F.row_number().over(ordered))
    reads = W.partitionBy(*KEY, "file_path", "event_type").orderBy("seq")
    df = df.withColumn("view_count", F.when(F.col("event_type") == "file_read", F.row_number().over(reads)).otherwise(0))
    if documents is None:
        return df.withColumn("content", F.lit(None).cast("string"))
    n = documents.agg(F.count(F.lit(1)).alias("n"))
    made = df.where(F.col("operation") == "create").select(*KEY, "seq", "event_id").crossJoin(F.broadcast(n)).withColumn("doc_id", F.col("event_id") % F.col("n"))
    text = F.col("text")
    parts = {"content": text} if head is None else {"content": F.substring(text, 1, head), "content_chars": F.length(text), "content_digest": F.sha2(text.cast("binary"), 256)}
    texts = made.join(documents.select("doc_id", *(c.alias(n) for n, c in parts.items())), "doc_id").select(*KEY, "seq", *parts)
    return df.join(texts, [*KEY, "seq"], "left")


__all__ = ["EVENT", "KEY", "annotations", "behavioural", "complete_sessions", "extension", "filtered", "ground_truth", "millis", "normalise", "packed_files", "profile_matrix", "read_events", "read_media", "read_session_files", "resolve_media", "tasks", "trace_of_events", "with_labels"]
