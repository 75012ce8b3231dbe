"""Queries that render, parse or prompt, with SQL where it says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import parsing as ps
from tracewell.operators import profiles as pf
from tracewell.operators import rendering as rd
from tracewell.operators import sequences as sq
from tracewell.operators import similarity as sm
from tracewell.operators.cache import IngestCache
from tracewell.operators.storage import scratch, settled
from tracewell.plans import methods
from tracewell.plans.trace_queries import FEATURES, TRACE, _features, events
from tracewell.sources.traces import KEY, behavioural

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _view(spark: SparkSession, sf: str, content: bool = False, head: int | None = None) -> DataFrame:
    """The trace with the path columns that some event types name differently."""
    t = events(spark, sf, content, head)
    path = F.col("file_path")
    return t.withColumns({"old_path": path, "new_path": F.concat(path, F.lit(".new")), "source_path": path, "dest_path": F.concat(path, F.lit(".copy"))})


NAME = "regexp_replace(file_path, '^/sandbox/[^/]+/', '')"


@query("WITH " + TRACE + f", l AS (SELECT *, row_number() OVER (PARTITION BY profile_id, task_id ORDER BY seq) AS n FROM b) SELECT profile_id, task_id, seq, '[' || n || '] ' || CASE event_type WHEN 'file_read' THEN 'Read file: ' || {NAME} || ' (lines [], view #' || view_count || ', ' || content_length || ' chars)' WHEN 'file_write' THEN CASE operation WHEN 'create' THEN 'Create' ELSE 'Overwrite' END || ' file: ' || {NAME} || ' (' || content_length || ' chars)' WHEN 'file_edit' THEN 'Edit file: ' || {NAME} || ' (+' || lines_added || '/-' || lines_deleted || ' lines, tool: ?)' WHEN 'file_search' THEN 'Search (?): query='''', 0 matches' WHEN 'file_browse' THEN 'Browse directory: ? (0 files, depth=' || depth || ')' WHEN 'dir_create' THEN 'Create directory: ? (depth=' || depth || ')' WHEN 'file_delete' THEN 'Delete file: ' || {NAME} WHEN 'file_move' THEN 'Move: ' || {NAME} || ' -> ' || {NAME} || '.new' WHEN 'file_copy' THEN 'Copy: ' || {NAME} || ' -> ' || {NAME} || '.copy (backup=' || CASE WHEN is_backup THEN 'True' ELSE 'False' END || ')' END AS line FROM l")
def narratives(spark: SparkSession, sf: str) -> DataFrame:
    return rd.narrative_lines(behavioural(_view(spark, sf))).select(*KEY, F.col("seq").cast("long").alias("seq"), "line")


@query("WITH " + TRACE + ", l AS (SELECT *, row_number() OVER (PARTITION BY profile_id, task_id ORDER BY seq) - 1 AS n FROM b) SELECT profile_id, task_id, seq, '[' || n || '] ' || event_type || ' ' || substr(coalesce(regexp_extract(file_path, '[^/]*$'), ''), 1, 30) || CASE event_type WHEN 'file_write' THEN ' (' || operation || ', ' || content_length || 'ch)' WHEN 'file_edit' THEN ' (+' || lines_added || '/-' || lines_deleted || ')' WHEN 'file_read' THEN ' (' || content_length || 'ch)' ELSE '' END AS line FROM l")
def timelines(spark: SparkSession, sf: str) -> DataFrame:
    return rd.timeline(behavioural(events(spark, sf))).withColumn("seq", F.col("seq").cast("long"))


def _texts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*KEY, F.col("seq").cast("long").alias("seq"), *columns)


@query("WITH " + TRACE + f""", m AS (SELECT profile_id, task_id, seq, CASE WHEN event_type IN ('file_read', 'file_search', 'file_browse') THEN 'user' ELSE 'assistant' END AS role, CASE event_type WHEN 'file_read' THEN 'I''m reading ' || {NAME} || ' (view #' || view_count || ', ' || content_length || ' chars, lines [])' WHEN 'file_write' THEN 'I ' || operation || 'd the file ' || {NAME} || ' (' || content_length || ' chars)' WHEN 'file_edit' THEN 'I edited ' || {NAME} || ' (+' || lines_added || '/-' || lines_deleted || ' lines)' WHEN 'file_search' THEN 'Search (): '''' -> 0 matches' WHEN 'file_browse' THEN 'Browsing directory  (0 files)' WHEN 'dir_create' THEN 'Created directory  (depth=' || depth || ')' WHEN 'file_move' THEN 'Moved ' || {NAME} || ' -> ' || {NAME} || '.new' WHEN 'file_copy' THEN 'Copied ' || {NAME} || ' -> ' || {NAME} || '.copy (backup=' || CASE WHEN is_backup THEN 'True' ELSE 'False' END || ')' WHEN 'file_delete' THEN 'Deleted ' || {NAME} END AS content FROM b) SELECT * FROM m""")
def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(rd.messages(behavioural(_view(spark, sf))), "role", "content")


@query("WITH " + TRACE + f""" SELECT profile_id, task_id, seq, CASE WHEN event_type IN ('file_write', 'file_edit') THEN 'semantic' WHEN event_type IN ('file_read', 'file_search', 'file_browse') THEN 'episodic' ELSE 'procedural' END AS level, CASE event_type WHEN 'file_read' THEN 'Read ' || {NAME} || ' (view #' || view_count || ', ' || content_length || ' chars)' WHEN 'file_write' THEN CASE operation WHEN 'create' THEN 'Create' ELSE 'Overwrite' END || ' ' || {NAME} || ' (' || content_length || ' chars)' WHEN 'file_edit' THEN 'Edit ' || {NAME} || ' (+' || lines_added || '/-' || lines_deleted || ')' WHEN 'file_search' THEN 'Search () '''' -> 0 matches' WHEN 'file_browse' THEN 'Browse  (0 files)' WHEN 'dir_create' THEN 'Create dir  (depth=' || depth || ')' WHEN 'file_move' THEN 'Move: ' || {NAME} || ' -> ' || {NAME} || '.new' WHEN 'file_copy' THEN 'Copy: ' || {NAME} || ' -> ' || {NAME} || '.copy (backup=' || CASE WHEN is_backup THEN 'True' ELSE 'False' END || ')' WHEN 'file_delete' THEN 'Delete file: ' || {NAME} END AS content FROM b""")
def memory_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(rd.memory_cells(behavioural(_view(spark, sf))), "level", "content")


@query("WITH " + TRACE + f""" SELECT profile_id, task_id, seq, CASE event_type WHEN 'file_read' THEN 'access' WHEN 'file_write' THEN 'creation' WHEN 'file_edit' THEN 'modification' WHEN 'dir_create' THEN 'organization' WHEN 'file_move' THEN 'organization' WHEN 'file_copy' THEN 'versioning' WHEN 'file_delete' THEN 'cleanup' WHEN 'file_search' THEN 'search' ELSE 'exploration' END AS type, CASE event_type WHEN 'file_read' THEN 'Accessed ' || {NAME} || ' (view #' || view_count || ')' WHEN 'file_write' THEN 'Created/wrote ' || {NAME} || ' (' || content_length || ' chars)' WHEN 'file_edit' THEN 'Modified ' || {NAME} || ' (+' || lines_added || '/-' || lines_deleted || ')' WHEN 'file_search' THEN 'Searched (): '''' -> 0 matches' WHEN 'file_browse' THEN 'Explored  (0 items)' WHEN 'dir_create' THEN 'Organized: created  (depth=' || depth || ')' WHEN 'file_move' THEN 'Move: ' || {NAME} || ' -> ' || {NAME} || '.new' WHEN 'file_copy' THEN 'Copied ' || {NAME} || ' -> ' || {NAME} || '.copy (backup=' || CASE WHEN is_backup THEN 'True' ELSE 'False' END || ')' WHEN 'file_delete' THEN 'Deleted ' || {NAME} END AS content, round(CASE event_type WHEN 'file_read' THEN 0.3 + 0.1 * least(view_count, 5) WHEN 'file_write' THEN 0.7 WHEN 'file_edit' THEN 0.6 WHEN 'dir_create' THEN 0.5 WHEN 'file_move' THEN 0.5 WHEN 'file_copy' THEN 0.6 WHEN 'file_delete' THEN 0.4 WHEN 'file_search' THEN 0.4 ELSE 0.3 END, 4) AS importance FROM b""")
def resource_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(rd.resources(behavioural(_view(spark, sf))).withColumn("importance", F.round("importance", 4)), "type", "content", "importance")


@query("WITH " + TRACE + f""" SELECT profile_id, task_id, seq, 'User' AS src, CASE event_type WHEN 'file_read' THEN 'READ' WHEN 'file_write' THEN 'WROTE' WHEN 'file_edit' THEN 'EDITED' WHEN 'dir_create' THEN 'CREATED' WHEN 'file_move' THEN 'MOVED' WHEN 'file_copy' THEN 'COPIED' WHEN 'file_delete' THEN 'DELETED' ELSE 'SEARCHED' END AS relation, CASE event_type WHEN 'file_read' THEN 'User READ file ''' || {NAME} || ''' (view #' || view_count || ', ' || content_length || ' chars)' WHEN 'file_write' THEN 'User ' || upper(operation) || ' file ''' || {NAME} || '''' || ' (' || content_length || ' chars)' WHEN 'file_edit' THEN 'User EDITED file ''' || {NAME} || ''' (+' || lines_added || '/-' || lines_deleted || ')' WHEN 'file_search' THEN 'User SEARCHED (): '''' -> 0 matches' WHEN 'dir_create' THEN 'User CREATED directory '''' (depth=' || depth || ')' WHEN 'file_move' THEN 'User MOVED ''' || {NAME} || ''' -> ''' || {NAME} || '.new''' WHEN 'file_copy' THEN 'User COPIED ''' || {NAME} || ''' -> ''' || {NAME} || '.copy'' (backup=' || CASE WHEN is_backup THEN 'True' ELSE 'False' END || ')' WHEN 'file_delete' THEN 'User DELETED ''' || {NAME} || '''' END || ' [task:' || task_id || ']' AS fact FROM b WHERE event_type <> 'file_browse'""")
def graph_relations(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(rd.graph_facts(behavioural(_view(spark, sf))), "src", "relation", "fact")


@query("WITH " + TRACE + f""" SELECT profile_id, task_id, seq, CASE event_type WHEN 'file_read' THEN 'reading' WHEN 'file_write' THEN 'writing' WHEN 'file_edit' THEN 'editing' WHEN 'file_search' THEN 'searching' ELSE 'organizing' END AS topic, CASE event_type WHEN 'file_read' THEN 'Read ' || {NAME} || ' (view #' || view_count || ', ' || content_length || ' chars)' WHEN 'file_write' THEN CASE operation WHEN 'create' THEN 'Create' ELSE 'Overwrite' END || ' ' || {NAME} || ' (' || content_length || ' chars)' WHEN 'file_edit' THEN 'Edit ' || {NAME} || ' (+' || lines_added || '/-' || lines_deleted || ' lines)' WHEN 'file_search' THEN 'Search (?): '''' → 0 matches' WHEN 'dir_create' THEN 'Create directory ? (depth=' || depth || ')' WHEN 'file_move' THEN 'file_move: ' || {NAME} || ' → ' || {NAME} || '.new' WHEN 'file_copy' THEN 'file_copy: ' || {NAME} || ' → ' || {NAME} || '.copy' WHEN 'file_delete' THEN 'Delete ' || {NAME} END AS restatement, coalesce({NAME}, '') AS entities FROM b WHERE event_type <> 'file_browse'""")
def memory_topics(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(rd.memory_entries(behavioural(_view(spark, sf))).withColumn("entities", F.array_join("entities", ",")), "topic", "restatement", "entities")


@query("WITH " + TRACE + ", c AS (SELECT profile_id, task_id, event_type, (row_number() OVER (PARTITION BY profile_id, task_id ORDER BY seq) - 1) // 20 AS chunk FROM b) SELECT profile_id, task_id, chunk, CASE WHEN count(*) FILTER (event_type IN ('file_write', 'file_edit')) > 0 THEN 'file_operation' WHEN count(*) FILTER (event_type IN ('file_search', 'file_browse')) > 0 THEN 'search_pattern' WHEN count(*) FILTER (event_type IN ('dir_create', 'file_move', 'file_rename')) > 0 THEN 'structural' ELSE 'file_operation' END AS source FROM c GROUP BY ALL")
def chunk_sources(spark: SparkSession, sf: str) -> DataFrame:
    return rd.chunk_tags(sq.chunks(behavioural(events(spark, sf))))


@query("WITH " + TRACE + " SELECT profile_id, task_id, string_agg('- ' || strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S') || CASE event_type WHEN 'file_search' THEN ' Search (?): query='''', 0 matches' ELSE ' Create directory: ? (depth=' || depth || ')' END, chr(10) ORDER BY seq) AS text FROM tr WHERE event_type IN ('file_search', 'dir_create') GROUP BY ALL")
def search_logs(spark: SparkSession, sf: str) -> DataFrame:
    return rd.session_log(events(spark, sf).where(F.col("event_type").isin("file_search", "dir_create")))


@query("WITH n AS (" + ORACLE["narratives"] + "), " + TRACE + " SELECT tr.profile_id, tr.task_id, string_agg('- ' || strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S') || ' ' || coalesce(regexp_replace(line, '^\\[[0-9]+\\] ', ''), 'Error: ? - ?'), chr(10) ORDER BY tr.seq) AS text FROM tr LEFT JOIN n USING (profile_id, task_id, seq) GROUP BY ALL")
def session_logs(spark: SparkSession, sf: str) -> DataFrame:
    return rd.session_log(_view(spark, sf))


@query("WITH " + FEATURES + ", a AS (SELECT profile_id, avg(total_reads) AS mean, stddev_samp(total_reads) AS std, min(total_reads) AS lo, max(total_reads) AS hi FROM f GROUP BY profile_id) SELECT profile_id, '- total_reads: mean ' || printf('%.3f', mean) || coalesce(' ± ' || printf('%.3f', std), '') || ' [' || printf('%.3f', CAST(lo AS DOUBLE)) || ', ' || printf('%.3f', CAST(hi AS DOUBLE)) || ']' AS text FROM a")
def aggregate_texts(spark: SparkSession, sf: str) -> DataFrame:
    return rd.aggregate_text(pf.aggregate_features(_features(spark, sf), ["total_reads"]))


@query("WITH " + TRACE + ", s AS (SELECT event_id, event_type AS kind, k, file_path, CASE WHEN k % 2 = 0 THEN file_path || '.b' ELSE '/other' || file_path END AS target FROM tr WHERE event_type IN ('file_move', 'file_delete', 'file_copy')) SELECT event_id, CASE WHEN kind = 'file_move' AND k % 2 = 0 THEN 'file_rename' ELSE kind END AS event_type, CASE WHEN kind = 'file_delete' THEN file_path END AS file_path, CASE WHEN kind <> 'file_delete' THEN file_path END AS source_file, CASE WHEN kind <> 'file_delete' THEN target END AS target_file FROM s UNION ALL SELECT event_id, 'dir_create', '/a;b', NULL, NULL FROM s")
def shell_events(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf).where(F.col("event_type").isin("file_move", "file_delete", "file_copy"))
    target = F.when(F.col("k") % 2 == 0, F.concat("file_path", F.lit(".b"))).otherwise(F.concat(F.lit("/other"), "file_path"))
    verb = F.when(F.col("event_type") == "file_move", F.concat(F.lit("mv '"), "file_path", F.lit("' "), target)).when(F.col("event_type") == "file_delete", F.concat(F.lit("rm -f "), "file_path")).otherwise(F.concat(F.lit("cp "), "file_path", F.lit(" "), target))
    commands = t.select("event_id", F.concat(F.lit("mkdir -p \"/a;b\" && "), verb).alias("command"))
    return ps.shell_events(commands).select("event_id", "event_type", "file_path", "source_file", "target_file")


@query("WITH " + TRACE + ", l AS (SELECT profile_id, ts_ms, event_id, file_path || ['', '', '', '.log', '.pid', '.PLIST', '.sb-1'][event_id % 7 + 1] AS path, ['editor', 'Code Helper', 'mdworker', 'QuickLookUI', 'python3', 'Finder', 'editor', 'com.apple.bird', 'preview'][event_id % 9 + 1] AS process, event_id % 11 = 0 AS writes FROM tr WHERE event_type = 'file_read'), k AS (SELECT *, lag(path) OVER (PARTITION BY profile_id ORDER BY ts_ms, event_id) AS p FROM l WHERE NOT writes AND event_id % 7 IN (0, 1, 2, 3) AND process IN ('editor', 'Code Helper', 'preview')) SELECT profile_id, count(*) AS reads, count(*) FILTER (path LIKE '%.log') AS logs FROM k WHERE p IS NULL OR p <> path GROUP BY profile_id")
def syscall_reads(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf).where(F.col("event_type") == "file_read")
    one_of = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    flags = F.when(F.col("event_id") % 11 == 0, "_W____").otherwise("R_____")
    path = F.concat("file_path", one_of(7, "", "", "", ".log", ".pid", ".PLIST", ".sb-1"))
    process = one_of(9, "editor.42", "Code Helper.7", "mdworker.9", "QuickLookUI.1", "python3.77", "Finder.5", "editor.43", "com.apple.bird.8", "preview.6")
    line = F.concat(F.lit("12:00:00.1  open  F=3  ("), flags, F.lit(")  "), path, F.lit("  0.0001  "), process)
    found = ps.opens(t.select("profile_id", F.struct("ts_ms", "event_id").alias("at"), line.alias("value")))
    reads = ps.reads_of_opens(found, ["/sandbox"], "at", ["profile_id"])
    return reads.groupBy("profile_id").agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.endswith("path", F.lit(".log"))).alias("logs"))


@query(None)
def content_diffs(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    versions = docs.select(F.col("source").alias("profile_id"), F.lit(0).alias("task_id"), F.col("doc_id").alias("seq"), F.col("lang").alias("file_path"), F.col("text").alias("content"))
    return ps.diffs(versions)


@query("SELECT user_id AS profile_id, event_id, CAST(floor(value) AS INT) % 5 + 1 AS score FROM events")
def parsed_replies(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    score = (F.floor("value").cast("int") % 5 + 1).cast("string")
    shapes = [F.concat(F.lit("```json\n{\"score\": "), score, F.lit(",}\n```")), F.concat(F.lit("Sure: {\"score\": "), score, F.lit("\n\"why\": \"x\"} done")), F.concat(F.lit("{\"score\": "), score, F.lit(", \"why\": \"cut of"))]
    reply = F.element_at(F.array(*shapes), (F.col("event_id") % 3 + 1).cast("int"))
    rows = e.select(F.col("user_id").alias("profile_id"), "event_id", reply.alias("reply"))
    return rows.select("profile_id", "event_id", ps.parsed(F.col("reply"), "score int, why string")["score"].cast("int").alias("score"))


def _greedy_sql(rows: str, by: str, threshold: float, least: int, step: str) -> str:
    """Recursion over rows (``by``, seq, text) in order: an entry joins the first kept one whose words overlap with its own, or is kept."""
    part = f"PARTITION BY {by}"
    fresh = "{'seq': e.seq, 'text': e.text, 'words': e.words, 'confidence': 0.8::DOUBLE, 'observations': 1}"
    near = f"list_position(list_transform(r.kept, lambda x: len(list_intersect(x.words, e.words)) / least(len(x.words), len(e.words)) > {threshold}), true)"
    same = " AND ".join(f"e.{c.strip()} = r.{c.strip()}" for c in by.split(","))
    keys = ", ".join(f"e.{c.strip()}" for c in by.split(","))
    return (
        f"e AS (SELECT {by}, seq, text, list_distinct(string_split(lower(text), ' ')) AS words, row_number() OVER ({part} ORDER BY seq) AS i, count(*) OVER ({part}) AS n FROM {rows}), "
        f"r AS (SELECT {keys}, e.i, e.n, [{fresh}] AS kept FROM e WHERE i = 1 UNION ALL SELECT {keys}, e.i, e.n, CASE WHEN e.n < {least} OR coalesce({near}, 0) = 0 THEN list_append(r.kept, {fresh}) "
        f"ELSE list_transform(r.kept, lambda x, j: CASE WHEN j = {near} THEN {{'seq': x.seq, 'text': x.text, 'words': x.words, 'confidence': {step}, 'observations': x.observations + 1}} ELSE x END) END FROM r JOIN e ON {same} AND e.i = r.i + 1), "
        f"kept AS (SELECT {by}, unnest(kept, recursive := true) FROM r WHERE i = n)"
    )


@query("WITH RECURSIVE m AS (SELECT profile_id, task_id * 1000000 + seq AS seq, restatement AS text FROM (" + ORACLE["memory_topics"] + ")), " + _greedy_sql("m", "profile_id", 0.5, 11, "least(1.0, x.confidence + 0.1::DOUBLE)") + " SELECT profile_id AS \"group\", seq, text, confidence, observations FROM kept")
def merged_memories(spark: SparkSession, sf: str) -> DataFrame:
    rows = rd.memory_entries(behavioural(_view(spark, sf)))
    return sm.merge_by_overlap(rows.select(F.col("profile_id").alias("group"), (F.col("task_id") * 1_000_000 + F.col("seq")).alias("seq"), F.col("restatement").alias("text"), "confidence"))


@query(None)
def content_samples(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kind = F.element_at(F.array(*map(F.lit, ("create", "major_edit", "minor_edit"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return sm.sample_contents(docs.select(F.col("source").alias("group"), (F.col("doc_id") % 7).alias("task_id"), kind.alias("kind"), F.col("lang").alias("file_type"), F.col("text").alias("content"), (F.lit(1.0) + F.col("doc_id") % 3).alias("importance")))


def _method_query(name: str):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return methods.METHODS[name](_view(spark, sf, content=name in ("visrag", "full_context", "channels"), head=methods.SHOWN if name == "full_context" else None))

    run.__name__ = f"method_{name}"
    return run


def _joined_sql(rows: str, text: str, order: str) -> str:
    return f"SELECT profile_id, string_agg({text}, chr(10) ORDER BY {order}) AS prompt FROM {rows} GROUP BY profile_id"


_importance = ORACLE["resource_weights"].replace("round(CASE", "CAST(CASE").replace(", 4) AS importance", " AS DOUBLE) AS importance").replace("0.3 + 0.1 * least(view_count, 5)", "0.3::DOUBLE + 0.1::DOUBLE * least(view_count, 5)")
_edges = ORACLE["graph_relations"].replace(" AS fact FROM b", f" AS fact, coalesce({NAME} || '.new', '') AS dst FROM b")
#: Methods that ask no model and compare no vectors, over the SQL of the rows that they render.
METHOD_SQL = {
    "eager_summarization": "WITH n AS (" + ORACLE["narratives"] + "), s AS (SELECT profile_id, task_id, 24 + length(string_agg(line, chr(10) ORDER BY seq)) AS n FROM n GROUP BY ALL) " + _joined_sql("s", "'{\"verdict\": \"uncertain\", \"n_chars\": ' || n || '}'", "task_id"),
    "mem0": "WITH m AS (" + ORACLE["chat_messages"] + "), d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY profile_id, content ORDER BY task_id, seq) = 1) " + _joined_sql("d", "content", "task_id, seq"),
    "memu": "WITH m AS (" + _importance + "), d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY importance DESC, task_id, seq) <= 50) " + _joined_sql("d", "content", "task_id, seq"),
    "memos": "WITH RECURSIVE m AS (SELECT profile_id, level, task_id * 1000000 + seq AS seq, content AS text FROM (" + ORACLE["memory_cells"] + ")), " + _greedy_sql("m", "profile_id, level", 0.4, 0, "x.confidence") + ", h AS (SELECT profile_id, level, '- ' || level || ': ' || count(*) || ' memories, confidence 0.50, ' || count(*) FILTER (observations > 1) || ' seen more than once' AS line FROM kept GROUP BY profile_id, level), heads AS (SELECT profile_id, string_agg(line, chr(10) ORDER BY level) AS head FROM h GROUP BY profile_id), f AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY seq) <= 60), p AS (" + _joined_sql("f", "text", "seq") + ") SELECT profile_id, head || chr(10) || prompt AS prompt FROM p JOIN heads USING (profile_id)",
    "zep": "WITH e AS (" + _edges + "), f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY task_id DESC, seq DESC) <= 150), p AS (" + _joined_sql("f", "fact", "task_id, seq") + "), ends AS (SELECT profile_id, src AS node FROM e UNION ALL SELECT profile_id, dst FROM e), deg AS (SELECT profile_id, node, count(*) AS n FROM ends GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, node) AS r FROM deg), linked AS (SELECT profile_id, count(*) AS nodes, string_agg(node || ' (' || n || ')', ', ' ORDER BY r) FILTER (r <= 10) AS linked FROM best GROUP BY profile_id), c AS (SELECT profile_id, count(*) AS edges, count(DISTINCT relation) AS relations FROM e GROUP BY profile_id) SELECT profile_id, 'Graph: ' || nodes || ' nodes, ' || edges || ' edges, ' || relations || ' relations' || chr(10) || 'Most linked: ' || linked || chr(10) || prompt AS prompt FROM p JOIN linked USING (profile_id) JOIN c USING (profile_id)",
    "full_context": "WITH n AS (" + ORACLE["narratives"] + "), " + TRACE + ", d AS (SELECT doc_id, text, count(*) OVER () AS size FROM documents), t AS (SELECT tr.profile_id, tr.task_id, tr.seq, text FROM tr JOIN d ON doc_id = event_id % size WHERE operation = 'create'), l AS (SELECT profile_id, task_id, string_agg(line || CASE WHEN coalesce(text, '') <> '' THEN chr(10) || '--- content ---' || chr(10) || CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || chr(10) || '... [truncated, ' || length(text) || ' chars total]' ELSE text END || chr(10) || '--- end ---' ELSE '' END, chr(10) ORDER BY seq) AS text FROM n LEFT JOIN t USING (profile_id, task_id, seq) GROUP BY ALL), w AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY profile_id ORDER BY task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l) SELECT profile_id, string_agg(substr(text, 1, CAST(160000 - before AS BIGINT)), chr(10) ORDER BY task_id) AS prompt FROM w WHERE before < 160000 GROUP BY profile_id",
}
for _name in methods.METHODS:
    query(METHOD_SQL.get(_name))(_method_query(_name))


@query("WITH " + FEATURES + " SELECT profile_id, count(*) AS asked, count(*) AS uncertain FROM f GROUP BY profile_id")
def model_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    asked = rd.prompts(_features(spark, sf), list(KEY), "Is session {task_id} with {total_reads} reads unusual?")
    replies = methods.answered(asked)
    verdict = ps.parsed(F.col("reply"), "verdict string, n_chars int")["verdict"]
    return replies.groupBy("profile_id").agg(F.count(F.lit(1)).alias("asked"), F.count_if(verdict == "uncertain").alias("uncertain"))


_STATES = METHOD_SQL["full_context"]


@query(f"WITH p AS ({_STATES}), c AS (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 3 AND epoch(ts) >= 1704067200 + 3 * 604800) SELECT p.*, CASE WHEN c.user_id IS NULL THEN 1 ELSE 2 END AS run FROM p LEFT JOIN c ON c.user_id = p.profile_id")
def cached_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts through the ingest cache: a run before every tenth profile had its last sessions, and one over everything, which makes those anew."""
    trace = settled(_view(spark, sf, content=True, head=methods.SHOWN), "trace")  # a run reads it for its prints and for what has changed
    cache = IngestCache(spark, scratch(spark, "cache"), "full_context")
    cache.ingest(trace.where(~((F.col("profile_id") % 10 == 3) & (F.col("task_id") >= 3))), methods.METHODS["full_context"])
    return cache.ingest(trace, methods.METHODS["full_context"]).withColumn("run", F.col("run").cast("int"))
