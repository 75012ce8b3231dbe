"""Streams over the table ``events``, run to the end, with the SQL of their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.storage import scratch
from tracewell.plans.trace_queries import COPIES, DELETE_AGES, TARGET, TRACE
from tracewell.sources.traces import mapped, with_targets
from tracewell.streaming import live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


#: How far out of order the feed may be: its files are dealt at random, and a month of events is one feed.
DISORDER = "60 days"
#: States that the keys of a feed are dealt to, and files that a micro-batch reads.
SLOTS, PIECES = 256, 8


def feed(spark: SparkSession, sf: str, clock: int, end: str | None = None, files: int = 3) -> DataFrame:
    """The events as a stream of ``files`` micro-batches, each a random part of them.

    With ``end``, an event type, one row of that type and of no profile comes
    last, far in the future: the feed has ended, and all timers may run out.
    """
    rows = live.with_event_time(with_targets(mapped(spark.read.parquet(f"{sf}/events.parquet"))), clock)
    path = f"{folder(spark)}/feed"
    rows.repartition(files * PIECES, F.xxhash64("event_id")).write.parquet(path)
    if end:
        far = F.lit(4102444800000).cast("long")
        values = {"event_type": F.lit(end), "file_path": F.lit(""), "content_hash": F.lit(-1), "profile_id": F.lit(-1), "event_id": F.lit(-1), "ts_ms": far * clock, "now": far, "ts": F.timestamp_millis(far)}
        row = spark.range(1).select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema))
        row.write.mode("append").parquet(path)  # files come by the time they were written
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", PIECES).parquet(path)


def folder(spark: SparkSession) -> str:
    return scratch(spark, "stream")


def only(df: DataFrame, *kinds: str) -> DataFrame:
    return df.where(F.col("event_type").isin(*kinds))


@query("WITH " + TRACE + ", e AS (SELECT profile_id, file_path, ts_ms // 1000000 AS now FROM tr WHERE event_type IN ('file_edit', 'file_write')), g AS (SELECT *, CASE WHEN now - lag(now) OVER (PARTITION BY profile_id, file_path ORDER BY now) < 2000 THEN 0 ELSE 1 END AS fresh FROM e), s AS (SELECT *, sum(fresh) OVER (PARTITION BY profile_id, file_path ORDER BY now ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT profile_id, file_path, count(*) AS changes, min(now) AS first_ms, max(now) AS last_ms FROM s GROUP BY profile_id, file_path, burst")
def stream_debounce(spark: SparkSession, sf: str) -> DataFrame:
    return live.run_to_end(live.debounced(only(feed(spark, sf, 1_000_000), "file_edit", "file_write"), ["profile_id", "file_path"]), folder(spark), complete=True)


@query("WITH " + TRACE + ", l AS (SELECT profile_id, event_id, file_path, ts_ms, lag(file_path) OVER (PARTITION BY profile_id ORDER BY ts_ms, event_id) AS p FROM tr WHERE event_type = 'file_read') SELECT profile_id, event_id, file_path, ts_ms FROM l WHERE p IS NULL OR p <> file_path")
def stream_changed_opens(spark: SparkSession, sf: str) -> DataFrame:
    return live.run_to_end(live.changed_opens(only(feed(spark, sf, 1, "file_read"), "file_read"), ["profile_id"], DISORDER, slots=SLOTS), folder(spark))


@query(COPIES)
def stream_copies(spark: SparkSession, sf: str) -> DataFrame:
    return live.run_to_end(live.copies(feed(spark, sf, 10_000, "file_write").where(F.col("content_hash").isNotNull()), delay=DISORDER, slots=SLOTS), folder(spark))


@query("WITH " + TRACE + ", a AS (SELECT profile_id, event_id, event_type, file_path, ts_ms, ts_ms // 1000000 AS now, lead(event_type) OVER w AS ne, lead(ts_ms // 1000000) OVER w AS nn FROM tr WHERE event_type IN ('file_delete', 'file_write') WINDOW w AS (PARTITION BY profile_id, file_path ORDER BY ts_ms, event_id)) SELECT profile_id, event_id, file_path, ts_ms FROM a WHERE event_type = 'file_delete' AND NOT coalesce(ne = 'file_write' AND nn - now <= 500, false)")
def stream_settled_deletes(spark: SparkSession, sf: str) -> DataFrame:
    return live.run_to_end(live.settled_deletes(only(feed(spark, sf, 1_000_000, "file_write"), "file_delete", "file_write"), delay=DISORDER, slots=SLOTS), folder(spark))


#: Sessions end with ten minutes of silence; at each snapshot's time the last row of each path before it says whether the path is there.
SNAPSHOTS = "WITH " + TRACE + ", e AS (SELECT profile_id, event_id, ts_ms, ts_ms // 1000 AS now, event_type, file_path, " + TARGET + """ AS target FROM tr),
 g AS (SELECT *, CASE WHEN now - lag(now) OVER (PARTITION BY profile_id ORDER BY ts_ms, event_id) <= 600000 THEN 0 ELSE 1 END AS fresh FROM e),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY profile_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
 p AS (SELECT profile_id, session, min(now) AS t0, max(now) + 600001 AS t1 FROM s GROUP BY ALL),
 t AS (SELECT profile_id, 'start' AS kind, t0 AS at_ms FROM p UNION ALL SELECT profile_id, 'end', t1 FROM p UNION ALL SELECT profile_id, 'periodic', unnest(range(t0 + 300000, t1, 300000)) FROM p),
 c AS (SELECT profile_id, now, ts_ms, event_id, 0 AS part, file_path AS path, event_type NOT IN ('file_delete', 'file_move') AS there FROM e WHERE file_path IS NOT NULL UNION ALL SELECT profile_id, now, ts_ms, event_id, 1, target, true FROM e WHERE target IS NOT NULL),
 l AS (SELECT t.profile_id, kind, at_ms, path, arg_max(there, struct_pack(a := ts_ms, b := event_id, c := part)) AS there FROM t JOIN c ON c.profile_id = t.profile_id AND c.now < t.at_ms GROUP BY ALL),
 f AS (SELECT profile_id, kind, at_ms, path, regexp_extract(path, '[^.]*$') AS ext FROM l WHERE there),
 n AS (SELECT profile_id, kind, at_ms, count(*) AS total_files, max(len(path) - len(replace(path, '/', ''))) AS max_depth, string_agg(path, ',' ORDER BY path) AS files FROM f GROUP BY ALL),
 x AS (SELECT profile_id, kind, at_ms, string_agg('"' || ext || '": ' || n, ', ' ORDER BY ext) AS kinds FROM (SELECT profile_id, kind, at_ms, ext, count(*) AS n FROM f GROUP BY ALL) GROUP BY ALL)
SELECT t.profile_id, t.kind, t.at_ms, CAST(coalesce(total_files, 0) AS INTEGER) AS total_files, '{' || coalesce(kinds, '') || '}' AS file_count_by_type, CAST(coalesce(max_depth, 0) AS INTEGER) AS max_depth, coalesce(files, '') AS files
FROM t LEFT JOIN n ON n.profile_id = t.profile_id AND n.kind = t.kind AND n.at_ms = t.at_ms LEFT JOIN x ON x.profile_id = t.profile_id AND x.kind = t.kind AND x.at_ms = t.at_ms"""


@query(SNAPSHOTS)
def stream_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return live.run_to_end(live.snapshots(feed(spark, sf, 1_000, "file_read"), delay=DISORDER, slots=SLOTS), folder(spark))


@query("WITH " + TRACE + " SELECT profile_id, task_id, count(*) FILTER (event_type = 'file_read') AS reads, count(*) FILTER (event_type = 'file_write') AS writes, count(*) FILTER (event_type = 'file_edit') AS edits, count(*) FILTER (event_type = 'error_encounter') AS errors FROM tr GROUP BY ALL")
def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    return live.run_to_end(live.running_counters(feed(spark, sf, 1), ["profile_id", "task_id"]), folder(spark), complete=True)


@query(DELETE_AGES)
def stream_births(spark: SparkSession, sf: str) -> DataFrame:
    return live.run_to_end(live.births(feed(spark, sf, 1, "file_read"), delay=DISORDER, slots=SLOTS), folder(spark))


@query("WITH " + TRACE + ", q AS (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY profile_id ORDER BY ts_ms, event_id), '') AS before FROM tr), p AS (SELECT *, max(CASE WHEN event_type = 'error_encounter' THEN struct_pack(t := ts_ms, e := event_id, tool := before) END) OVER (PARTITION BY profile_id ORDER BY ts_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pending FROM q), r AS (SELECT * FROM p WHERE event_type <> 'error_encounter' AND pending IS NOT NULL QUALIFY row_number() OVER (PARTITION BY profile_id, pending ORDER BY ts_ms, event_id) = 1) SELECT profile_id, pending.e AS error_id, event_id, CASE WHEN pending.tool = event_type THEN 'retry' ELSE 'rethink' END AS strategy, ts_ms - pending.t AS latency_ms FROM r")
def stream_recoveries(spark: SparkSession, sf: str) -> DataFrame:
    return live.run_to_end(live.recoveries(feed(spark, sf, 1, "file_read"), ["profile_id"], DISORDER, slots=SLOTS), folder(spark))


@query("SELECT DISTINCT event_id FROM events")
def stream_once(spark: SparkSession, sf: str) -> DataFrame:
    return live.run_to_end(live.once(feed(spark, sf, 1), DISORDER).select("event_id"), folder(spark))


@query("SELECT event_id, user_id AS profile_id, event_type, value FROM events")
def live_feed(spark: SparkSession, sf: str) -> DataFrame:
    """A feed of JSON lines that delivers every event twice: read a file at a time, stopped, and gone on with when more has come."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("user_id").alias("profile_id"), "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    out = folder(spark)

    def append(rows: DataFrame) -> None:
        rows.repartition(2, F.xxhash64("event_id", F.lit("again"))).write.mode("append").json(f"{out}/in")

    late = F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0
    append(events.where(~late))
    stream = live.once(live.with_event_time(live.event_feed(spark, f"{out}/in", events.schema, files_a_batch=1)), DISORDER).select("event_id", "profile_id", "event_type", "value")
    live.run_once(stream, out)
    append(events)
    return live.run_once(stream, out)
