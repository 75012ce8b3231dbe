"""Operators over live events: event time, watermarks, and state per key.

Each works on a stream and, where it holds no state of its own, on a table as
well. Rows later than the watermark are dropped. Those that depend on the order
of events step through each key's rows in event time (see ``ordered``), so that
their rows are those of a batch job over all events, however the events fell
into batches; their state lives in the checkpoint. ``slots`` deals many keys of
few rows each to so many states.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.config import DEFAULTS
from tracewell.operators.joins import copy_step
from tracewell.streaming.ordered import PROVIDER, Entry, Memory, in_order

DELAY = "10 minutes"


def event_feed(spark: SparkSession, path: str, schema: str | StructType, files_a_batch: int | None = None) -> DataFrame:
    """Events appended to a folder as JSON lines, all that is new or ``files_a_batch`` files at a time."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).json(path)


def with_event_time(df: DataFrame, clock: int = 1) -> DataFrame:
    """Adds ts, from ts_ms on a clock divided by ``clock``, and now, the same in milliseconds."""
    now = F.floor(F.col("ts_ms") / clock)
    return df.withColumn("now", now).withColumn("ts", F.timestamp_millis(now))


def once(df: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each event_id once within the watermark."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def debounced(df: DataFrame, by: list[str], gap_ms: int = DEFAULTS.debounce_ms, delay: str = DELAY) -> DataFrame:
    """One row per burst of changes of a path; a burst ends with ``gap_ms`` of silence.

    A session window would join rows exactly a gap apart, where a timer has run
    out, so the window is one millisecond shorter.
    """
    window = F.session_window("ts", f"{gap_ms - 1} milliseconds")
    out = df.withWatermark("ts", delay).groupBy(*by, window.alias("w")).agg(F.count(F.lit(1)).alias("changes"), F.min("now").alias("first_ms"), F.max("now").alias("last_ms"))
    return out.drop("w")


#: Names of entries that are no paths.
TICK, END = "\x00tick", "\x00end"


def snapshots(df: DataFrame, by: str = "profile_id", every_ms: int = 300_000, idle_ms: int = 600_000, delay: str = DELAY, slots: int | None = None) -> DataFrame:
    """The files as they stand at a session's start, ``every_ms`` from then on, and at its end.

    A session ends with session_end, or when nothing came for over ``idle_ms``.
    Any event with a path but a delete or a move away makes a file be there;
    moves (file_move, file_rename) go to target_file. A snapshot has what came
    before its time. Files outlive sessions.
    """

    def taken(memory: Memory, key: int, at: int, kind: str) -> dict:
        files = [(k, e.text) for k, e in memory.items() if k not in (TICK, END)]
        kinds: dict[str, int] = {}
        for _, x in files:
            kinds[x or "unknown"] = kinds.get(x or "unknown", 0) + 1
        return {by: key, "kind": kind, "at_ms": at, "total_files": len(files), "file_count_by_type": json.dumps(kinds, sort_keys=True), "max_depth": max((k.count("/") for k, _ in files), default=0), "files": ",".join(k for k, _ in files)}

    def step(memory: Memory, row: dict) -> list[dict]:
        out, now, path, kind = [], row["now"], row["file_path"], row["event_type"]
        if memory.get(END) is None:
            out.append(taken(memory, row[by], now, "start"))
            memory.put(TICK, row[by], due=now + every_ms)
        if kind == "session_end":
            memory.pop(TICK), memory.pop(END)
            return [*out, taken(memory, row[by], now, "end")]
        memory.put(END, row[by], due=now + idle_ms + 1)
        if path is not None:
            if kind in ("file_delete", "file_move", "file_rename"):
                memory.pop(path)
            else:
                memory.put(path, now, row["file_type"])
        if kind in ("file_move", "file_rename") and row["target_file"] is not None:
            memory.put(row["target_file"], now, row["target_file"].rpartition(".")[2])
        return out

    def at_due(memory: Memory, name: str, entry: Entry) -> list[dict]:
        if name == END:
            memory.pop(TICK)
            return [taken(memory, entry.value, entry.due, "end")]
        memory.put(TICK, entry.value, due=entry.due + every_ms)
        return [taken(memory, entry.value, entry.due, "periodic")]

    schema = f"{by} long, kind string, at_ms long, total_files int, file_count_by_type string, max_depth int, files string"
    return in_order(df, [by], step, schema, ["event_type", "file_path", "file_type", "target_file"], delay, at_due=at_due, slots=slots)


def running_counters(df: DataFrame, by: list[str]) -> DataFrame:
    """Reads, writes, edits and errors so far."""
    is_ = lambda k: F.col("event_type") == k
    return df.groupBy(*by).agg(F.count_if(is_("file_read")).alias("reads"), F.count_if(is_("file_write")).alias("writes"), F.count_if(is_("file_edit")).alias("edits"), F.count_if(is_("error_encounter")).alias("errors"))


def collapsed_saves(df: DataFrame, source: str = "source_file", target: str = "target_file") -> DataFrame:
    """Atomic saves as what they mean: a move to a ``.sb-`` name is dropped, one from such a name, or from one with ``~``, is an edit of its target."""
    temp = lambda c: F.contains(F.col(c), F.lit(".sb-"))
    moves = F.col("event_type").isin("file_rename", "file_move")
    out = df.where(~(moves & temp(target)))
    edit = F.col("event_type").isin("file_rename", "file_move") & (temp(source) | F.endswith(F.col(source), F.lit("~")))
    return out.withColumn("file_path", F.when(edit, F.col(target)).otherwise(F.col("file_path"))).withColumn("event_type", F.when(edit, "file_edit").otherwise(F.col("event_type")))


def changed_opens(df: DataFrame, by: list[str], delay: str = DELAY, slots: int | None = None) -> DataFrame:
    """Opens of another file than the last one of the same key."""

    def step(memory: Memory, row: dict) -> list[dict]:
        last = memory.get("last")
        if last and last.text == row["file_path"]:
            return []
        memory.put("last", row["ts_ms"], row["file_path"])
        return [{k: row[k] for k in ("profile_id", "event_id", "file_path", "ts_ms")}]

    return in_order(df, by, step, "profile_id long, event_id long, file_path string, ts_ms long", ["profile_id", "file_path"], delay, slots=slots)


def copies(df: DataFrame, within_ms: int = DEFAULTS.copy_window_ms, forget_ms: int = 300_000, delay: str = DELAY, slots: int | None = None) -> DataFrame:
    """Copies by hash (see ``joins.copy_step``); a registration is forgotten ``forget_ms`` after it was made."""
    copied = copy_step(within_ms, forget_ms)

    def step(memory: Memory, row: dict) -> list[dict]:
        held = memory.get("seen")
        state = {"seen": [held.text, held.value]} if held else {}
        hit = copied(state, row["file_path"], row["now"])
        if hit:
            return [{"profile_id": row["profile_id"], "event_id": row["event_id"], "source_path": hit[0], "dest_path": row["file_path"], "age_ms": hit[1]}]
        memory.put("seen", row["now"], row["file_path"], due=row["now"] + forget_ms + 1)
        return []

    schema = "profile_id long, event_id long, source_path string, dest_path string, age_ms long"
    return in_order(df, ["profile_id", "content_hash"], step, schema, ["file_path"], delay, slots=slots)


def settled_deletes(df: DataFrame, within_ms: int = DEFAULTS.deferred_delete_ms, delay: str = DELAY, slots: int | None = None) -> DataFrame:
    """Deletes that held: no write of the path followed within ``within_ms``.

    A later event of the path shows it, or else the time, once the watermark has passed.
    """

    def step(memory: Memory, row: dict) -> list[dict]:
        held = memory.pop("held")
        if row["event_type"] == "file_delete":
            kept = {k: row[k] for k in ("profile_id", "event_id", "file_path", "ts_ms")}
            memory.put("held", row["now"], json.dumps(kept), due=row["now"] + within_ms + 1)
        return [json.loads(held.text)] if held and row["event_type"] != "file_write" else []

    schema = "profile_id long, event_id long, file_path string, ts_ms long"
    return in_order(df, ["profile_id", "file_path"], step, schema, ["event_type"], delay, at_due=lambda memory, name, entry: [json.loads(entry.text)], slots=slots)


def births(df: DataFrame, by: str = "profile_id", forget_ms: int | None = None, delay: str = DELAY, slots: int | None = None) -> DataFrame:
    """Age of each deleted file since it was created, through moves; the stream form of ``joins.delete_ages``.

    There is an entry for each path with a known birth: a delete drops it, a
    move renames it, and with ``forget_ms`` it goes that long after the birth.
    """

    def step(memory: Memory, row: dict) -> list[dict]:
        path, kind = row["file_path"], row["event_type"]
        if path is None:
            return []
        if kind == "file_delete":
            born = memory.pop(path)
            return [{by: row[by], "event_id": row["event_id"], "file_path": path, "file_age_ms": row["ts_ms"] - born.value if born else None}]
        if kind == "file_write" and row["operation"] == "create":
            memory.put(path, row["ts_ms"], due=None if forget_ms is None else row["now"] + forget_ms)
        elif kind in ("file_move", "file_rename") and row["target_file"] is not None and row["target_file"] != path:
            born = memory.pop(path)
            if born:
                memory.put(row["target_file"], born.value, due=born.due)
        return []

    return in_order(df, [by], step, f"{by} long, event_id long, file_path string, file_age_ms long", ["event_type", "operation", "file_path", "target_file"], delay, slots=slots)


def recoveries(df: DataFrame, by: list[str], delay: str = DELAY, slots: int | None = None) -> DataFrame:
    """The first success after the pending error of a key, by retry (the same tool) or rethink; a newer error replaces the pending one.

    The tool of a row is its event type; an error's is that of the row before it.
    """

    def step(memory: Memory, row: dict) -> list[dict]:
        if row["event_type"] == "error_encounter":
            before = memory.get("before")
            memory.put("pending", row["ts_ms"], json.dumps([row["event_id"], before.text if before else ""]))
            memory.put("before", row["ts_ms"], row["event_type"])
            return []
        memory.put("before", row["ts_ms"], row["event_type"])
        pending = memory.pop("pending")
        if not pending:
            return []
        error, tool = json.loads(pending.text)
        return [{**{k: row[k] for k in by}, "error_id": error, "event_id": row["event_id"], "strategy": "retry" if tool == row["event_type"] else "rethink", "latency_ms": row["ts_ms"] - pending.value}]

    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    return in_order(df, by, step, f"{keys}, error_id long, event_id long, strategy string, latency_ms long", ["event_type"], delay, slots=slots)


@contextmanager
def _versioned_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which map states and timers need."""
    key, value = PROVIDER
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_to_end(df: DataFrame, out: str, complete: bool = False) -> DataFrame:
    """Runs a stream over what is there, into a folder of Parquet with its checkpoint, and reads that back."""
    spark = df.sparkSession
    writer = df.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    with _versioned_state(spark):
        if complete:
            writer = writer.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows"))
            writer.start().awaitTermination()
        else:
            writer.outputMode("append").format("parquet").option("path", f"{out}/rows").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def run_once(df: DataFrame, out: str, after_write: Callable[[int], None] | None = None) -> DataFrame:
    """As ``run_to_end`` in append mode, through a sink that writes each batch's rows once, even if the batch is run again.

    A batch goes to a folder of its own number, which a repeated run of the
    batch writes anew: what a run left there that ended between its write and
    its commit is replaced, not added to. ``after_write`` is told of each batch
    that was written and not committed yet. To go on after a stop or failure,
    call it with the same ``out``.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
        if after_write:
            after_write(n)

    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{out}/rows/batch=-1")  # a folder to read where no batch has rows
    with _versioned_state(spark):
        df.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).outputMode("append").foreachBatch(write).start().awaitTermination()
    return spark.read.schema(df.schema).option("basePath", f"{out}/rows").parquet(f"{out}/rows").select(*df.columns)
