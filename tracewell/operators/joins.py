"""As-of and interval joins over event sequences, as windows over one ordered pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import DEFAULTS
from tracewell.operators.storage import settled
from tracewell.sources.traces import KEY


def clocked(clock: int) -> Column:
    return F.floor(F.col("ts_ms") / clock)


def copy_step(within_ms: int, forget_ms: int = 300_000) -> Callable[[dict, str, int], tuple[str, int] | None]:
    """A step over the rows of one content: (source, age) if another path registered it less than ``within_ms`` ago; else the path is registered.

    A hit isn't registered itself, so that it can't be the source of the next copy.
    """

    def step(state: dict, path: str, now: int) -> tuple[str, int] | None:
        seen = state.get("seen")
        if seen and now - seen[1] <= forget_ms and now - seen[1] < within_ms and seen[0] != path:
            return seen[0], now - seen[1]
        state["seen"] = [path, now]
        return None

    return step


def copies(trace: DataFrame, by: str = "profile_id", within_ms: int = DEFAULTS.copy_window_ms, clock: int = 1) -> DataFrame:
    """Files whose hash was last registered by another path less than ``within_ms`` before; see ``copy_step``.

    What registers depends on the hits before, so that the rows of one profile
    and content are read in order, batch after batch; only the last
    registration is held.
    """
    step = copy_step(within_ms)
    rows = trace.where(F.col("content_hash").isNotNull()).select(by, "content_hash", F.col("event_id").cast("long").alias("event_id"), "ts_ms", "file_path", clocked(clock).alias("now"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for batch in batches:
            out = []
            for who, content, event, path, now in zip(batch[by], batch["content_hash"], batch["event_id"], batch["file_path"], batch["now"], strict=True):
                if (who, content) != key:
                    key, state = (who, content), {}
                hit = step(state, path, int(now))
                if hit:
                    out.append((who, event, hit[0], path, hit[1]))
            yield pd.DataFrame(out, columns=[by, "event_id", "source_path", "dest_path", "age_ms"])

    ordered = rows.repartition(by, "content_hash").sortWithinPartitions(by, "content_hash", "ts_ms", "event_id")
    return ordered.mapInPandas(run, f"{by} {dict(trace.dtypes)[by]}, event_id long, source_path string, dest_path string, age_ms long")


def recoveries(trace: DataFrame, is_error: Column, is_success: Column, tool: Column) -> DataFrame:
    """The first success after each pending error; a newer error replaces the pending one. ``tool`` names the tool of a row."""
    w = W.partitionBy(*KEY).orderBy("seq")
    rows = trace.withColumn("_tool", tool).withColumn("_ok", is_success).withColumn("_error", F.when(is_error, F.struct("seq", "ts_ms", "_tool")))
    rows = rows.withColumn("_pending", F.last("_error", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).where(F.col("_ok") & F.col("_pending").isNotNull())
    first = W.partitionBy(*KEY, "_pending.seq").orderBy("seq")
    out = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1)
    how = F.when(F.col("_pending._tool").eqNullSafe(F.col("_tool")), "retry").otherwise("rethink")
    return out.select(*KEY, F.col("_pending.seq").alias("error_seq"), "seq", how.alias("strategy"), (F.col("ts_ms") - F.col("_pending.ts_ms")).alias("latency_ms"))


def delete_ages(trace: DataFrame, by: str = "profile_id") -> DataFrame:
    """Age of each deleted file since it was created, wherever it has been moved in between; null if that isn't known.

    A move takes the birth of its source along, and overwrites that of a file
    it meets; a source of unknown birth changes nothing at its target. Rows of
    ``trace`` are ordered by (ts_ms, event_id), which is unique in ``by``; moves
    (file_move, file_rename) go from file_path to target_file, and one to its
    own path, or without a path, changes nothing.

    A path's life ends with a delete or a move away, so that each life that
    ends in a move continues in one other. Which lives hold a birth is what
    any life that leads to them held, and a birth is that of the last row
    that set it: both are found by doubling pointers between lives, in as many
    rounds as the logarithm of the longest chain of moves. No task holds more
    than the rows of one path.
    """
    moved = F.col("event_type").isin("file_move", "file_rename") & F.col("file_path").isNotNull() & F.col("target_file").isNotNull() & (F.col("file_path") != F.col("target_file"))
    created = (F.col("event_type") == "file_write") & (F.col("operation") == "create")
    deleted = F.col("event_type") == "file_delete"
    rows = trace.select(by, "event_id", "ts_ms", "file_path", F.when(created, "made").when(deleted, "end").when(moved, "out").alias("kind"), "target_file")
    rows = rows.where(F.col("kind").isNotNull() & F.col("file_path").isNotNull())
    into = rows.where(F.col("kind") == "out").select(by, "event_id", "ts_ms", F.col("target_file").alias("file_path"), F.lit("in").alias("kind"))
    on_path = W.partitionBy(by, "file_path").orderBy("ts_ms", "event_id")
    ender = F.first(F.when(F.col("kind").isin("end", "out"), F.col("event_id")), ignorenulls=True)
    lives = rows.drop("target_file").unionByName(into).withColumn("life", ender.over(on_path.rowsBetween(0, W.unboundedFollowing)))
    lives = settled(lives.where(F.col("life").isNotNull()), "lives")  # what no later row ends is never asked for

    # which lives hold a birth: those with a create, and all that they lead to
    leads = lives.where(F.col("kind") == "in").select(by, F.col("event_id").alias("life"), F.col("life").alias("to"))
    holds = lives.where(F.col("kind") == "made").select(by, "life").distinct()
    while not leads.isEmpty():
        holds = settled(holds.unionByName(holds.join(leads, [by, "life"]).select(by, F.col("to").alias("life"))).distinct(), "holds")
        leads = settled(leads.join(leads.select(by, F.col("life").alias("to"), F.col("to").alias("further")), [by, "to"]).select(by, "life", F.col("further").alias("to")), "leads")

    # what sets a life's birth last: a create, or a move whose source held one
    known = lives.where(F.col("kind") == "in").join(holds.withColumnRenamed("life", "event_id"), [by, "event_id"], "left_semi").unionByName(lives.where(F.col("kind") == "made"))
    last = known.groupBy(by, "life").agg(F.max(F.struct("ts_ms", "event_id", "kind")).alias("last"))
    made = F.col("last.kind") == "made"
    births = settled(last.select(by, "life", F.when(made, F.col("last.ts_ms")).alias("born"), F.when(~made, F.col("last.event_id")).alias("of")), "births")
    while not births.where(F.col("of").isNotNull()).isEmpty():
        sources = births.select(by, F.col("life").alias("of"), F.col("born").alias("_born"), F.col("of").alias("_of"))
        births = settled(births.join(sources, [by, "of"], "left").select(by, "life", F.coalesce("born", "_born").alias("born"), F.col("_of").alias("of")), "births")

    ends = trace.where(deleted & F.col("file_path").isNotNull()).select(by, "event_id", "file_path", "ts_ms")
    return ends.join(births.select(by, F.col("life").alias("event_id"), "born"), [by, "event_id"], "left").select(by, "event_id", "file_path", (F.col("ts_ms") - F.col("born")).alias("file_age_ms"))


def settled_deletes(trace: DataFrame, within_ms: int = DEFAULTS.deferred_delete_ms, clock: int = 1) -> DataFrame:
    """Deletes that no write of the same path follows within ``within_ms``, as atomic saves do."""
    w = W.partitionBy("profile_id", "file_path").orderBy("ts_ms", "event_id")
    rows = trace.where(F.col("event_type").isin("file_delete", "file_write")).select("profile_id", "event_id", "event_type", "file_path", "ts_ms", clocked(clock).alias("now"))
    rows = rows.withColumn("_next", F.lead(F.struct("event_type", "now")).over(w)).where(F.col("event_type") == "file_delete")
    undone = (F.col("_next.event_type") == "file_write") & (F.col("_next.now") - F.col("now") <= within_ms)
    return rows.where(~F.coalesce(undone, F.lit(False))).select("profile_id", "event_id", "file_path", "ts_ms")


def rated_by_all(ratings: DataFrame) -> DataFrame:
    """Profiles that every rater has rated."""
    raters = ratings.agg(F.count_distinct("rater").alias("raters"))
    return ratings.groupBy("profile_id").agg(F.count_distinct("rater").alias("n")).join(F.broadcast(raters), F.col("n") == F.col("raters")).select("profile_id")


def with_predictions(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Ground truth with predicted tiers; a missing one is ``?``."""
    return truth.join(predicted.select("profile_id", "dim", F.col("tier").alias("predicted")), ["profile_id", "dim"], "left").withColumn("predicted", F.coalesce("predicted", F.lit("?")))


def not_yet(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no result yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def of_tasks(rows: DataFrame, task_ids: DataFrame) -> DataFrame:
    return rows.join(task_ids.select("task_id").distinct(), "task_id", "left_semi")


def first_tasks(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` trajectories of each profile."""
    return rows.withColumn("_r", F.dense_rank().over(W.partitionBy("profile_id").orderBy("task_id"))).where(F.col("_r") <= n).drop("_r")
