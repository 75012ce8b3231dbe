"""Ordered operators for sessions of any length: one session's rows are spread over all tasks.

A window over a session holds it in one task. Here rows are placed in a global
order first, by ranges; the places fall into blocks, a block is scanned on its
own, and one row for each block (its last row, its sum) is scanned over the
blocks and handed to each. Keys (``by``) are never null; ``seq`` counts a
session's rows from 1 and ``block`` is (seq - 1) / size, whatever is filtered
later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import DEFAULTS
from tracewell.operators.sequences import phase_class
from tracewell.operators.storage import settled

SIZE = 4096


def blocks_of(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """``rows`` with the block of their ``seq``."""
    return rows.withColumn("block", F.floor((F.col("seq") - 1) / size))


def placed(rows: DataFrame, by: list[str], order: list[str], size: int = SIZE) -> DataFrame:
    """``rows`` with seq, their place by ``order`` (unique within ``by``), and block."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.select(*by, "_part", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order))
    return blocks_of(ranged.join(sums, [*by, "_part"]).withColumn("seq", (F.col("_before") + number).cast("long")).drop("_part", "_before"), size)


def _in_block(by: list[str]):  # noqa: ANN202
    return W.partitionBy(*by, "block").orderBy("seq")


def _over_blocks(by: list[str]):  # noqa: ANN202
    return W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)


def before(rows: DataFrame, by: list[str], columns: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``, a struct of ``columns`` of the row before, null for the first of each session."""
    own = F.struct(*columns)
    last = rows.groupBy(*by, "block").agg(F.max_by(own, "seq").alias("_last"))
    carried = last.select(*by, "block", F.last("_last", ignorenulls=True).over(_over_blocks(by)).alias("_carried"))  # blocks that a filter has emptied are skipped
    return rows.join(carried, [*by, "block"]).withColumn(out, F.coalesce(F.lag(own).over(_in_block(by)), "_carried")).drop("_carried")


def running(rows: DataFrame, by: list[str], value: Column, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row."""
    rows = rows.withColumn(out, value)
    sums = rows.groupBy(*by, "block").agg(F.sum(out).alias("_sum"))
    carried = sums.select(*by, "block", F.coalesce(F.sum("_sum").over(_over_blocks(by)), F.lit(0)).alias("_carried"))
    here = F.coalesce(F.sum(out).over(_in_block(by).rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return rows.join(carried, [*by, "block"]).withColumn(out, F.col("_carried") + here).drop("_carried")


def latest(rows: DataFrame, by: list[str], value: Column, out: str) -> DataFrame:
    """``rows`` with the last ``value`` that isn't null, up to and with each row."""
    rows = rows.withColumn(out, value)
    ends = rows.where(F.col(out).isNotNull()).groupBy(*by, "block").agg(F.max_by(out, "seq").alias("_end"))
    every = rows.select(*by, "block").distinct().join(ends, [*by, "block"], "left")
    carried = every.select(*by, "block", F.last("_end", ignorenulls=True).over(_over_blocks(by)).alias("_carried"))
    here = F.last(out, ignorenulls=True).over(_in_block(by).rowsBetween(W.unboundedPreceding, 0))
    return rows.join(carried, [*by, "block"]).withColumn(out, F.coalesce(here, "_carried")).drop("_carried")


def transitions(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, seq, from_type, to_type): consecutive event types; seq is that of the second."""
    out = before(rows.select(*by, "seq", "block", "event_type"), by, ["event_type"], "_p").where(F.col("_p").isNotNull())
    return out.select(*by, "seq", F.col("_p.event_type").alias("from_type"), F.col("event_type").alias("to_type"))


def phases(rows: DataFrame, by: list[str], of: int = DEFAULTS.phase_block, size: int = SIZE) -> DataFrame:
    """Merged phases with their number of events, as ``sequences.phases``."""
    rows = rows.select(*by, "seq", phase_class(F.col("event_type")).alias("phase"), F.floor((F.col("seq") - 1) / of).alias("five"))
    counts = rows.groupBy(*by, "five", "phase").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("at"))
    best = F.max_by("phase", F.struct((F.col("phase") != "other").cast("int"), "n", -F.col("at"))).alias("phase")
    fives = counts.groupBy(*by, "five").agg(best, F.sum("n").alias("events"))
    fives = blocks_of(fives.withColumn("seq", F.col("five") + 1), size)
    fives = before(fives, by, ["phase"], "_p")
    fives = running(fives, by, F.when(F.col("_p.phase") == F.col("phase"), 0).otherwise(1), "phase_no")
    return fives.groupBy(*by, "phase_no", "phase").agg(F.sum("events").alias("events"), F.count(F.lit(1)).alias("blocks"))


def context_switches(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, seq, from_file, to_file, switch_count): reads of another file than the last read one, with a running number."""
    reads = before(rows.where(F.col("event_type") == "file_read").select(*by, "seq", "block", "file_path"), by, ["file_path"], "_p")
    out = running(reads.where(F.col("_p.file_path") != F.col("file_path")), by, F.lit(1), "switch_count")
    return out.select(*by, "seq", F.col("_p.file_path").alias("from_file"), F.col("file_path").alias("to_file"), "switch_count")


def running_number(rows: DataFrame, by: list[str], kind: str, out: str = "sequence_position") -> DataFrame:
    """Position of each event of one kind among its kind."""
    return running(rows.where(F.col("event_type") == kind), by, F.lit(1), out)


def iterations(rows: DataFrame, by: list[str], start: Column, tool: Column, failed: Column) -> DataFrame:
    """Tools and errors by iteration, an iteration being what follows a start."""
    numbered = running(rows, by, start.cast("int"), "iteration")
    return numbered.groupBy(*by, "iteration").agg(F.count_if(tool).alias("tools_called"), F.coalesce(F.bool_or(failed), F.lit(False)).alias("has_error"))


def recoveries(rows: DataFrame, by: list[str], is_error: Column, is_success: Column, tool: Column) -> DataFrame:
    """The first success after each pending error, as ``joins.recoveries``; rows have ts_ms."""
    rows = rows.withColumn("_tool", tool).withColumn("_ok", is_success)
    rows = latest(rows, by, F.when(is_error, F.struct("seq", "ts_ms", "_tool")), "_pending").where(F.col("_ok") & ~is_error & F.col("_pending").isNotNull())
    first = rows.groupBy(*by, F.col("_pending").alias("_pending")).agg(F.min(F.struct("seq", "ts_ms", "_tool")).alias("_r"))
    how = F.when(F.col("_pending._tool").eqNullSafe(F.col("_r._tool")), "retry").otherwise("rethink")
    return first.select(*by, F.col("_pending.seq").alias("error_seq"), F.col("_r.seq").alias("seq"), how.alias("strategy"), (F.col("_r.ts_ms") - F.col("_pending.ts_ms")).alias("latency_ms"))
