"""Ordered operators over a trajectory: transitions, phases, islands, segments, chunks and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import DEFAULTS, EXPLORATION_TYPES, ORGANIZATION_TYPES, PRODUCTION_TYPES
from tracewell.sources.traces import KEY


def _w():  # noqa: ANN202
    return W.partitionBy(*KEY).orderBy("seq")


def transitions(behaviour: DataFrame) -> DataFrame:
    """Consecutive event types of each trajectory."""
    pairs = behaviour.select(*KEY, "seq", F.col("event_type").alias("from_type"), F.lead("event_type").over(_w()).alias("to_type"))
    return pairs.where(F.col("to_type").isNotNull())


def transition_counts(behaviour: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return transitions(behaviour).groupBy(*by, "from_type", "to_type").agg(F.count(F.lit(1)).alias("n"))


def dominant_transition(behaviour: DataFrame) -> DataFrame:
    """The most frequent transition of a trajectory; of equals that whose first type, then whose pair, was seen first."""
    counts = transitions(behaviour).groupBy(*KEY, "from_type", "to_type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("pair_at"))
    counts = counts.withColumn("from_at", F.min("pair_at").over(W.partitionBy(*KEY, "from_type")))
    rank = W.partitionBy(*KEY).orderBy(F.desc("n"), "from_at", "pair_at")
    return counts.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") == 1).select(*KEY, "from_type", "to_type", "n")


def common_dominant(dominant: DataFrame) -> DataFrame:
    """The transition that is dominant in most sessions of each profile, of equals that of the earlier session."""
    counts = dominant.groupBy("profile_id", "from_type", "to_type").agg(F.count(F.lit(1)).alias("sessions"), F.min("task_id").alias("since"))
    rank = W.partitionBy("profile_id").orderBy(F.desc("sessions"), "since")
    return counts.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") == 1).select("profile_id", "from_type", "to_type", "sessions")


def phase_class(kind: Column) -> Column:
    return F.when(kind.isin(*EXPLORATION_TYPES), "exploration").when(kind.isin(*PRODUCTION_TYPES), "production").when(kind.isin(*ORGANIZATION_TYPES), "organization").otherwise("other")


def phases(behaviour: DataFrame, block: int = DEFAULTS.phase_block) -> DataFrame:
    """Merged phases of each trajectory, with their number of events.

    Events fall into blocks; a block's phase is its most frequent class but
    ``other`` (of equals the first seen), and neighbouring blocks of one phase merge.
    """
    rows = behaviour.select(*KEY, "seq", phase_class(F.col("event_type")).alias("phase"), F.floor((F.row_number().over(_w()) - 1) / block).alias("block"))
    counts = rows.groupBy(*KEY, "block", "phase").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("at"))
    counts = counts.withColumn("events", F.sum("n").over(W.partitionBy(*KEY, "block")))
    rank = W.partitionBy(*KEY, "block").orderBy((F.col("phase") == "other").cast("int"), F.desc("n"), "at")
    blocks = counts.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") == 1)
    order = W.partitionBy(*KEY).orderBy("block")
    fresh = (F.lag("phase").over(order) != F.col("phase")) | F.lag("phase").over(order).isNull()
    blocks = blocks.withColumn("_new", fresh.cast("int")).withColumn("phase_no", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return blocks.groupBy(*KEY, "phase_no", "phase").agg(F.sum("events").alias("events"), F.count(F.lit(1)).alias("blocks"))


def phase_summary(merged: DataFrame) -> DataFrame:
    """Number of phases and their order, as ``a -> b``."""
    ordered = F.array_sort(F.collect_list(F.struct("phase_no", "phase")))
    return merged.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_phases"), F.array_join(F.transform(ordered, lambda x: x["phase"]), " -> ").alias("pattern"))


def access_edges(behaviour: DataFrame) -> DataFrame:
    """Moves from one file to another, skipping events without a path."""
    rows = behaviour.where(F.coalesce(F.col("file_path"), F.lit("")) != "").select(*KEY, "seq", F.col("file_path").alias("dst"), F.lag("file_path").over(_w()).alias("src"))
    return rows.where(F.col("src") != F.col("dst")).select(*KEY, "seq", "src", "dst")


def views(trace: DataFrame) -> DataFrame:
    """Running view count and time since the last view of each path."""
    w = W.partitionBy(*KEY, "file_path").orderBy("seq")
    return trace.where(F.col("event_type") == "file_read").select(*KEY, "seq", "file_path", F.row_number().over(w).alias("views"), (F.col("ts_ms") - F.lag("ts_ms").over(w)).alias("revisit_ms"))


def context_switches(trace: DataFrame) -> DataFrame:
    """Reads of another file than the last read one, with a running number."""
    reads = trace.where(F.col("event_type") == "file_read").select(*KEY, "seq", F.col("file_path").alias("to_file"), F.lag("file_path").over(_w()).alias("from_file"))
    out = reads.where(F.col("from_file") != F.col("to_file"))
    return out.withColumn("switch_count", F.row_number().over(_w()))


def cross_file_references(trace: DataFrame, within_ms: int = DEFAULTS.cross_reference_ms, clock: int = 1, with_searches: bool = False) -> DataFrame:
    """A read or edit within ``within_ms`` of the last one on another file; ``clock`` divides the milliseconds."""
    kinds = ["file_read", "file_edit", *(["file_search"] if with_searches else [])]
    now = F.floor(F.col("ts_ms") / clock)
    rows = trace.where(F.col("event_type").isin(kinds)).select(*KEY, "seq", "event_type", "file_path", now.alias("now"))
    rows = rows.withColumn("_last", F.lag(F.struct("event_type", "file_path", "now")).over(_w()))
    out = rows.where((F.col("_last.file_path") != F.col("file_path")) & (F.col("now") - F.col("_last.now") <= within_ms))
    kind = F.when((F.col("_last.event_type") == "file_read") & (F.col("event_type") == "file_edit"), "read_then_edit").otherwise("sequential_access")
    return out.select(*KEY, "seq", F.col("_last.file_path").alias("source_file"), F.col("file_path").alias("target_file"), kind.alias("reference_type"), (F.col("now") - F.col("_last.now")).alias("interval_ms"))


def running_number(trace: DataFrame, kind: str, out: str = "sequence_position") -> DataFrame:
    """Position of each event of one kind among its kind."""
    return trace.where(F.col("event_type") == kind).withColumn(out, F.row_number().over(_w()))


def iterations(trace: DataFrame, start: Column, tool: Column, failed: Column) -> DataFrame:
    """Tools and errors by iteration, an iteration being what follows a start."""
    rows = trace.withColumn("iteration", F.sum(start.cast("int")).over(_w().rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*KEY, "iteration").agg(F.count_if(tool).alias("tools_called"), F.coalesce(F.bool_or(failed), F.lit(False)).alias("has_error"))


def chunks(behaviour: DataFrame, size: int = DEFAULTS.chunk_events) -> DataFrame:
    """Rows with the index of their chunk of ``size`` events."""
    return behaviour.withColumn("chunk", F.floor((F.row_number().over(_w()) - 1) / size))


def overlapping(behaviour: DataFrame, size: int = DEFAULTS.window_events, overlap: int = DEFAULTS.window_overlap) -> DataFrame:
    """Rows once per window they lie in; windows start every ``size - overlap`` events."""
    stride = size - overlap
    at = F.row_number().over(_w()) - 1
    rows = behaviour.withColumn("_at", at)
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - size + 1) / stride))
    return rows.withColumn("window_no", F.explode(F.sequence(first.cast("long"), F.floor(F.col("_at") / stride).cast("long")))).drop("_at")


def segments(behaviour: DataFrame, boundary: Column, shortest: int = DEFAULTS.min_segment, most: int = DEFAULTS.max_segments) -> DataFrame:
    """Segments at boundary rows; those shorter than ``shortest``, but for the first, join the one before; the last of ``most`` takes the rest."""
    w = _w().rowsBetween(W.unboundedPreceding, 0)
    rows = behaviour.withColumn("_raw", F.sum(boundary.cast("int")).over(w)).withColumn("_first", F.min("_raw").over(W.partitionBy(*KEY)))
    rows = rows.withColumn("_size", F.count(F.lit(1)).over(W.partitionBy(*KEY, "_raw")))
    opens = (F.lag("_raw").over(_w()) != F.col("_raw")) & (F.col("_raw") != F.col("_first")) & (F.col("_size") >= shortest)
    rows = rows.withColumn("segment", F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(w))
    return rows.withColumn("segment", F.least("segment", F.lit(most - 1))).drop("_raw", "_first", "_size")


def split_at(trace: DataFrame, kind: str = "context_switch") -> DataFrame:
    """Segments between events of one kind, which are dropped; numbered without gaps."""
    rows = trace.withColumn("_raw", F.sum((F.col("event_type") == kind).cast("int")).over(_w().rowsBetween(W.unboundedPreceding, 0))).where(F.col("event_type") != kind)
    return rows.withColumn("segment", F.dense_rank().over(W.partitionBy(*KEY).orderBy("_raw")) - 1).drop("_raw")


def text_chunks(texts: DataFrame, key: str, text: str, size: int = DEFAULTS.chunk_chars, least: int = DEFAULTS.min_chunk_chars) -> DataFrame:
    """(key, chunk_no, chunk): texts cut every ``size`` characters, stripped, without chunks below ``least``."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / size), F.lit(0)).cast("int")))
    rows = texts.select(key, text, at.alias("chunk_no"))
    rows = rows.select(key, "chunk_no", F.regexp_replace(F.substring(F.col(text), F.col("chunk_no") * size + 1, F.lit(size)), r"^\s+|\s+$", "").alias("chunk"))
    return rows.where(F.length("chunk") >= least)


def forced_cells(behaviour: DataFrame, most: int = DEFAULTS.forced_split, window: int = 5) -> DataFrame:
    """(keys, cell, events, boundary): cells of whole windows of ``window`` events, closed once they hold ``most``; the rest is the last one."""
    full = -(-most // window)
    rows = behaviour.select(*KEY, F.floor(F.floor((F.row_number().over(_w()) - 1) / window) / full).cast("long").alias("cell"))
    out = rows.groupBy(*KEY, "cell").agg(F.count(F.lit(1)).alias("events"))
    return out.withColumn("boundary", F.when(F.col("events") >= most, "force_split").otherwise("end_of_task"))


def chosen_chunks(texts: DataFrame, by: str, key: str, text: str, most: int = DEFAULTS.max_chunks, size: int = DEFAULTS.chunk_chars) -> DataFrame:
    """(by, key, chunk_no, chunk): up to ``most`` chunks of each group (is_edit, is_deviant, importance), usual texts before deviant ones, the important first.

    Of edits only the first ``size`` characters are cut.
    """
    shown = F.when(F.col("is_edit"), F.substring(F.col(text), 1, size)).otherwise(F.col(text))
    chunks = text_chunks(texts.select(key, shown.alias(text)), key, text, size)
    rows = chunks.join(texts.select(by, key, "is_deviant", "importance"), key)
    order = [F.col("is_deviant"), F.desc("importance"), F.col(key), F.col("chunk_no")]
    return first_by(rows, [by], order, most).select(by, key, "chunk_no", "chunk")


def first_by(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    right = right.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    met = left.join(right, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])  # groups may be null
    return met.drop(*(f"_of_{c}" for c in keys))


def _lengths_before(rows: DataFrame, by: list[str], order: list[str], size: Column, blocks: int) -> DataFrame:
    """Adds _before, the sum of ``size`` over the rows of the group that come earlier.

    With one numeric column as order a group is dealt to ``blocks`` ranges of
    it, summed up one by one and then over each other, so that a group that
    holds most rows is not ordered in one task.
    """
    earlier = F.coalesce(F.sum("_size").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long"))
    if len(order) > 1 or dict(rows.dtypes)[order[0]] not in ("int", "bigint", "smallint", "tinyint", "double", "float"):
        return rows.withColumn("_before", earlier).drop("_size")
    at = F.col(order[0])
    bounds = rows.groupBy(*by).agg(F.percentile_approx(at, [i / blocks for i in range(1, blocks)]).alias("_bounds"))
    dealt = _beside(rows, bounds, by).withColumn("_block", F.coalesce(F.size(F.filter("_bounds", lambda b: b < at)), F.lit(0))).drop("_bounds")
    sums = dealt.groupBy(*by, "_block").agg(F.sum("_size").alias("_size"))
    w = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*by, "_block", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*by, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = _beside(dealt, sums, [*by, "_block"])
    return out.withColumn("_before", F.col("_offset") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).drop("_block", "_size", "_offset")


def within_budget(rows: DataFrame, by: list[str], order: list[str], text: str, budget: int = DEFAULTS.prompt_chars, separator: int = 2, blocks: int = 256, key: list[str] | None = None) -> DataFrame:
    """Rows while the running length, with a separator each, is below the budget; the last is cut. A null text has no length.

    With ``key``, the columns that tell rows apart, lengths are summed up
    without the texts, which meet their sums once.
    """
    size = F.length(text) + separator
    if key:
        sizes = rows.select(*dict.fromkeys([*by, *order, *key]), size.alias("_chars"))
        sums = _lengths_before(sizes, by, order, F.col("_chars"), blocks).where(F.col("_before") < budget)
        rows = _beside(rows, sums.select(*key, "_before"), key)
    else:
        rows = _lengths_before(rows, by, order, size, blocks).where(F.col("_before") < budget)
    return rows.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("_before")).cast("int"))).drop("_before")


def batches_of(rows: DataFrame, by: list[str], order: list[str], text: str, size: int, blocks: int = 256) -> DataFrame:
    """Batch number of each row where batches hold about ``size`` characters of the running text."""
    rows = _lengths_before(rows, by, order, F.length(text), blocks)
    return rows.withColumn("batch", F.floor(F.col("_before") / size)).drop("_before")


def recency(rows: DataFrame, by: list[str], order: list[str], half_life: float = DEFAULTS.decay_half_life) -> DataFrame:
    """Weight 0.5 ^ (age / half life), age counted from the last item."""
    w, all_ = W.partitionBy(*by).orderBy(*order), W.partitionBy(*by)
    return rows.withColumn("recency", F.pow(F.lit(0.5), (F.count(F.lit(1)).over(all_) - F.row_number().over(w)) / half_life))


def first_action(behaviour: DataFrame) -> DataFrame:
    return behaviour.groupBy(*KEY).agg(F.min_by("event_type", "seq").alias("first_action"))


def pruning_candidates(turns: DataFrame, conversation: str, order: str, role: str, tokens: Column, skip_users: int = 2, protect: int = 40_000, least: int = 20_000) -> DataFrame:
    """Turns that could be dropped: older than the last ``skip_users`` user turns and than ``protect`` tokens, where that saves ``least``."""
    back = W.partitionBy(conversation).orderBy(F.desc(order))
    seen = F.sum((F.col(role) == "user").cast("int")).over(back.rowsBetween(W.unboundedPreceding, 0))
    rows = turns.withColumn("tokens", tokens).withColumn("_users", seen).where(F.col("_users") >= skip_users)
    rows = rows.withColumn("_total", F.sum("tokens").over(back.rowsBetween(W.unboundedPreceding, 0))).where(F.col("_total") > protect)
    saved = F.sum("tokens").over(W.partitionBy(conversation))
    return rows.withColumn("saved", saved).where(F.col("saved") > least).drop("_users", "_total")
