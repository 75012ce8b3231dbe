"""The registered methods as pipelines from a trace to a prompt table, and the model stage that answers prompts.

A method is ``f(trace) -> DataFrame(profile_id, prompt)``; a model is any
function of prompt texts, run over partitions of the prompt table. Methods that
extract memories with a model take one as ``model`` and ask it about batches or
windows of narrative; without one they take the rendered events as memories.
Where a method always asks, a deterministic stand-in answers by default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import DEFAULTS
from tracewell.operators import features as ft
from tracewell.operators import profiles as pf
from tracewell.operators import rendering as rd
from tracewell.operators import sequences as sq
from tracewell.operators import similarity as sm
from tracewell.operators.storage import settled
from tracewell.sources.traces import KEY, behavioural

Model = Callable[[list[str]], list[str]]
#: Adds the column vector for the texts in a column; any method that compares vectors takes one.
Embedder = Callable[[DataFrame, str], DataFrame]


def stand_in(prompts: list[str]) -> list[str]:
    """The default model: uncertain about everything."""
    return ['{"verdict": "uncertain", "n_chars": %d}' % len(p) for p in prompts]


def answered(prompts: DataFrame, model: Model = stand_in, tries: int = 3) -> DataFrame:
    """``prompts`` with a reply each; a batch that fails is tried again, then the task fails and Spark retries it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for attempt in range(tries):
                try:
                    yield batch.assign(reply=model(batch["prompt"].fillna("").tolist()))
                    break
                except Exception:
                    if attempt + 1 == tries:
                        raise

    return prompts.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes) + ", reply string")


METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def method(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    METHODS[f.__name__] = f
    return f


def _of_profile(lines: DataFrame, order: str, text: str, k: int | None = None, by: list | None = None) -> DataFrame:
    if k:
        lines = sq.first_by(lines, ["profile_id"], by or [F.col(order)], k)
    return rd.joined(lines, ["profile_id"], order, text).withColumnRenamed("text", "prompt")


def _headed(prompts: DataFrame, heads: DataFrame) -> DataFrame:
    """Prompts behind the ``head`` of their profile."""
    rows = prompts.join(heads.select("profile_id", "head"), "profile_id")
    return rows.select("profile_id", F.concat_ws("\n", "head", "prompt").alias("prompt"))


def _extracted(texts: DataFrame, model: Model, order: str, ask: str) -> DataFrame:
    """(profile_id, seq, content): replies about ``texts`` (profile_id, ``order``, text), numbered in their order within each profile."""
    asked = texts.select("profile_id", F.col(order).alias("at"), F.concat(F.lit(f"{ask}\n"), "text").alias("prompt"))
    replies = answered(asked, model)
    return replies.select("profile_id", F.row_number().over(W.partitionBy("profile_id").orderBy("at")).alias("seq"), F.col("reply").alias("content"))


def _at(df: DataFrame) -> DataFrame:
    """Adds ``at``, which orders rows by task and place."""
    return df.withColumn("at", F.struct("task_id", "seq"))


#: Characters of a content that ``full_context`` shows; a trace needs no more of them (see ``trace_of_events``).
SHOWN = 800


@method
def full_context(trace: DataFrame) -> DataFrame:
    """All narratives up to the prompt budget."""
    whole = settled(rd.joined(rd.narrative_lines(behavioural(trace), SHOWN), list(KEY)), "sessions")  # read twice below
    return _of_profile(sq.within_budget(whole, ["profile_id"], ["task_id"], "text", key=list(KEY)), "task_id", "text")


@method
def eager_summarization(trace: DataFrame) -> DataFrame:
    """A summary per trajectory, joined."""
    whole = rd.joined(rd.narrative_lines(behavioural(trace)), list(KEY))
    replies = answered(whole.select(*KEY, F.concat(F.lit("Summarise this session.\n"), "text").alias("prompt")))
    return _of_profile(replies, "task_id", "reply")


@method
def naive_rag(trace: DataFrame, query: str = "file access and editing habits", k: int = 5, embed: Embedder | None = sm.embed) -> DataFrame:
    """The chunks of events most like the query; without an embedder those that contain most of its parts, between commas, then the first."""
    lines = rd.narrative_lines(behavioural(trace))
    chunks = rd.joined(sq.chunks(lines), [*KEY, "chunk"]).withColumn("id", F.xxhash64("profile_id", "task_id", "chunk"))
    if embed is None:
        words = trace.sparkSession.createDataFrame([(query,)], "text string").select(sm.keywords_of(F.col("text"), by_commas=True)).first()[0]
        hits = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in words), F.lit(0))
        return _of_profile(sq.first_by(chunks.withColumn("hits", hits), ["profile_id"], [F.desc("hits"), F.col("task_id"), F.col("chunk")], k), "rank", "text")
    asked = embed(trace.sparkSession.createDataFrame([(0, query)], "query_id int, text string"), "text").select("query_id", "vector")
    vectors = embed(chunks, "text").crossJoin(F.broadcast(asked.select(F.col("vector").alias("asked"))))
    scored = vectors.withColumn("similarity", sm.cosine(F.col("vector"), F.col("asked")))
    return _of_profile(sq.first_by(scored, ["profile_id"], [F.desc("similarity"), F.col("task_id"), F.col("chunk")], k), "rank", "text")


@method
def mem0(trace: DataFrame, batch: int = 20) -> DataFrame:
    """Messages in batches, distinct memories kept by first appearance."""
    rows = rd.messages(behavioural(trace))
    rows = rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("profile_id").orderBy("task_id", "seq")) - 1) / batch))
    first = rows.groupBy("profile_id", "content").agg(F.min(F.struct("batch", "task_id", "seq")).alias("at"))
    return _of_profile(first, "at", "content")


@method
def zep(trace: DataFrame, k: int = 150) -> DataFrame:
    """Figures of each profile's graph, its most linked nodes, and the latest facts."""
    facts = rd.graph_facts(behavioural(trace))
    figures = pf.graph_stats(facts, ["profile_id"])
    linked = pf.degrees(facts, 10, ["profile_id"]).select("profile_id", "rank", F.concat("node", F.lit(" ("), F.col("degree").cast("string"), F.lit(")")).alias("node"))
    linked = rd.joined(linked, ["profile_id"], "rank", "node", ", ").withColumnRenamed("text", "linked")
    count = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("Graph: "), count("nodes"), F.lit(" nodes, "), count("edges"), F.lit(" edges, "), count("relations"), F.lit(" relations\nMost linked: "), "linked")
    return _headed(_of_profile(_at(facts), "at", "fact", k, [F.desc("task_id"), F.desc("seq")]), figures.join(linked, "profile_id").withColumn("head", head))


def _cells(trace: DataFrame, model: Model | None, size: int) -> DataFrame:
    """(profile_id, seq, level, content): rendered cells, or what ``model`` says about batches of ``size`` characters of narrative."""
    if model is None:
        cells = rd.memory_cells(behavioural(trace))
        return cells.select("profile_id", (F.col("task_id") * 1_000_000 + F.col("seq")).cast("long").alias("seq"), "level", "content")
    lines = sq.batches_of(_at(rd.narrative_lines(behavioural(trace))), ["profile_id"], ["task_id", "seq"], "line", size)
    found = _extracted(rd.joined(lines, ["profile_id", "batch"], "at"), model, "batch", "List what this part of the log says about its user.")
    return found.select("profile_id", F.col("seq").cast("long").alias("seq"), F.lit("extracted").alias("level"), "content")


@method
def memos(trace: DataFrame, k: int = 60, model: Model | None = None) -> DataFrame:
    """Memory cells without overlapping ones of the same level, behind their number, confidence and observations by level."""
    cells = _cells(trace, model, 3000)
    entries = cells.select(F.col("profile_id").alias("group"), F.col("level").alias("type"), "seq", F.col("content").alias("text"), F.lit(0.5).alias("confidence"), F.lit(1).alias("observations"))
    kept = settled(sm.consolidate(entries).withColumnRenamed("group", "profile_id"), "kept")  # read twice below
    count = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("- "), "type", F.lit(": "), count("memories"), F.lit(" memories, confidence "), F.format_string("%.2f", "mean_confidence"), F.lit(", "), count("observed_often"), F.lit(" seen more than once"))
    heads = rd.joined(pf.memory_statistics(kept, ["profile_id"], "type").withColumn("line", line), ["profile_id"], "type").withColumnRenamed("text", "head")
    return _headed(_of_profile(kept, "seq", "text", k), heads)


@method
def memu(trace: DataFrame, k: int = 50, batch: int = 50, model: Model | None = None) -> DataFrame:
    """The most important resources; with a model, what it says about each batch of ``batch`` of them."""
    rows = _at(rd.resources(behavioural(trace)))
    if model is None:
        return _of_profile(rows, "at", "content", k, [F.desc("importance"), F.col("task_id"), F.col("seq")])
    number = F.row_number().over(W.partitionBy("profile_id").orderBy("task_id", "seq")) - 1
    texts = rd.joined(rows.withColumn("batch", F.floor(number / batch)), ["profile_id", "batch"], "at", "content")
    return _of_profile(_extracted(texts, model, "batch", "Name the categories of these resources."), "seq", "content", k)


@method
def evermemos(trace: DataFrame, most: int = DEFAULTS.forced_split, model: Model | None = None, embed: Embedder = sm.embed) -> DataFrame:
    """Segments between context switches, of ``most`` events at most, clustered by leader, the largest cluster's first.

    Each cluster names the most frequent main event of its segments, how sure
    that is by their number, and how many other main events contradict it.
    """
    lines = rd.narrative_lines(trace)
    parts = sq.split_at(trace).select(*KEY, "seq", "segment", "event_type")
    number = F.row_number().over(W.partitionBy(*KEY, "segment").orderBy("seq")) - 1
    parts = parts.withColumn("segment", F.struct("segment", F.floor(number / most).alias("part"))).join(lines, [*KEY, "seq"])
    padded = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    texts = rd.joined(parts, [*KEY, "segment"]).withColumn("id", F.concat_ws("/", padded("task_id"), padded("segment.segment"), padded("segment.part")))
    if model:
        texts = answered(texts.withColumn("prompt", F.concat(F.lit("Summarise this episode.\n"), "text")), model).withColumn("text", F.col("reply"))
    mains = parts.groupBy(*KEY, "segment", "event_type").agg(F.count(F.lit(1)).alias("n"))
    mains = sq.first_by(mains, [*KEY, "segment"], [F.desc("n"), F.col("event_type")], 1).select(*KEY, "segment", F.col("event_type").alias("main"))
    vectors = embed(texts.select("profile_id", "id", "text"), "text")
    clusters = sm.leader_clusters(vectors.select(F.col("profile_id").alias("group"), "id", "vector")).withColumnRenamed("group", "profile_id")
    rows = texts.join(mains, [*KEY, "segment"]).join(clusters, ["profile_id", "id"])
    sure = pf.evidence(rows.groupBy("profile_id", "cluster", "main").agg(F.count(F.lit(1)).alias("n")), ["profile_id", "cluster"], "main")
    name = F.concat(F.lit("# Mostly "), "main", F.lit(": confidence "), "confidence", F.lit(", contradicted "), F.col("contradictions").cast("string"), F.lit(" times"))
    clustered = rd.joined(rows, ["profile_id", "cluster"], "id", "text")
    sizes = rows.groupBy("profile_id", "cluster").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    out = clustered.join(sizes, ["profile_id", "cluster"]).join(sure.select("profile_id", "cluster", name.alias("name")), ["profile_id", "cluster"])
    out = out.select("profile_id", F.struct(-F.col("size"), F.col("first")).alias("at"), F.concat_ws("\n", "name", "text").alias("text"))
    return _of_profile(out, "at", "text")


@method
def simplemem(trace: DataFrame, k: int = 120, model: Model | None = None) -> DataFrame:
    """Memory entries, near-equal ones merged; with a model, what it says about overlapping windows of events."""
    if model is None:
        rows = rd.memory_entries(behavioural(trace)).withColumn("seq", (F.col("task_id") * 1_000_000 + F.col("seq")).cast("long"))
    else:
        lines = _at(sq.overlapping(rd.narrative_lines(behavioural(trace))))
        texts = rd.joined(lines, [*KEY, "window_no"]).withColumn("window", F.struct("task_id", "window_no"))
        none = F.array().cast("array<string>")
        rows = _extracted(texts, model, "window", "Restate what happens here.").select("profile_id", F.col("seq").cast("long").alias("seq"), F.col("content").alias("restatement"), none.alias("keywords"), none.alias("entities"), F.lit(0.8).alias("confidence"))
    entries = rows.select(F.col("profile_id").alias("group"), "seq", F.col("restatement").alias("text"), "confidence", "keywords", "entities")
    merged = sm.merge_by_overlap(entries).withColumnRenamed("group", "profile_id")
    tagged = merged.withColumn("text", F.concat("text", F.when(F.size("keywords") > 0, F.concat(F.lit(" ["), F.array_join("keywords", ", "), F.lit("]"))).otherwise("")))
    return _of_profile(tagged, "seq", "text", k, [F.desc("confidence"), F.col("seq")])


@method
def mma(trace: DataFrame, query: str = "file access and editing habits", k: int = 8, embed: Embedder = sm.embed) -> DataFrame:
    """Chunks in two stages: by likeness to the query, then with their confidence from source, recency and neighbours."""
    rows = sq.chunks(behavioural(trace))
    tags = rd.chunk_tags(rows).withColumn("weight", F.when(F.col("source") == "content_detail", 0.9).when(F.col("source") == "structural", 0.7).otherwise(0.5))
    texts = rd.joined(sq.chunks(rd.narrative_lines(behavioural(trace))), [*KEY, "chunk"]).join(tags, [*KEY, "chunk"])
    texts = texts.withColumn("id", F.xxhash64("profile_id", "task_id", "chunk"))
    timed = sq.recency(texts, ["profile_id"], ["task_id", "chunk"])
    vectors = embed(texts.select("profile_id", "id", "text"), "text").select(F.col("profile_id").alias("group"), "id", "vector")
    sure = sm.propagate_confidence(timed.select("id", F.col("weight").alias("source"), F.col("recency").alias("time")), sm.neighbours(vectors))
    asked = embed(trace.sparkSession.createDataFrame([(query,)], "text string"), "text").select(F.col("vector").alias("asked"))
    like = vectors.crossJoin(F.broadcast(asked)).select("id", sm.cosine(F.col("vector"), F.col("asked")).alias("similarity"))
    # a profile asks among its own chunks
    scored = timed.select(F.col("profile_id").alias("query_id"), "id", "text").join(like, "id").join(sure.select("id", "confidence"), "id")
    return _of_profile(sm.two_stage(scored, "confidence", k).withColumnRenamed("query_id", "profile_id"), "rank", "text")


@method
def visrag(trace: DataFrame, query: str = "file access and editing habits", k: int = 5, embed: Embedder = sm.embed) -> DataFrame:
    """Chunks of events and documents of 100 characters or more in one ranking by likeness to the query."""
    chunks = rd.joined(sq.chunks(rd.narrative_lines(behavioural(trace))), [*KEY, "chunk"]).select("profile_id", F.lit("text").alias("kind"), "text")
    files = ft.created_files(trace).where(F.length("content") >= 100).select("profile_id", F.lit("document").alias("kind"), F.col("content").alias("text"))
    asked = embed(trace.sparkSession.createDataFrame([(query,)], "text string"), "text").select(F.col("vector").alias("asked"))
    both = embed(chunks.unionByName(files), "text").crossJoin(F.broadcast(asked)).withColumn("similarity", sm.cosine(F.col("vector"), F.col("asked")))
    return _of_profile(sq.first_by(both, ["profile_id"], [F.desc("similarity"), F.col("kind"), F.col("text")], k), "rank", "text")


@method
def channels(trace: DataFrame) -> DataFrame:
    """The core method: procedural, semantic and episodic channels, clusters of sessions, and samples of content."""
    trace = settled(trace, "trace")  # this and the two below are read by several channels
    features = settled(ft.trajectory_features(trace, sets=True), "features")
    means = pf.profile_means(features)
    scored = settled(pf.deviations(pf.z_scores(features)), "scored")
    sessions = rd.session_table(scored, features)
    report = rd.profile_report(pf.tiers(means), pf.patterns(means), pf.absences(features), sessions)
    prints = pf.fingerprint(features).select(F.col("profile_id").alias("group"), F.col("task_id").alias("id"), F.col("fingerprint").alias("vector"))
    clusters = sm.centroid_clusters(prints).groupBy(F.col("group").alias("profile_id"), "cluster").agg(F.sort_array(F.collect_list("id")).alias("tasks"))
    named = F.concat(F.lit("- cluster "), F.col("cluster").cast("string"), F.lit(": T"), F.array_join(F.transform("tasks", lambda t: t.cast("string")), ", T"))
    groups = rd.joined(clusters.withColumn("line", named), ["profile_id"], "cluster").select("profile_id", F.concat(F.lit("# Clusters\n"), "text").alias("groups"))
    changed = F.col("lines_added") + F.col("lines_deleted")
    kind = F.when(F.col("event_type") == "file_edit", F.when(changed > 10, "major_edit").otherwise("minor_edit")).when(F.col("operation") == "create", "create")
    files = trace.where(kind.isNotNull() & (F.coalesce("content", F.lit("")) != "")).join(scored.select(*KEY, "distance"), list(KEY))
    picks = sm.sample_contents(files.select(F.col("profile_id").alias("group"), "task_id", kind.alias("kind"), "file_type", "content", (1 + F.col("distance")).alias("importance")))
    shown = F.concat(F.lit("## T"), F.col("task_id").cast("string"), F.lit(" "), "kind", F.lit(" ("), "file_type", F.lit(")\n"), "sample")
    picks = picks.select(F.col("group").alias("profile_id"), F.struct("task_id", "kind").alias("at"), shown.alias("line"))
    samples = rd.joined(picks, ["profile_id"], "at").select("profile_id", F.concat(F.lit("# Samples\n"), "text").alias("samples"))
    out = report.join(groups, "profile_id", "left").join(samples, "profile_id", "left")
    return out.select("profile_id", F.concat_ws("\n\n", "report", "groups", "samples").alias("prompt"))


__all__ = ["METHODS", "answered", "method", "stand_in"]
