"""Scores, agreement between raters, and questions with known answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import CROSS_QUESTION_SKIPS, QUESTION_SKIPS
from tracewell.sources.traces import KEY

TIERS = ("L", "M", "R")


def overall(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the scores above 0."""
    return scores.groupBy(*by).agg(F.avg(F.when(F.col("score") > 0, F.col("score"))).alias("overall"))


def method_summary(scores: DataFrame) -> DataFrame:
    """mean, median, std, min, max and n per method and attribute; scores of 0 count."""
    s = F.col("score")
    return scores.groupBy("method", "attr").agg(F.avg(s).alias("mean"), F.median(s).alias("median"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), F.count(s).alias("n"))


def ranking(scores: DataFrame) -> DataFrame:
    """Methods by the mean of their attributes' means, best first."""
    means = method_summary(scores).groupBy("method").agg(F.avg("mean").alias("overall"))
    return means.withColumn("rank", F.row_number().over(W.orderBy(F.desc("overall"), "method")))


def comparison(scores: DataFrame, attributes: list) -> DataFrame:
    """Method by attribute, with the mean of the attributes' means."""
    wide = scores.groupBy("method").pivot("attr", attributes).agg(F.avg("score"))
    return wide.join(ranking(scores).select("method", "overall"), "method")


def group_means(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean per method and attribute group (attr, channel); a missing score counts as 0."""
    methods = scores.select("method", "profile_id").distinct()
    full = methods.join(F.broadcast(groups)).join(scores, ["method", "profile_id", "attr"], "left")
    return full.groupBy("method", "channel").agg(F.avg(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("mean"))


def learning_curve(scores: DataFrame) -> DataFrame:
    """Mean by method and number of trajectories, over profiles with a score above 0."""
    per_profile = scores.groupBy("method", "n", "profile_id").agg(F.avg(F.when(F.col("score") > 0, F.col("score"))).alias("s"))
    return per_profile.where(F.col("s") > 0).groupBy("method", "n").agg(F.avg("s").alias("mean"), F.count(F.lit(1)).alias("profiles"))


def valid_score(x: Column) -> Column:
    return F.when(x.between(1, 5), x).otherwise(0)


def valid_tier(x: Column) -> Column:
    t = F.upper(F.trim(x))
    return F.when(t.isin(*TIERS), t).otherwise("?")


def accuracy(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Share of equal (truth, predicted) among valid ones, for each of ``by``, or pooled if that is empty."""
    ok = pairs.where(F.col("truth").isin(*TIERS) & F.col("predicted").isin(*TIERS))
    return ok.groupBy(*by).agg(F.avg((F.col("truth") == F.col("predicted")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion(pairs: DataFrame, labels: list) -> DataFrame:
    return pairs.groupBy("truth").pivot("predicted", labels).count().na.fill(0)


def cohens_kappa(pairs: DataFrame, labels: list) -> DataFrame:
    """Agreement of two raters (one, two) beyond chance, in one row."""
    n = F.count(F.lit(1))
    marginals = [(F.avg((F.col("one") == x).cast("double")), F.avg((F.col("two") == x).cast("double"))) for x in labels]
    chance = sum((a * b for a, b in marginals), F.lit(0.0))
    out = pairs.agg(n.alias("n"), F.avg((F.col("one") == F.col("two")).cast("double")).alias("po"), chance.alias("pe"))
    return out.select("n", "po", "pe", F.when(F.col("n") == 0, 0.0).when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, raters: int) -> DataFrame:
    """Agreement of ``raters`` raters over the items (item, rater, label) that all of them rated."""
    full = ratings.groupBy("item").agg(F.count_distinct("rater").alias("r")).where(F.col("r") == raters).select("item")
    counts = ratings.join(full, "item", "left_semi").groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"))
    items = counts.groupBy("item").agg(((F.sum(F.col("n") * F.col("n")) - raters) / (raters * (raters - 1))).alias("p"))
    shares = counts.groupBy("label").agg(F.sum("n").alias("n"))
    total = items.agg(F.count(F.lit(1)).alias("items"), F.avg("p").alias("po"))
    pe = shares.crossJoin(F.broadcast(total)).groupBy("items", "po").agg(F.sum(F.pow(F.col("n") / (F.col("items") * raters), 2)).alias("pe"))
    return pe.select("items", "po", "pe", F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def majority(ratings: DataFrame) -> DataFrame:
    """Most frequent label of each item; of equals the one its first rater gave."""
    counts = ratings.groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"), F.min("rater").alias("first_rater"))
    rank = W.partitionBy("item").orderBy(F.desc("n"), "first_rater", "label")
    return counts.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") == 1).select("item", "label", "n")


def vote_accuracy(ratings: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the items (item, label in ``truth``) whose majority label is right, and their number."""
    votes = majority(ratings).select("item", F.col("label").alias("voted")).join(truth.select("item", F.col("label").alias("right")), "item")
    return votes.agg(F.avg((F.col("voted") == F.col("right")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


#: Question kinds: name, answer, and what must hold for the question to be asked.
def facts(features: DataFrame, first: DataFrame) -> DataFrame:
    """(profile_id, task_id, question, category, answer) of the questions each trajectory can be asked."""
    f = features.join(first, list(KEY), "left")
    c = F.col
    size = F.when(c("avg_lines_changed") < 5, "small").when(c("avg_lines_changed") < 20, "medium").otherwise("large")
    kinds = [
        ("reads", "reading_strategy", c("unique_files_read").cast("string"), c("unique_files_read") >= 2),
        ("first_action", "reading_strategy", c("first_action"), c("first_action").isin("file_read", "file_browse", "file_search", "file_write", "dir_create", "file_edit")),
        ("dirs", "directory_style", c("dirs_created").cast("string"), c("dirs_created") >= 1),
        ("depth", "directory_style", c("max_dir_depth").cast("string"), c("dirs_created") >= 1),
        ("creates", "output_detail", c("files_created").cast("string"), c("files_created") >= 1),
        ("edits", "edit_strategy", c("total_edits").cast("string"), c("total_edits") >= 1),
        ("edit_size", "edit_strategy", size, c("total_edits") >= 1),
        ("search_or_browse", "reading_strategy", F.when(c("total_searches") > c("total_browses"), "search").when(c("total_searches") < c("total_browses"), "browse").otherwise("equal"), c("total_searches") + c("total_browses") >= 1),
        ("backups", "version_strategy", F.when(c("backup_copies") > 0, "yes").otherwise("no"), c("total_copies") + c("total_overwrites") >= 1),
    ]
    rows = F.array(*(F.when(when, F.struct(F.lit(q).alias("question"), F.lit(k).alias("category"), a.alias("answer"))) for q, k, a, when in kinds))
    return f.select(*KEY, F.explode(F.array_compact(rows)).alias("x")).select(*KEY, "x.*")


def read_before_write(trace: DataFrame) -> DataFrame:
    """Whether a trajectory's first read comes before its first write, where it has both."""
    first = trace.groupBy(*KEY).agg(F.min(F.when(F.col("event_type") == "file_read", F.col("ts_ms"))).alias("r"), F.min(F.when(F.col("event_type") == "file_write", F.col("ts_ms"))).alias("w"))
    return first.where(F.col("r").isNotNull() & F.col("w").isNotNull()).select(*KEY, (F.col("r") < F.col("w")).alias("read_first"))


def usual_first_action(first: DataFrame) -> DataFrame:
    """Most common first action of each profile; of equals the one seen in the earlier task."""
    counts = first.groupBy("profile_id", "first_action").agg(F.count(F.lit(1)).alias("n"), F.min("task_id").alias("since"))
    rank = W.partitionBy("profile_id").orderBy(F.desc("n"), "since")
    return counts.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") == 1).select("profile_id", "first_action", "n")


def directory_bucket(mean_dirs: Column) -> Column:
    return F.when(mean_dirs < 1, "0").when(mean_dirs < 3, "1-2").when(mean_dirs < 6, "3-5").otherwise("6+")


def choices(numeric: DataFrame, seed: str = "42", deltas: tuple[int, ...] = (-3, -2, -1, 1, 2, 3, 5)) -> DataFrame:
    """Numeric answers (question_id, answer) with three distractors near them, and the letter of the right one.

    A hash of ``seed``, the question and the value draws the distractors among
    those that are 0 or more, and another one sets the order.
    """
    key = lambda role, x: F.md5(F.concat_ws("/", F.lit(seed), F.lit(role), F.col("question_id"), x.cast("string")))
    ranked = lambda role, xs: F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(key(role, x).alias("h"), x.alias("v")))), lambda s: s["v"])
    near = F.filter(F.transform(F.array(*map(F.lit, deltas)), lambda d: F.col("answer") + d), lambda x: x >= 0)
    options = ranked("order", F.concat(F.array("answer"), F.slice(ranked("draw", near), 1, 3)))
    rows = numeric.withColumn("options", options)
    return rows.withColumn("correct", F.substring(F.lit("ABCD"), F.array_position("options", F.col("answer")).cast("int"), F.lit(1)))


def question_set(questions: DataFrame, of_session: int = 3, of_profile: int = 10, seed: str = "42") -> DataFrame:
    """At most ``of_session`` questions (profile_id, task_id, question) of each session, and ``of_profile`` of each profile, drawn by a hash.

    Questions across sessions have no task_id, and only the second limit.
    """
    drawn = F.md5(F.concat_ws("/", F.lit(seed), F.col("profile_id").cast("string"), F.coalesce(F.col("task_id").cast("string"), F.lit("")), "question"))
    rows = questions.withColumn("_h", drawn)
    own = F.row_number().over(W.partitionBy(*KEY).orderBy("_h", "question"))
    rows = rows.withColumn("_r", own).where(F.col("task_id").isNull() | (F.col("_r") <= of_session))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("profile_id").orderBy("_h", "task_id", "question")))
    return rows.where(F.col("place") <= of_profile).drop("_h", "_r")


def question_rows(trace: DataFrame, across: bool = False) -> DataFrame:
    """Rows that questions may be about: within one trajectory, or ``across`` several, where snapshots are left out too."""
    return trace.where(~F.col("event_type").isin(*(CROSS_QUESTION_SKIPS if across else QUESTION_SKIPS)))


def shift_agreement(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """How deviation flags (keys, is_deviant) agree with shifts (keys, applied); a session without a label isn't shifted."""
    rows = flags.join(labels, list(KEY), "left").select(F.coalesce("is_deviant", F.lit(False)).alias("d"), F.coalesce("applied", F.lit(False)).alias("s"))
    counts = rows.agg(F.count_if(F.expr("d AND s")).alias("hits"), F.count_if(F.expr("d AND NOT s")).alias("false_alarms"), F.count_if(F.expr("s AND NOT d")).alias("misses"), F.count_if(F.expr("NOT d AND NOT s")).alias("quiet"))
    hits, total = F.col("hits"), F.col("hits") + F.col("false_alarms") + F.col("misses") + F.col("quiet")
    share = lambda n, of: F.when(of > 0, n / of)
    return counts.withColumns({"precision": share(hits, hits + F.col("false_alarms")), "recall": share(hits, hits + F.col("misses")), "accuracy": share(hits + F.col("quiet"), total)})


def backbone_summary(scores: DataFrame) -> DataFrame:
    """Mean and number of the scores above 0 by backbone and method."""
    return scores.where(F.col("score") > 0).groupBy("backbone", "method").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("scores"))


def with_rubrics(scores: DataFrame, rubrics: DataFrame) -> DataFrame:
    """``scores`` with the rubric of their attribute; an attribute without one gets an empty text. Rubrics are one row per attribute."""
    return scores.join(rubrics, "attribute", "left").withColumn("rubric", F.coalesce("rubric", F.lit("")))
