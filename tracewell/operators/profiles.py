"""Profiles: aggregates over a profile's trajectories, fingerprints, deviations, rules and tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import DIMENSIONS, DEFAULTS, FINGERPRINT, FINGERPRINT_DIMENSIONS
from tracewell.functions.paths import has_cjk
from tracewell.operators.features import distinct
from tracewell.sources.traces import KEY


def numeric_long(features: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(profile_id, task_id, key, value): booleans count as 0 and 1."""
    keys = keys or [c for c, kind in features.dtypes if c not in KEY and not kind.startswith(("array", "map", "struct", "string"))]
    return features.select(*KEY, *(F.col(c).cast("double").alias(c) for c in keys)).unpivot(list(KEY), keys, "key", "value")


def aggregate_features(features: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """mean, median, std (null for one trajectory), min and max of each key over a profile's trajectories; means of booleans are their true ratios."""
    v = F.col("value")
    return numeric_long(features, keys).groupBy("profile_id", "key").agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def profile_means(features: DataFrame) -> DataFrame:
    """Mean of every numeric feature per profile, in one wide row."""
    keys = [c for c, kind in features.dtypes if c not in KEY and not kind.startswith(("array", "map", "struct", "string"))]
    return features.groupBy("profile_id").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in keys), F.count(F.lit(1)).alias("n_trajectories"))


def merge_counters(histogram: DataFrame, by: str = "profile_id", key: str = "file_type") -> DataFrame:
    return histogram.groupBy(by, key).agg(F.sum("n").alias("n"))


def weighted_by_deviation(features: DataFrame, deviations: DataFrame) -> DataFrame:
    """Rows of steady trajectories twice, of deviant ones once, so that all statistics follow."""
    flags = deviations.select(*KEY, "is_deviant")
    copies = F.array_repeat(F.lit(1), F.when(F.coalesce("is_deviant", F.lit(False)), 1).otherwise(2))
    return features.join(flags, list(KEY), "left").withColumn("_copy", F.explode(copies)).drop("_copy", "is_deviant")


def fingerprint(features: DataFrame) -> DataFrame:
    return features.select(*KEY, F.array(*(F.col(c).cast("double") for c in FINGERPRINT)).alias("fingerprint"))


def z_scores(features: DataFrame) -> DataFrame:
    """Fingerprint dimensions within a profile; 0 without spread, as they are for a single trajectory."""
    w = W.partitionBy("profile_id")
    rows = features.select(*KEY, *(F.col(c).cast("double").alias(c) for c in FINGERPRINT))
    # one window operator for all statistics
    stats = rows.select("*", F.count(F.lit(1)).over(w).alias("_n"), *(F.avg(c).over(w).alias(f"_m_{c}") for c in FINGERPRINT), *(F.stddev_samp(c).over(w).alias(f"_s_{c}") for c in FINGERPRINT))
    scores = (F.when(F.col("_n") < 2, F.col(c)).when(F.col(f"_s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) for c in FINGERPRINT)
    return stats.select(*KEY, *scores)


def deviations(scored: DataFrame, threshold: float = DEFAULTS.deviation_threshold) -> DataFrame:
    """Distance of each trajectory to its profile's centroid, rounded to 4 places, and whether it is far off.

    ``scored`` has the fingerprint's columns. Of fewer than three trajectories none is deviant.
    """
    w = W.partitionBy("profile_id")
    squares = reduce(lambda a, b: a + b, ((F.col(c) - F.avg(c).over(w)) ** 2 for c in FINGERPRINT))
    out = scored.withColumn("distance", F.round(F.sqrt(squares), 4)).withColumn("_n", F.count(F.lit(1)).over(w))
    far = F.col("distance") > F.avg("distance").over(w) + threshold * F.stddev_samp("distance").over(w)
    return out.withColumn("is_deviant", (F.col("_n") >= 3) & F.coalesce(far, F.lit(False))).drop("_n")


def shifted_dimensions(deviant: DataFrame, top: int = DEFAULTS.top_shifted) -> DataFrame:
    """The ``top`` features of each deviant trajectory that are furthest from the centroid, earlier features first among equals."""
    w = W.partitionBy("profile_id")
    pairs = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.lit(d).alias("dimension"), F.col(c).alias("value"), F.avg(c).over(w).alias("centroid")) for i, (c, d) in enumerate(zip(FINGERPRINT, FINGERPRINT_DIMENSIONS, strict=True))]
    rows = deviant.withColumn("_pairs", F.array(*pairs)).where("is_deviant").select(*KEY, F.explode("_pairs").alias("p")).select(*KEY, "p.*")
    rows = rows.withColumn("delta", F.round(F.abs(F.col("value") - F.col("centroid")), 3))
    rank = W.partitionBy(*KEY).orderBy(F.desc("delta"), "pos")
    return rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select(*KEY, "rank", "feature", "dimension", "delta")


def consistency(features: DataFrame, keys: tuple[str, ...], stable: float = DEFAULTS.cv_stable) -> DataFrame:
    """Coefficient of variation per key of profiles with two trajectories or more; 0 where the mean is 0."""
    keys = [k for k in keys if k in features.columns]
    agg = aggregate_features(features, keys).where(F.col("n") >= 2)
    cv = F.when(F.col("mean") == 0, 0.0).otherwise(F.col("std") / F.abs("mean"))
    return agg.select("profile_id", "key", "mean", cv.alias("cv")).withColumn("stable", F.col("cv") < stable)


ABSENCES = {
    "never_searches": "total_searches", "never_browses": "total_browses", "never_creates_directories": "dirs_created", "never_edits": "total_edits",
    "never_backs_up": "backup_copies", "never_deletes": "total_deletes", "never_makes_images": "image_files_created",
}


def absences(features: DataFrame) -> DataFrame:
    """(profile_id, absence): what none of a profile's trajectories does."""
    wide = features.groupBy("profile_id").agg(*(F.bool_and(F.col(c) == 0).alias(k) for k, c in ABSENCES.items()))
    return wide.unpivot(["profile_id"], list(ABSENCES), "absence", "holds").where("holds").select("profile_id", "absence")


def consistency_statements(features: DataFrame) -> DataFrame:
    """(profile_id, statement) of what holds in all of two trajectories or more."""
    rules = {"never_search": F.bool_and(F.col("total_searches") == 0), "never_dirs": F.bool_and(F.col("dirs_created") == 0), "always_dirs": F.bool_and(F.col("dirs_created") >= 2), "never_edit": F.bool_and(F.col("total_edits") == 0)}
    wide = features.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in rules.items())).where(F.col("n") >= 2)
    return wide.unpivot(["profile_id"], list(rules), "statement", "holds").where("holds").select("profile_id", "statement")


def pattern_rules() -> list[tuple[str, Column]]:
    """Threshold rules over a profile's means (of booleans: true ratios), in report order."""
    c = F.col
    per_file = F.when((c("total_reads") > 0) & (c("unique_files_read") > 0), c("total_reads") / c("unique_files_read"))
    rules = [
        ("READING: rarely searches", c("search_ratio") < 0.05),
        ("READING: searches heavily", c("search_ratio") > 0.2),
        ("READING: often revisits", c("revisit_ratio") > 0.25),
        ("READING: rarely revisits", c("revisit_ratio") < 0.05),
        ("READING: often browses", c("browse_ratio") > 0.3),
        ("READING: deep", per_file > 1.5),
        ("READING: shallow", per_file < 1.1),
        ("OUTPUT: detailed", c("avg_output_length") > 3000),
        ("OUTPUT: concise", c("avg_output_length") < 800),
        ("OUTPUT: many files", c("files_created") > 3),
        ("OUTPUT: few files", c("files_created") <= 1.5),
        ("ORGANIZATION: many directories", c("dirs_created") >= 3),
        ("ORGANIZATION: few directories", c("dirs_created") < 0.5),
        ("ORGANIZATION: moves files", c("files_moved") > 1),
        ("EDITING: many small edits", (c("total_edits") > 3) & (c("small_edit_ratio") > 0.6)),
        ("EDITING: rarely edits", (c("total_edits") <= 1) & ~((c("total_edits") > 3) & (c("small_edit_ratio") > 0.6))),
        ("EDITING: large edits", c("avg_lines_changed") > 30),
        ("VERSIONING: backs up", c("has_backup_behavior") > 0.5),
        ("VERSIONING: overwrites", (c("has_backup_behavior") <= 0.5) & (c("total_overwrites") > 0.5) & (c("backup_copies") < 0.1)),
        ("VERSIONING: deletes", c("total_deletes") > 1),
        ("CROSS-MODAL: tables", (c("has_tables_or_data") > 0.5) | (c("markdown_table_rows") > 5)),
        ("CROSS-MODAL: images", c("has_images") > 0.3),
        ("CROSS-MODAL: structured data", c("structured_files_created") > 0.5),
        ("CROSS-MODAL: text only", (c("has_tables_or_data") < 0.2) & (c("has_images") < 0.1) & (c("structured_files_created") < 0.2)),
        ("STRUCTURE: deep headings", c("heading_max_depth") >= 3),
        ("STRUCTURE: prose", c("prose_to_structure_ratio") > 3),
        ("STRUCTURE: lists", (c("prose_to_structure_ratio") < 0.5) & (c("heading_count") > 0)),
    ]
    return rules


def patterns(means: DataFrame) -> DataFrame:
    """``means`` plus the array of patterns that hold; features that are absent count as 0.

    Means count to 10 places: one that is 3 / 10 by its fractions is not over
    0.3, in whatever order the rows were summed. Reads and files read stay as
    they are: sums of counts are exact, and cut to places 2 / (4 / 3) would be over 1.5.
    """
    for name in ("heading_max_depth", "prose_to_structure_ratio", "heading_count"):
        if name not in means.columns:
            means = means.withColumn(name, F.lit(0.0))
    kept = ("profile_id", "total_reads", "unique_files_read")
    means = means.select(*(c for c in kept if c in means.columns), *(F.round(F.col(c), 10).alias(c) for c, kind in means.dtypes if kind == "double" and c not in kept))
    return means.select("profile_id", F.array_compact(F.array(*(F.when(rule, F.lit(text)) for text, rule in pattern_rules()))).alias("patterns"))


def tiers(means: DataFrame, fixed: bool = False) -> DataFrame:
    """L, M or R in each dimension by rules over a profile's means.

    The rule for F reads a table feature that no extractor gives, which counts
    as 0; with ``fixed`` it reads has_tables_or_data.
    """
    r = {k: F.round(F.col(k), 3) for k in ("search_ratio", "browse_ratio", "revisit_ratio", "total_reads", "avg_output_length", "files_created", "total_output_chars", "dirs_created", "max_dir_depth", "files_moved", "total_edits", "avg_lines_changed", "small_edit_ratio", "total_deletes", "delete_to_create_ratio", "image_files_created", "structured_files_created", "markdown_table_rows", "has_tables_or_data")}
    score = r["total_deletes"] * 0.7 + r["delete_to_create_ratio"] * 0.3
    visual = r["image_files_created"] + r["structured_files_created"] + F.when(r["markdown_table_rows"] > 5, 1).otherwise(0)
    tables = r["has_tables_or_data"] if fixed else F.lit(0.0)
    rules = {
        "A": F.when(r["search_ratio"] >= 0.15, "M").when((r["browse_ratio"] >= 0.15) | ((r["revisit_ratio"] < 0.05) & (r["total_reads"] < 15)), "R").otherwise("L"),
        "B": F.when((r["total_output_chars"] >= 8000) | ((r["avg_output_length"] >= 3000) & (r["files_created"] >= 3)), "L").when((r["total_output_chars"] <= 3000) | ((r["avg_output_length"] <= 1500) & (r["files_created"] <= 1.5)), "R").otherwise("M"),
        "C": F.when((r["dirs_created"] >= 2) & (r["max_dir_depth"] >= 2), "L").when((r["dirs_created"] <= 0.5) & (r["max_dir_depth"] <= 0.5), "R").otherwise("M"),
        "D": F.when((r["total_edits"] >= 3) & ((r["small_edit_ratio"] >= 0.5) | (r["avg_lines_changed"] <= 15)), "L").when((r["total_edits"] <= 1) | (r["avg_lines_changed"] >= 30), "R").otherwise("M"),
        "E": F.when(score >= 0.15, "L").when(score <= 0.05, "R").otherwise("M"),
        "F": F.when((visual >= 1.5) | (r["image_files_created"] >= 0.5), "L").when((tables < 0.2) & (r["image_files_created"] < 0.1) & (r["markdown_table_rows"] <= 1), "R").otherwise("M"),
    }
    return means.select("profile_id", *(c.alias(k) for k, c in rules.items()))


def tiers_long(wide: DataFrame) -> DataFrame:
    return wide.unpivot(["profile_id"], [c for c in wide.columns if c != "profile_id"], "dim", "tier")


def first_seen(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Distinct values with where they came first, numbered in that order."""
    found = rows.groupBy(*by, value).agg(F.min(order).alias("first_at"))
    return found.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy("first_at", value)))


def labelled_by_trajectory(rows: DataFrame) -> DataFrame:
    """T1..Tn by task within the profile."""
    return rows.withColumn("label", F.concat(F.lit("T"), F.dense_rank().over(W.partitionBy("profile_id").orderBy("task_id"))))


def naming_language(names: DataFrame, name: str = "file_path") -> DataFrame:
    """Language by the share of names with CJK characters: over 0.6 chinese, over 0.2 mixed."""
    out = names.groupBy("profile_id").agg(F.avg(has_cjk(F.col(name)).cast("int")).alias("cjk_share"))
    return out.withColumn("language", F.when(F.col("cjk_share") > 0.6, "chinese").when(F.col("cjk_share") > 0.2, "mixed").otherwise("english"))


def naming_flags(means: DataFrame) -> DataFrame:
    return means.select("profile_id", (F.col("has_date_prefix") > 0.3).alias("date_prefixes"), (F.col("has_numeric_prefix") > 0.3).alias("numeric_prefixes"), (F.col("has_underscores") > 0.7).alias("underscores"))


def top_types(counter: DataFrame, k: int = 4) -> DataFrame:
    rank = W.partitionBy("profile_id").orderBy(F.desc("n"), "file_type")
    return counter.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def session_summary(trace: DataFrame) -> DataFrame:
    """Counts, durations and ordered lists of each session, in one shuffle."""
    is_ = lambda k: F.col("event_type") == k
    made = is_("file_write") & (F.col("operation") == "create")
    changed = is_("file_edit") | is_("file_write")
    return trace.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("total_events"),
        (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms"),
        distinct(F.when(is_("file_read"), F.col("file_path"))).alias("files_read"),
        distinct(F.when(changed, F.col("file_path"))).alias("files_modified"),
        F.count_if(made).alias("files_created"),
        F.count_if(is_("file_delete")).alias("files_deleted"),
        F.count_if(is_("file_rename") | is_("file_move")).alias("files_renamed"),
        F.coalesce(F.sum(F.when(is_("file_edit"), F.col("lines_added"))), F.lit(0)).alias("lines_added"),
        F.coalesce(F.sum(F.when(is_("file_edit"), F.col("lines_deleted"))), F.lit(0)).alias("lines_deleted"),
        F.count_if(is_("error_encounter")).alias("errors"),
    )


def snapshot(paths: DataFrame, by: list[str], path: str = "file_path") -> DataFrame:
    """Files by type are a counter of their own; here total, greatest depth and kinds of a listing."""
    from tracewell.functions.paths import extension

    p = F.col(path)
    rows = paths.where(p.isNotNull()).select(*by, p.alias("p")).distinct()
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total_files"), F.max(F.size(F.filter(F.split("p", "/"), lambda x: x != "")) - 1).alias("max_depth"), F.count_distinct(extension(F.col("p"))).alias("types"))


def class_distances(wide: DataFrame) -> DataFrame:
    """Numbers of differing dimensions between the classes of profiles of equal tiers, with the classes' sizes.

    Profiles fall into 3 ^ 6 classes at most, so that no pair of profiles is ever made.
    """
    classes = wide.groupBy(F.concat(*DIMENSIONS).alias("tiers")).agg(F.count(F.lit(1)).alias("n"))
    one, two = (classes.select(F.col("tiers").alias(x), F.col("n").alias(f"profiles_{x}")) for x in "ab")
    differing = sum(((F.substring("a", i + 1, 1) != F.substring("b", i + 1, 1)).cast("long") for i in range(len(DIMENSIONS))), F.lit(0).cast("long"))
    return one.join(two, F.col("a") < F.col("b")).withColumn("differing", differing)


def evidence(counts: DataFrame, by: list[str], pattern: str, n: str = "n") -> DataFrame:
    """Primary pattern, confidence by evidence (3 high, 2 medium, 1 low) and number of contradicting patterns of each group."""
    rank = W.partitionBy(*by).orderBy(F.desc(n), pattern)
    best = counts.withColumn("_r", F.row_number().over(rank)).withColumn("contradictions", F.count(F.lit(1)).over(W.partitionBy(*by)) - 1).where(F.col("_r") == 1)
    return best.withColumn("confidence", F.when(F.col(n) >= 3, "high").when(F.col(n) == 2, "medium").otherwise("low")).drop("_r")


def graph_stats(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Nodes, edges and distinct relations of an edge table (src, relation, dst), or of each group's."""
    by = by or []
    nodes = edges.select(*by, F.explode(F.array("src", "dst")).alias("node")).groupBy(*by).agg(F.count_distinct("node").alias("nodes"))
    counts = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("relation").alias("relations"))
    return counts.join(nodes, by) if by else counts.crossJoin(nodes)


def degrees(edges: DataFrame, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """The ``k`` nodes with most edge ends, or those of each group; of equals the first by name."""
    counts = edges.select(*(by or []), F.explode(F.array("src", "dst")).alias("node")).groupBy(*(by or []), "node").agg(F.count(F.lit(1)).alias("degree"))
    if not by:
        return counts.orderBy(F.desc("degree"), "node").limit(k)
    best = W.partitionBy(*by).orderBy(F.desc("degree"), "node")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def memory_statistics(memories: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Number, mean confidence and number of those observed more than once of each kind of memories (confidence, observations)."""
    return memories.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("memories"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("observations") > 1).alias("observed_often"))


def clipped_phrases(rows: DataFrame, by: list[str], phrase: str, most: int = 6, shorter_than: int = 150) -> DataFrame:
    """Up to ``most`` different phrases of each group that are shorter than ``shorter_than`` characters, in order of the alphabet."""
    kept = rows.where(F.col(phrase).isNotNull() & (F.length(phrase) < shorter_than)).select(*by, phrase).distinct()
    first = kept.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(phrase))).where(F.col("_r") <= most)
    return first.groupBy(*by).agg(F.array_sort(F.collect_list(phrase)).alias("phrases"))
