"""Quality rules: a threshold table compiled into one Spark projection.

``measures()`` gives the columns that rules speak of and ``RULES`` their
bounds; ``compile_rules`` turns the table into boolean columns. There are no
user functions, no shuffle, and no row leaves its task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import SPACE, text_of

#: Frequent function words of the languages that documents come in.
STOP_WORDS = (
    "the of and to in a is that it for on was with as be by this are or from at an not "
    "de la le les des et un une du que qui en pour dans est sur au par il "
    "der die das und den von zu mit sich auf ist nicht ein eine im dem "
    "el los las del y se por con una su para al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if ``measure`` lies outside [least, most], either of which may be open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_chars", "mean_word_chars", 1.5, 25.0),
    Rule("symbols", "symbol_ratio", None, 0.3),
    Rule("stop_words", "stop_word_ratio", 0.005, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
)


def _shifted(column: str, by: int) -> Column:
    """Hashes of each element with the one ``by`` places later."""
    n = F.greatest(F.size(column) - by, F.lit(0))
    return F.zip_with(F.slice(column, 1, n), F.slice(column, by + 1, n), lambda a, b: F.xxhash64(a, b))


def repeated_words(df: DataFrame, words: str = "_words", out: str = "n_repeat_words", window: int = 8) -> DataFrame:
    """``df`` with the number of words that lie in windows found twice or more in the same array (``window``: a power of 2).

    Window hashes come by doubling. Where they are distinct, nothing more is
    done; else the windows sorted by hash show which ones repeat, and the words
    under their sorted starts are the sums of the gaps, each at most a window.
    """
    df = df.withColumn("_h", F.transform(F.col(words), lambda w: F.xxhash64(w)))
    by = 1
    while by < window:
        df = df.withColumn("_h", _shifted("_h", by))
        by *= 2
    df = df.withColumn("_again", F.size(F.array_distinct("_h")) < F.size("_h"))
    df = df.withColumn("_s", F.when(F.col("_again"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    empty = F.lit(None).cast("struct<h:bigint,i:int>")
    df = df.withColumn("_t", F.when(F.col("_again"), F.zip_with("_s", F.concat(F.array(empty), F.col("_s")), lambda x, y: F.when(x["h"].isNull(), None).otherwise(F.struct(x["i"].alias("i"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("same"))))))
    # an element repeats if it equals the one before it, or the one after it does
    df = df.withColumn("_u", F.when(F.col("_again"), F.zip_with("_t", F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))), lambda x, y: F.when(x["same"] | F.coalesce(y["same"], F.lit(False)), x["i"]))))
    df = df.withColumn("_p", F.when(F.col("_again"), F.sort_array(F.filter("_u", lambda i: i.isNotNull()))))
    gaps = F.zip_with("_p", F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)
    return df.withColumn(out, F.when(F.col("_again"), total).otherwise(F.lit(0)).cast("long")).drop("_h", "_again", "_s", "_t", "_u", "_p")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each whole text; null texts count as empty, ratios over nothing are null."""
    df = docs.select("doc_id", text_of().alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split("_text", SPACE), ""))
    df = repeated_words(df)
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    df = df.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").alias("_n_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("_n_stop"),
    )
    some = lambda c: F.nullif(F.col(c), F.lit(0))
    return df.withColumns({
        "mean_word_chars": F.col("word_chars") / some("n_words"),
        "symbol_ratio": F.col("n_symbols") / some("n_words"),
        "stop_word_ratio": F.col("_n_stop") / some("n_words"),
        "dup_line_ratio": F.col("n_dup_lines") / some("_n_lines"),
    }).drop("_n_lines", "_n_stop")


def compile_rules(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """For each rule a column that is true where a document fails it; a null measure fails nothing."""
    out = {}
    for r in rules:
        x, bad = F.col(r.measure), F.lit(False)
        if r.least is not None:
            bad = bad | (x < r.least)
        if r.most is not None:
            bad = bad | (x > r.most)
        out[r.name] = F.coalesce(bad, F.lit(False))
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Measures and verdict of every document.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_percent``
    percent of words in repeated windows. kept: neither that nor any rule.
    Empty and null texts fail; repeated rows are judged alike; other columns
    than doc_id and text are not read.
    """
    df = measures(docs)
    failed = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in compile_rules(rules).items())))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    df = df.withColumn("base_failed", base).withColumn("failed_rules", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"), "symbol_ratio", "stop_word_ratio", "dup_line_ratio")
