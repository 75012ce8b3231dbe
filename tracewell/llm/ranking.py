"""Places of rows in an order, without putting a group's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import partitions, stored


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with _pos (long, from 0) and _total (long) of each row's ``group`` in ``order``.

    ``group`` must not be null. Rows that are alike in every column are folded
    before the shuffle and unfolded when their places are known, so that a row
    repeated a million times isn't a hot key; rows that tie in ``order`` but
    differ elsewhere get some order. Ranges of the order go to the tasks, the
    counts of the ranges (one row for each group and range) are summed, and
    each range is numbered on its own. An empty table stays empty.
    """
    columns = rows.columns
    folded = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    ranged = stored(folded.repartitionByRange(partitions(rows.sparkSession), F.col(group), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(group, "_range").agg(F.sum("_n").alias("_held"))
    whole = W.partitionBy(group)
    before = F.coalesce(F.sum("_held").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(group, "_range", before.alias("_before"), F.sum("_held").over(whole).alias("_total"))
    inside = W.partitionBy(group, "_range").orderBy(*order)
    places = ranged.join(sums, [group, "_range"]).withColumn("_last", F.col("_before") + F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return places.select(*columns, F.explode(F.sequence(F.col("_last") - F.col("_n"), F.col("_last") - 1)).alias("_pos"), "_total")
