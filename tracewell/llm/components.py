"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import stored

#: Rows of one key (of a few numbers each) that may meet in one task, and keys at most that may have more.
SHARE, HOT_KEYS = 100_000, 10_000


def dealt(rows: DataFrame, *keys: str, n: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with _deal, and the keys (with _deals) whose rows are dealt over several values of it; None if there are none.

    ``rows`` should be a written table: it is read again to count its keys, and
    its rows too if their number ``n`` isn't given. A key is dealt if it has more than ``SHARE`` rows, or more than a part in ``HOT_KEYS``
    of all; so there are at most ``HOT_KEYS`` of them, and each deal has that many rows.
    """
    n = rows.count() if n is None else n
    most = max(SHARE, n // HOT_KEYS)
    hot = None
    if n > most:
        hot = stored(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("_deals")).where(F.col("_deals") > 1), "hot")
        hot = hot if hot.limit(1).count() else None
    if hot is None:
        return rows.withColumn("_deal", F.lit(0).cast("long")), None
    rows = rows.join(F.broadcast(hot), list(keys), "left")
    return rows.withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.coalesce("_deals", F.lit(1)))).drop("_deals"), hot


def met(rows: DataFrame, hot: DataFrame | None, table: DataFrame, *keys: str) -> DataFrame:
    """``rows`` as ``dealt`` gave them with the columns of ``table``, which has one row a key at most (left join)."""
    if hot is None:
        return rows.drop("_deal").join(table, list(keys), "left")
    last = F.coalesce("_deals", F.lit(1).cast("long")) - 1
    table = table.join(F.broadcast(hot), list(keys), "left").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_deals")
    return rows.join(table, [*keys, "_deal"], "left").drop("_deal")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the smallest node reachable.

    A round takes the least label among a node's neighbours, then that label's
    own label, and is written to the shared folder; rounds end when no label
    has changed. Each node ends with one row, whatever number of edges it has.
    Edges of a node that has very many, and nodes of such a label, are dealt to
    several tasks. Edges with a null end are left out.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = stored(pairs.union(pairs.select("b", "a")).toDF("node", "other"), "edges")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    both, centres = dealt(both, "other")
    nodes = labels.count()
    while True:
        near = met(both, centres, labels.toDF("other", "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        if nodes > SHARE:
            step = stored(step, "labels")
        above = met(*dealt(step, "root", n=nodes), labels.toDF("root", "top"), "root")
        labels = stored(above.select("node", "old", F.least("root", F.coalesce("top", "root")).alias("root")), "labels")
        changed = labels.where(F.col("root") != F.col("old")).limit(1).count()
        labels = labels.select("node", "root")
        if not changed:
            return labels
