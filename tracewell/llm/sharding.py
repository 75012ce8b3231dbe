"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A topology is a list of leaves (region, rack, shard, weight). A row descends
region, rack and shard; at each level every child draws ``-ln(u) / weight``
with ``u`` from a hash of the key and the child's own name, and the least draw
wins. A child's draw depends on nothing but the key, its name and its weight,
so that a changed weight moves rows only into or out of that child, and the
subtrees whose weights stay as they were keep their rows.

``topology(n)`` fills racks of ``per_rack`` shards and regions of ``racks``
racks, in order. When shard n opens a new region, as 24 does with the default
sizes, the only draw that is new is the region's: every row that moves goes to
the new shard. When it joins an existing region, rows move into that region,
and within it only towards the racks and shards whose weights rose.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Leaf = tuple[int, int, int, float]


def topology(shards: int, per_rack: int = 4, racks: int = 2, weights: dict[int, float] | None = None, built: int | None = None) -> list[Leaf]:
    """Leaves of a tree over shards 0 to ``shards - 1``; weights default to 1.

    The first ``built`` shards (all, unless given) fill racks and regions in
    turn. Each one added since opens a region of its own: the draws of all
    regions that were there stay as they were, so that rows move to it alone.
    """
    built = shards if built is None else min(built, shards)
    of_region = per_rack * racks
    weight = lambda s: float((weights or {}).get(s, 1.0))
    regular = [(s // of_region, s // per_rack, s, weight(s)) for s in range(built)]
    regions, all_racks = -(-built // of_region), -(-built // per_rack)
    return regular + [(regions + s - built, all_racks + s - built, s, weight(s)) for s in range(built, shards)]


def _least(key: Column, level: str, children: Column) -> Column:
    """The child whose draw is least; ``children``: an array of (child, weight)."""

    def drawn(c: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{level}"), c["child"].cast("string"))), 1, 12), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / F.lit(float(2**48))) / c["weight"]).alias("draw"), c["child"].alias("child"))

    return F.array_min(F.transform(children, drawn))["child"]


def _children(weights: dict[int, float]) -> Column:
    return F.array(*(F.struct(F.lit(c).alias("child"), F.lit(w).alias("weight")) for c, w in weights.items()))


def _below(tree: dict[int, dict[int, float]], parent: str) -> Column:
    """The children of the node that column ``parent`` names."""
    pairs = [x for k, w in tree.items() for x in (F.lit(k), _children(w))]
    return F.create_map(*pairs)[F.col(parent)]


def place(df: DataFrame, key: str, leaves: list[Leaf], out: str = "shard") -> DataFrame:
    """``df`` with ``{out}_region``, ``{out}_rack`` and ``out``; leaves of weight 0 get no rows. A null key counts as an empty one."""
    leaves = sorted(x for x in leaves if x[3] > 0)
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))

    def weights(rows: list[Leaf], level: int) -> dict[int, float]:
        return {k: sum(x[3] for x in g) for k, g in groupby(sorted(rows, key=itemgetter(level)), itemgetter(level))}

    regions = weights(leaves, 0)
    racks = {r: weights([x for x in leaves if x[0] == r], 1) for r in regions}
    shards = {k: weights([x for x in leaves if x[1] == k], 2) for r in regions for k in racks[r]}
    df = df.withColumn(f"{out}_region", _least(text, "region", _children(regions)))
    df = df.withColumn(f"{out}_rack", _least(text, "rack", _below(racks, f"{out}_region")))
    return df.withColumn(out, _least(text, "shard", _below(shards, f"{out}_rack")))


def number(df: DataFrame, group: str, key: str, order: list[str], out: str = "slot", blocks: int = 1024) -> DataFrame:
    """``df`` with gapless numbers from 0 within each ``group``.

    Rows are numbered within ``blocks`` blocks of each group, by a hash of
    ``key``; the block's first number is the running sum of the earlier blocks'
    counts. No task orders a whole group, however the keys are spread. ``df``
    is planned twice; the counts need only ``group`` and ``key``.
    """
    df = df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    before = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    first = df.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    first = first.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = W.partitionBy(group, "_block").orderBy(key, *order)
    return df.join(first, [group, "_block"]).withColumn(out, F.col("_first") + F.row_number().over(within) - 1).drop("_block", "_first")


def shard_documents(docs: DataFrame, shards: int = 24, built: int | None = None) -> DataFrame:
    """One row per document: its size, checksum, shard, slot and the shard it would have with one shard more.

    ``built`` is the number of shards that the tree was first laid out for (by
    default ``shards``); with it given, shard for n + 1 is grown_shard for n.
    Null texts have size 8 and the checksum of no bytes; a null doc_id is a key
    like any other; repeated rows share a shard and take slots of their own, in
    any order. An empty table gives no rows. Only doc_id and text are read.
    """
    built = shards if built is None else built
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = place(rows, "doc_id", topology(shards, built=built), "shard")
    rows = place(rows, "doc_id", topology(shards + 1, built=built), "grown_shard").drop("grown_shard_region", "grown_shard_rack")
    rows = number(rows.withColumn("_key", F.xxhash64("doc_id", "size", "text_crc32")), "shard", "_key", ["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard", F.col("shard_region").alias("region"), F.col("shard_rack").alias("rack"))
