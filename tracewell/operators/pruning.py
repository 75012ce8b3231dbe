"""Exact neighbours without comparing all blocks: angles to pivots bound how alike two blocks can be.

Each vector goes to the pivot that is nearest by angle; blocks hold vectors of
one pivot and one band of angles to it. By the triangle inequality no vector of
a block is nearer to one of another than the angle between the pivots less the
blocks' angles to them, or than the difference of these angles. A block knows
how alike its own vectors' k-th neighbours within it are; blocks that can't hold
a nearer one are never read. Where vectors spread evenly in many dimensions all
angles are alike, and nothing can be left out; where they cluster, the share
that is compared falls as rows are added.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import DEFAULTS
from tracewell.operators.similarity import TILE, best_of
from tracewell.operators.storage import settled

BLOCK, PIVOTS, BAND = 512, 256, 0.1
#: Angles are rounded outwards by this much, so that rounding prunes nothing.
SLACK = 1e-6


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _every(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def blocked(items: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """``items`` (group, id, vector) with cell, band and part, and the pivots (group, cell, vector), at most ``pivots`` a group.

    A part has about ``block`` vectors. Vectors without length are as far from every pivot as can be.
    """
    items = settled(items.select("group", "id", "vector"), "items")
    sizes = items.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    sizes = settled(sizes.select("group", F.ceil(F.col("n") / block).alias("parts"), F.least(F.ceil(F.col("n") / block), F.lit(pivots)).cast("long").alias("cells")), "sizes")
    drawn = items.join(sizes, "group").withColumn("_h", F.xxhash64("id")).groupBy("group", F.pmod("_h", "cells").alias("cell")).agg(F.min_by("vector", F.xxhash64("id", F.lit(1))).alias("vector"))
    drawn = settled(drawn, "pivots")
    left = items.join(sizes, "group").withColumn("deal", F.pmod(F.xxhash64("id", F.lit(2)), "parts")).select("group", "id", "vector", "deal")
    right = drawn.join(sizes, "group").select("group", "cell", F.col("vector").alias("pivot"), _every(F.col("parts")).alias("deal"))

    def assign(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"group": [], "id": [], "vector": [], "cell": [], "angle": []})
        y = y.sort_values("cell")
        cosines = np.clip(_unit(x["vector"]) @ _unit(y["pivot"]).T, -1, 1)
        best = cosines.argmax(axis=1)
        return pd.DataFrame({"group": x["group"], "id": x["id"], "vector": x["vector"], "cell": y["cell"].to_numpy()[best], "angle": np.arccos(cosines[np.arange(len(x)), best])})

    kind = dict(items.dtypes)
    placed = left.groupBy("group", "deal").cogroup(right.groupBy("group", "deal")).applyInPandas(assign, f"group {kind['group']}, id {kind['id']}, vector {kind['vector']}, cell long, angle double")
    placed = settled(placed.withColumn("band", F.floor(F.col("angle") / BAND)), "placed")
    parts = placed.groupBy("group", "cell", "band").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    return placed.join(parts, ["group", "cell", "band"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), "parts")).drop("parts"), drawn


PLACE = ["cell", "band", "part"]


def block_pairs(rows: DataFrame, pivots: DataFrame, k: int, least: float) -> DataFrame:
    """(group, a, b, needed): all ordered pairs of blocks (structs of cell, band and part), and whether b may hold neighbours of a's vectors."""

    def own(x: pd.DataFrame) -> pd.DataFrame:
        sims = _unit(x["vector"]) @ _unit(x["vector"]).T
        np.fill_diagonal(sims, -2)
        kth = np.sort(sims, axis=1)[:, -k] if len(x) > k else np.full(len(x), -2.0)
        one = x.iloc[0]
        return pd.DataFrame({"group": [one["group"]], "cell": [one["cell"]], "band": [one["band"]], "part": [one["part"]], "near": [x["angle"].min()], "far": [x["angle"].max()], "floor": [max(least, float(kth.min()))]})

    kind = dict(rows.dtypes)["group"]
    blocks = settled(rows.groupBy("group", *PLACE).applyInPandas(own, f"group {kind}, cell long, band long, part long, near double, far double, floor double"), "blocks")

    def between(x: pd.DataFrame) -> pd.DataFrame:  # at most PIVOTS rows
        x = x.sort_values("cell")
        angles, cells = np.arccos(np.clip(_unit(x["vector"]) @ _unit(x["vector"]).T, -1, 1)), x["cell"].to_numpy()
        np.fill_diagonal(angles, 0)
        i, j = np.indices(angles.shape)
        return pd.DataFrame({"group": x["group"].iloc[0], "ca": cells[i.ravel()], "cb": cells[j.ravel()], "apart": angles.ravel()})

    apart = pivots.groupBy("group").applyInPandas(between, f"group {kind}, ca long, cb long, apart double")
    side = lambda s: blocks.select("group", F.col("cell").alias(f"c{s}"), F.struct(*PLACE).alias(s), F.col("near").alias(f"near_{s}"), F.col("far").alias(f"far_{s}"), F.col("floor").alias(f"floor_{s}"))
    pairs = apart.join(side("a"), ["group", "ca"]).join(side("b"), ["group", "cb"])
    bound = F.greatest(F.lit(0.0), F.col("apart") - F.col("far_a") - F.col("far_b"), F.col("near_b") - F.col("apart") - F.col("far_a"), F.col("near_a") - F.col("apart") - F.col("far_b")) - SLACK
    return pairs.select("group", "a", "b", ((F.col("a") == F.col("b")) | (F.cos(F.greatest(F.lit(0.0), bound)) >= F.col("floor_a"))).alias("needed"))


def tiled(rows: DataFrame, tile: int) -> DataFrame:
    """(group, at, no, tile): a number for each block of ``rows`` in its group, and the tile of blocks behind each other, of about ``tile`` rows, that it is in."""
    order = W.partitionBy("group").orderBy(*PLACE)
    blocks = rows.groupBy("group", *PLACE).agg(F.count(F.lit(1)).alias("n"))
    return blocks.select("group", F.struct(*PLACE).alias("at"), F.row_number().over(order).alias("no"), F.floor((F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")) / tile).alias("tile"))


def neighbours(items: DataFrame, k: int = DEFAULTS.knn, least: float = DEFAULTS.knn_least, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(group, id, other, similarity, rank): as ``similarity.neighbours``, from the pairs of blocks that may hold some; ``least`` is 0 or more.

    Rows are copied once for each pair of tiles with such a pair of blocks in it, not for each pair of blocks.
    """
    rows, pivots = blocked(items, block)
    rows = settled(rows, "rows")
    tiles = settled(tiled(rows, tile), "tiles")
    side = lambda s: tiles.select("group", F.col("at").alias(s), F.col("no").alias(f"no_{s}"), F.col("tile").alias(f"tile_{s}"))
    pairs = block_pairs(rows, pivots, k, least).where("needed").join(side("a"), ["group", "a"]).join(side("b"), ["group", "b"])
    pairs = settled(pairs.select("group", "tile_a", "tile_b", "no_a", "no_b"), "pairs")
    met = pairs.select("group", "tile_a", "tile_b").distinct()
    keyed = settled(rows.select("group", F.struct(*PLACE).alias("at"), "id", "vector").join(tiles, ["group", "at"]).select("group", "tile", "no", "id", "vector"), "keyed")
    keys = ["group", "tile_a", "tile_b"]
    kind = dict(items.dtypes)
    fresh = lambda df: df.select(*(F.expr(f"`{c}`").alias(c) for c in [*keys, "no", "other_no", "id", "vector"]))  # noqa: E731  # fresh names on each side of the cogroup
    left = keyed.withColumnRenamed("tile", "tile_a").join(met, ["group", "tile_a"]).withColumn("other_no", F.lit(None).cast("int"))
    wanted = pairs.select(*keys, F.col("no_a").alias("no"), F.col("no_b").alias("other_no"), F.lit(0).cast(kind["id"]).alias("id"), F.lit(None).cast(kind["vector"]).alias("vector"))
    right = keyed.withColumnRenamed("tile", "tile_b").join(met, ["group", "tile_b"]).withColumn("other_no", F.lit(None).cast("int"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        asked = x[x["other_no"].notna()]
        x = x[x["other_no"].isna()]
        own = dict(iter(x.groupby("no")))
        out = [best_of(own[no], y[y["no"].isin(others)], k, least) for no, others in asked.groupby("no")["other_no"]]
        return pd.concat(out, ignore_index=True) if out else best_of(x[:0], y, k, least)

    met = fresh(left.select(*keys, "no", "other_no", "id", "vector").unionByName(wanted)).groupBy(*keys).cogroup(fresh(right).groupBy(*keys)).applyInPandas(meet, f"group {kind['group']}, id {kind['id']}, other {kind['id']}, similarity double")
    best = W.partitionBy("group", "id").orderBy(F.desc("similarity"), "other")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
