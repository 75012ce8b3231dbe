"""Neighbours by pruned blocks against those of all blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import pruning
from tracewell.operators import similarity as sm


def items(spark, v, groups=1):
    return spark.createDataFrame([(i % groups, i, [float(x) for x in row]) for i, row in enumerate(v)], "group int, id long, vector array<double>")


def clustered(n, seed=1, dims=8, centres=12, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, dims))


def rows(df):
    return sorted((r["group"], r["id"], r["rank"], r["other"], round(r["similarity"], 9)) for r in df.collect())


@pytest.mark.parametrize("kind", ["clustered", "even", "equal"])
def test_same_neighbours_as_all_blocks(spark, kind):
    rng = np.random.default_rng(2)
    v = {"clustered": clustered(400), "even": rng.normal(size=(150, 16)), "equal": np.concatenate([np.ones((120, 4)), np.zeros((3, 4)), rng.normal(size=(40, 4))])}[kind]
    df = items(spark, v, groups=2)
    for least in (0.0, 0.6):
        assert rows(pruning.neighbours(df, 5, least, block=24)) == rows(sm.neighbours(df, 5, least))


def test_the_share_compared_falls_as_rows_grow(spark):
    shares = []
    for n in (200, 1600):
        blocks, pivots = pruning.blocked(items(spark, clustered(n)), block=32)
        shares.append(pruning.block_pairs(blocks, pivots, 5, 0.3).agg(F.avg(F.col("needed").cast("int"))).first()[0])
    assert shares[1] < shares[0] < 1 and shares[1] < 0.25


def test_no_vectors(spark):
    assert pruning.neighbours(items(spark, np.zeros((0, 2)))).collect() == []


def test_pairs_of_tiles_hold_the_pairs_of_blocks(spark):
    df = items(spark, clustered(700), groups=2)
    small, one = (rows(pruning.neighbours(df, 5, 0.3, block=24, tile=t)) for t in (100, 8192))
    assert small == one == rows(sm.neighbours(df, 5, 0.3))
    blocks, _ = pruning.blocked(df, block=24)
    tiles = pruning.tiled(blocks, 100)
    assert tiles.select("group", "tile").distinct().count() < tiles.count() / 2
