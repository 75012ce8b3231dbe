"""Exact top-k search by inner product: histograms of all scores locate each query's k-th score.

Components are quantised to integers, so scores are integers and ties are real.
Queries and candidates are dealt to cells of bounded size, a group of queries
beside a group of candidates. In each pass every cell scores all its pairs
and counts, for each query, the scores by bins of the interval that holds the
query's k-th score; the counts of all cells are summed, and the bin where they
reach k is the next, narrower interval. Once an interval is one score wide, a
last pass keeps what lies above it and the smallest ids of what equals it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewell.llm.common import ship, stored

#: Most queries and candidates of a cell on average; they are dealt by hash.
QUERIES_A_CELL, CANDIDATES_A_CELL = 2048, 8192
#: Bins of a pass: 2 ** 10, so that two passes locate a score among a million.
BIN_BITS = 10
#: Scores that a cell holds at once.
AT_ONCE = 1 << 20
SCALE = 64
#: A query: its id, and the hash of its vector, which parts queries of one id.
QUERY = ["query_id", "query"]


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def quantised(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(64 * x) of the vectors, as rows of floats where all products of two rows are exact in them, else of Python's integers."""
    m = np.stack(vectors).astype(np.float64) if vectors else np.zeros((0, 0))
    with np.errstate(over="ignore"):
        q = np.floor(SCALE * m)
    if not q.size or np.abs(q).max() ** 2 * q.shape[1] < 2**24:
        return q.astype(np.float32)
    if np.abs(q).max() ** 2 * q.shape[1] < 2**53:
        return q
    return np.array([[math.floor(SCALE * Fraction(float(x))) for x in row] for row in m], dtype=object)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products; those beyond 64 bits are the nearest long."""
    if queries.dtype != object and candidates.dtype != object:
        bound = np.abs(queries).max(initial=0.0) * np.abs(candidates).max(initial=0.0) * queries.shape[1]
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else None
        if kind:
            return (queries.astype(kind) @ candidates.T.astype(kind)).astype(np.int64)
    a, b = (np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape) for m in (queries, candidates))
    return np.clip(a.dot(b.T), -(2**63), 2**63 - 1).astype(np.int64)


def _rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


class Cell:
    """A group of queries beside a group of candidates, scored a few queries at a time."""

    def __init__(self, asked: pa.Table, held: pa.Table) -> None:
        self.queries, self.candidates = quantised(_rows(asked["vector"])), quantised(_rows(held["vector"]))
        self.query_ids, self.lows = asked["query_id"].to_numpy(), asked["low"].to_numpy()
        self.unnamed, self.ids = pc.is_null(held["vec_id"]).to_numpy(), pc.fill_null(held["vec_id"], 0).to_numpy()

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of queries, their scores, which candidates aren't the query itself)."""
        step = max(1, AT_ONCE // len(self.ids))
        for at in range(0, len(self.query_ids), step):
            some = np.arange(at, min(at + step, len(self.query_ids)))
            yield some, scores(self.queries[some], self.candidates), (self.query_ids[some][:, None] != self.ids) | self.unnamed

    def counts(self, width: int, shift: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of queries, bins, counts) of the scores in each query's interval, best bins first until the cell has k scores.

        An interval is 2 ** width scores wide, a bin 2 ** shift.

        The k-th score of all cells is no smaller than that of any one, so that
        the bins below that can't hold it. What lies above the interval is one
        more bin here and no bin of the result.
        """
        size = 1 << (width - shift)
        for some, score, other in self.parts():
            low = self.lows[some][:, None]
            place = (score.view(np.uint64) - low.view(np.uint64)) >> np.uint64(shift)  # unsigned: an interval may be 64 bits wide
            bins = np.minimum(place, size).astype(np.int64)
            flat = (np.arange(len(some))[:, None] * (size + 1) + bins)[other & (score >= low)]
            found = np.bincount(flat, minlength=len(some) * (size + 1)).reshape(len(some), size + 1)[:, ::-1]
            above = np.cumsum(found, axis=1) - found
            i, j = np.nonzero((found > 0) & (above < k))
            i, j = i[j > 0], j[j > 0]
            yield some[i], size - j, found[i, j]

    def best(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of queries, places of candidates, scores): what reaches each query's k-th score, k of them at most, ties by id."""
        for some, score, other in self.parts():
            i, j = np.nonzero(other & (score >= self.lows[some][:, None]))
            order = np.lexsort((self.ids[j], self.unnamed[j], ~score[i, j], i))
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            yield some[i[first]], j[first], score[i[first], j[first]]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest scores among all vectors but its own, ties to the smaller vec_id.

    Queries are the rows of ``vectors`` (vec_id, embedding) whose vec_id is
    divisible by ``every``; with fewer than ``k`` candidates a query gets all.
    Vectors that are null or hold null or non-finite components take no part,
    as queries or candidates. Rows with a query's vec_id are never its
    candidates. A vec_id with several different vectors is asked with each of
    them, with the same vector several times once; as a candidate every row
    counts, repeated ones too. Rows without vec_id are candidates behind all
    others of their score. Vectors of different lengths don't meet, and those
    of length 0 score 0. Further columns are left out; no queries, no rows.
    """
    ship(vectors.sparkSession)
    usable = vectors.where(_usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    usable = stored(usable.withColumn("deal", F.xxhash64("vec_id", F.monotonically_increasing_id())), "vectors")  # repeated rows are dealt apart
    asked = usable.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    asked = stored(asked.withColumn("query", F.xxhash64("vector")), "queries")
    groups, blocks = (max(1, -(-df.count() // most)) for df, most in ((asked, QUERIES_A_CELL), (usable, CANDIDATES_A_CELL)))
    size = lambda x: SCALE * F.abs(x) + 1  # noqa: E731  no quantised component is further from 0
    largest = usable.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + size(x) * size(x)))).first()[0] or 0.0
    bits = math.ceil(math.log2(min(largest, 2.0**63) + 2)) + 1  # all scores are in [-largest, largest], by Cauchy and Schwarz
    held = usable.select("vec_id", "vector", F.pmod("deal", F.lit(blocks)).alias("block"), _each(groups).alias("group"), F.size("vector").alias("dim"))
    lows = asked.select(*QUERY, F.lit(-(2 ** (bits - 1))).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    for width in range(bits, 0, -BIN_BITS):
        shift = max(0, width - BIN_BITS)
        lows = stored(_narrowed(_counted(_dealt(asked, lows, groups, blocks), held, width, shift, k), lows, shift), "intervals")
    return _kept(_dealt(asked, lows, groups, blocks), held, k)


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _dealt(asked: DataFrame, lows: DataFrame, groups: int, blocks: int) -> DataFrame:
    """The queries with their intervals, each beside every block of candidates."""
    rows = asked.join(lows.select(*QUERY, "low"), QUERY)
    return rows.select(*QUERY, "vector", "low", _each(blocks).alias("block"), F.pmod(F.xxhash64(*QUERY), F.lit(groups)).alias("group"), F.size("vector").alias("dim"))


def _over_cells(asked: DataFrame, held: DataFrame, run: Callable[[Cell, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        return run(Cell(queries, candidates), queries, candidates) if len(queries) and len(candidates) else empty

    keys = ("group", "block", "dim")
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(cell, schema)


def _joined(parts: Iterator[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _counted(asked: DataFrame, held: DataFrame, width: int, shift: int, k: int) -> DataFrame:
    """(query, bin, n): the scores of all cells by bins of 2 ** shift scores within each query's interval."""

    def run(cell: Cell, queries: pa.Table, _: pa.Table) -> pa.Table:
        i, bins, n = _joined(cell.counts(width, shift, k))
        return pa.table([queries["query_id"].take(i), queries["query"].take(i), bins, n], names=[*QUERY, "bin", "n"])

    return _over_cells(asked, held, run, "query_id long, query long, bin long, n long").groupBy(*QUERY, "bin").agg(F.sum("n").alias("n"))


def _narrowed(counts: DataFrame, lows: DataFrame, shift: int) -> DataFrame:
    """The intervals of 2 ** shift scores that hold the k-th scores; queries with too few candidates keep the lowest."""
    down = W.partitionBy(*QUERY).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    reached = counts.withColumn("reached", F.sum("n").over(down)).join(lows.select(*QUERY, "need"), QUERY)
    found = reached.where((F.col("reached") >= F.col("need")) & (F.col("reached") - F.col("n") < F.col("need")))
    found = found.select(*QUERY, "bin", (F.col("need") - F.col("reached") + F.col("n")).alias("left"))
    at = F.coalesce("bin", F.lit(0))
    low = F.shiftleft(F.shiftright("low", 1) + at * (1 << (shift - 1)), 1) if shift else F.col("low") + at  # sums of halves: no step is beyond 64 bits
    return lows.join(found, QUERY, "left").select(*QUERY, low.alias("low"), F.coalesce("left", "need").alias("need"))


def _kept(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """What reaches the k-th score, in order, without the ties that are too many."""

    def run(cell: Cell, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        i, j, score = _joined(cell.best(k))
        return pa.table([queries["query_id"].take(i), queries["query"].take(i), candidates["vec_id"].take(j), score], names=[*QUERY, "vec_id", "score"])

    rows = _over_cells(asked, held, run, "query_id long, query long, vec_id long, score long")
    best = W.partitionBy(*QUERY).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
