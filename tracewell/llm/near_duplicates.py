"""Near-duplicate documents by MinHash in an LSH forest, confirmed on full shingle sets.

1. Documents with equal sets form classes; only one of each class goes on.
2. A class has 96 MinHash values. Classes whose values are all equal are
   candidates of the first of them, which alone goes on. 24 trees each order
   the classes by their own sequence of these values; a region of a tree are
   the classes whose longest common prefix has 3 values where that leaves few
   enough of them in one place, and more where it doesn't (adaptive depth). At
   the deepest level the order is cut into runs, each of which also has the
   first class of the next one, so that a region of one kind stays connected.
   Neighbours in a region whose values agree in ``LEAST_AGREE`` of the places,
   well below the similarity asked for, are candidates; each region passes on a
   forest that connects them. A crowded region's classes that this leaves in
   different components are then compared all the same, in cells of two tiles:
   greater depth saves comparisons, it doesn't replace any.
3. Candidates' components are the clusters inside which links can lie. A
   cluster's classes are numbered and dealt to cells of two tiles of bounded
   size; within a cell all sizes of intersections are counted exactly on the
   full sets, and a forest of the true links is passed on.
4. The components of the true links are the result.

A pair at the threshold shares no region with probability (1 - 0.75^3)^24, two
in a million, and agrees in too few values once in five thousand times; it is
then still found if others connect its two sides. (Measured on 4,231 planted
pairs of similarity 0.75 to 0.8: 4,230 found.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import frugal, partitions, ship, stored, text_of
from tracewell.llm.components import components, dealt, met
from tracewell.llm.sharding import number

SHINGLE, TREES, HASHES = 5, 24, 96
DEPTHS = (3, 6, 12, 24)
REGION, TILE = 1024, 128
LEAST_AGREE = 0.58

_random = np.random.default_rng(20240607)
_FACTORS = _random.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 2**63, HASHES, np.uint64)
#: The order in which each tree looks at the values: its own four first, then the others from there on.
ORDERS = (np.arange(TREES)[:, None] * (HASHES // TREES) + np.arange(max(DEPTHS))[None, :]) % HASHES


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's 5-word shingles (of all its words, if there are fewer)."""
    words = text.encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(SHINGLE, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k]
    return np.unique(_mix(out))


def minhash(hashes: np.ndarray) -> np.ndarray:
    """96 MinHash values of a non-empty set, as unsigned 32-bit numbers."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096][None, :] * _FACTORS[:, None]
        part += _TERMS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, the set's key (two hashes over all its members) and its signature; null for empty sets."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, sig = [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py())
                n.append(len(s))
                if len(s):
                    one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(_mix(s + np.uint64(len(s))).sum(dtype=np.uint64).view(np.int64)))
                    sig.append(minhash(s).tobytes())
                else:
                    one.append(None)
                    two.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "print", "n_shingles", "one", "two", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("print"), text_of().alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, print long, n_shingles long, one long, two long, sig binary")


def set_classes(signed: DataFrame) -> DataFrame:
    """One row for each different non-empty set of ``signed``: its key, its first document (doc_id, then print) and its number rep.

    Numbers rise with the first doc_id, so that the least class of a component
    also has its least doc_id, and differ even where two sets have one first
    doc_id. Classes of rows without doc_id have a null one.
    """
    kinds = ["one", "two", "n_shingles"]
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "print"))).alias("first")
    classes = signed.where(F.col("n_shingles") > 0).groupBy(*kinds).agg(first).select(*kinds, "first.doc_id", "first.print")
    return stored(classes.orderBy("doc_id", "print", *kinds).withColumn("rep", F.monotonically_increasing_id()), "classes")


def _keyed(classes: DataFrame, depth: int, trees: str | None = None) -> DataFrame:
    """(key, rep) for each class (rep, sig) and tree: keys of the prefixes of ``depth`` values, of the listed trees or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            if trees:
                tree = np.array(batch.column(2), np.int64)
                values = np.take_along_axis(sig, ORDERS[tree], axis=1)[:, None, :]
                salt = tree[:, None]
            else:
                values, salt = sig[:, ORDERS], np.arange(TREES)[None, :]
            key = _mix(salt.astype(np.uint64) + np.uint64(depth * 1000 + 1))
            key = np.broadcast_to(key, values.shape[:2]).copy()
            for k in range(depth):
                key = _mix(key ^ values[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            each = key.shape[1]
            rep = np.repeat(np.array(batch.column(0), np.int64), each)
            tree_out = np.broadcast_to(salt, key.shape).astype(np.int32).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(rep), pa.array(tree_out)], names=["key", "rep", "tree"])

    return classes.select("rep", "sig", *([trees] if trees else [])).mapInArrow(frugal(run), "key long, rep long, tree int")


def equal_signatures(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b): each class and the first of those with the same values; and the classes (rep, sig) that are first.

    A value that very many classes share is dealt over 16 keys on both sides.
    """
    deals = 16
    keys = [F.xxhash64("sig").alias("one"), F.xxhash64(F.lit(1), "sig").alias("two")]
    keyed = classes.select("rep", *keys, F.pmod(F.xxhash64("rep"), F.lit(deals)).alias("deal"))
    first = keyed.groupBy("one", "two").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    first = first.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
    star = stored(keyed.join(first, ["one", "two", "deal"]).where(F.col("rep") != F.col("lead")).select(F.col("rep").alias("a"), F.col("lead").alias("b")), "equal-signatures")
    return star, stored(classes.join(star.select(F.col("a").alias("rep")), "rep", "left_anti"), "forest")


def spread(rows: int) -> int:
    """Blocks in which groups that may hold all of ``rows`` are numbered."""
    return max(16, rows // 50_000)


def regions(classes: DataFrame, blocks: int = 16) -> tuple[DataFrame, DataFrame | None]:
    """(region, rep): members of regions of 2 to ``REGION`` classes; what is larger at the greatest depth is cut into chained runs.

    Also, alike, the members of the regions of the least depth that hold more; None if there are none.
    """
    out, now, crowded = None, classes, None
    for level, depth in enumerate(DEPTHS):
        keyed = _keyed(now, depth, "tree" if level else None)
        if level:
            keyed = stored(keyed, "forest")
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        members = stored(keyed.join(sizes, "key"), "forest")
        last = depth == DEPTHS[-1]
        fits = members if last else members.where(F.col("n") <= REGION)
        if last:
            # too many still: numbered along the region, in another order in each tree, and cut into runs that share an end
            many = fits.where(F.col("n") > REGION).withColumn("spot", F.xxhash64("key", "rep"))
            many = number(many, "key", "spot", ["rep"], out="place", blocks=blocks)
            in_run = F.floor(F.col("place") / REGION)
            ends = F.when((F.col("place") % REGION == 0) & (in_run > 0), F.array(in_run - 1, in_run)).otherwise(F.array(in_run))
            cut = many.select("key", "rep", F.explode(ends).alias("run")).select(F.xxhash64("key", "run").alias("key"), "rep")
            fits = fits.where(F.col("n") <= REGION).select("key", "rep").union(cut)
        part = fits.select(F.col("key").alias("region"), "rep")
        out = part if out is None else out.union(part)
        more = members.where(F.col("n") > REGION)
        if last or not more.limit(1).count():
            break
        if crowded is None:
            crowded = more.select(F.col("key").alias("region"), "rep")
        now = more.select("rep", "tree").join(classes, "rep")
    return out, crowded


def _forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation the least row it is connected with."""
    n = len(near)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` agree with which rows of ``b`` in enough places."""
    out = np.empty((len(a), len(b)), bool)
    step = max(1, 200_000 // len(b))
    for at in range(0, len(a), step):
        out[at : at + step] = (a[at : at + step, None, :] == b[None, :, :]).sum(axis=2) >= LEAST_AGREE * HASHES
    return out


def candidates(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): within each region, classes connected by agreeing values, each with the least of them."""

    def region(reps: np.ndarray, sigs: np.ndarray) -> list[tuple[int, int]]:
        order = np.argsort(reps)
        reps, sigs = reps[order], sigs[order]
        n = len(reps)
        if n == 2:
            return [(int(reps[1]), int(reps[0]))] if np.count_nonzero(sigs[0] == sigs[1]) >= LEAST_AGREE * HASHES else []
        label = _forest(_agree(sigs, sigs))
        rows = np.flatnonzero(label != np.arange(n))
        return list(zip(reps[rows].tolist(), reps[label[rows]].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in grouped(batches):
            found: list[tuple[int, int]] = []
            for rows in groups:
                sigs = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint16)
                found += region(np.array(rows.column(1), np.int64), sigs)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    rows = members.join(classes.select("rep", "sig"), "rep").select("region", "rep", "sig")
    return rows.repartition(partitions(rows.sparkSession), "region").sortWithinPartitions("region").mapInArrow(frugal(run), "a long, b long").distinct()


def remaining(crowded: DataFrame, known: DataFrame, classes: DataFrame, blocks: int = 16) -> DataFrame:
    """(a, b): as ``candidates``, for crowded regions (region, rep): pairs between the components ``known`` (node, root).

    A region's classes of one component are dealt to tiles of their own if they
    fill one, the others share tiles. A cell pairs two tiles, or a shared tile
    with itself; only two tiles of the same component have none. So any two
    classes of a region that aren't connected yet meet, and a cell holds
    ``REGION`` of them at most.
    """
    tile = REGION // 2
    named = crowded.join(known.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = stored(named.select("region", "rep", "root"), "crowded")
    large = named.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= tile).select("region", "root", F.col("root").alias("own"))
    named = named.join(large, ["region", "root"], "left")
    # a region of one component only has nothing left to compare
    split = named.groupBy("region").agg(F.min("root").alias("least"), F.max("root").alias("most")).where(F.col("least") != F.col("most")).select("region")
    named = stored(named.join(split, "region").withColumn("part", F.xxhash64("region", "own", F.col("own").isNull())), "crowded")
    placed = number(named, "part", "rep", [], out="place", blocks=blocks)
    placed = stored(placed.select("region", "rep", "root", "own", "part", F.floor(F.col("place") / tile).alias("tile")), "crowded")
    tiles = placed.select("region", "part", "tile", "own").distinct()
    one, two = (tiles.select("region", *(F.col(c).alias(f"{c}{k}") for c in ("part", "tile", "own"))) for k in (1, 2))
    other_part, other_tile = F.col("part1") != F.col("part2"), F.col("tile1") != F.col("tile2")
    pairs = one.join(two, "region").where((F.col("part1") < F.col("part2")) | (~other_part & (F.col("tile1") <= F.col("tile2")) & F.col("own1").isNull()))
    pairs = pairs.select("region", F.xxhash64("region", "part1", "tile1", "part2", "tile2").alias("cell"), "part1", "tile1", "part2", "tile2")
    sides = pairs.select("region", "cell", F.col("part1").alias("part"), F.col("tile1").alias("tile"), F.lit(0).alias("side"))
    sides = sides.union(pairs.where(other_part | other_tile).select("region", "cell", "part2", "tile2", F.lit(1)))
    rows = placed.join(sides, ["region", "part", "tile"]).join(classes.select("rep", "sig"), "rep").select("cell", "rep", "root", "side", "sig")

    def cell(rows: pa.RecordBatch) -> list[tuple[int, int]]:
        reps, roots, side = (np.array(rows.column(k), np.int64) for k in (1, 2, 3))
        sigs = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint32).reshape(-1, HASHES).astype(np.uint16)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(b):
            b = a
        near = _agree(sigs[a], sigs[b]) & (roots[a][:, None] != roots[b][None, :])
        x, y = np.nonzero(near)
        if not len(x):
            return []
        at, where = np.unique(np.concatenate([a[x], b[y]]), return_inverse=True)
        both = np.zeros((len(at), len(at)), bool)
        both[where[: len(x)], where[len(x) :]] = True
        label = _forest(both | both.T)
        rows_out = np.flatnonzero(label != np.arange(len(at)))
        return list(zip(reps[at[rows_out]].tolist(), reps[at[label[rows_out]]].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in grouped(batches):
            found = [x for rows in groups for x in cell(rows)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return rows.repartition(partitions(rows.sparkSession), "cell").sortWithinPartitions("cell").mapInArrow(frugal(run), "a long, b long").distinct()


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows of equal first column, which come next to each other, as one record batch each; lists of them per input batch."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.array(batch.column(0), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held_key != keys[a]:
                out.append(_joined(held))
                held = []
            held.append(batch.slice(a, b - a))
            held_key = keys[a]
        yield out
    if held:
        yield [_joined(held)]


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def links(docs: DataFrame, clusters: DataFrame, classes: DataFrame, percent: int, blocks: int = 16) -> DataFrame:
    """(a, b): a forest of the true links within each cluster (rep, cluster), on the full sets of the ``classes``' first documents.

    Cells pair two tiles of a cluster, so that any two of its classes meet in
    one of them and a cell holds 2 * ``TILE`` sets at most.
    """
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    placed = number(clusters, "cluster", "rep", [], out="place", blocks=blocks).join(sizes, "cluster")
    placed = placed.select("rep", "cluster", F.floor(F.col("place") / TILE).alias("tile"), F.floor((F.col("n") - 1) / TILE).alias("last"))
    placed = placed.join(classes.select("rep", "doc_id", "print"), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("print"), text_of().alias("text"))
    texts = texts.join(placed, ["doc_id", "print"]).dropDuplicates(["doc_id", "print", "rep"])

    def make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), *batch.columns[2:]], names=["rep", "set", "cluster", "tile", "last"])

    sets = texts.select("rep", "text", "cluster", "tile", "last").mapInArrow(frugal(make_sets), "rep long, set binary, cluster long, tile long, last long")
    cells = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    cells = cells.select(F.xxhash64("cluster", F.least("tile", "other"), F.greatest("tile", "other")).alias("cell"), "rep", "set")

    def verify(rows: pa.RecordBatch) -> list[tuple[int, int]]:
        reps = np.array(rows.column(1), np.int64)
        order = np.argsort(reps)
        reps = reps[order]
        raw = rows.column(2)
        sets = [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in order]
        n = len(sets)
        size = np.array([len(s) for s in sets], np.int64)
        if n == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            return [(int(reps[1]), int(reps[0]))] if 100 * both >= percent * (size.sum() - both) else []
        owner = np.repeat(np.arange(n), size)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1  # columns that several sets have, numbered
        use = times[column] > 1
        owner, column = owner[use], shared[column[use]]
        both = np.zeros((n, n), np.float32)
        width = 4096
        by_column = np.argsort(column, kind="stable")
        owner, column = owner[by_column], column[by_column]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, (at, at + width))
            part = np.zeros((n, width), np.float32)
            part[owner[a:b], column[a:b] - at] = 1
            both += part @ part.T  # exact: counts stay far below 2^24
        label = _forest(100 * both >= percent * (size[:, None] + size[None, :] - both))
        rows_out = np.flatnonzero(label != np.arange(n))
        return list(zip(reps[rows_out].tolist(), reps[label[rows_out]].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in grouped(batches):
            found = [x for rows in groups for x in verify(rows)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return cells.repartition(partitions(cells.sparkSession), "cell").sortWithinPartitions("cell").mapInArrow(frugal(run), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked if 100 * intersection >= ``percent`` * union of their
    shingle sets; component_id is the smallest doc_id reachable. Null, empty
    and blank texts have no set and stand alone. Repeated rows get the same
    answer; rows that differ under one doc_id each have their own links. Rows
    without doc_id take part if their set is that of a numbered one, and aren't
    kept then; others of them stand alone. Only doc_id and text are read.
    """
    ship(docs.sparkSession)
    signed = stored(signatures(docs), "signatures")
    kinds = ["one", "two", "n_shingles"]
    classes = set_classes(signed)
    named = classes.where(F.col("doc_id").isNotNull())
    of_class = signed.join(named, ["doc_id", "print", *kinds]).select("rep", "sig").dropDuplicates(["rep"])
    of_class = stored(of_class, "class-signatures")
    blocks = spread(of_class.count())
    star, unlike = equal_signatures(of_class)
    members, crowded = regions(unlike, blocks)
    near = components(stored(candidates(members, unlike).union(star), "candidates"))
    if crowded is not None:
        more = stored(remaining(crowded, near, unlike, blocks), "candidates")
        if more.limit(1).count():
            near = components(near.toDF("a", "b").union(more))
    clusters = near.select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    roots = components(stored(links(docs, stored(clusters, "clusters"), named, percent, blocks), "links"))
    least = roots.select("root").distinct().join(named.select(F.col("rep").alias("root"), F.col("doc_id").alias("component_id")), "root")
    linked = met(*dealt(roots, "root"), least, "root").select(F.col("node").alias("rep"), "component_id")
    found = classes.join(linked, "rep", "left").select(*kinds, F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = F.col("n_shingles") == 0
    rows = signed.select("doc_id", *kinds)
    out = met(*dealt(rows.where(~alone), *kinds), found, *kinds).select("doc_id", "n_shingles", "component_id")
    out = out.union(rows.where(alone).select("doc_id", "n_shingles", "doc_id"))
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` without the rows whose component has a smaller doc_id, in the columns they came in, whatever these are called.

    Null, empty and blank texts stay; so do all rows of a doc_id that is kept,
    repeated ones too, and rows without doc_id. Of rows that differ under one
    doc_id all go as soon as one of them does. An empty table stays empty.
    """
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
