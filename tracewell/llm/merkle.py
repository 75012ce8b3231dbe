"""A Merkle tree over all documents, and versions of it that copy only the path of a changed leaf.

Each language is a tree of its own: leaves ascend by doc_id, and runs of eight
consecutive nodes become their hash until one node, the subroot, is left; the
subroots, by language, become the root in the same way. The trees are built in
aligned blocks of 512 nodes: a task has a whole block, builds its nodes
once, and hands one node to the next pass, whose leaves they are. On the way
down each block is told the siblings above it; a changed leaf is then a version
of the tree that shares every untouched node of the block, copies the leaf's
ancestors within it, and goes on through the ancestors above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import LOWER, UPPER, ship, stored
from tracewell.llm.ranking import numbered

ARITY = 8
#: Levels of a block: a task holds 8 ** 3 = 512 nodes of one tree.
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class Version:
    """What one changed leaf makes new; all other nodes are those of the tree it is a version of."""

    index: int
    copied: tuple[str, ...]  # the changed leaf, then its ancestors, up to the block's top


class Block:
    """The nodes above up to 8 ** ``height`` consecutive nodes of a tree.

    ``alone`` says that they are the whole tree, which ends with its first
    single node; any other block rises ``height`` levels, even from one node.
    """

    def __init__(self, digests: list[str], alone: bool, height: int) -> None:
        self.levels = [digests]
        while len(self.levels[-1]) > 1 if alone else len(self.levels) <= height:
            below = self.levels[-1]
            self.levels.append([h("".join(below[i : i + ARITY])) for i in range(0, len(below), ARITY)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, index: int) -> list[tuple[str, str]]:
        """(left, right) of the node at ``index`` and of its ancestors: their siblings' digests, joined."""
        out = []
        for level in self.levels[:-1]:
            first = index - index % ARITY
            out.append(("".join(level[first:index]), "".join(level[index + 1 : first + ARITY])))
            index //= ARITY
        return out

    def version(self, index: int, digest: str) -> Version:
        """The tree with another leaf at ``index``: copies of its ancestors, everything else shared."""
        copied, at = [digest], index
        for level in self.levels[:-1]:
            first = at - at % ARITY
            copied.append(h("".join(copied[-1] if i == at else level[i] for i in range(first, min(first + ARITY, len(level))))))
            at //= ARITY
        return Version(index, tuple(copied))


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    """The top that ``digest`` leads to beside the siblings of ``path``."""
    for left, right in path:
        digest = h(left + digest + right)
    return digest


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row with this text; nulls are "-", other values their number of bytes, ":" and the value."""
    return F.sha2(F.concat(*(_field(text if c == "text" else F.col(c)) for c in FIELDS)).cast("binary"), 256)


def tampered(doc_id: Column) -> Column:
    """Whether the row is one of those whose text is lower-cased; rows without doc_id aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _tree(lang: Column) -> Column:
    """A key for each language that is never null and orders null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, changed, pos, total): changed is the tampered leaf's digest, null where nothing is tampered with.

    Rows without doc_id come first in their language; of rows with one doc_id
    the smaller digest comes first, and equal rows are leaves each.
    """
    lower = F.translate("text", UPPER, LOWER)
    rows = docs.select(_tree(F.col("lang")).alias("tree"), F.col("doc_id"), leaf(F.col("text")).alias("leaf"), F.when(tampered(F.col("doc_id")), leaf(lower)).alias("changed"))
    places = numbered(rows, "tree", [F.col("doc_id"), F.col("leaf"), F.col("changed")])
    return stored(places.withColumnsRenamed({"_pos": "pos", "_total": "total"}), "leaves")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY**height))


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by("pos")


def _lifted(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, pos, digest, total) of ``nodes`` -> the same of the tops of their blocks."""
    size = ARITY**height
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("total", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        total, first = rows["total"][0].as_py(), rows["pos"][0].as_py()
        top = Block(rows["digest"].to_pylist(), total <= size, height).top
        return pa.table([[rows["tree"][0].as_py()], [first // size], [top], [-(-total // size)]], schema=schema)

    return _blocks(nodes.select("tree", "pos", "digest", "total"), height).groupBy("tree", "block").applyInArrow(run, "tree string, pos long, digest string, total long")


def _passes(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``nodes`` and the nodes of each pass above, until every tree has one; log 512 of the largest tree passes."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1 or len(out) == 1:
        out.append(stored(_lifted(out[-1], height), "nodes"))
    return out


def _lowered(nodes: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """(tree, pos, path) of ``nodes``, given the paths of their blocks' tops."""
    size = ARITY**height
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))])

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        digests, upper = rows["digest"].to_pylist(), above["path"][0].as_py()
        block = Block(digests, rows["total"][0].as_py() <= size, height)
        found = [[{"left": a, "right": b} for a, b in block.siblings(i)] + upper for i in range(len(digests))]
        return pa.table([rows["tree"], rows["pos"], pa.array(found, schema.field("path").type)], schema=schema)

    return _met(nodes, paths, height).applyInArrow(run, f"tree string, pos long, path {PATH}")


def _met(nodes: DataFrame, paths: DataFrame, height: int):  # noqa: ANN202
    left = _blocks(nodes, height).groupBy("tree", "block")
    return left.cogroup(paths.withColumnRenamed("pos", "block").groupBy("tree", "block"))


def _paths(passes: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """Paths of the nodes of the second pass, whose blocks are those of the first, from ``tops`` (tree, pos = 0, path)."""
    for nodes in passes[-2:0:-1]:
        tops = stored(_lowered(nodes, tops, height), "paths")
    return tops


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Leaf, subroot, root, proof and the root of its own version for each document, and whether that equals the root.

    All columns but those hashed are left out, whatever they are called; text
    and others may be null or empty. Repeated rows are leaves each, and rows
    without doc_id are leaves that nobody tampers with. proof_sha256 is the hash
    of all siblings from the leaf up, copied the number of nodes that the row's
    version has of its own (0 if nothing is tampered with, else the leaf and all
    its ancestors). No documents give no rows.
    """
    ship(docs.sparkSession)
    rows = leaves(docs)
    trees = _passes(rows.select("tree", "pos", F.col("leaf").alias("digest"), "total"), height)
    subroots = trees[-1].select(F.lit("root").alias("group"), F.col("tree").alias("key"), "digest")
    subroots = stored(numbered(subroots, "group", [F.col("key")]).select(F.col("group").alias("tree"), F.col("_pos").alias("pos"), "digest", F.col("_total").alias("total"), "key"), "subroots")
    upper = _passes(subroots.select("tree", "pos", "digest", "total"), height)
    root = upper[-1].select("tree", "pos", F.array().cast(PATH).alias("path"))
    lowered = _lowered(subroots.select("tree", "pos", "digest", "total"), _paths(upper, root, height), height)
    tops = subroots.join(lowered, ["tree", "pos"]).select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
    paths = _paths(trees, stored(tops, "tops"), height)
    roots = subroots.select(F.col("key").alias("tree"), F.col("digest").alias("subroot"))
    with_roots = paths.join(roots, "tree")  # a row for each block of 512 leaves
    return _verified(rows, stored(with_roots, "paths"), height)


def _verified(rows: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    size = ARITY**height
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied int"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(own: pa.Table, above: pa.Table) -> pa.Table:
        own = _sorted(own)
        digests, changed = own["leaf"].to_pylist(), own["changed"].to_pylist()
        block = Block(digests, own["total"][0].as_py() <= size, height)
        upper = [(x["left"], x["right"]) for x in above["path"][0].as_py()]
        end = "".join(a + b for a, b in upper)
        root, subroot = folded(block.top, upper), above["subroot"][0].as_py()
        n = len(digests)
        proofs, ends, copied = [], [], []
        for i, new in enumerate(changed):
            proofs.append(h("".join(a + b for a, b in block.siblings(i)) + end))
            version = block.version(i, digests[i] if new is None else new)
            ends.append(folded(version.copied[-1], upper))
            copied.append(0 if new is None else len(version.copied) + len(upper))
        values = [own["doc_id"].cast(pa.int64()), own["leaf"], [subroot] * n, [root] * n, proofs, ends, [x == root for x in ends], pa.array(copied, pa.int32())]
        return pa.table(values, names=names)

    return _met(rows, paths, height).applyInArrow(run, schema)


def versions(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(tree, pos, doc_id, level, index, digest): the nodes that each tampered row's version has of its own within its block.

    tree is "" for rows without a language, else "=" and the language; level 0
    are leaves, and index counts a level's nodes from 0. All other nodes of a
    version are those of the tree itself.
    """
    ship(docs.sparkSession)
    size = ARITY**height
    rows = _blocks(leaves(docs), height)

    def run(own: pa.Table) -> pa.Table:
        own = _sorted(own)
        start = own["pos"][0].as_py()
        block = Block(own["leaf"].to_pylist(), own["total"][0].as_py() <= size, height)

        def found() -> Iterator[dict]:
            for i, (new, doc) in enumerate(zip(own["changed"].to_pylist(), own["doc_id"].to_pylist(), strict=True)):
                for level, digest in enumerate(block.version(i, new).copied if new is not None else ()):
                    yield {"tree": own["tree"][0].as_py(), "pos": start + i, "doc_id": doc, "level": level, "index": (start + i) // ARITY**level, "digest": digest}

        kinds = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())])
        return pa.Table.from_pylist(list(found()), schema=kinds)

    return rows.groupBy("tree", "block").applyInArrow(run, "tree string, pos long, doc_id long, level int, index long, digest string")
