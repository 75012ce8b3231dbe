"""Vectors, retrieval, neighbour graphs, clustering and word-overlap deduplication."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.config import DEFAULTS
from tracewell.operators.storage import settled

#: Rows of a matrix, and of a side of what one call compares.
BLOCK, TILE = 512, 8192
#: Entries of a group that one task reads in order without looking for links between them first.
ALONE = 1000
#: Similarities that a task holds at once, and vectors of a group that one pass takes by leaders.
CELLS, LEADERS = 4_000_000, 500_000
#: Bytes of texts that one call looks for words in.
CHARS = 16_000_000
#: Items of a component that average linkage merges in one task.
LINKED = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without length."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def top_chunks(chunks: DataFrame, queries: DataFrame, k: int = DEFAULTS.top_chunks) -> DataFrame:
    """The ``k`` chunks (id, vector) most like each query (query_id, vector), itself left out; of ties the smaller id.

    Both sides are dealt to blocks of bounded size; pairs of blocks meet as
    matrices, and only a block's k best of each query go on to be ranked.
    """
    rows = _met(queries.select(F.lit(0).alias("group"), F.col("query_id").alias("id"), "vector"), chunks.select(F.lit(0).alias("group"), "id", "vector"), k, -2.0)
    best = W.partitionBy("id").orderBy(F.desc("similarity"), "other")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return rows.select(F.col("id").alias("query_id"), F.col("other").alias("id"), "similarity", "rank")


def two_stage(scored: DataFrame, confidence: str, k: int = 8, by_similarity: float = 0.6, by_confidence: float = 0.4) -> DataFrame:
    """3k by similarity, then k by a blend of similarity and confidence."""
    first = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    rows = scored.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= 3 * k).withColumn("score", by_similarity * F.col("similarity") + by_confidence * F.col(confidence))
    second = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(second)).where(F.col("rank") <= k).drop("_r")


def keywords_of(text: Column, by_commas: bool = False) -> Column:
    """The lower-cased keywords of a query: its different words, or what stands between commas and blanks."""
    if by_commas:
        return F.transform(F.array_distinct(F.split(F.lower(text), ", ")), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""))


def _found(texts: list[str], words: list[str], size: int = 3, few: int = 200) -> Iterator[list[int]]:
    """The places in ``words`` of those that each text contains.

    Of more than ``few`` words only those are looked for of which the text has the run of ``size``
    characters that is rarest in some of the texts, as it has all runs of a word that it contains.
    """
    runs = lambda t: {t[i : i + size] for i in range(len(t) - size + 1)}
    every, under = list(range(len(words))), {}
    if len(words) > few:
        seen = Counter(g for t in texts[:: max(1, len(texts) // 50)] for g in runs(t))
        every = [j for j, w in enumerate(words) if len(w) < size]
        for j, w in enumerate(words):
            if len(w) >= size:
                under.setdefault(min(sorted(runs(w)), key=lambda g: seen[g]), []).append(j)
    for t in texts:
        near = [j for g in runs(t) if g in under for j in under[g]] if under else []
        yield [j for j in (*every, *near) if words[j] in t]


def _contained(texts: list[str | None], words: list[str], short: int = 24) -> Iterator[list[int]]:
    """The places in ``words`` of those that each text contains; a null text contains none.

    A word without blanks is in a text if it is in one of the text's parts between blanks, so that each
    part is looked at once for all texts: one of up to ``short`` characters along the beginnings of words
    from each of its characters on. Longer parts, and whole texts for words with blanks, are searched.
    """
    places, whole = ([j for j, w in enumerate(words) if (w.split() == [w]) is alone] for alone in (True, False))
    heads = {words[j][:e]: -1 for j in places for e in range(1, len(words[j]))} | {words[j]: j for j in places}
    parts: defaultdict[str, int] = defaultdict(lambda: len(parts))
    own = [[parts[s] for s in set(t.split())] if t is not None else [] for t in texts]

    def begun(s: str) -> Iterator[int]:
        for i in range(len(s)):
            for e in range(i + 1, len(s) + 1):
                if (j := heads.get(s[i:e])) is None:
                    break
                if j >= 0:
                    yield j

    far = _found([s for s in parts if len(s) > short], [words[j] for j in places])
    held = [[*begun(s)] if len(s) <= short else [places[j] for j in next(far)] for s in parts]
    for t, ps, found in zip(texts, own, _found([t or "" for t in texts], [words[j] for j in whole]), strict=True):
        yield [*set().union(*(held[s] for s in ps)), *(whole[j] for j in found if t is not None)]


def keyword_hits(texts: DataFrame, keywords: DataFrame, text: str, k: int = DEFAULTS.top_chunks, confidence: str | None = None) -> DataFrame:
    """(query_id, id, hits, rank): the ``k`` texts that contain the most of each query's ``words`` as substrings, by id among equals.

    A word that is listed twice counts twice. With ``confidence``, a column of
    ``texts``, they are ranked by 0.6 of the hits and 0.4 of it, in the column
    combined, and texts without a hit, null ones too, are ranked behind all others;
    without it they are left out. A confidence is from 0 to 1. An empty word is
    in every text that isn't null. Ids are unique. Texts are dealt to blocks of some ``CHARS`` bytes and
    queries to blocks of ``BLOCK``; a pair of them hands on the ``k`` best of each query.
    """
    sure = F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)) if confidence else F.lit(0.0)
    rows = (texts if confidence else texts.where(F.col(text).isNotNull())).select("id", F.lower(text).alias("text"), sure.alias("sure"))
    blocks = texts.agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.sum(F.coalesce(F.octet_length(text).cast("long"), F.lit(0)) + 64) / CHARS)).alias("blocks"))
    blocks = blocks.crossJoin(keywords.agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count(F.lit(1)) / BLOCK)).alias("asked")))
    left = rows.crossJoin(F.broadcast(blocks)).select("id", "text", "sure", F.pmod(F.xxhash64("id"), "blocks").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("asked") - 1)).alias("b"))
    right = keywords.crossJoin(F.broadcast(blocks)).select("query_id", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("a"), F.pmod(F.xxhash64("query_id"), "asked").alias("b"))
    kinds = dict(texts.dtypes) | dict(keywords.dtypes)
    columns = ["query_id", "id", "hits", "combined"]

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        asked: dict[str, list[tuple[int, int]]] = {}
        for q, words in enumerate(y["words"]):
            for w, n in Counter(words if words is not None else ()).items():
                asked.setdefault(w, []).append((q, n))
        words = list(asked)
        at, asking, times = (np.array(c, np.int64) for c in zip(*((j, q, n) for j, w in enumerate(words) for q, n in asked[w]), strict=True)) if words else [np.empty(0, np.int64)] * 3
        ids, sures, out = x["id"].to_numpy(), x["sure"].to_numpy(), []
        order = np.argsort(ids, kind="stable")
        found = _contained(list(x["text"].to_numpy()[order]), words)
        step, tile = max(k, CELLS // max(1, len(y), len(words))), max(1, CELLS // max(1, len(y)))
        for p in range(0, len(ids), step):
            some = order[p : p + step]
            has, hits = np.zeros((len(some), len(words)), np.float32), np.zeros((len(some), len(y)), np.float32)
            for i, js in enumerate(islice(found, len(some))):
                has[i, js] = 1
            for j in range(0, len(words), tile):
                of = slice(*np.searchsorted(at, [j, j + tile]))
                many = np.zeros((min(tile, len(words) - j), len(y)), np.float32)
                many[at[of] - j, asking[of]] = times[of]
                hits += has[:, j : j + tile] @ many
            hits = hits.astype(np.int32)
            score = hits * 0.6 + sures[some, None] * 0.4 if confidence else hits.astype(np.float64)
            for q in range(len(y)):
                own = np.arange(len(some)) if confidence else np.flatnonzero(hits[:, q])
                own = own[np.argsort(-score[own, q], kind="stable")[:k]]
                out.append((np.full(len(own), q), some[own], hits[own, q], score[own, q]))
        if not out:
            return pd.DataFrame({c: [] for c in columns})
        q, i, n, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"query_id": y["query_id"].to_numpy()[q], "id": ids[i], "hits": n, "combined": s})

    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(meet, f"query_id {kinds['query_id']}, id {kinds['id']}, hits int, combined double")
    best = W.partitionBy("query_id").orderBy(F.desc("combined"), "id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "hits", *(["combined"] if confidence else []), "rank")


def neighbours(items: DataFrame, k: int = DEFAULTS.knn, least: float = DEFAULTS.knn_least) -> DataFrame:
    """(group, id, other, similarity, rank): up to ``k`` most similar items over ``least``, exactly, within each group.

    Items (group, id, vector) are dealt to blocks of bounded size; pairs of
    blocks meet as matrices, each keeps the k best per item, and those are ranked.
    Tasks read groups of up to ``ALONE`` items many at once.
    """
    large = settled(items.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ALONE).select("group"), "large")
    some = not large.isEmpty()
    kind = dict(items.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("group", kind="stable").reset_index(drop=True)
        m, ids = np.stack(rows["vector"].to_numpy()).astype(np.float64), rows["id"].to_numpy()
        lengths, out = np.linalg.norm(m, axis=1), []
        of = rows.groupby("group", sort=False, dropna=False).ngroup().to_numpy()
        ends = np.searchsorted(of, np.arange(of[-1] + 2)).tolist()
        for p, q in zip(ends, ends[1:], strict=False):
            own, size = ids[p:q], lengths[p:q, None] * lengths[None, p:q]
            sims = np.divide(m[p:q] @ m[p:q].T, size, out=np.zeros_like(size), where=size > 0)
            sims[own[:, None] == own[None, :]] = -2
            i, j = np.nonzero(sims > least)
            order = np.lexsort((own[j], -sims[i, j], i))
            i, j = i[order], j[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((i[best] + p, j[best] + p, sims[i[best], j[best]]))
        i, j, sim = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"group": rows["group"].to_numpy()[i], "id": ids[i], "other": ids[j], "similarity": sim})

    small = items.select("group", "id", "vector")
    met = _grouped(small.join(large, "group", "left_anti") if some else small, ["group"], run, f"group {kind['group']}, id {kind['id']}, other {kind['id']}, similarity double", most=ALONE, many=True)
    if some:
        larger = small.join(large, "group", "left_semi")
        met = met.unionByName(_met(larger, larger, k, least))
    rank = W.partitionBy("group", "id").orderBy(F.desc("similarity"), "other")
    return met.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def best_of(x: pd.DataFrame, y: pd.DataFrame, k: int, least: float, cosine: bool = True) -> pd.DataFrame:
    """(group, id, other, similarity): for each row of ``x`` the ``k`` best over ``least`` of ``y``, in matrices of ``BLOCK`` rows a side."""
    if x.empty or y.empty:
        return pd.DataFrame({"group": [], "id": [], "other": [], "similarity": []})
    m, n = (np.stack([np.asarray(v, np.float64) for v in t["vector"]]) for t in (x, y))
    lengths = [np.linalg.norm(t, axis=1) for t in (m, n)]
    xi, yi = x["id"].to_numpy(), y["id"].to_numpy()
    out = []
    for p in range(0, len(m), BLOCK):
        some, ids, found = m[p : p + BLOCK], xi[p : p + BLOCK], []
        for q in range(0, len(n), BLOCK):
            others = yi[q : q + BLOCK]
            sims = some @ n[q : q + BLOCK].T
            if cosine:
                size = lengths[0][p : p + BLOCK, None] * lengths[1][None, q : q + BLOCK]
                sims = np.divide(sims, size, out=np.zeros_like(size), where=size > 0)
            else:
                sims = np.round(sims, 12)
            sims[ids[:, None] == others[None, :]] = -2
            if k < sims.shape[1]:  # what is under a row's k-th best can't count; ties with it can
                kth = np.partition(sims, -k, axis=1)[:, -k:].min(axis=1, keepdims=True)
                i, j = np.nonzero((sims > least) & (sims >= kth))
            else:
                i, j = np.nonzero(sims > least)
            found.append((i, others[j], sims[i, j]))
        i, other, sim = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((other, -sim, i))
        i = i[order]
        kept = order[np.arange(len(i)) - np.searchsorted(i, i) < k]  # a row's place among its own
        out.append((ids[np.concatenate([f[0] for f in found])[kept]], other[kept], sim[kept]))
    i, other, sim = (np.concatenate(c) for c in zip(*out, strict=True))
    return pd.DataFrame({"group": x["group"].iloc[0], "id": i, "other": other, "similarity": sim})


def _met(asked: DataFrame, items: DataFrame, k: int, least: float, cosine: bool = True) -> DataFrame:
    """(group, id, other, similarity): for each of ``asked`` the ``k`` best over ``least`` in each tile of ``items`` (both: group, id, vector), by cosine or by plain product.

    A side is copied once for each tile of the other, so that tiles are large; a task reads a pair of them in blocks.
    """
    sizes = asked.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks_a"))
    sizes = sizes.join(items.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks_b")), "group")
    # fresh names on each side of the cogroup
    renamed = [F.expr("`group`").alias("group"), F.expr("id + 0").alias("id"), F.expr("slice(vector, 1, size(vector))").alias("vector")]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(sizes, "group").withColumn("other_block", every("blocks_b")).select(*renamed, F.pmod(F.xxhash64("id"), "blocks_a").alias("a"), F.col("other_block").alias("b"))
    right = items.join(sizes, "group").withColumn("left_block", every("blocks_a")).select(*renamed, F.col("left_block").alias("a"), F.pmod(F.xxhash64("id"), "blocks_b").alias("b"))
    keys = ["group", "a", "b"]
    kind = dict(items.dtypes)

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return best_of(x, y, k, least, cosine)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"group {kind['group']}, id {kind['id']}, other {kind['id']}, similarity double")


def propagate_confidence(items: DataFrame, edges: DataFrame, passes: int = 2, source: str = "source", time: str = "time") -> DataFrame:
    """Confidence from source, recency and neighbours' consensus after synchronous passes, starting at 0.5.

    consensus is the mean of neighbours' confidence times similarity, weighed by positive similarity.
    """
    now = items.select("id", source, time, F.lit(0.5).alias("confidence"))
    weight = F.greatest("similarity", F.lit(0.0))
    for _ in range(passes):
        sent = edges.join(now.select(F.col("id").alias("other"), "confidence"), "other").groupBy("id").agg(F.sum(weight * F.col("confidence") * F.col("similarity")).alias("_up"), F.sum(weight).alias("_down"))
        consensus = F.coalesce(F.when(F.col("_down") > 0, F.col("_up") / F.col("_down")), F.lit(0.0))
        consensus = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), consensus))
        score = 0.4 * F.col(source) + 0.3 * F.col(time) + 0.3 * consensus
        now = now.drop("confidence").join(sent, "id", "left").select("id", source, time, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"))
    return now


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the smaller set's size."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def _grouped(df: DataFrame, by: list[str], f, schema: str, most: int = 20_000, many: bool = False) -> DataFrame:  # noqa: ANN001
    """An order-dependent pass over each group, as of one profile's entries.

    A group of more than ``most`` rows is not what such a pass is for: it stops
    with a message that names the group, in place of running out of memory.
    Tasks read their groups one behind the other from batches of rows, as a
    call for each of many small groups costs more than their rows do. With
    ``many``, ``f`` takes the rows of any number of whole groups at once.
    """

    def checked(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > most:
            raise ValueError(f"group {tuple(rows[by].iloc[0])} has over {most} rows: group by something smaller, as a profile or a session")
        return rows

    def passed(rows: pd.DataFrame) -> pd.DataFrame:
        groups = rows.groupby(by, sort=False, dropna=False)
        if many and groups.size().max() <= most:
            return f(rows)
        return pd.concat([f(checked(x)) for _, x in groups], ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if batch.empty:
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = rows[by].iloc[-1]
            open_ = reduce(lambda a, b: a & b, (rows[c].isna() if pd.isna(last[c]) else rows[c] == last[c] for c in by))
            held, done = checked(rows[open_]), rows[~open_]
            if len(done):
                yield passed(done)
        if held is not None:
            yield f(held)

    return df.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != ""))


def set_classes(entries: DataFrame, by: list[str]) -> DataFrame:
    """``entries`` (``by``, seq, words) with class, the least seq of those with the same words in ``by``; an empty set is a class of its own."""
    rows = entries.withColumn("words", F.sort_array("words"))
    first = rows.groupBy(*by, "words").agg(F.min("seq").alias("_first"))
    return rows.join(first, [*by, "words"]).withColumn("class", F.when(F.size("words") == 0, F.col("seq")).otherwise(F.col("_first"))).drop("_first")


def overlapping(sets: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by, a, b), a < b: pairs of ``sets`` (by, seq, words: distinct, each set once) that share over ``threshold`` of the smaller set's words.

    Of a set of n words the pair must share o > threshold * n with any larger
    one, so that one of its n - o + 1 rarest words is in the other: sets meet at
    the rarest words of the smaller one only, and are then held against each
    other. Empty sets overlap with nothing.
    """
    sets = sets.where(F.size("words") > 0).select(*by, "seq", "words", F.size("words").alias("n"))
    words = sets.select(*by, "seq", "n", F.explode("words").alias("word"))
    counted = words.join(words.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("df")), [*by, "word"])
    rare = W.partitionBy(*by, "seq").orderBy("df", "word")
    needed = F.floor(F.col("n") * threshold - 1e-9) + 1
    heads = counted.withColumn("_r", F.row_number().over(rare)).where(F.col("_r") <= F.col("n") - needed + 1).select(*by, "word", F.col("seq").alias("x"), F.col("n").alias("nx"))
    met = heads.join(words.select(*by, "word", F.col("seq").alias("y"), F.col("n").alias("ny")), [*by, "word"]).where((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))))
    pairs = met.select(*by, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda c: sets.select(*by, F.col("seq").alias(c), F.col("words").alias(f"_{c}"))
    return pairs.join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"]).where(overlap(F.col("_a"), F.col("_b")) > threshold).select(*by, "a", "b")


def first_kept(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, seq, kept): for each b of ``edges`` (by, a, b) the first kept node that it is linked to, where a node is kept if no earlier kept one is linked to it.

    The choice that a pass in order would make, in rounds over the edges: nodes
    with an earlier neighbour that is kept go, nodes whose earlier neighbours
    are all gone are kept; what is decided takes no part in later rounds. Nodes
    that aren't in the result are kept.
    """
    edges = settled(edges, "edges")
    kept = edges.select(*by, F.col("a").alias("node")).distinct().join(edges.select(*by, F.col("b").alias("node")).distinct(), [*by, "node"], "left_anti")
    gone, open_edges, kept_all = None, edges, kept
    while True:
        news = settled(open_edges.join(kept.withColumnRenamed("node", "a"), [*by, "a"], "left_semi").select(*by, F.col("b").alias("node")).distinct(), "gone")
        gone = news if gone is None else gone.unionByName(news)
        left = open_edges.join(news.withColumnRenamed("node", "b"), [*by, "b"], "left_anti")
        waiting = settled(left.join(news.withColumnRenamed("node", "a"), [*by, "a"], "left_anti"), "open")  # edges whose earlier end isn't gone
        freed = settled(left.select(*by, F.col("b").alias("node")).distinct().join(waiting.select(*by, F.col("b").alias("node")).distinct(), [*by, "node"], "left_anti"), "kept")
        kept, open_edges = freed, waiting
        kept_all = kept_all.unionByName(freed)
        if freed.isEmpty() and waiting.isEmpty():
            break
    return edges.join(gone.withColumnRenamed("node", "b"), [*by, "b"], "left_semi").join(kept_all.withColumnRenamed("node", "a"), [*by, "a"], "left_semi").groupBy(*by, F.col("b").alias("seq")).agg(F.min("a").alias("kept"))


def merge_by_overlap(entries: DataFrame, threshold: float = DEFAULTS.dedup_overlap, least: int = 11, alone: int = ALONE) -> DataFrame:
    """Greedy merge of entries (group, seq, text, confidence) whose words overlap: confidence +0.1 up to 1, one observation more.

    An entry joins the first kept one, by seq (unique in the group), of which it
    shares over ``threshold`` of the smaller word set; else it is kept. Lists
    ``keywords`` and ``entities``, where there are any, are united and sorted.
    Groups of fewer than ``least`` entries stay as they are. Groups of up to ``alone``
    are read in order, many to a task; of larger ones, in which entries of equal
    words are one meanwhile, pairs are looked for.
    """
    lists = [c for c in ("keywords", "entities") if c in entries.columns]
    entries = entries.select("group", "seq", "text", "confidence", *lists)
    large = settled(entries.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(alone, least - 1)).select("group"), "large")
    some = not large.isEmpty()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq").reset_index(drop=True)
        of = rows.groupby("group", sort=False, dropna=False).ngroup().to_numpy()
        enough, seq = (np.bincount(of) >= least).tolist(), rows["seq"].tolist()
        into, kept = list(seq), [[] for _ in enough]
        for i, (g, text) in enumerate(zip(of.tolist(), rows["_low"].tolist(), strict=True)):
            if not enough[g]:
                continue
            words = set(re.split(r"[ \t\n\x0b\f\r]+", text)) - {""}
            for other, at in kept[g]:
                small = min(len(words), len(other))
                if small and len(words & other) / small > threshold:
                    into[i] = at
                    break
            else:
                kept[g].append((words, seq[i]))
        return rows.drop(columns="_low").assign(into=into)

    small = entries.join(large, "group", "left_anti") if some else entries
    kinds = [*entries.dtypes, ("into", dict(entries.dtypes)["seq"])]
    all_rows = _grouped(small.withColumn("_low", F.lower(F.coalesce("text", F.lit("")))), ["group"], run, ", ".join(f"{c} {t}" for c, t in kinds), most=max(alone, least), many=True)
    if some:
        rows = settled(set_classes(entries.select("group", "seq", word_set(F.col("text")).alias("words")).join(large, "group", "left_semi"), ["group"]), "classes")
        into = first_kept(overlapping(rows.where(F.col("seq") == F.col("class")), ["group"], threshold), ["group"])
        into = rows.select("group", "seq", "class").join(into.withColumnRenamed("seq", "class"), ["group", "class"], "left").select("group", "seq", F.coalesce("kept", "class").alias("into"))
        all_rows = all_rows.unionByName(entries.join(into, ["group", "seq"]))
    own = F.col("seq") == F.col("into")
    merged = all_rows.groupBy("group", "into").agg(
        F.first(F.when(own, F.col("text")), ignorenulls=True).alias("text"), F.first(F.when(own, F.col("confidence")), ignorenulls=True).cast("double").alias("confidence"), F.count(F.lit(1)).cast("int").alias("observations"),
        *(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in lists),
    )
    steps = F.when(F.col("observations") > 1, F.sequence(F.lit(2), F.col("observations"))).otherwise(F.array().cast("array<int>"))
    return merged.select("group", F.col("into").alias("seq"), "text", F.aggregate(steps, F.col("confidence"), lambda c, _: F.least(F.lit(1.0), c + 0.1)).alias("confidence"), "observations", *lists)


def linked(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, root): the least node that each node of ``edges`` (by, a, b) is linked to, by least labels and pointer jumping."""
    both = settled(edges.select(*by, F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(*by, "b", "a")).distinct(), "links")
    labels = settled(both.groupBy(*by, "node").agg(F.min("other").alias("m")).select(*by, "node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(*by, F.col("node").alias("other"), "root"), [*by, "other"]).groupBy(*by, "node").agg(F.min("root").alias("near"))
        step = labels.join(near, [*by, "node"]).select(*by, "node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        top = labels.select(*by, F.col("node").alias("root"), F.col("root").alias("top"))
        labels = settled(step.join(top, [*by, "root"], "left").select(*by, "node", "old", F.least("root", F.coalesce("top", "root")).alias("root")), "labels")
        if labels.where(F.col("root") != F.col("old")).isEmpty():
            return labels.drop("old")
        labels = labels.drop("old")


def consolidate(entries: DataFrame, threshold: float = DEFAULTS.consolidate_overlap, alone: int = ALONE) -> DataFrame:
    """As ``merge_by_overlap`` within a type, but of two overlapping texts the more confident one stays, with the observations of both (if that is a column).

    The text that stays is what later ones are held against, so that entries are
    read in order. Of a type with over ``alone`` entries in its group, only
    those that some chain of overlaps links are read together, and the others
    stay as they are; of a smaller one all are.
    """
    kinds, by = dict(entries.dtypes), ["group", "type"]
    first = entries.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    first = settled(first.where(F.col("_n") > alone), "large")
    parts = entries.withColumn("_component", F.lit(None).cast(dict(entries.dtypes)["seq"]))
    if not first.isEmpty():
        large = entries.select(*by, "seq", word_set(F.col("text")).alias("words")).join(first.select(*by), by, "left_semi")
        rows = settled(set_classes(large, by), "classes")
        roots = linked(overlapping(rows.where(F.col("seq") == F.col("class")), by, threshold), by).withColumnRenamed("node", "class")
        placed = rows.select(*by, "seq", "class").join(roots, [*by, "class"], "left").select(*by, "seq", F.coalesce("root", "class").alias("_component"))
        parts = entries.join(placed, [*by, "seq"], "left")

    keys = [*by, "_component"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq").reset_index(drop=True)
        kept: dict[int, list[list]] = {}
        seen = rows["observations"].tolist() if "observations" in kinds else [1] * len(rows)
        sure = rows["confidence"].tolist()
        of = rows.groupby(keys, sort=False, dropna=False).ngroup().tolist()
        for i, text in enumerate(rows["text"].tolist()):
            words = set((text or "").lower().split())
            for other in kept.setdefault(of[i], []):
                small = min(len(words), len(other[0]))
                if small and len(words & other[0]) / small > threshold:
                    other[2] += seen[i]
                    if sure[i] > sure[other[1]]:
                        other[:2] = [words, i]
                    break
            else:
                kept[of[i]].append([words, i, seen[i]])
        stay = [k for own in kept.values() for k in own]
        out = rows.iloc[[k[1] for k in stay]][list(kinds)]
        return out.assign(observations=[k[2] for k in stay]) if "observations" in kinds else out

    return _grouped(parts, keys, run, ", ".join(f"{c} {t}" for c, t in entries.dtypes), many=True)


def leader_clusters(items: DataFrame, least: float = DEFAULTS.leader_similarity) -> DataFrame:
    """(group, id, cluster): items in order join the cluster whose running, renormalised centroid is most like them, or open one.

    A pass in order over one group: its work grows with the items times the
    clusters, its memory with the items. Items meet the centres as matrices, a
    few hundred at a time; centres that change meanwhile are compared anew, and
    so are all within rounding of the best.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        items = [np.asarray(v, np.float64) for v in rows["vector"]]
        wide = len(items[0])
        centres, sums, n, out, at = np.empty((64, wide)), np.empty((64, wide)), 0, [], 0
        while at < len(items):
            some = np.stack(items[at : at + max(1, min(256, CELLS // max(n, 1)))])
            some = some / np.array([np.linalg.norm(x) or 1.0 for x in some])[:, None]
            at += len(some)
            sims = some @ centres[:n].T  # as of now; a centre that moves is taken out and compared by itself
            moved: list[int] = []
            for i, x in enumerate(some):
                own = sims[i]
                own[[c for c in moved if c < len(own)]] = -np.inf
                top = np.max(own, initial=-np.inf)
                new = centres[moved] @ x if moved else np.empty(0)
                top = max(top, np.max(new, initial=-np.inf)) - 1e-9
                close = sorted([*np.flatnonzero(own >= top).tolist(), *(moved[j] for j in np.flatnonzero(new >= top))]) if n else []
                exact = [float(centres[c] @ x) for c in close]
                best = close[int(np.argmax(exact))] if close else -1
                if best < 0 or max(exact) < least:
                    if n == len(centres):
                        centres, sums = (np.concatenate([m, np.empty_like(m)]) for m in (centres, sums))
                    centres[n] = sums[n] = x
                    best, n = n, n + 1
                    moved.append(best)
                else:
                    sums[best] += x
                    centres[best] = sums[best] / (np.linalg.norm(sums[best]) or 1.0)
                    if best not in moved:
                        moved.append(best)
                out.append(best)
        return pd.DataFrame({"group": rows["group"], "id": rows["id"], "cluster": out})

    kind = dict(items.dtypes)
    return _grouped(items.select("group", "id", "vector"), ["group"], run, f"group {kind['group']}, id {kind['id']}, cluster int", most=LEADERS)


def linkage_clusters(items: DataFrame, least: float = DEFAULTS.episode_similarity) -> DataFrame:
    """(group, id, cluster): average linkage on cosine until no two clusters are ``least`` alike; clusters by size.

    The mean similarity of two clusters is the product of their mean unit
    vectors, so that a cluster is one row. In each round every cluster finds the
    one most like it, and all pairs that chose each other merge: what merges two
    others never brings a third nearer to them than it was to one of them, so
    that these are merges of the one-by-one order too. A cluster to which none
    is ``least`` alike is done, and takes no part any more. Similarities count to
    12 digits, and of equal ones the smaller ids; copies of a vector are one cluster
    from the start. Clusters that merge have two items of that likeness, so that no
    cluster leaves its component of items that are alike: components of up to
    ``LINKED`` items are merged in one task each, larger ones block against block.
    """
    unit = F.transform(normalised(F.transform("vector", lambda x: x.cast("double"))), lambda x: x.cast("double"))
    rows = items.select("group", "id", unit.alias("vector"))
    none = F.forall("vector", lambda x: x == 0) if least <= 1 else F.lit(True)
    rows = settled(rows.select("*", F.transform("vector", lambda x: F.round(x, 13) + 0.0).alias("_v"), F.when(none, F.col("id")).alias("_own")), "vectors")
    same = [F.col("group") == F.col("_g"), F.col("_v") == F.col("_w"), F.col("_own").eqNullSafe(F.col("_o"))]
    first = settled(rows.groupBy("group", "_v", "_own").agg(F.min("id").alias("root"), F.min_by("vector", "id").alias("vector"), F.count(F.lit(1)).alias("size")), "first")
    member = rows.select("group", "id", "_v", "_own").join(first.select(F.col("group").alias("_g"), F.col("_v").alias("_w"), F.col("_own").alias("_o"), "root"), same).select("group", "id", "root")
    now = first.select("group", F.col("root").alias("id"), "vector", "size")
    parts = settled(linked(_alike(now, least), ["group"]), "components")
    large = parts.groupBy("group", "root").agg((F.count(F.lit(1)) > LINKED).alias("large"))
    parts = settled(now.join(parts.join(large, ["group", "root"]).withColumnsRenamed({"node": "id", "root": "part"}), ["group", "id"]), "parts")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["group", "part", "id"]).reset_index(drop=True)
        m, size, ids = np.stack(rows["vector"].to_numpy()), rows["size"].to_numpy(), rows["id"].to_numpy()
        start = [0, *(np.flatnonzero((rows["group"] != rows["group"].shift()) | (rows["part"] != rows["part"].shift()))[1:].tolist()), len(rows)]
        to = [ids[p:q][_averaged(m[p:q], size[p:q], least)] for p, q in zip(start, start[1:], strict=False)]
        return pd.DataFrame({"group": rows["group"], "root": ids, "to": np.concatenate(to)})

    kind = dict(items.dtypes)
    merged = _grouped(parts.where(~F.col("large")), ["group", "part"], run, f"group {kind['group']}, root {kind['id']}, to {kind['id']}", most=LINKED, many=True)
    if not large.where("large").isEmpty():
        merged = merged.unionByName(_averaged_apart(parts.where("large").select("group", "id", "vector", "size"), least))
    member = settled(member.join(merged, ["group", "root"], "left").select("group", "id", F.coalesce("to", "root").alias("root")), "members")
    sizes = member.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    numbers = sizes.withColumn("cluster", F.row_number().over(W.partitionBy("group").orderBy(F.desc("n"), "first")) - 1)
    return member.join(numbers, ["group", "root"]).select("group", "id", "cluster")


def _alike(units: DataFrame, least: float) -> DataFrame:
    """(group, a, b): pairs of ``units`` (group, id, vector) that link all which are ``least`` alike or a little less, at most one for each vector and pair of tiles."""
    sizes = units.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    rows = units.join(sizes, "group").select("group", "id", F.col("vector").cast("array<float>").alias("vector"), F.pmod(F.xxhash64("id"), "tiles").alias("at"), "tiles")
    to = lambda a, b: F.explode(F.sequence(a, b))
    # fresh names on each side of the cogroup
    left = rows.select(F.expr("`group`").alias("group"), "id", "vector", F.col("at").alias("a"), to(F.col("at"), F.col("tiles") - 1).alias("b"))
    right = rows.where(F.col("tiles") > 1).select(F.expr("`group`").alias("group"), F.expr("id + 0").alias("id"), F.expr("slice(vector, 1, size(vector))").alias("vector"), to(F.lit(0).cast("long"), F.col("at")).alias("a"), F.col("at").alias("b")).where("a < b")
    kind, keys = dict(units.dtypes), ["group", "a", "b"]

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty:
            return pd.DataFrame({"group": [], "a": [], "b": []})
        m = np.stack(x["vector"].to_numpy())
        n = np.stack(y["vector"].to_numpy()) if len(y) else m
        ids = np.concatenate([x["id"].to_numpy(), y["id"].to_numpy().astype(x["id"].dtype)])
        up, at = np.arange(len(ids)), len(x) if len(y) else 0
        for p in range(0, len(m), BLOCK):
            i, j = np.nonzero(m[p : p + BLOCK] @ n.T >= least - 1e-4)
            i, j = up[i + p], up[j + at]
            while (i != j).any():
                i, j = i[i != j], j[i != j]
                np.minimum.at(up, np.maximum(i, j), np.minimum(i, j))
                while (up[up] != up).any():
                    up = up[up]
                i, j = up[i], up[j]
        b = np.flatnonzero(up != np.arange(len(up)))
        return pd.DataFrame({"group": x["group"].iloc[0], "a": ids[up[b]], "b": ids[b]})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"group {kind['group']}, a {kind['id']}, b {kind['id']}")


def _averaged(m: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """The first row of each row's cluster; rows are mean unit vectors, by id. Only what merged, or was nearest to what did, looks again."""
    m, size = m.copy(), size.astype(np.float64)
    root, other, sim = np.arange(len(m)), np.full(len(m), -1), np.zeros(len(m))
    alive = stale = np.arange(len(m))
    while len(alive) > 1:
        step = max(1, CELLS // len(alive))
        for p in range(0, len(stale), step):
            rows = stale[p : p + step]
            sims = np.round(m[rows] @ m[alive].T, 12)
            sims[np.arange(len(rows)), np.searchsorted(alive, rows)] = -2
            best = sims.argmax(axis=1)
            sim[rows] = sims[np.arange(len(rows)), best]
            other[rows] = np.where(sim[rows] >= least, alive[best], -1)
        alive = alive[other[alive] >= 0]
        if not len(alive):
            break
        a = alive[(other[other[alive]] == alive) & (alive < other[alive])]
        if not len(a):  # one rounded otherwise from the other side
            a = alive[[np.argmax(sim[alive])]]
        a, b = np.minimum(a, other[a]), np.maximum(a, other[a])
        both = size[a] + size[b]
        m[a] = (m[a] * size[a, None] + m[b] * size[b, None]) / both[:, None]
        size[a], root[b] = both, a
        moved = np.zeros(len(m), bool)
        moved[a] = moved[b] = True
        alive = alive[root[alive] == alive]
        stale = alive[moved[alive] | moved[other[alive]]]
    while (root[root] != root).any():
        root = root[root]
    return root


def _averaged_apart(now: DataFrame, least: float) -> DataFrame:
    """(group, root, to): what ``_averaged`` does, for clusters (group, id, vector, size) of any number, in rounds of joins."""
    member = settled(now.select("group", F.col("id").alias("root"), F.col("id").alias("to")), "members")
    near, stale, best = None, now, W.partitionBy("group", "id").orderBy(F.desc("similarity"), "other")
    while True:
        found = _met(stale, now, 1, np.nextafter(least, -2), cosine=False).withColumn("_r", F.row_number().over(best)).where(F.col("_r") == 1).select("group", "id", "other", "similarity")
        near = settled(found if near is None else near.unionByName(found), "near")
        if near.isEmpty():
            return member
        back = near.select("group", F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = settled(near.join(back, ["group", "id", "other"], "left_semi").where(F.col("id") < F.col("other")).select("group", "id", F.col("other").alias("gone")), "merges")
        to = pairs.select("group", F.col("gone").alias("_from"), F.col("id").alias("_to"))
        member = settled(member.join(to.withColumnRenamed("_from", "to"), ["group", "to"], "left").select("group", "root", F.coalesce("_to", "to").alias("to")), "members")
        alive = now.join(near.select("group", "id"), ["group", "id"], "left_semi").join(to.withColumnRenamed("_from", "id"), ["group", "id"], "left").select("group", F.coalesce("_to", "id").alias("id"), "vector", "size")
        added = alive.groupBy("group", "id").agg(F.collect_list(F.struct("vector", "size")).alias("v"))  # one or two of them
        one, two, size = F.element_at("v", 1), F.element_at("v", -1), F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["size"])
        mean = F.when(F.size("v") == 1, one["vector"]).otherwise(F.zip_with(one["vector"], two["vector"], lambda x, y: (x * one["size"] + y * two["size"]) / size))
        now = settled(added.select("group", "id", mean.alias("vector"), size.alias("size")), "clusters")
        moved = pairs.select("group", F.explode(F.array("id", "gone")).alias("id"))
        near = settled(near.join(moved, ["group", "id"], "left_anti").join(moved.withColumnRenamed("id", "other"), ["group", "other"], "left_anti").select("group", "id", "other", "similarity"), "near")
        stale = now.join(near.select("group", "id"), ["group", "id"], "left_anti")


def centroid_clusters(items: DataFrame, most: int = DEFAULTS.session_clusters) -> DataFrame:
    """(group, id, cluster): the two nearest centroids merge until ``most`` are left, on vectors as they are; clusters by size."""

    def merged(m: np.ndarray) -> np.ndarray:
        groups, centres = [[i] for i in range(len(m))], list(m)
        while len(groups) > most:
            at = np.stack(centres)
            d = np.linalg.norm(at[:, None] - at[None], axis=2)
            d[np.tril_indices(len(groups))] = np.inf
            i, j = np.unravel_index(int(np.argmin(d)), d.shape)
            groups[i] += groups.pop(j)
            centres[i] = m[groups[i]].mean(axis=0)
            centres.pop(j)
        label = np.empty(len(m), int)
        for c, g in enumerate(sorted(groups, key=lambda x: (-len(x), min(x)))):
            label[g] = c
        return label

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_no=rows.groupby("group", sort=False, dropna=False).ngroup()).sort_values(["_no", "id"])
        vectors = list(rows["vector"])
        ends = [*(np.flatnonzero(np.diff(rows["_no"])) + 1), len(rows)]
        labels = [merged(np.stack([np.asarray(v, np.float64) for v in vectors[i:j]])) for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        return pd.DataFrame({"group": rows["group"], "id": rows["id"], "cluster": np.concatenate(labels)})

    kind = dict(items.dtypes)
    return _grouped(items.select("group", "id", "vector"), ["group"], run, f"group {kind['group']}, id {kind['id']}, cluster int", many=True)


def distinct_first(rows: DataFrame, by: list[str], within: list[str], order: list[Column], k: int) -> DataFrame:
    """Top ``k`` of each group, taking the best of each inner group before any second one."""
    inner = W.partitionBy(*by, *within).orderBy(*order)
    rows = rows.withColumn("_again", (F.row_number().over(inner) > 1).cast("int"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("_again", *order))).where(F.col("rank") <= k).drop("_again")


def sample_contents(files: DataFrame, budget: int = 8000, least: int = 200, each: int = 3) -> DataFrame:
    """Texts for a prompt from (group, task_id, kind, file_type, content, importance): shares of a budget by importance.

    A trajectory gives a create, a major and a minor edit; kinds of file not
    seen yet come first, then longer ones, cut to what is left of its share.
    Only the longest text of each trajectory, kind and file type can be chosen;
    it is found first, so that a group's pass in order holds one short text of each.
    """
    best = files.where(F.length("content") > 0).groupBy("group", "task_id", "kind", "file_type").agg(F.min(F.struct((-F.length("content")).alias("size"), "content")).alias("best"))
    order = W.partitionBy("group", "task_id", "kind").orderBy("best", "file_type")
    best = best.select("group", "task_id", "kind", "file_type", F.row_number().over(order).alias("place"), F.substring("best.content", 1, max(budget, least)).alias("content"))
    weights = files.groupBy("group", "task_id").agg(F.max("importance").cast("double").alias("importance"))

    def chosen(tasks: dict, pools: dict[tuple, list]) -> Iterator[tuple]:
        total = np.array([tasks[t] for t in sorted(tasks)]).sum() or 1.0
        share = {t: max(least, int(budget * tasks[t] / total)) for t in sorted(tasks)}
        scale = min(1.0, budget / max(1, sum(share.values())))
        seen: set = set()
        for t in share:
            left = int(share[t] * scale)
            for kind in ("create", "major_edit", "minor_edit")[:each]:
                pool = pools.get((t, kind))
                if not pool or left <= 0:
                    continue
                _, file_type, content = min(pool, key=lambda r: (r[1] in seen, r[0]))
                seen.add(file_type)
                text = content[:left]
                left -= len(text)
                yield t, kind, file_type, text

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["task_id"].notna()]
        number = rows.groupby("group", sort=False, dropna=False).ngroup()
        found: dict[int, tuple] = {}
        columns = (rows[c].tolist() for c in ("group", "task_id", "importance", "kind", "place", "file_type", "content"))
        for no, group, t, weight, kind, *text in zip(number.tolist(), *columns, strict=True):
            _, tasks, pools = found.setdefault(no, (group, {}, {}))
            tasks[t] = weight  # the same in all rows of a task
            pools.setdefault((t, kind), []).append(text)
        out = [(group, *pick) for group, tasks, pools in found.values() for pick in chosen(tasks, pools)]
        return pd.DataFrame(out, columns=["group", "task_id", "kind", "file_type", "sample"])

    kind = dict(files.dtypes)
    return _grouped(weights.join(best, ["group", "task_id"], "left"), ["group"], run, f"group {kind['group']}, task_id {kind['task_id']}, kind string, file_type string, sample string", many=True)


def embed(texts: DataFrame, text: str, size: int = 64) -> DataFrame:
    """Default embedding: hashed words, counts damped and L2-normalised; a stand-in for a model's vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for batch in batches:
            out = []
            for t in batch[text]:
                v = np.zeros(size)
                for w in (t or "").lower().split():
                    v[zlib.crc32(w.encode()) % size] += 1
                v = np.log1p(v)
                out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32).tolist())
            yield batch.assign(vector=out)

    return texts.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in texts.dtypes) + ", vector array<float>")
