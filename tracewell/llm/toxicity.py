"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and their first 5 and 6 bytes, so that inflected forms meet.
A term's weight is its idf, shrunk by how surely its presence goes with the
label: times 1 - ``chance`` / G2 with the likelihood ratio G2 over the training
examples, and nothing where chance alone explains it. There is no limit on the
number of terms. A text's vector holds, per term, that weight times
log(1 + occurrences per 100 words), and one pseudo-term of fixed weight for all
other words, so that the angle between two texts depends on how dense the terms
are and not only on which ones occur. (Unshrunk TF-IDF over all words finds a
third of the held-out toxic rows only: most of a long text's length in that
space are words that tell nothing about the label.)

Examples lie in an inverted index of sparse posting lists, cut into blocks of
examples with the largest weight of each term in each. A query adds up these
maxima to bound the similarity in each block, and skips the blocks whose bound
is below the k-th best found; the result is exactly that of comparing all
examples. Similarities, raised to a power, weigh the votes, with the base rate
as one vote more. The training examples' own votes, each found without itself,
give the curve that turns votes into the share of toxic texts with such votes:
the score.

What is learnt is bounded by ``max_examples`` labelled rows (those with the
smallest hash of doc_id). Scores are given to all rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import frugal, ship, stored, text_of

#: Letters lower-cased; digits and punctuation part words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
STEMS = (5, 6)


@dataclass(frozen=True)
class Settings:
    max_examples: int = 8192
    chance: float = 15.0
    others: float = 3.0
    k: int = 15
    power: int = 8
    block: int = 32
    pool: int = 40


def term_counts(text: str) -> tuple[int, dict[bytes, int]]:
    """Number of words, and occurrences of each term (a whole word ends with a space)."""
    words = Counter(text.encode("utf-8", "replace").translate(FOLD).split())
    out: dict[bytes, int] = defaultdict(int)
    for w, n in words.items():
        out[w + b" "] += n
        for k in STEMS:
            if len(w) > k:
                out[w[:k]] += n
    return sum(words.values()), out


def held_out(doc_id: str = "doc_id"):  # noqa: ANN201
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def examples(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text, toxic) of the bounded sample of training rows, written to the shared folder.

    A doc_id counts once, with its greatest label and, of several texts, the
    smallest; labels without documents and null labels are left out.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_examples)
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(rows), "doc_id")
    return stored(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")), "toxicity-examples")


def vocabulary(sample: DataFrame, s: Settings) -> dict[bytes, float]:
    """Weights of the terms that go with the label more than by chance."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_label: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                with_label[toxic].update(term_counts(text.as_py())[1].keys())
        terms = list(with_label[0] | with_label[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *(pa.array([c[t] for t in terms], pa.int64()) for c in with_label)], names=["term", "clean", "toxic"])

    n_clean, n_toxic = (sample.where(F.col("toxic") == y).count() for y in (0, 1))
    if not n_clean or not n_toxic:
        return {}
    n = n_clean + n_toxic
    df = sample.select("text", "toxic").mapInArrow(frugal(count), "term binary, clean long, toxic long")
    df = df.groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.col("t") * n_clean > F.col("c") * n_toxic)

    def part(seen, whole):  # noqa: ANN001, ANN202
        return F.when(seen > 0, 2 * seen * F.log(seen / whole)).otherwise(0.0)

    both = F.col("c") + F.col("t")
    g2 = part(F.col("t"), both * n_toxic / n) + part(F.col("c"), both * n_clean / n) + part(n_toxic - F.col("t"), (n - both) * n_toxic / n) + part(n_clean - F.col("c"), (n - both) * n_clean / n)
    sure = df.withColumn("g2", g2).where(F.col("g2") > s.chance).orderBy("term")
    return {bytes(r["term"]): math.log(n / (r["c"] + r["t"])) * (1 - s.chance / r["g2"]) for r in sure.collect()}


@dataclass
class Vectors:
    """Turns texts into sparse unit vectors over a vocabulary; the pseudo-term's weight comes apart."""

    weight: dict[bytes, float]
    others: float
    at: dict[bytes, int] = field(init=False)

    def __post_init__(self) -> None:
        self.at = {t: i for i, t in enumerate(self.weight)}
        self.idf = list(self.weight.values())

    def of(self, text: str) -> tuple[list[int], list[float], float]:
        words = Counter(text.encode("utf-8", "replace").translate(FOLD).split())
        at, n, counts = self.at, 0, defaultdict(int)
        for w, k in words.items():
            n += k
            if (i := at.get(w + b" ")) is not None:
                counts[i] += k
            for size in STEMS:
                if len(w) > size and (i := at.get(w[:size])) is not None:
                    counts[i] += k
        ids = sorted(counts)
        weights = [self.idf[i] * math.log1p(100 * counts[i] / n) for i in ids]
        norm = math.sqrt(sum(x * x for x in weights) + self.others**2)
        return ids, [x / norm for x in weights], self.others / norm


class Index:
    """Block-max inverted index over unit vectors: a posting list and a list of block maxima per term."""

    def __init__(self, vectors: list[tuple[list[int], list[float], float]], labels: list[int], names: list[int], terms: int, s: Settings):
        # examples of like terms next to each other make tight bounds
        order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0][int(np.argmax(vectors[i][1]))] if vectors[i][0] else terms, vectors[i][2], names[i]))
        self.s, self.n = s, len(order)
        self.blocks = -(-self.n // s.block)
        place = np.repeat(np.arange(self.n), [len(vectors[i][0]) for i in order])
        term = np.array([t for i in order for t in vectors[i][0]], np.int64)
        weight = np.array([w for i in order for w in vectors[i][1]], np.float64)
        by_term = np.argsort(term, kind="stable")
        self.place, self.weight = place[by_term], weight[by_term]
        self.of_term = np.searchsorted(term[by_term], np.arange(terms + 1))
        cell = term[by_term] * max(self.blocks, 1) + self.place // s.block
        self.cells, start = np.unique(cell, return_index=True)
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.empty(0)
        self.of_cell = np.searchsorted(self.cells, np.arange(terms + 1) * max(self.blocks, 1))
        self.cells %= max(self.blocks, 1)
        self.rest = np.array([vectors[i][2] for i in order])
        self.most_rest = np.maximum.reduceat(self.rest, np.arange(0, self.n, s.block)) if self.n else np.empty(0)
        self.labels = np.array([labels[i] for i in order], np.float64)
        self.names = np.array([names[i] for i in order], np.int64)
        self.rate = float(self.labels.mean()) if self.n else 0.0
        self.plain: tuple[float, int, float] | None = None

    def _lists(self, ids: list[int], weights: list[float], ends: np.ndarray, where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [slice(ends[i], ends[i + 1]) for i in ids]
        if not parts:
            return np.empty(0, np.int64), np.empty(0)
        return np.concatenate([where[p] for p in parts]), np.concatenate([what[p] * w for p, w in zip(parts, weights, strict=True)])

    def nearest(self, ids: list[int], weights: list[float], rest: float, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the k nearest examples, with all that tie with the k-th; not that named ``without``."""
        size, k = self.s.block, self.s.k
        block, most = self._lists(ids, weights, self.of_cell, self.cells, self.most)
        bounds = rest * self.most_rest + np.bincount(block, most, self.blocks)
        place, part = self._lists(ids, weights, self.of_term, self.place, self.weight)

        def within(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            places = np.flatnonzero(np.repeat(blocks, size)[: self.n])
            use = blocks[place // size]
            sims = rest * self.rest + np.bincount(place[use], part[use], self.n)
            if without is not None:
                places = places[self.names[places] != without]
            return places, sims[places]

        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bounds, kind="stable")[: -(-(k + 1) // size) + 1]] = True
        _, sims = within(first)
        kth = float(np.partition(sims, len(sims) - k)[len(sims) - k]) if len(sims) >= k else -1.0
        places, sims = within(bounds >= kth - 1e-9)
        if len(sims) > k:
            kth = float(np.partition(sims, len(sims) - k)[len(sims) - k])
            places, sims = places[sims >= kth - 1e-9], sims[sims >= kth - 1e-9]
        return places, sims

    def votes(self, ids: list[int], weights: list[float], rest: float, without: int | None = None) -> tuple[float, int | None, float]:
        """Share of toxic votes, and the nearest example with its similarity (of ties the smallest doc_id)."""
        if not self.n:
            return 0.0, None, 0.0
        if not ids and without is None and self.plain:  # texts without any term are all alike
            return self.plain
        places, sims = self.nearest(ids, weights, rest, without)
        if not len(places):
            return self.rate, None, 0.0
        power = np.maximum(sims, 0.0) ** self.s.power
        share = float((power @ self.labels[places] + self.rate) / (power.sum() + 1.0))
        best = float(sims.max())
        out = share, int(self.names[places[sims >= best - 1e-9]].min()), min(best, 1.0)
        if not ids and without is None:
            self.plain = out
        return out


def curve(shares: list[float], labels: list[int], s: Settings) -> list[tuple[float, float]]:
    """Knots (share of votes, score): pools of neighbouring examples, made to rise, the base rate as one example more in each."""
    if not shares:
        return []
    order = np.argsort(np.asarray(shares), kind="stable")
    x, y = np.asarray(shares, float)[order], np.asarray(labels, float)[order]
    rate = float(y.mean())
    pools: list[list[float]] = []  # number, sum of shares, sum of labels
    at = 0
    while at < len(x):
        to = min(len(x), at + s.pool)
        to = int(np.searchsorted(x, x[to - 1], "right"))  # equal shares stay together
        if len(x) - to < s.pool:
            to = len(x)
        pools.append([to - at, float(x[at:to].sum()), float(y[at:to].sum())])
        while len(pools) > 1 and (pools[-2][2] + rate) / (pools[-2][0] + 1) >= (pools[-1][2] + rate) / (pools[-1][0] + 1):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        at = to
    return [(total / n, (hits + rate) / (n + 1)) for n, total, hits in pools]


def calibrated(share: float, knots: list[tuple[float, float]]) -> float:
    """The score of a share of votes; a hundredth of the share keeps the order where the curve is flat."""
    if not knots:
        return share
    on_curve = float(np.interp(share, [k[0] for k in knots], [k[1] for k in knots]))
    return min(max(0.99 * on_curve + 0.01 * share, 0.0), 1.0)


@dataclass
class Model:
    vectors: Vectors
    index: Index
    knots: list[tuple[float, float]]

    def score(self, text: str) -> tuple[float, int | None, float]:
        share, name, similarity = self.index.votes(*self.vectors.of(text))
        return calibrated(share, self.knots), name, similarity


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """The vocabulary, the index of the sampled examples and the curve of scores; held-out rows take no part.

    Rows of ``docs`` and ``labels`` without doc_id teach nothing; without labels
    of both kinds there are no terms, and without any examples all scores are 0.
    """
    s = settings or Settings()
    ship(docs.sparkSession)
    return fit_sample(examples(docs, labels, s), s)


def fit_sample(sample: DataFrame, s: Settings) -> Model:
    """As ``fit``, from examples (doc_id, text, toxic) already drawn."""
    make = Vectors(vocabulary(sample, s), s.others)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make.of(t.as_py()) for t in batch.column(1)]
            ids, weights, rest = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64())), pa.array(rest, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "ids", "weights", "rest"])

    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").mapInArrow(frugal(vectors), "doc_id long, toxic int, ids array<int>, weights array<double>, rest double").orderBy("doc_id").collect()
    index = Index([(r["ids"], r["weights"], r["rest"]) for r in rows], [r["toxic"] for r in rows], [r["doc_id"] for r in rows], len(make.at), s)
    shares = [index.votes(r["ids"], r["weights"], r["rest"], r["doc_id"])[0] for r in rows]
    return Model(make, index, curve(shares, [r["toxic"] for r in rows], s))


def cross_validated(docs: DataFrame, labels: DataFrame, tried: list[Settings]) -> list[tuple[Settings, float, int]]:
    """Each of the settings with its mean log loss and its number of errors at 0.5 on training rows; the best one comes first.

    The sampled examples fall into four folds by their hash; each fold is scored
    by a model, terms and curve included, that has seen the three others only.
    Held-out rows take no part, so that figures on them stay untouched by the
    choice. All settings should have one ``max_examples``; without examples the
    loss is 0.
    """
    ship(docs.sparkSession)
    sample = examples(docs, labels, tried[0])
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    right = F.when(F.col("toxic") > 0, F.col("score")).otherwise(1 - F.col("score"))
    out = []
    for s in tried:
        loss, errors, n = 0.0, 0, 0
        for k in (1, 2, 3, 4):
            scored = score(sample.where(fold == k), fit_sample(sample.where(fold != k), s)).select("doc_id", "score").join(sample.select("doc_id", "toxic"), "doc_id")
            row = scored.agg(F.sum(-F.log(F.greatest(right, F.lit(1e-6)))), F.sum(((F.col("score") >= 0.5) != (F.col("toxic") > 0)).cast("int")), F.count(F.lit(1))).first()
            loss, errors, n = loss + (row[0] or 0.0), errors + (row[1] or 0), n + row[2]
        out.append((s, loss / max(n, 1), errors))
    return sorted(out, key=lambda x: x[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, nearest_doc and nearest_similarity of every row of ``docs``, by its text alone.

    Null and empty texts score like texts without any term of the vocabulary;
    repeated rows are scored each; of equally near examples the smallest doc_id
    is named; with no examples at all every score is 0.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.score(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.int64(), pa.float64()), strict=True))], names=["doc_id", "score", "nearest_doc", "nearest_similarity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(frugal(run), "doc_id long, score double, nearest_doc long, nearest_similarity double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) and the nearest example of every row; cases as in ``score``."""
    df = score(docs, fit(docs, labels))
    return df.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "nearest_doc", "nearest_similarity")


def keep_clean(docs: DataFrame, model: Model, reject_at: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``reject_at`` or more, in the columns they came in, whatever these are called.

    Null and empty texts stay (unless texts without any term are toxic as a
    rule); repeated rows stay or go together; an empty table stays empty.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [shared.value.score(t.as_py() or "")[0] < reject_at for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
