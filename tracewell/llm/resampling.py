"""Resampling of documents by importance: those whose words are likelier in the target (the benchmark) are drawn.

A text is translated by a table of 256 bytes, which lower-cases letters and
blanks what parts words, and is split at blanks; bytes beyond ASCII are parts
of words, so that no character needs decoding. A run of words is hashed by
going on with the CRC of the run before it. Tasks count buckets; the counts of
all tasks give each bucket a gain, a document's weight is the mean gain of its
features, and Gumbel noise from its doc_id turns the weights into a draw without
replacement.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import LOWER, UPPER, frugal, ship, stored
from tracewell.llm.ranking import numbered

#: Digits, letters and bytes beyond ASCII stay, capitals become small, all else parts words.
TABLE = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b >= 0x80 or chr(b) in LOWER or chr(b).isdigit() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TABLE).split()


def features(words: list[bytes], longest: int, buckets: int) -> list[int]:
    """The buckets of all runs of 1 to ``longest`` consecutive words, joined by a blank."""
    runs = list(map(crc32, words))
    out = [x % buckets for x in runs]
    spaced = [b" " + w for w in words]
    for n in range(1, longest):
        runs = list(map(crc32, spaced[n:], runs))  # the CRC of a run goes on from that of the run without its last word
        out += [x % buckets for x in runs]
    return out


def bucket_counts(docs: DataFrame, longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) over the texts of ``docs``; a task hands on one row for each bucket at most."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(features(words_of(text.as_py()), longest, buckets))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(counts.keys(), pa.int32()), "n": pa.array(counts.values(), pa.int64())})

    return docs.select("text").mapInArrow(frugal(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, scale: int = 1000) -> list[int]:
    """The gain of each bucket: how much likelier it is in ``target`` than in ``docs``, logarithm times ``scale``; as many as there are buckets."""
    sides = []
    for df in (docs, target):
        found = {r["bucket"]: r["n"] for r in bucket_counts(df, longest, buckets).collect()}  # a row for each bucket at most
        sides.append(([found.get(b, 0) for b in range(buckets)], sum(found.values())))
    (s, all_s), (t, all_t) = sides
    return [math.floor(scale * math.log((float(t[b] + 1) * (all_s + buckets)) / (float(s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]


def weighted(docs: DataFrame, gain: list[int], longest: int = 2) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of each row; without words the weight is 0."""
    ship(docs.sparkSession)
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = features(words, longest, buckets)
                rows.append((len(found), len(words), sum(map(gain.__getitem__, found)) // max(1, len(found))))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_features", "n_words", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, n_features long, n_words long, weight long")


def resampled(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7, scale: int = 1000) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank counts the drawn ones from 1, the others have none.

    ``share`` of every hundred documents with ``least_words`` words or more are
    drawn, those of the highest scores, ties to the smaller doc_id. Null texts
    have no words, and so no features, weight 0 and no place in the draw.
    Repeated rows are documents each and get consecutive ranks. Rows without
    doc_id take their noise from the word null and stand before other rows of
    their score. Further columns are left out; an empty target only changes the
    gains, and no documents give no rows.
    """
    rows = weighted(docs, gains(docs, target, longest, buckets, scale), longest)
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-scale * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    rows = stored(rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("may")), "weights")
    places = numbered(rows.where("may").withColumn("group", F.lit("")), "group", [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")])
    rank = F.when(F.col("_pos") < F.floor(share * F.col("_total") / 100), F.col("_pos") + 1)
    kept = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    return places.select(*kept, rank.cast("long").alias("rank")).unionByName(rows.where(~F.col("may")).select(*kept, F.lit(None).cast("long").alias("rank")))
