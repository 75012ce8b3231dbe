"""Repeated passages by suffix sorting: what a text shares with earlier text, byte by byte.

A byte goes if it lies in a string of ``length`` bytes that also starts
earlier: in a document of smaller doc_id, or earlier in the same one. So all
starts with equal next ``length`` bytes must meet, and all but the first go.
Sorting every suffix of the corpus would move each byte a hundred times over;
these steps leave only the suffixes that can have an equal:

1. Copies of whole documents are known by their hashes. Only the first of each
   goes on; the others are repeats as a whole.
2. Every start has an anchor, the place of the least hash of ``GRAM`` bytes
   among those inside its string (of equal ones the first). Equal strings have
   equal anchors at equal distances, so a start whose anchor's hash is found
   once only has no equal. Hashes meet in buckets as packed arrays.
3. The starts that share an anchor are consecutive. With the bytes that their
   strings cover they form a run. Sampled splitters range-partition the runs by
   the leading bytes at their anchors; equal leading bytes are never parted, so
   that no equal suffixes lie across a boundary.
4. Each bucket sorts the suffixes of its runs by multikey quicksort, eight
   bytes a key, going on only with those that are still tied; ties through
   ``length`` bytes are equal strings.
5. Suffixes with equal leading bytes stay in one bucket, however many they are.
   Where they are more than ``HOT`` (a passage in very many different
   surroundings), they are dealt by 128-bit hashes of their whole strings
   instead, and the first of each is a minimum that Spark adds up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import frugal, partitions, ship, stored, text_of

GRAM = 32
#: Anchors in a bucket, and suffixes that are sorted at once, about.
BUCKET, BATCH = 400_000, 200_000
#: Suffixes of equal leading bytes that one bucket may have to sort; sums by hash in which those that have more are sought.
HOT, SUMS = 2_000_000, 1 << 16
#: Longest part of a text whose anchors are sought at once; places fit in 24 bits.
PART = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM`` bytes from each place, by doubling."""
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    by = 1
    while by < GRAM:
        h = (h[:-by] * np.uint64(0xD6E8FEB86659FD93 + 2 * by)) ^ (h[by:] >> np.uint64(7)) ^ h[by:]
        by *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, with the first and last start that have it."""
    x = np.frombuffer(raw, np.uint8)
    out = []
    for at in range(0, max(1, len(x) - length + 1), PART):
        part = x[at : at + PART + length - 1]
        if len(part) < length:
            continue
        h = _gram_hashes(part)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width, by = length - GRAM + 1, 1
        while 2 * by <= width:
            low = np.minimum(low[:-by], low[by:])
            by *= 2
        if width > by:
            low = np.minimum(low[: len(low) - (width - by)], low[width - by :])
        place = (low & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:] - 1, [len(place) - 1]))
        out.append((h[place[first]], place[first] + at, first + at, last + at))
    if not out:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


PACKED = "bucket int, hash binary, doc binary, place binary, first binary, last binary"


def _packed(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket, with the columns' values as bytes; hash and doc have 8 each, the others 4."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, np.int64)
    ends = np.concatenate((cuts[1:], [len(bucket)])).astype(np.int64)
    data = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends, strict=False)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), *data], names=["bucket", "hash", "doc", "place", "first", "last"])


def _unpacked(batch: pa.RecordBatch, at: int) -> list[np.ndarray]:
    kinds = (np.uint64, np.int64, np.int32, np.int32, np.int32)
    return [np.frombuffer(b"".join(batch.column(at + i).to_pylist()), k) for i, k in enumerate(kinds)]


def shared_anchors(firsts: DataFrame, length: int, buckets: int, doc_buckets: int) -> DataFrame:
    """Packed anchors whose hash occurs twice or more, by a bucket of their document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[np.ndarray]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, place, first, last = anchors(text.as_buffer().to_pybytes(), length)
                held.append([h, np.full(len(h), doc, np.int64), place.astype(np.int32), first.astype(np.int32), last.astype(np.int32)])
            if held:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield _packed((columns[0] % np.uint64(buckets)).astype(np.int64), columns)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tracewell.llm.near_duplicates import grouped

        for groups in grouped(b.set_column(0, "bucket", b.column(0).cast(pa.int64())) for b in batches):
            for rows in groups:
                columns = _unpacked(rows, 1)
                order = np.argsort(columns[0], kind="stable")
                h = columns[0][order]
                same = h[1:] == h[:-1]
                again = np.concatenate(([False], same)) | np.concatenate((same, [False]))
                keep = order[again]
                if len(keep):
                    columns = [c[keep] for c in columns]
                    yield _packed(columns[1] % doc_buckets, columns)

    found = firsts.mapInArrow(frugal(find), PACKED)
    return found.repartition(min(buckets, 8 * partitions(firsts.sparkSession)), "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(meet), PACKED)


RUNS = "lead long, next long, doc long, first int, last int, lead_at int, bytes binary"


def runs(firsts: DataFrame, shared: DataFrame, length: int, doc_buckets: int) -> DataFrame:
    """Runs of starts with a shared anchor, with the bytes that their strings cover.

    Of runs of equal bytes in one bucket of documents only the first has its
    bytes; the others repeat it throughout, and as rows without bytes are dealt
    anywhere. So a passage that very many documents share, or a text that goes
    round in circles, sends few rows to the place where its suffixes are sorted.
    """
    blank = [F.lit(None).cast("binary").alias(c) for c in ("hash", "doc", "place", "first", "last")]
    texts = firsts.select(F.pmod("doc_id", F.lit(doc_buckets)).cast("int").alias("bucket"), F.lit(1).alias("kind"), "doc_id", "raw", *blank)
    marks = shared.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("raw"), "hash", "doc", "place", "first", "last")
    both = marks.union(texts).repartition(partitions(firsts.sparkSession), "bucket").sortWithinPartitions("bucket", "kind", "doc_id")

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["lead", "next", "doc", "first", "last", "lead_at", "bytes"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, sorted_, seen = None, [], None, set()
        for batch in batches:
            out: list[tuple] = []
            kinds, numbers = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                if numbers[i] != bucket:
                    bucket, parts, sorted_, seen = numbers[i], [], None, set()
                if kinds[i] == 0:
                    parts.append(_unpacked(batch.slice(i, 1), 4)[1:])
                    continue
                if not parts:
                    continue
                if sorted_ is None:
                    sorted_ = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    order = np.lexsort((sorted_[2], sorted_[0]))
                    sorted_ = [c[order] for c in sorted_]
                doc = batch.column(2)[i].as_py()
                a, b = np.searchsorted(sorted_[0], (doc, doc + 1))
                if a == b:
                    continue
                raw = batch.column(3)[i].as_py()
                for place, first, last in zip(*(c[a:b].tolist() for c in sorted_[1:]), strict=True):
                    covered = raw[first : last + length]
                    if covered in seen:
                        out.append((hash((doc, first)), 0, doc, first, last, place, None))
                        continue
                    seen.add(covered)
                    lead = int.from_bytes(raw[place : place + 8], "big") - 2**63
                    after = int.from_bytes(raw[place + 8 : place + 16], "big") - 2**63
                    out.append((lead, after, doc, first, last, place, covered))
                if len(out) >= 20_000:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    return both.mapInArrow(frugal(cut), RUNS)


def multikey_sort(keys: np.ndarray) -> np.ndarray:
    """Numbers of the classes of equal rows of ``keys`` (n, levels).

    A level's sort splits the groups that the levels before have left tied;
    rows that are alone in their group take no further part.
    """
    n, levels = keys.shape
    group = np.zeros(n, np.int64)
    live = np.arange(n)
    fresh = 1
    for level in range(levels):
        key = keys[live, level]
        order = np.lexsort((key, group[live]))
        live, key = live[order], key[order]
        g = group[live]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (key[1:] != key[:-1]))) if len(live) else np.empty(0, bool)
        number = np.cumsum(new) - 1
        group[live] = fresh + number
        fresh += len(live)
        tied = np.bincount(number)[number] > 1 if len(live) else new
        live = live[tied]
        if not len(live):
            break
    return group


def repeated(docs: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, payload: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(doc, from, to) of the bytes under starts whose string is found before, among the given runs."""
    out = [(int(docs[i]), int(firsts[i]), int(lasts[i]) + length) for i, p in enumerate(payload) if p is None]
    # runs of equal bytes: the first stands for all, the others repeat it throughout
    order = np.lexsort((firsts, docs))
    seen: set[bytes] = set()
    left: list[int] = []
    for i in order.tolist():
        if payload[i] is None:
            continue
        if payload[i] in seen:
            out.append((int(docs[i]), int(firsts[i]), int(lasts[i]) + length))
        else:
            seen.add(payload[i])
            left.append(i)
    if len(left) < 2:
        return out
    text = np.frombuffer(b"".join([*(payload[i] for i in left), bytes(8)]), np.uint8)
    size = np.array([len(payload[i]) for i in left])
    count = size - length + 1
    base = np.repeat(np.cumsum(size) - size, count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = base + step
    owner = np.repeat(np.arange(len(left)), count)  # runs in order of document and place: the first of a class is the earliest
    words = text[: len(text) - 7].astype(np.uint64)
    for k in range(1, 8):
        words = (words << np.uint64(8)) | text[k : len(text) - 7 + k]
    keys = np.empty((len(start), -(-length // 8)), np.uint64)
    for level in range(keys.shape[1]):
        at = 8 * level
        keys[:, level] = words[start + min(at, length - 8)]  # the last key overlaps the one before
    group = multikey_sort(keys)
    _, first = np.unique(group, return_index=True)
    again = np.ones(len(group), bool)
    again[first] = False
    places = np.flatnonzero(again)
    if len(places):
        doc, s = docs[left][owner[places]], firsts[left][owner[places]] + step[places]
        edge = np.flatnonzero(np.concatenate(([True], (owner[places][1:] != owner[places][:-1]) | (s[1:] != s[:-1] + 1))))
        end = np.concatenate((edge[1:] - 1, [len(places) - 1]))
        out += list(zip(doc[edge].tolist(), s[edge].tolist(), (s[end] + length).tolist(), strict=True))
    return out


def repeats(all_runs: DataFrame, length: int) -> DataFrame:
    """(doc, from, to): the bytes that repeat earlier ones, found bucket by bucket of the sorted suffixes."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            doc, first, last = (np.array(rows.column(i), np.int64) for i in (2, 3, 4))
            found = repeated(doc, first, last, rows.column(6).to_pylist(), length)
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "from", "to"])

        for batch in batches:
            lead, after = np.array(batch.column(0), np.int64), np.array(batch.column(1), np.int64)
            cuts = [0, *(np.flatnonzero((lead[1:] != lead[:-1]) | (after[1:] != after[:-1])) + 1).tolist(), batch.num_rows]
            sizes = np.cumsum(np.concatenate(([0], np.array(batch.column(4), np.int64) - np.array(batch.column(3), np.int64) + 1)))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and total >= BATCH and (lead[a], after[a]) != key:
                    yield flush(held)
                    held, total = [], 0
                held.append(batch.slice(a, b - a))
                key = (lead[a], after[a])
                total += int(sizes[b] - sizes[a])
        if held:
            yield flush(held)

    spread = all_runs.repartitionByRange(2 * partitions(all_runs.sparkSession), "lead", "next").sortWithinPartitions("lead", "next")
    return spread.mapInArrow(frugal(sort), "doc long, from long, to long")


def hot_leads(all_runs: DataFrame) -> DataFrame | None:
    """(lead, next) with more than ``HOT`` starts, or None if there are none.

    Sums over hashes of the leads, a bounded number, tell first whether any can
    have so many; only those of large sums are then counted one by one.
    """
    starts = F.sum((F.col("last") - F.col("first") + 1).cast("long")).alias("starts")
    kept = all_runs.where(F.col("bytes").isNotNull()).select("lead", "next", "first", "last", F.pmod(F.xxhash64("lead", "next"), F.lit(SUMS)).alias("sum_of"))
    large = [r["sum_of"] for r in kept.groupBy("sum_of").agg(starts).where(F.col("starts") > HOT).collect()]
    if not large:
        return None
    some = kept.join(F.broadcast(all_runs.sparkSession.createDataFrame([(x,) for x in large], "sum_of long")), "sum_of")
    hot = stored(some.groupBy("lead", "next").agg(starts).where(F.col("starts") > HOT).select("lead", "next"), "hot-leads")
    return hot if hot.limit(1).count() else None


def repeats_by_hash(hot_runs: DataFrame, length: int) -> DataFrame:
    """As ``repeats``, for runs with bytes: each start's string is hashed, and all starts but the least of a hash repeat it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                docs, starts, digests = [], [], []
                for doc, first, last, raw in zip(*(batch.column(i).slice(at, 2000).to_pylist() for i in (2, 3, 4, 6)), strict=True):
                    for k in range(last - first + 1):
                        docs.append(doc)
                        starts.append(first + k)
                        digests.append(xxhash.xxh3_128_digest(raw[k : k + length]))
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(docs, pa.int64()), pa.array(starts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["one", "two", "doc", "start"])

    starts = stored(hot_runs.mapInArrow(frugal(each), "one long, two long, doc long, start long"), "hot-starts")
    least = starts.groupBy("one", "two").agg(F.min(F.struct("doc", "start")).alias("least"))
    again = starts.join(least, ["one", "two"]).where(F.struct("doc", "start") != F.col("least"))
    return again.select("doc", F.col("start").alias("from"), (F.col("start") + length).alias("to"))


def deduplicate(docs: DataFrame, length: int = 100, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, with kept bytes if ``keep_text``.

    Null texts are empty. Texts shorter than ``length`` lose nothing. Rows
    without doc_id are neither searched nor changed. doc_id names the document:
    repeated rows are one document and get the same answer; that different
    texts come under one doc_id isn't meant, and what is found in any of them is
    then cut from each as far as it is long. An empty table gives no rows. Only
    doc_id and text are read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("raw"))
    keys = ["one", "two", "size"]
    signed = stored(rows.where(F.col("doc_id").isNotNull() & (F.length("raw") >= length)).select("doc_id", F.xxhash64("raw").alias("one"), F.xxhash64(F.lit(1), "raw").alias("two"), F.length("raw").alias("size")), "texts")
    first_of = signed.groupBy(*keys).agg(F.min("doc_id").alias("rep"))
    named = stored(signed.join(first_of, keys).select("doc_id", "size", (F.col("doc_id") == F.col("rep")).alias("is_first")).distinct(), "copies")
    whole = named.where(~F.col("is_first")).select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("from"), F.col("size").cast("long").alias("to"))
    total = named.where("is_first").agg(F.sum(F.col("size").cast("long")).alias("n")).first()["n"] or 0
    buckets = max(partitions(spark), total // (BUCKET * (length - GRAM + 2) // 2) + 1)
    copies = named.where(~F.col("is_first")).select("doc_id")
    firsts = rows.where(F.col("doc_id").isNotNull() & (F.length("raw") >= length)).join(copies, "doc_id", "left_anti")
    shared = stored(shared_anchors(firsts, length, buckets, 4 * buckets), "anchors")
    all_runs = stored(runs(firsts, shared, length, 4 * buckets), "runs")
    hot = hot_leads(all_runs)
    if hot is None:
        spans = repeats(all_runs, length).union(whole)
    else:  # at most one lead for every HOT starts: few enough to send
        marked = all_runs.join(F.broadcast(hot.withColumn("is_hot", F.lit(1))), ["lead", "next"], "left").select(*all_runs.columns, (F.col("is_hot").isNotNull() & F.col("bytes").isNotNull()).alias("is_hot"))
        spans = repeats(marked.where(~F.col("is_hot")).drop("is_hot"), length).union(repeats_by_hash(marked.where("is_hot").drop("is_hot"), length)).union(whole)
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    joined = rows.join(spans.withColumnRenamed("doc", "doc_id"), "doc_id", "left").select("doc_id", "raw", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, count, digest, left = [], [], [], [], []
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py()
                gone, last, at, kept = 0, -1, 0, []
                pieces = 0
                for s in sorted((x["from"], x["to"]) for x in batch.column(2)[i].as_py() or ()):
                    if s[0] > last:
                        pieces += 1
                        kept.append(raw[at : s[0]])
                        gone += s[1] - s[0]
                        last = at = s[1]
                    elif s[1] > last:
                        gone += s[1] - last
                        last = at = s[1]
                kept.append(raw[at:])
                joined_bytes = b"".join(kept)
                n.append(len(raw))
                removed.append(gone)
                count.append(pieces)
                digest.append(hashlib.sha256(joined_bytes).hexdigest())
                left.append(joined_bytes)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (n, removed, count)), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(left, pa.binary())] if keep_text else [])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    return joined.mapInArrow(frugal(cut), schema)
