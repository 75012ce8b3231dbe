"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Only piece lengths matter to a packing, and there are at most ``capacity`` of
them. So Spark counts the lengths, the plan is made over that bounded
histogram (sets of lengths with a number of times each, never documents), and
Spark deals the pieces to the plan's places by their rank within their length.

The plan first applies Martello and Toth's dominance reduction: a set of
pieces is fixed for good when every other set for its largest piece could be
exchanged for it without needing more sequences. What remains is packed by
best fit in decreasing order of length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from tracewell.llm.common import frugal, held, ship, stored, text_of
from tracewell.llm.sharding import number

#: Fixed value: how byte-level BPE vocabularies of this kind part text.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer's pre-tokenizer starts a new part at every single space that
    stands between non-spaces, so that texts are encoded part by part there and
    frequent parts come from a bounded memory of earlier ones. Parts that are
    new go through a faster engine over the same vocabulary where its merges
    are in the order of their ids; the tests hold it against the tokenizer.
    """

    def __init__(self, path: str, most: int = 250_000, longest: int = 48):
        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.known: dict[str, bytes] = {}
        self.odd = re.compile(r"\s \s|^ | $")
        self.between = re.compile(r"(?<=\S) (?=\S)")
        model = json.loads(self.tokenizer.to_str())
        self.special = [x["content"] for x in model.get("added_tokens", [])]
        self.fast = self._engine(model)

    @staticmethod
    def _engine(model: dict) -> tiktoken.Encoding | None:
        vocab, merges = model["model"]["vocab"], model["model"].get("merges", [])
        pre = model.get("pre_tokenizer") or {}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("normalizer")
        if not plain or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        # the byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if i < 256 + len(pairs)}
        return tiktoken.Encoding("parts", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _fresh(self, part: str) -> bytes:
        if self.fast and not any(x in part for x in self.special):
            ids = self.fast.encode_ordinary(part)
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        parts = self.between.split(text) if self.odd.search(text) else text.split(" ")
        known, first = self.known, self._fresh(parts[0])
        del parts[0]
        try:
            return first + b"".join([known[x] for x in parts])
        except KeyError:
            pass
        if len(known) > self.most:
            known.clear()
        out = [first]
        for x in parts:
            ids = known.get(x)
            if ids is None:
                ids = self._fresh(f" {x}")
                if len(x) <= self.longest:
                    known[x] = ids
            out.append(ids)
        return b"".join(out)


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece: documents' ids and ``end_id``, cut every ``capacity`` from the end; only the first piece may be shorter."""
    ship(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = held(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + end
                n = len(ids) // 4
                start, stop = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    rows.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start, stop = stop, stop + capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(frugal(run, holds=True), PIECES)


Pattern = tuple[tuple[int, ...], int]


def reduce_by_dominance(counts: Counter, capacity: int) -> list[Pattern]:
    """Sets that can be fixed without loss, with how often; their pieces are taken out of ``counts``.

    For a piece of length w these sets dominate all others that hold it:
    itself alone if nothing else fits beside it; itself with a piece that fills
    the sequence exactly; itself with the longest piece that fits, if no two
    pieces fit beside it together.
    """
    fixed: list[Pattern] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for x in lengths:
            counts[x] -= times
            if not counts[x]:
                del counts[x]
                have.pop(bisect_left(have, x))

    have = sorted(counts)
    for w in sorted(counts, reverse=True):
        while counts.get(w):
            room, n = capacity - w, counts[w]
            if room in counts and (room != w or n > 1):
                take((w, room), n // 2 if room == w else min(n, counts[room]))
                continue
            others = [x for x in have[:3] for _ in range(min(2, counts[x] - (x == w)))][:2]
            if not others or others[0] > room:
                take((w,), n if others or n == 1 or 2 * w > capacity else 1)
                continue
            if len(others) == 2 and sum(others) <= room:
                break
            k = bisect_left(have, room + 1) - 1
            best = have[k] if have[k] != w or n > 1 else have[k - 1]
            if best == w:
                take((w, w), n // 2)
            else:
                take((w, best), min(n, counts[best]) if len(others) == 2 else 1)
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[Pattern]:
    """Best fit in decreasing length over a histogram: equal sequences are kept as one pattern with a number of times."""
    bins: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append(pattern)

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                items, times = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                room, items, times = capacity, (), n
            each = room // w  # the copy after one that was put here finds its room least again
            full = min(times, n // each)
            used = full
            if full:
                put(room - each * w, (items + (w,) * each, full))
                n -= full * each
            if used < times and 0 < n < each:
                put(room - n * w, (items + (w,) * n, 1))
                n, used = 0, used + 1
            if used < times and items:
                put(room, (items, times - used))
    return [p for ps in bins.values() for p in ps]


def plan(counts: Counter, capacity: int) -> list[Pattern]:
    counts = Counter(counts)
    return reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first rank, offset) for each place of each pattern."""
    rank: Counter = Counter()
    out, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            out.append((x, rank[x], rank[x] + times, sequence - rank[x], offset))
            rank[x] += times
            offset += x
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset.

    What reaches the driver is the histogram, at most ``capacity`` rows, and
    the plan's places are broadcast; their number depends on the lengths that
    occur and not on how many documents have them.
    """
    spark = pieces.sparkSession
    counts = Counter({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()})
    rows = places(plan(counts, capacity))
    table = spark.createDataFrame(rows, "length long, _from long, _to long, _base long, offset long")
    # the pieces of long documents nearly all have the full length: the more of them, the more blocks
    ranked = number(pieces, "length", "doc_id", ["piece", "start"], out="_rank", blocks=max(64, max(counts.values(), default=0) // 50_000))
    fits = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    out = ranked.alias("p").join(F.broadcast(table).alias("t"), (F.col("p.length") == F.col("t.length")) & fits)
    return out.select("p.*", (F.col("_base") + F.col("_rank")).alias("sequence_id"), "offset").drop("_rank")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    Empty and null texts give one piece of the end id alone; repeated rows are
    packed each; an empty table gives no rows. Only doc_id and text are read.
    """
    pieces = stored(cut(docs, tokenizer, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
