"""Benchmark decontamination by a generalised suffix automaton.

The automaton holds every run of consecutive words of the test items. Training
text streams through it word by word, and the length of the longest suffix
that some item holds tells which words lie in a window of the benchmark. Runs
of words that can't reach a window, as no short word sequence of them occurs in
any item, are skipped by a vectorised test first.

Items are read in blocks of a bounded number of words, a block an automaton
that is broadcast; further blocks take further passes over the same rows, with
no shuffle. Documents never leave their task.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from tracewell.llm.common import frugal, held, ship, text_of

#: Letters lower-cased, what parts words as spaces, the rest as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RUN = re.compile(rb"[^\x20]+")
SEED = 5


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences, with what ends where.

    ``window`` consecutive words of an item are a window, and so is a whole
    item of fewer. ``step`` lists give, for each state, transitions by word,
    the suffix link and the length of the longest sequence that leads there.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items_at: dict[tuple[int, int], set[str]] = {}
        self.sizes: set[int] = set()
        grams: dict[int, set[int]] = {}
        coded = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            coded.append((name, ids))
            last = 0
            for x in ids:
                last = self._extend(last, x)
        for name, ids in coded:  # windows are noted once all links are final
            size = min(window, len(ids))
            if not size:
                continue
            self.sizes.add(size)
            seed = min(SEED, size)
            codes = _codes(np.asarray(ids, np.int64), seed)
            grams.setdefault(seed, set()).update(codes.tolist())
            state = run = 0
            for x in ids:
                state, run = self._step(state, run, x)
                if run >= size:
                    self.items_at.setdefault((self._cut(state, size), size), set()).add(name)
        self.grams = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in grams.items()}

    def _extend(self, last: int, x: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if x in nxt[last]:
            q = nxt[last][x]
            return q if length[q] == length[last] + 1 else self._clone(last, x, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and x not in nxt[p]:
            nxt[p][x] = new
            p = link[p]
        if p != -1:
            q = nxt[p][x]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, x, q)
        return new

    def _clone(self, p: int, x: int, q: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = c
        while p != -1 and self.next[p].get(x) == q:
            self.next[p][x] = c
            p = self.link[p]
        return c

    def _step(self, state: int, run: int, x: int) -> tuple[int, int]:
        while state and x not in self.next[state]:
            state = self.link[state]
            run = self.length[state]
        if x in self.next[state]:
            return self.next[state][x], run + 1
        return 0, 0

    def _cut(self, state: int, size: int) -> int:
        """The state of the last ``size`` words."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words (end exclusive) inside windows, in order and apart, and the items whose windows occur."""
        n = len(words)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, n)
        inside = ids > 0
        if not inside.any():
            return [], set()
        live = np.zeros(n + 1, np.int32)
        for seed, known in self.grams.items():
            if n < seed:
                continue
            whole = inside[: n - seed + 1].copy()
            for k in range(1, seed):
                whole &= inside[k : n - seed + 1 + k]
            at = np.flatnonzero(whole)
            if len(at):
                codes = _codes(ids, seed)[at]
                where = np.searchsorted(known, codes)
                at = at[known[np.minimum(where, len(known) - 1)] == codes]
                live[at] += 1
                np.subtract.at(live, at + seed, 1)
        cover = np.cumsum(live[:-1]) > 0
        if not cover.any():
            return [], set()
        edge = np.flatnonzero(np.diff(np.concatenate(([0], cover.view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        smallest = min(self.sizes)
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < smallest:
                continue
            state = run = 0
            for i, x in enumerate(ids[a:b].tolist(), a):
                state, run = self._step(state, run, x)
                if run < smallest:
                    continue
                for size in self.sizes:
                    if run >= size and (names := self.items_at.get((self._cut(state, size), size))):
                        found |= names
                        spans.append((i + 1 - size, i + 1))
        return merged(spans), found


def _codes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the sequences of ``n`` ids that start at each place."""
    x = ids.astype(np.uint64)
    m = len(x) - n + 1
    out = np.zeros(max(0, m), np.uint64)
    for k in range(n):
        out = (out ^ x[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, window: int, words_a_block: int) -> Iterator[list[tuple[str, str]]]:
    """Items (id, text) in blocks of bounded size; the driver holds one block at a time.

    Items longer than a block are cut into pieces that overlap by less than a window.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), text_of().alias("text"))
    block: list[tuple[str, list[bytes]]] = []
    held = 0
    for r in rows.toLocalIterator():
        words = words_of(r["text"])
        for at in range(0, max(1, len(words) - window + 1), words_a_block):
            piece = words[at : at + words_a_block + window - 1]
            if held and held + len(piece) > words_a_block:
                yield block
                block, held = [], 0
            block.append((r["id"], piece))
            held += len(piece)
    if block:
        yield block


SPANS = ArrayType(StructType().add("from", IntegerType()).add("to", IntegerType()))


def match(docs: DataFrame, benchmark: DataFrame, window: int = 10, words_a_block: int = 100_000, names: tuple[str, str, str] = ("n_words", "spans", "items")) -> DataFrame:
    """``docs`` with the number of words, spans of words (end exclusive) and items (ids, sorted as strings), called ``names``.

    Null texts have no words. Repeated rows are matched each. Items without
    words match nothing; items without id are called "". Existing columns of
    those names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*names)
    schema = StructType([*docs.schema.fields]).add(names[0], LongType()).add(names[1], SPANS).add(names[2], ArrayType(StringType()))
    at = docs.columns.index("text")
    out = docs
    for k, block in enumerate(item_blocks(benchmark, window, words_a_block) or []):
        out = _pass(out, schema, at, spark.sparkContext.broadcast(block), window, first=k == 0)
    if out is docs:
        out = _pass(docs, schema, at, spark.sparkContext.broadcast([]), window, first=True)
    return out


def _pass(df: DataFrame, schema: StructType, at: int, items, window: int, first: bool) -> DataFrame:  # noqa: ANN001
    arrow, key = to_arrow_schema(schema), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held(key, lambda: Automaton(items.value, window))
        for batch in batches:
            n_words, spans, found = [], [], []
            before = [] if first else list(zip(batch.column(len(arrow) - 2).to_pylist(), batch.column(len(arrow) - 1).to_pylist(), strict=True))
            for i, text in enumerate(batch.column(at)):
                words = words_of(text.as_py() or "")
                got, names = automaton.scan(words)
                if before:
                    got = merged(got + [(x["from"], x["to"]) for x in before[i][0]])
                    names = names | set(before[i][1])
                n_words.append(len(words))
                spans.append([{"from": a, "to": b} for a, b in got])
                found.append(sorted(names))
            kept = batch.columns if first else batch.columns[: len(arrow) - 3]
            new = [pa.array(x, arrow.field(len(arrow) - 3 + k).type) for k, x in enumerate((n_words, spans, found))]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(kept, arrow, strict=False)), *new], schema=arrow)

    return df.mapInArrow(frugal(run, holds=True), schema)


def digest(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Counts and a checksum of the items for each document."""
    df = match(docs.select("doc_id", "text"), benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["to"] - s["from"])
    return df.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between the words of one span."""
    raw = text.encode("utf-8", "replace")
    places = [m.span() for m in RUN.finditer(raw.translate(FOLD))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8")


def _free(name: str, taken: set[str]) -> str:
    """``name``, made longer until no column has it."""
    while name in taken:
        name += "_"
    return name


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without benchmark passages, in the columns they came in, whatever these are called.

    Spans of hit words are cut out of the text; a document of which more than
    ``max_coverage`` of the words are hit is left out. Others stay as they are,
    null and empty texts too. n_chars, where there is one, follows the text.
    Repeated rows are treated alike; an empty table, or an empty benchmark,
    takes nothing away.
    """
    schema = docs.schema
    taken = {c.lower() for c in docs.columns}
    of, spans_name, items = (_free(x, taken) for x in ("_hit_of", "_hit_spans", "_hit_items"))
    hit = F.aggregate(spans_name, F.lit(0).cast("long"), lambda acc, s: acc + s["to"] - s["from"])
    df = match(docs, benchmark, window, names=(of, spans_name, items))
    df = df.where(hit <= max_coverage * F.greatest(F.col(of), F.lit(1)))
    arrow = to_arrow_schema(schema)
    at, spans_at = schema.names.index("text"), len(schema) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(spans_at).to_pylist()):
                if spans:
                    texts[i] = cut_spans(texts[i], [(s["from"], s["to"]) for s in spans])
            columns = [c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)]
            columns[at] = pa.array(texts, arrow.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    out = df.mapInArrow(frugal(run, holds=True), schema)  # in the stage that matches, whose automata stay
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out
