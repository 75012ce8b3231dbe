"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import merkle, ranking, resampling, topk
from tracewell.llm.common import LOWER, UPPER

VECTORS = "vec_id long, embedding array<double>"


def plain_topk(rows, k=20, every=20):
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in usable if i is not None and i % every == 0}:
        scored = [(-sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v, w, strict=True)), i is None, i or 0) for i, w in usable if i != q and len(w) == len(v)]
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found_topk(spark, rows, **how):
    return sorted(map(tuple, topk.nearest(spark.createDataFrame(rows, VECTORS).withColumns({"query": F.lit(1), "score": F.lit("x"), "low": F.lit(None)}), **how).collect()), key=str)


@pytest.mark.parametrize("bits", [2, 10])
def test_topk_in_many_cells(spark, monkeypatch, bits):
    monkeypatch.setattr(topk, "QUERIES_A_CELL", 3)
    monkeypatch.setattr(topk, "CANDIDATES_A_CELL", 40)
    monkeypatch.setattr(topk, "BIN_BITS", bits)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(5)]) for i in range(200)]
    rows += [(i, [0.5, 0.25, -0.5, 0.0, 0.1]) for i in range(200, 300)]  # a vector that a third of all have
    assert found_topk(spark, rows, k=7) == plain_topk(rows, k=7)


def test_topk_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, -1.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (20, []), (6, [2.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (None, [0.5, 0.5]), (-20, [-1.0, 2.0])]
    assert found_topk(spark, rows, k=3) == plain_topk(rows, k=3)
    assert found_topk(spark, []) == []
    assert found_topk(spark, [(20, [1.0])]) == []  # no candidate


def test_topk_of_large_components(spark):
    rows = [(i, [x, 1.0, -3.5]) for i, x in enumerate([1e3, 2e5, 3e7, -4e7, 5.5, 0.0, 2e7])] + [(20, [1e7, -1.0, 0.25])]
    assert found_topk(spark, rows, k=4) == plain_topk(rows, k=4)
    beyond = found_topk(spark, [(0, [1e15]), (1, [1e15]), (2, [-1e15])])
    assert [r[2:] for r in beyond] == [(1, 2**63 - 1), (2, -(2**63))]


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(digests):
    """The levels of a tree and, for each leaf, the (left, right) siblings up to its top."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    paths = []
    for i in range(len(digests)):
        path = []
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            path.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            i //= 8
        paths.append(path)
    return levels[-1][0], paths


def plain_manifest(rows):
    def leaf(r, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    trees = {}
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        new = leaf(r, r[1] and r[1].translate(str.maketrans(UPPER, LOWER))) if changed else None
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), new))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {lang: plain_tree([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])]) for lang in order}
    root, above = plain_tree([own[lang][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for (named, doc, digest, new), path in zip(sorted(trees[lang], key=lambda x: x[:3]), own[lang][1], strict=True):
            end = merkle.folded(new or digest, path + above[k])
            out.append((doc if named else None, digest, own[lang][0], root, h("".join(a + b for a, b in path + above[k])), end, end == root, 0 if new is None else 1 + len(path + above[k])))
    return sorted(out, key=str)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"tree": F.lit("x"), "leaf": F.lit(1), "pos": F.lit(None), "_n": F.lit(2)})


def test_manifest_as_plain(spark, awkward):
    rows = [(i, f"Text {i}" if i % 5 else None, lang, "s", None if i % 7 else i) for lang, n in (("en", 700), ("de", 65), ("fr", 8), ("es", 1), (None, 9)) for i in range(n)]
    rows += [(i, t, "é", None, 3) for i, t in awkward] + [(4, "SAME", "", "s", 4)] * 20
    assert sorted(map(tuple, merkle.manifest(docs(spark, rows)).collect()), key=str) == plain_manifest(rows)
    assert merkle.manifest(docs(spark, [])).collect() == []


def test_manifest_over_several_passes(spark):
    rows = [(i, f"T{i}", "en" if i < 520 else f"lang{i:03d}", "s", 1) for i in range(600)]
    assert sorted(map(tuple, merkle.manifest(docs(spark, rows), 1).collect()), key=str) == plain_manifest(rows)
    rows = rows[:1]
    assert sorted(map(tuple, merkle.manifest(docs(spark, rows), 1).collect()), key=str) == plain_manifest(rows)


def test_versions_share_what_they_do_not_copy(spark):
    block = merkle.Block([h(str(i)) for i in range(100)], alone=True, height=3)
    version = block.version(37, h("new"))
    assert len(version.copied) == 4  # the leaf and its ancestors
    other = merkle.Block([h("new") if i == 37 else h(str(i)) for i in range(100)], alone=True, height=3)
    differing = [(k, i) for k, (a, b) in enumerate(zip(block.levels, other.levels, strict=True)) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y]
    assert differing == [(k, 37 // 8**k) for k in range(4)]
    assert [other.levels[k][i] for k, i in differing] == list(version.copied)
    rows = merkle.versions(docs(spark, [(i, f"T{i}", "en", "s", 1) for i in range(30)])).collect()
    changed = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 == 0]
    assert sorted((r["doc_id"], r["level"], r["index"]) for r in rows) == sorted((i, k, i // 8**k) for i in changed for k in range(3))


def plain_resampling(rows, target, share=25):
    def of(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
        return w, [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(of(text)[1])
    for text in target:
        t.update(of(text)[1])
    all_s, all_t, out = sum(s.values()), sum(t.values()), []
    for doc, text in rows:
        w, f = of(text)
        gain = [math.floor(1000 * math.log((t[x] + 1) * (all_s + 10_000) / ((s[x] + 1) * (all_t + 10_000)))) for x in f]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        u = (int(h(f"7:{'null' if doc is None else doc}")[:8], 16) + 0.5) / 4294967296
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, len(w) >= 20])
    may = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1], x[2]))
    for r, x in enumerate(may[: share * len(may) // 100], 1):
        x[4] = r
    return sorted((tuple(x[:5]) for x in out), key=str)


def test_resampling_as_plain(spark, docs_of, awkward):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)] + ["Éa", "straße", "ABC", "x_y", "don't"]
    rows = awkward + [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(100, 300)] + [(400, " ".join(words))] * 40
    target = [" ".join(rng.choices(words[:30], k=50)), None, ""]
    got = resampling.resampled(docs_of(rows, n_features="x", rank=1, group="g", may="m"), docs_of(target))
    assert sorted(map(tuple, got.collect()), key=str) == plain_resampling(rows, target)
    assert resampling.resampled(docs_of([]), docs_of(target)).collect() == []
    assert all(r["weight"] <= 0 for r in resampling.resampled(docs_of(rows[:3]), docs_of([])).collect())


def test_features_of_longer_runs():
    words = b"the cat sat on the mat".split()
    runs = [b" ".join(words[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(words) - n + 1)]
    assert sorted(resampling.features(words, 4, 997)) == sorted(zlib.crc32(x) % 997 for x in runs)
    assert resampling.features([], 3, 10) == [] and resampling.features([b"a"], 3, 10) == [zlib.crc32(b"a") % 10]


def test_numbered_whatever_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[int(g)], int(x), "t") for g, x in zip(rng.integers(0, 2, 300), rng.integers(0, 20, 300), strict=True)] + [("a", 7, "t")] * 2000
    got = ranking.numbered(spark.createDataFrame(rows, "g string, x int, t string"), "g", [F.desc("x")]).collect()
    for g in "ab":
        own = sorted((r["_pos"], r["x"]) for r in got if r["g"] == g)
        assert [p for p, _ in own] == list(range(len(own))) == list(range(sum(r[0] == g for r in rows)))
        assert [x for _, x in own] == sorted((r[1] for r in rows if r[0] == g), reverse=True)
        assert {r["_total"] for r in got if r["g"] == g} == {len(own)}
