"""Merges of overlapping texts and average linkage in rounds, against passes in order."""

import random

import numpy as np
import pytest

from tracewell.operators import similarity as sm


def words_of(t):
    return set((t or "").lower().split())


def near(a, b, t):
    small = min(len(a), len(b))
    return bool(small) and len(a & b) / small > t


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append((rng.randrange(2), i, rng.choice(["Aa", "b", "c", "d", "e"]) and " ".join(rng.choices("Aa b c d e f g h i j k l m".split(), k=rng.randrange(7)))))
    return [*out, (0, n, None), (0, n + 1, ""), (1, n + 2, "solo words here")] + [(2, i, "same same words") for i in range(9)] + [(3, i, "same same words") for i in range(15)]


@pytest.mark.parametrize("seed", range(3))
def test_merge_by_overlap_as_a_pass_in_order(spark, seed):
    rows = [(g, s, t, 0.5 + s % 4 / 8, [f"k{s % 5}"] if s % 2 else None) for g, s, t in texts(seed, 70)]
    want = []
    for g in range(4):
        own, kept = [r for r in sorted(rows) if r[0] == g], []
        for _, s, t, c, k in own:
            other = next((x for x in kept if near(words_of(t), words_of(x[1]), 0.5)), None) if len(own) >= 11 else None
            if other:
                other[2], other[3], other[4] = min(1.0, other[2] + 0.1), other[3] + 1, other[4] | set(k or [])
            else:
                kept.append([s, t, c, 1, set(k or [])])
        want += [(g, s, t, c, n, sorted(k)) for s, t, c, n, k in kept]
    got = sm.merge_by_overlap(spark.createDataFrame(rows, "group int, seq long, text string, confidence double, keywords array<string>"))
    assert sorted((r["group"], r["seq"], r["text"], r["confidence"], r["observations"], r["keywords"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_consolidate_as_a_pass_in_order(spark, seed):
    rows = [(g, s % 2, s, t, (s * 7 % 5) / 5, 1 + s % 3) for g, s, t in texts(seed, 70)]
    want = []
    for g, kind in {r[:2] for r in rows}:
        kept = []
        for r in sorted(r for r in rows if r[:2] == (g, kind)):
            other = next((x for x in kept if near(words_of(r[3]), words_of(x[0][3]), 0.4)), None)
            if other:
                other[1] += r[5]
                if r[4] > other[0][4]:
                    other[0] = r
            else:
                kept.append([r, r[5]])
        want += [(*r[:5], n) for r, n in kept]
    got = sm.consolidate(spark.createDataFrame(rows, "group int, type int, seq long, text string, confidence double, observations int"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_overlapping_finds_all_pairs(spark):
    rng = random.Random(8)
    sets = [(i % 2, i, sorted(set(rng.choices("abcdefghijklmnop", k=rng.randrange(9))))) for i in range(120)]
    df = spark.createDataFrame(sets, "g int, seq long, words array<string>")
    for t in (0.3, 0.5, 0.75, 0.99):
        want = {(g, i, j) for g, i, a in sets for h, j, b in sets if g == h and i < j and near(set(a), set(b), t)}
        assert {tuple(r) for r in sm.overlapping(df, ["g"], t).collect()} == want


def plain_linkage(v, least):
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    sims, members = v @ v.T, {i: [i] for i in range(len(v))}
    while len(members) > 1:
        best = max(((np.mean(sims[np.ix_(members[a], members[b])]), -a, -b) for a in members for b in members if a < b))
        if best[0] < least:
            break
        members[-best[1]] += members.pop(-best[2])
    order = sorted(members.values(), key=lambda x: (-len(x), min(x)))
    return {i: c for c, x in enumerate(order) for i in x}


def test_linkage_in_rounds_as_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.concatenate([c + rng.normal(0, s, (n, 6)) for c, s, n in zip(rng.normal(0, 1, (5, 6)), (0.2, 0.5, 0.8, 0.1, 1.5), (20, 25, 10, 8, 12), strict=True)] + [np.zeros((2, 6))])
    df = spark.createDataFrame([(g, i, [float(x) for x in row]) for g in (7, 8) for i, row in enumerate(v if g == 7 else -v[:30])], "group int, id long, vector array<double>")
    monkeypatch.setattr(sm, "BLOCK", 16)
    got = {(r["group"], r["id"]): r["cluster"] for r in sm.linkage_clusters(df, 0.6).collect()}
    want = {(7, i): c for i, c in plain_linkage(v, 0.6).items()} | {(8, i): c for i, c in plain_linkage(-v[:30], 0.6).items()}
    assert got == want and len(set(got.values())) > 3
    assert sm.linkage_clusters(df.limit(0)).collect() == []


@pytest.mark.parametrize("most", [1, 40])
def test_consolidate_alone_or_by_links(spark, monkeypatch, most):
    """Small groups are read as they are, without a look for links; the rows are those of the way by links."""
    rows = [(g, s % 2, s, t, 0.5 + s % 4 / 8, 1) for g, s, t in texts(7, 150)]
    entries = spark.createDataFrame(rows, "group int, type int, seq long, text string, confidence double, observations int")
    by_links = sorted(sm.consolidate(entries, alone=most).collect(), key=str)
    monkeypatch.setattr(sm, "linked", None)
    assert sorted(sm.consolidate(entries).collect(), key=str) == by_links


def test_groups_go_on_from_one_batch_to_the_next(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(i % 5 if i % 5 else None, i) for i in range(40)], "group int, id int")
        sizes = sm._grouped(df, ["group"], lambda r: r.assign(n=len(r))[["id", "n"]].head(1), "id int, n int")
        assert sorted(r.n for r in sizes.collect()) == [8] * 5
        with pytest.raises(Exception, match="over 7 rows"):
            sm._grouped(df, ["group"], lambda r: r, "group int, id int", most=7).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def plain_leaders(v, least):
    sums, out = [], []
    for x in v:
        x = x / (np.linalg.norm(x) or 1.0)
        likes = [float(s / np.linalg.norm(s) @ x) if s.any() else 0.0 for s in sums]
        best = int(np.argmax(likes)) if likes else -1
        if best < 0 or likes[best] < least:
            sums.append(x.copy())
            best = len(sums) - 1
        else:
            sums[best] += x
        out.append(best)
    return out


def test_leaders_of_a_large_group_as_one_by_one(spark, monkeypatch):
    """Over 20,000 vectors in one group; blocks in which clusters open, move and meet equal vectors."""
    rng = np.random.default_rng(4)
    kept = [*rng.normal(0, 1, (700, 6)), *np.zeros((2, 6))]
    v = np.array([kept[i] for i in rng.integers(0, len(kept), 1500)])
    many = rng.normal(0, 1, (20_001, 2))
    rows = [(g, i, x.tolist()) for g, own in (("a", v), ("b", many)) for i, x in enumerate(own)]
    got = {(r["group"], r["id"]): r["cluster"] for r in sm.leader_clusters(spark.createDataFrame(rows, "group string, id int, vector array<double>")).collect()}
    assert [got["a", i] for i in range(len(v))] == plain_leaders(v, 0.7)
    assert [got["b", i] for i in range(len(many))] == plain_leaders(many, 0.7)


@pytest.mark.parametrize("most", [0, 9, 20_000])
def test_linkage_of_components_and_of_copies(spark, monkeypatch, most):
    """Copies are one cluster at once (one pair a round would take a minute a dozen); components in a task or by rounds give the plain loop's clusters."""
    rng = np.random.default_rng(6)
    v = np.concatenate([c + rng.normal(0, s, (n, 6)) for c, s, n in zip(rng.normal(0, 1, (6, 6)), (0.2, 0.5, 0.8, 0.1, 0.3, 1.5), (9, 15, 8, 6, 5, 10), strict=True)] + [np.zeros((2, 6))])
    v = np.concatenate([v, np.repeat(v[[3, 20, 50]], 13, axis=0) * rng.integers(1, 9, (39, 1))])
    rows = [(g, i, [float(x) for x in row]) for g in (7, 8) for i, row in enumerate(v if g == 7 else -v[:30])]
    monkeypatch.setattr(sm, "LINKED", most)
    monkeypatch.setattr(sm, "TILE", 40)
    got = {(r["group"], r["id"]): r["cluster"] for r in sm.linkage_clusters(spark.createDataFrame(rows, "group int, id long, vector array<double>"), 0.6).collect()}
    assert got == {(7, i): c for i, c in plain_linkage(v, 0.6).items()} | {(8, i): c for i, c in plain_linkage(-v[:30], 0.6).items()}


@pytest.mark.parametrize("most", [1, 40])
def test_merge_by_overlap_alone_or_by_links(spark, monkeypatch, most):
    """Small groups are read in order without a look for links; the rows are those of the way by links."""
    rows = [(g, s, t, 0.5 + s % 4 / 8, [f"k{s % 5}"]) for g, s, t in texts(7, 150)]
    entries = spark.createDataFrame(rows, "group int, seq long, text string, confidence double, keywords array<string>")
    by_links = sorted(sm.merge_by_overlap(entries, alone=most).collect(), key=str)
    monkeypatch.setattr(sm, "first_kept", None)
    assert sorted(sm.merge_by_overlap(entries).collect(), key=str) == by_links


def test_neighbours_of_many_small_groups(spark, monkeypatch):
    """Groups that are read many at once have the rows that tiles give."""
    rng = np.random.default_rng(2)
    rows = [(i % 9, i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "group int, id long, vector array<float>")
    small = sorted(map(tuple, sm.neighbours(df, 3, 0.2).collect()))
    monkeypatch.setattr(sm, "ALONE", 16)
    assert [(*r[:3], round(r[3], 9), r[4]) for r in sorted(map(tuple, sm.neighbours(df, 3, 0.2).collect()))] == [(*r[:3], round(r[3], 9), r[4]) for r in small] and small
