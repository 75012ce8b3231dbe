"""Hand-made cases: ties, guards, boundaries and odd names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.functions import paths as pa
from tracewell.operators import evaluation as ev
from tracewell.operators import features as ft
from tracewell.operators import parsing as ps
from tracewell.operators import profiles as pf
from tracewell.operators import rendering as rd
from tracewell.operators import sequences as sq
from tracewell.operators import similarity as sm
from tracewell.config import FINGERPRINT
from tracewell.streaming import live


def column(spark, values, f, kind="string"):
    return [r.y for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x")).alias("y")).collect()]


def test_paths(spark):
    names = ["/a/2024-01-02_report.md", "/a/.env", "noext", "a.tar.gz", "/x/图.png"]
    assert column(spark, names, pa.extension) == ["md", "unknown", "unknown", "gz", "png"]
    assert column(spark, names, pa.stem) == ["2024-01-02_report", ".env", "noext", "a.tar", "图"]
    assert column(spark, ["/sandbox/x/d/f.md", "/sandbox/x/", "/etc/passwd", "?", ""], pa.anonymised) == ["d/f.md", ".", "passwd", "?", ""]
    assert column(spark, ["/b/c/d.md", "/else/x.md"], lambda x: pa.depth_below(x, F.lit("/b"))) == [1, 2]
    assert column(spark, ["a图", "abc"], pa.has_cjk) == [True, False]
    assert column(spark, [".x", "a.sb-1", "~a", "a~", "b.pyc", "ok.md"], pa.ignored) == [True, True, True, True, True, False]
    assert column(spark, ["~x", "Untitled 1", "a.tmp", "a.md"], pa.looks_temporary) == [True, True, True, False]


@pytest.mark.parametrize(("old", "new", "kind"), [("a.md", "a.txt", "extension_change"), ("r.md", "2024-01_r.md", "added_date_prefix"), ("2024-01_r.md", "r.md", "removed_date_prefix"), ("A.md", "a.md", "case_change"), ("a_b.md", "a-b.md", "snake_to_kebab"), ("a-b.md", "a_b.md", "kebab_to_snake"), ("x.md", "y.md", "other")])
def test_rename_class(spark, old, new, kind):
    assert spark.range(1).select(pa.rename_class(F.lit(old), F.lit(new)).alias("k")).first().k == kind


TRACE = "profile_id int, task_id int, seq int, event_type string, file_path string, ts_ms long, event_id long"


def trace(spark, kinds, path="/f", task=0):
    return spark.createDataFrame([(1, task, i, k, path, i * 1000, i) for i, k in enumerate(kinds)], TRACE)


def test_ties_go_to_the_first_seen(spark):
    df = trace(spark, ["file_read", "file_edit", "file_read", "file_search", "file_edit"])
    r = sq.dominant_transition(df).first()
    assert (r.from_type, r.to_type, r.n) == ("file_read", "file_edit", 1)
    blocks = trace(spark, ["file_edit", "file_read", "file_write", "file_browse", "session_x"] + ["context_switch"] * 5)
    assert [(r.phase, r.events) for r in sq.phases(blocks).orderBy("phase_no").collect()] == [("production", 5), ("other", 5)]


def test_transitions_like_a_plain_loop(spark):
    rng = random.Random(7)
    kinds = ["file_read", "file_edit", "file_write", "dir_create"]
    rows, expected = [], Counter()
    for task in range(20):
        seq = [rng.choice(kinds) for _ in range(rng.randint(0, 30))]
        rows += [(1, task, i, k, "/f", i, i) for i, k in enumerate(seq)]
        expected.update(zip(seq, seq[1:], strict=False))
    got = {(r.from_type, r.to_type): r.n for r in sq.transition_counts(spark.createDataFrame(rows, TRACE)).collect()}
    assert got == dict(expected)


def test_short_segments_join_the_one_before(spark):
    df = trace(spark, ["a", "B", "x", "B", "x", "x", "B"])
    out = sq.segments(df, F.col("event_type") == "B").orderBy("seq").collect()
    assert [r.segment for r in out] == [0, 0, 0, 1, 1, 1, 1]


def test_deviation_guards(spark):
    base = {c: 0.0 for c in FINGERPRINT}
    rows = [(1, t, *({**base, "total_edits": v}[c] for c in FINGERPRINT)) for t, v in enumerate([1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 50.0])] + [(2, t, *base.values()) for t in range(2)]
    df = spark.createDataFrame(rows, "profile_id int, task_id int, " + ", ".join(f"{c} double" for c in FINGERPRINT))
    out = pf.deviations(pf.z_scores(df))
    assert [(r.profile_id, r.task_id) for r in out.where("is_deviant").collect()] == [(1, 7)]
    assert pf.shifted_dimensions(out).orderBy("rank").first().feature == "total_edits"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "profile_id int, task_id int, seq int, event_type string, file_path string, file_type string, operation string, content string, ts_ms long, content_length long, lines_added int, lines_deleted int, depth int, is_backup boolean, view_count int")
    assert ft.trajectory_features(empty).count() == 0
    assert sq.phases(empty).count() == 0


def test_agreement(spark):
    pairs = spark.createDataFrame([("L", "L"), ("M", "M"), ("R", "L"), ("L", "M")], "one string, two string")
    assert ev.cohens_kappa(pairs, list("LMR")).first().kappa == pytest.approx(0.2)
    same = spark.createDataFrame([("L", "L")], "one string, two string")
    assert ev.cohens_kappa(same, list("LMR")).first().kappa == 1.0
    votes = spark.createDataFrame([(1, "b", "M"), (1, "a", "L"), (2, "a", "R"), (2, "b", "R")], "item int, rater string, label string")
    assert {(r.item, r.label) for r in ev.majority(votes).collect()} == {(1, "L"), (2, "R")}
    assert column(spark, [" l ", "x", None], ev.valid_tier) == ["L", "?", "?"]


def test_replies(spark):
    replies = ['```json\n{"score": 4,}\n```', 'text {"score": 3, "why": "a"} more', '{"score": 2, "why": "cut']
    df = spark.createDataFrame([(r,) for r in replies], "x string")
    fields = ps.parsed(F.col("x"), "score int, why string")
    assert [r.s for r in df.select(fields["score"].alias("s")).collect()] == ["4", "3", "2"]


def test_shell(spark):
    df = spark.createDataFrame([("mkdir -p 'a b' c && mv x/a.md x/b.md; cp a.md a.bak || rm -rf t.tmp 'q;z'",), ("ls",)], "command string")
    rows = ps.shell_events(df, folder="/w").select("event_type", "file_path", "source_file", "target_file", "was_temporary", "is_backup").collect()
    assert [r.event_type for r in rows] == ["dir_create", "dir_create", "file_rename", "file_copy", "file_delete", "file_delete", "file_browse"]
    assert (rows[0].file_path, rows[2].target_file, rows[3].is_backup, rows[4].was_temporary, rows[5].file_path) == ("/w/a b", "/w/x/b.md", True, True, "/w/q;z")


def test_diffs(spark):
    rows = [(1, 0, 0, "/f", "a\nb"), (1, 0, 1, "/f", "a\nc\nd"), (1, 0, 2, "/f", "a\nc\nd")]
    out = ps.diffs(spark.createDataFrame(rows, "profile_id int, task_id int, seq int, file_path string, content string")).orderBy("seq").collect()
    assert (out[0].is_create, out[0].diff) == (True, None)
    assert (out[1].lines_added, out[1].lines_deleted, out[1].lines_modified) == (1, 0, 1)
    assert out[2].lines_added is None


def test_clusters(spark):
    rows = [("g", i, v) for i, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9], [0.0, 0.0]])]
    df = spark.createDataFrame(rows, "group string, id int, vector array<double>")
    for f in (sm.leader_clusters, sm.linkage_clusters):
        got = {r.id: r.cluster for r in f(df).collect()}
        assert got[0] == got[1] != got[2] == got[3]
    assert len({r.cluster for r in sm.centroid_clusters(df, 2).collect()}) == 2
    assert {(r.id, r.other) for r in sm.neighbours(df).collect()} == {(0, 1), (1, 0), (2, 3), (3, 2)}


def test_merges(spark):
    rows = [("g", i, t, 0.5) for i, t in enumerate(["a b c d"] * 2 + [f"x{i} y{i}" for i in range(10)])]
    df = spark.createDataFrame(rows, "group string, seq long, text string, confidence double")
    assert sm.merge_by_overlap(df).where("observations = 2").count() == 1
    assert sm.merge_by_overlap(df.limit(5)).count() == 5
    typed = spark.createDataFrame([("g", "t", 1, "a b c", 0.2), ("g", "t", 2, "a b c d", 0.9)], "group string, type string, seq long, text string, confidence double")
    assert [r.confidence for r in sm.consolidate(typed).collect()] == [0.9]


def test_truncation_and_lines(spark):
    assert column(spark, ["abcdef"], lambda x: rd.truncated(x, 3)) == ["abc\n... [truncated, 6 chars total]"]
    df = trace(spark, ["file_delete", "strange"], "/sandbox/u/a.md")
    lines = [r.line for r in rd.narrative_lines(df).orderBy("seq").collect()]
    assert lines[0] == "[1] Delete file: a.md"
    assert lines[1].startswith("[2] strange: {")


def test_atomic_saves(spark):
    rows = [("file_rename", "/a.sb-1", "/a.md", "/a.sb-1"), ("file_rename", "/a.md", "/a.md.sb-2", "/a.md"), ("file_rename", "/a.md", "/b.md", "/a.md")]
    df = spark.createDataFrame(rows, "event_type string, source_file string, target_file string, file_path string")
    assert [(r.event_type, r.file_path) for r in live.collapsed_saves(df).collect()] == [("file_edit", "/a.md"), ("file_rename", "/a.md")]


@pytest.mark.parametrize(("gap", "bursts"), [(1999, 1), (2000, 2), (2001, 2)])
def test_debounce_boundary(spark, gap, bursts):
    df = live.with_event_time(spark.createDataFrame([("/f", 10_000), ("/f", 10_000 + gap)], "file_path string, ts_ms long"))
    assert live.debounced(df, ["file_path"]).count() == bursts


def test_methods_ask_their_model(spark, sf):
    """What a model says becomes the memory; batches and windows hold every event."""
    from tracewell.plans import methods
    from tracewell.plans.text_queries import _view

    trace = _view(spark, sf)

    def model(prompts):
        return [f"said {p.count(chr(10))}" for p in prompts]

    events = {r.profile_id: r["count"] for r in trace.where("event_type <> 'error_encounter'").groupBy("profile_id").count().collect()}
    for name in ("memos", "memu", "simplemem", "evermemos"):
        rows = methods.METHODS[name](trace, model=model).collect()
        assert len(rows) == len({r.profile_id for r in rows}) == len(events)
        assert all("said " in r.prompt for r in rows)
    said = {r.profile_id: r.prompt.split("\n") for r in methods.METHODS["memu"](trace, batch=5, model=model).collect()}
    assert {p: sum(int(x.split()[1]) for x in lines) for p, lines in said.items()} == events


def test_merging_unites_lists(spark):
    rows = [("g", i, f"word{i} other{i}", 0.8, [f"k{i}"], ["e"]) for i in range(11)] + [("g", 11, "word0 other0 more", 0.8, ["z"], ["f"])]
    df = spark.createDataFrame(rows, "group string, seq int, text string, confidence double, keywords array<string>, entities array<string>")
    first = sm.merge_by_overlap(df).where("seq = 0").collect()[0]
    assert (first.observations, first.keywords, first.entities, round(first.confidence, 6)) == (2, ["k0", "z"], ["e", "f"], 0.9)


def test_clusters_and_samples_as_plain_loops(spark):
    """Leader, centroid and average-linkage clusters and the sampler against versions written out in plain Python."""
    import numpy as np

    rng = np.random.default_rng(5)
    vectors = {(g, i): rng.normal(size=6) + 3 * np.eye(6)[i % 3] for g in "ab" for i in range(14)}
    df = spark.createDataFrame([(g, i, v.tolist()) for (g, i), v in vectors.items()], "group string, id int, vector array<double>")
    unit = lambda v: v / np.linalg.norm(v)
    got = {f.__name__: {(r.group, r.id): r.cluster for r in f(df).collect()} for f in (sm.leader_clusters, sm.centroid_clusters, sm.linkage_clusters)}
    for g in "ab":
        own = [vectors[g, i] for i in range(14)]
        totals, leaders = [], []
        for v in map(unit, own):
            likes = [(unit(t) @ v, -c) for c, t in enumerate(totals)]
            if likes and max(likes)[0] >= 0.7:
                c = -max(likes)[1]
                totals[c] = totals[c] + v
            else:
                c = len(totals)
                totals.append(v)
            leaders.append(c)
        assert [got["leader_clusters"][g, i] for i in range(14)] == leaders

        def merged(distance, stop, own=own):
            sets = [[i] for i in range(len(own))]
            while len(sets) > 1:
                d, x, y = min((distance(sets[x], sets[y]), x, y) for x in range(len(sets)) for y in range(x + 1, len(sets)))
                if stop(d, len(sets)):
                    break
                sets[x] = sets[x] + sets.pop(y)
            sets.sort(key=lambda s: (-len(s), min(s)))
            return [next(c for c, s in enumerate(sets) if i in s) for i in range(len(own))]

        between = lambda a, b, own=own: np.linalg.norm(np.mean([own[i] for i in a], axis=0) - np.mean([own[i] for i in b], axis=0))
        unlike = lambda a, b, own=own: -np.mean([unit(own[i]) @ unit(own[j]) for i in a for j in b])
        assert [got["centroid_clusters"][g, i] for i in range(14)] == merged(between, lambda d, n: n <= 3)
        assert [got["linkage_clusters"][g, i] for i in range(14)] == merged(unlike, lambda d, n: -d < 0.6)

    kinds, types = ["create", "major_edit", "minor_edit"], ["md", "csv", "json"]
    files = [("g", int(rng.integers(3)), kinds[rng.integers(3)], types[rng.integers(3)], "x" * int(rng.integers(1, 900)), float(rng.integers(1, 4))) for _ in range(40)]
    rows = sm.sample_contents(spark.createDataFrame(files, "group string, task_id int, kind string, file_type string, content string, importance double"), budget=2000).collect()
    weight = {t: max(f[5] for f in files if f[1] == t) for t in {f[1] for f in files}}
    share = {t: max(200, int(2000 * w / sum(weight.values()))) for t, w in weight.items()}
    scale, seen, plain = min(1.0, 2000 / sum(share.values())), set(), []
    for t in sorted(weight):
        left = int(share[t] * scale)
        for kind in kinds:
            pool = sorted((f for f in files if f[1] == t and f[2] == kind), key=lambda f: (f[3] in seen, -len(f[4]), f[4]))
            if pool and left > 0:
                seen.add(pool[0][3])
                plain.append((t, kind, pool[0][3], pool[0][4][:left]))
                left -= len(plain[-1][3])
    assert sorted((r.task_id, r.kind, r.file_type, r["sample"]) for r in rows) == sorted(plain)


def test_running_lengths_in_blocks(spark):
    """Ranges of a hot group, a null group and null texts give the batches of one ordered pass."""
    rows = [(None if i % 7 == 0 else "hot" if i % 7 < 5 else "b", i * 37 % 501, None if i % 11 == 0 else "x" * (i % 13)) for i in range(501)]
    df = spark.createDataFrame(rows, "source string, doc_id int, text string")
    got = {r.doc_id: r.batch for r in sq.batches_of(df, ["source"], ["doc_id"], "text", 40, blocks=9).collect()}
    assert len(got) == len(rows)
    for source in (None, "hot", "b"):
        total = 0
        for _, doc, text in sorted((r for r in rows if r[0] == source), key=lambda r: r[1]):
            assert got[doc] == total // 40
            total += len(text or "")
    assert sq.batches_of(df.limit(0), ["source"], ["doc_id"], "text", 40).count() == 0
