import json

import pytest

from tracewell.operators import storage as st
from tracewell.sources import traces as tr


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("signal")

    def session(name, events, summary=None, perturbation=None, blobs=()):
        d = base / name
        (d / "media" / "blobs").mkdir(parents=True)
        (d / "events.json").write_text(json.dumps(events))
        if summary is not None:
            (d / "summary.json").write_text(json.dumps(summary))
        if perturbation is not None:
            (d / "perturbation.json").write_text(json.dumps(perturbation))
        entries = {}
        for h, data in blobs:
            (d / "media" / "blobs" / f"{h}.blob").write_bytes(data)
            entries[h] = {"type": "blob", "original_path": f"/x/{h}", "size_bytes": len(data), "stored_at": 1.0, "references": 1}
        (d / "media" / "manifest.json").write_text(json.dumps({"version": 1, "entries": entries, "stats": {}}))

    ref = {"type": "blob", "hash": "aa", "path": "media/blobs/aa.blob"}
    session("p1_t01", [
        {"event_type": "session_start", "timestamp": 5.0},
        {"event_type": "file_write", "timestamp": 1.0, "file_path": "/sandbox/x/a.md", "file_type": "md", "operation": "create", "content_length": 3, "media_ref": ref},
        {"event_type": "file_move", "old_path": "/a", "new_path": "/b", "file_type": None},
        {"event_type": "todo_created"},
        {"event_type": "session_end"},
    ], {"completed": True}, {"applied": True}, [("aa", "| é |".encode()), ("bb", b"\xff\xfe"), ("cc", b"  ")])
    session("p1_t02", [{"event_type": "file_read", "view_count": 2}], {"completed": False})
    session("p10_t01", [])
    return str(base)


def test_events_keep_array_order_and_keys(spark, root):
    rows = tr.read_events(spark, root).orderBy("profile_id", "task_id", "seq").collect()
    assert [(r.profile_id, r.task_id, r.seq) for r in rows] == [("p1", "t01", i) for i in range(5)] + [("p1", "t02", 0)]


def test_one_profile_by_prefix(spark, root):
    assert tr.read_events(spark, root, "p1").select("profile_id").distinct().count() == 1
    assert tr.read_events(spark, root, "p10").count() == 0


def test_media_are_resolved_and_bad_bytes_are_null(spark, root):
    media = tr.read_media(spark, root)
    assert {r.path[-7:]: r.text for r in media.collect()} == {"aa.blob": "| é |", "bb.blob": None, "cc.blob": "  "}
    events = tr.resolve_media(tr.read_events(spark, root), media)
    assert [r.content for r in events.where("event_type = 'file_write'").collect()] == ["| é |"]


def test_normalise_unifies_paths_and_drops_unknown_types(spark, root):
    rows = {r.event_type: r for r in tr.normalise(tr.read_events(spark, root, "p1")).where("task_id = 't01'").collect()}
    assert set(rows) == {"file_write", "file_move"}
    assert (rows["file_move"].source_file, rows["file_move"].target_file, rows["file_move"].file_type, rows["file_move"].view_count) == ("/a", "/b", "unknown", 0)


def test_filters_and_labels(spark, root):
    events = tr.read_events(spark, root)
    summaries = tr.read_session_files(spark, root, "summary.json", "completed boolean")
    shifts = tr.read_session_files(spark, root, "perturbation.json", "applied boolean")
    kept = tr.filtered(events, summaries, shifts)
    assert {(r.task_id, r.is_perturbed) for r in kept.select("task_id", "is_perturbed").distinct().collect()} == {("t01", True)}
    assert tr.filtered(events, summaries, shifts, with_perturbed=False).count() == 0
    assert [r.task_id for r in tr.complete_sessions(events).collect()] == ["t01"]


def test_manifest_blobs(spark, root):
    manifests = tr.read_session_files(spark, root, "manifest.json", "version int, entries map<string,struct<type:string,original_path:string,size_bytes:long,stored_at:double,references:int>>")
    assert [r["hash"] for r in st.manifest_blobs(manifests, tr.read_media(spark, root)).collect()] == ["aa"]


def test_dimension_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"profiles": {"p1": {"name": "a", "role": "b", "language": "en", "dimensions": {"A": "L", "B": "M"}}}}))
    (tmp_path / "a.json").write_text(json.dumps({"annotator": "x", "profile_id": "p1", "dimensions": {"A": {"value": "L", "confidence": None}}}))
    (tmp_path / "t.json").write_text(json.dumps({"task_id": "t01", "type": "x", "dimensions": ["A"], "observable_attributes": {"k": "v"}}))
    assert {(r.dim, r.tier) for r in tr.profile_matrix(spark, f"{tmp_path}/m.json").collect()} == {("A", "L"), ("B", "M")}
    assert tr.annotations(spark, f"{tmp_path}/a.json").first().confidence is None
    assert tr.tasks(spark, f"{tmp_path}/t.json").first().dimensions == ["A"]
    truth = tr.ground_truth(spark, [{"profile_id": "p1", "basic": {"tone": "dry", "verbosity": "low"}}])
    assert {(r.attribute, r.value) for r in truth.collect()} == {("tone", "dry"), ("verbosity", "low"), ("output_detail", "low")}


def test_upsert_and_store(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, x int")
    new = spark.createDataFrame([("a", 2, 9)], "k string, v int, x int")
    assert {(r.k, r.x) for r in st.upsert(old, new, ["k"], "v").collect()} == {("a", 9), ("b", 1)}
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "\x00bin"), (4, None)], "i int, content string")
    assert [(r.references, r["first"]) for r in st.store(rows, [], "i").collect()] == [(2, 1)]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p1", "hello")], "profile_id string, line string")
    st.append_events(df, f"{tmp_path}/e")
    st.append_events(df, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").count() == 2
    st.write_json(df, f"{tmp_path}/j")
    st.write_text(df, f"{tmp_path}/t", ["profile_id"])
    assert spark.read.json(f"{tmp_path}/j").count() == 1
    assert [r.value for r in spark.read.text(f"{tmp_path}/t").collect()] == ["hello"]


def test_packed_sessions_give_the_same_rows_as_folders(spark, root, tmp_path):
    files = spark.read.text(f"{root}/*/*.json", wholetext=True).selectExpr("regexp_extract(_metadata.file_path, '([^/]+/[^/]+)$', 1) AS path", "value")
    out = f"{tmp_path}/packed"
    st.pack(files.coalesce(1), out)
    for profile in (None, "p1", "p10"):
        one, two = tr.read_events(spark, root, profile), tr.read_events(spark, out, profile, packed=True)
        assert one.columns == two.columns
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    for name, schema in (("summary.json", "completed boolean"), ("perturbation.json", "applied boolean")):
        one, two = tr.read_session_files(spark, root, name, schema), tr.read_session_files(spark, out, name, schema, packed=True)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))


def test_files_do_not_grow_with_profiles(spark, sf, tmp_path, monkeypatch):
    """Sessions, documents and sinks of the queries: many profiles to a file."""
    from tracewell.plans import queries, source_queries

    monkeypatch.setattr(source_queries, "folder", lambda spark: f"{tmp_path}/{len(list(tmp_path.iterdir()))}")
    for name in ("session_scan", "kept_sessions", "profile_matrix_scan", "annotation_scan", "ground_truth_scan"):
        queries()[name](spark, sf)
    assert len(list(tmp_path.rglob("part-*"))) <= 4 * 7
    rows = spark.range(5000).selectExpr("id AS profile_id", "'x' AS line")
    st.append_events(rows, f"{tmp_path}/e")
    st.write_text(rows.select(st.bucket("profile_id").alias("bucket"), "line"), f"{tmp_path}/t", ["bucket"])
    for sink in "et":
        assert len(list((tmp_path / sink).rglob("part-*"))) <= 2 * st.BUCKETS
    assert spark.read.parquet(f"{tmp_path}/e").count() == spark.read.text(f"{tmp_path}/t").count() == 5000
