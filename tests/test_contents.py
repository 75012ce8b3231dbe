"""Contents of creates: no step moves more of a text than it shows."""

import hashlib
import shutil

from pyspark.sql import functions as F

from tracewell import plans
from tracewell.operators import rendering as rd
from tracewell.operators import sequences as sq
from tracewell.operators.cache import fingerprints
from tracewell.sources.traces import trace_of_events


def noise(n, seed):
    """``n`` characters that don't compress well."""
    return "".join(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in range(n // 64 + 1))[:n]


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    none = jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_starts_show_what_whole_texts_show(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    docs = spark.createDataFrame([(0, "é" * 900), (1, "b" * 800), (2, "c" * 801), (3, ""), (4, None), (5, "d😀\n" * 400)], "doc_id long, text string")
    lines = lambda head: {tuple(r) for r in rd.narrative_lines(trace_of_events(events, docs, head), 800).collect()}
    assert lines(800) == lines(None) and any("900 chars total" in r[-1] for r in lines(800))
    edits = spark.createDataFrame([(1, 0, 1, "file_edit", "abc", 900, None), (1, 0, 2, "file_edit", "abc", 900, "dd"), (1, 0, 3, "file_read", "abc", 900, None)], "profile_id long, task_id int, seq int, event_type string, content string, content_chars int, diff string")
    assert [r[0] for r in edits.orderBy("seq").select(rd.with_content(F.lit("x"), edits, 3)).collect()] == ["x\n--- diff ---\nabc\n... [truncated, 900 chars total]\n--- end ---", "x\n--- diff ---\ndd\n--- end ---", "x"]


def test_a_change_behind_the_start_changes_the_print(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    texts = lambda end: spark.createDataFrame([(i, "a" * 900 + (end if i == 3 else "x")) for i in range(10)], "doc_id long, text string")
    prints = [{r[0]: r[1] for r in fingerprints(trace_of_events(events, texts(e), 800)).collect()} for e in ("y", "z")]
    made = {r[0] for r in trace_of_events(events, texts("y")).where((F.col("operation") == "create") & (F.col("event_id") % 10 == 3)).select("profile_id").collect()}
    assert made and {p for p in prints[0] if prints[0][p] != prints[1][p]} == made


def test_budget_by_keys_is_the_same(spark):
    rows = spark.createDataFrame([(g, t, "x" * ((t * 7) % 11) if t % 5 else None) for g in (1, 2, None) for t in range(40)], "g int, t int, text string")
    kept = [sorted(map(tuple, sq.within_budget(rows, ["g"], ["t"], "text", budget=60, blocks=4, key=k).collect()), key=str) for k in (None, ["g", "t"])]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < 120


def test_cached_contexts_shuffle_no_whole_texts(spark, sf, tmp_path):
    shutil.copy(f"{sf}/events.parquet", tmp_path / "events.parquet")
    spark.createDataFrame([(i, noise(40_000, i)) for i in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    before = shuffled(spark)
    assert plans.queries()["cached_contexts"](spark, str(tmp_path)).count() > 0
    assert sum(b for k, b in shuffled(spark).items() if k not in before) < 50 * 40_000 / 2
