"""Streams give the rows of a batch job over all events, however these fall into batches, and go on after failures."""

import json
import random

import pytest

from tracewell.operators import storage
from tracewell.streaming import live
from tracewell.streaming.ordered import Entry, Memory

SCHEMA = "profile_id long, event_id long, ts_ms long, event_type string, operation string, file_path string, target_file string, file_type string, content_hash long"
FAR = 4102444800000


def events(seed, n=60, span=40_000):
    rng = random.Random(seed)
    paths = [f"/p{i}" for i in range(5)]
    out = []
    for i in range(n):
        kind = rng.choice(["file_write", "file_write", "file_move", "file_delete", "file_read", "error_encounter"])
        path = rng.choice(paths)
        out.append((rng.randrange(2), i, rng.randrange(span), kind, "create" if kind == "file_write" else None, path, rng.choice(paths) if kind == "file_move" else None, "md", rng.randrange(3)))
    return out


def feed(spark, batches, end=True):
    """A stream of these batches, one file each, and of a last row far in the future."""
    path = storage.scratch(spark, "feed")
    for rows in [*batches, *([[(-1, -1, FAR, "file_read", None, "", None, "", -1)]] if end else [])]:
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return live.with_event_time(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))


def split(rows, seed, n):
    rng = random.Random(seed)
    out = [[] for _ in range(n)]
    for r in rows:
        out[rng.randrange(n)].append(r)
    return out


def nearly_sorted(rows, seed, n, within):
    """Batches in which no row comes after one that is over ``within`` later."""
    rng = random.Random(seed)
    late = sorted(rows, key=lambda r: r[2] + rng.randrange(within))
    size = -(-len(late) // n)
    return [late[i : i + size] for i in range(0, len(late), size)]


def done(spark, df):
    return sorted(map(tuple, live.run_to_end(df, storage.scratch(spark, "stream")).collect()), key=str)


class Held:
    """A map state in memory."""

    def __init__(self):
        self.rows = {}

    def getValue(self, key):  # noqa: N802
        return self.rows.get(key)

    def containsKey(self, key):  # noqa: N802
        return key in self.rows

    def updateValue(self, key, value):  # noqa: N802
        self.rows[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.rows[key]

    def iterator(self):
        return iter(list(self.rows.items()))


def plain_recoveries(rows):
    out, pending, before = [], {}, {}
    for p, event, at, kind, *_ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if kind == "error_encounter":
            pending[p] = (event, at, before.get(p, ""))
        elif p in pending:
            error, since, tool = pending.pop(p)
            out.append((p, error, event, "retry" if tool == kind else "rethink", at - since))
        before[p] = kind
    return sorted(out, key=str)


def plain_births(rows):
    births, out = {}, []
    for p, event, at, kind, _, path, target, *_ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if kind == "file_write":
            births[p, path] = at
        elif kind == "file_delete":
            born = births.pop((p, path), None)
            out.append((p, event, path, None if born is None else at - born))
        elif kind == "file_move" and (p, path) in births:
            births[p, target] = births.pop((p, path))
    return sorted(out, key=str), births


def plain_settled(rows, within=500):
    out = []
    own = sorted((r for r in rows if r[3] in ("file_delete", "file_write")), key=lambda r: (r[2], r[1]))
    for i, r in enumerate(own):
        if r[3] == "file_delete":
            after = next((x for x in own[i + 1 :] if (x[0], x[5]) == (r[0], r[5])), None)
            if not (after and after[3] == "file_write" and after[2] - r[2] <= within):
                out.append((r[0], r[1], r[5], r[2]))
    return sorted(out, key=str)


def plain_opens(rows):
    out, last = [], {}
    for r in sorted((r for r in rows if r[3] == "file_read"), key=lambda r: (r[2], r[1])):
        if last.get(r[0]) != r[5]:
            out.append((r[0], r[1], r[5], r[2]))
        last[r[0]] = r[5]
    return sorted(out, key=str)


@pytest.mark.parametrize(("delay", "cut"), [("60 days", lambda rows: split(rows, 1, 3)), ("5 seconds", lambda rows: nearly_sorted(rows, 2, 4, 5_000))])
def test_any_split_into_batches(spark, delay, cut):
    rows = events(3)
    batches = cut(rows)
    only = lambda df, *kinds: df.where(df.event_type.isin(*kinds))
    assert done(spark, live.recoveries(feed(spark, batches), ["profile_id"], delay)) == plain_recoveries(rows)
    assert done(spark, live.births(feed(spark, batches), delay=delay)) == plain_births(rows)[0]
    assert done(spark, live.changed_opens(only(feed(spark, batches), "file_read"), ["profile_id"], delay)) == plain_opens(rows)
    assert done(spark, live.settled_deletes(only(feed(spark, batches), "file_delete", "file_write", "file_read").where("event_type != 'file_read' or profile_id < 0"), delay=delay)) == plain_settled(rows)


def test_an_error_in_one_batch_and_its_recovery_in_a_later_one(spark):
    batches = [[(1, 1, 1000, "error_encounter", *[None] * 5), (1, 3, 4000, "file_read", *[None] * 5)], [(1, 2, 2000, "file_write", *[None] * 5)]]
    assert done(spark, live.recoveries(feed(spark, batches), ["profile_id"], "1 hour")) == [(1, 1, 2, "rethink", 1000)]


def test_births_are_dropped_on_delete_and_after_a_time(spark):
    rows = events(5)
    out = storage.scratch(spark, "stream")
    live.run_to_end(live.births(feed(spark, split(rows, 4, 2)), delay="60 days"), out)
    entries = spark.read.format("statestore").option("path", f"{out}/checkpoint").option("stateVarName", "entries").load().select("key.profile_id", "user_map_key.name").collect()
    assert sorted((r["profile_id"], r["name"]) for r in entries) == sorted(plain_births(rows)[1])
    out = storage.scratch(spark, "stream")
    live.run_to_end(live.births(feed(spark, [rows]), forget_ms=10_000, delay="60 days"), out)
    assert spark.read.format("statestore").option("path", f"{out}/checkpoint").option("stateVarName", "entries").load().isEmpty()


def test_forgotten_births_have_no_age(spark):
    rows = [(1, 1, 1_000, "file_write", "create", "/a", None, "md", 0), (1, 2, 4_000, "file_move", None, "/a", "/b", "md", 0), (1, 3, 10_000, "file_delete", None, "/b", None, "md", 0)]
    for forget, age in ((9_001, 9_000), (9_000, None)):
        assert done(spark, live.births(feed(spark, [rows]), forget_ms=forget, delay="1 hour")) == [(1, 3, "/b", age)]


def test_snapshots_have_the_files_as_they_stand(spark):
    rows = [
        (1, 1, 1_000, "file_write", "create", "/d/a.md", None, "md", 0), (1, 2, 200_000, "file_move", None, "/d/a.md", "/b.csv", "md", 0),
        (1, 3, 301_000, "file_write", "create", "/c.md", None, "md", 0), (1, 4, 400_000, "session_end", None, None, None, None, None),
        (2, 5, 2_000, "file_read", None, "/x.txt", None, "txt", 0), (2, 6, 3_000_000, "file_delete", None, "/x.txt", None, "txt", 0),
    ]
    got = live.run_to_end(live.snapshots(feed(spark, split(rows, 9, 2)), every_ms=300_000, idle_ms=500_000, delay="60 days"), storage.scratch(spark, "stream")).collect()
    assert sorted((r["profile_id"], r["at_ms"], r["kind"], r["files"], r["file_count_by_type"], r["max_depth"]) for r in got) == [
        (1, 1_000, "start", "", "{}", 0), (1, 301_000, "periodic", "/b.csv", '{"csv": 1}', 1), (1, 400_000, "end", "/b.csv,/c.md", '{"csv": 1, "md": 1}', 1),
        (2, 2_000, "start", "", "{}", 0), (2, 302_000, "periodic", "/x.txt", '{"txt": 1}', 1), (2, 502_001, "end", "/x.txt", '{"txt": 1}', 1),
        (2, 3_000_000, "start", "/x.txt", '{"txt": 1}', 1), (2, 3_300_000, "periodic", "", "{}", 0), (2, 3_500_001, "end", "", "{}", 0),
    ]


def test_each_event_once_after_failures_between_write_and_commit(spark):
    rows = [(i % 3, i, 1000 * (i + 1), "file_read", None, f"/p{i}", None, "md", 0) for i in range(40)]
    twice = [rows[:15], rows[5:30], rows[20:], rows[::2]]
    stream, out, failed = live.once(feed(spark, twice, end=False), "1 day").select("event_id"), storage.scratch(spark, "stream"), []

    def fail(n):
        if n in (1, 2) and failed.count(n) < 2:
            failed.append(n)
            raise OSError(f"lost after batch {n} was written")

    for _ in range(4):
        with pytest.raises(Exception, match="lost after batch"):
            live.run_once(stream, out, fail)
    assert failed == [1, 1, 2, 2]
    assert sorted(r["event_id"] for r in live.run_once(stream, out, fail).collect()) == list(range(40))
    assert sorted(r["event_id"] for r in live.run_once(stream, out).collect()) == list(range(40))  # nothing new


def test_a_feed_of_nothing(spark):
    stream = live.recoveries(feed(spark, []), ["profile_id"])
    assert live.run_once(stream, storage.scratch(spark, "stream")).collect() == []


def test_memory_reads_and_writes_only_what_it_needs():
    state = Held()
    memory = Memory(state)
    assert memory.get("a") is None and memory.pop("a") is None
    memory.put("a", 1, "x", due=9)
    memory.put("b", 2)
    memory.put("a", 3, due=7)
    assert memory.next_due() == (7, "a")
    memory.pop("a")
    assert memory.next_due() is None
    memory.write()
    assert state.rows == {("b",): (2, None, None)}
    state.rows["c",] = (4, "t", 5)
    memory = Memory(state)
    memory.pop("b")
    assert memory.items() == [("c", Entry(4, "t", 5))] and memory.next_due() == (5, "c")
    memory.write()
    assert state.rows == {("c",): (4, "t", 5)}


@pytest.mark.parametrize(("delay", "cut"), [("60 days", lambda rows: split(rows, 1, 2)), ("5 seconds", lambda rows: nearly_sorted(rows, 2, 3, 5_000))])
def test_keys_dealt_to_slots(spark, delay, cut):
    """Many keys in one state: rows that wait for a later batch, entries that go on to it, and times that run out are each key's own."""
    rows = events(3)
    batches = cut(rows)
    only = lambda df, *kinds: df.where(df.event_type.isin(*kinds))
    assert done(spark, live.recoveries(feed(spark, batches), ["profile_id"], delay, slots=1)) == plain_recoveries(rows)
    assert done(spark, live.births(feed(spark, batches), delay=delay, slots=2)) == plain_births(rows)[0]
    assert done(spark, live.settled_deletes(only(feed(spark, batches), "file_delete", "file_write", "file_read").where("event_type != 'file_read' or profile_id < 0"), delay=delay, slots=2)) == plain_settled(rows)
    for f in (live.copies, live.snapshots):
        assert done(spark, f(feed(spark, batches), delay=delay, slots=2)) == done(spark, f(feed(spark, batches), delay=delay))


def test_births_in_slots_are_dropped_and_forgotten(spark):
    rows = events(5)
    out = storage.scratch(spark, "stream")
    live.run_to_end(live.births(feed(spark, split(rows, 4, 2)), delay="60 days", slots=1), out)
    names = spark.read.format("statestore").option("path", f"{out}/checkpoint").option("stateVarName", "entries").load().select("user_map_key.name").collect()
    assert sorted(tuple(json.loads(r["name"])) for r in names) == sorted(plain_births(rows)[1])
    out = storage.scratch(spark, "stream")
    live.run_to_end(live.births(feed(spark, [rows]), forget_ms=10_000, delay="60 days", slots=1), out)
    assert spark.read.format("statestore").option("path", f"{out}/checkpoint").option("stateVarName", "entries").load().isEmpty()
