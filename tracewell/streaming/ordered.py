"""Event-time order for stateful operators: what a key's rows give doesn't depend on how they fell into batches.

Rows wait in state until the watermark has passed them, and are then stepped
through in order; a row that comes later than the watermark is dropped before
it gets here. What steps remember lies in a map state of one entry for each
name (a path, a pending error), which is dropped by the step or when its time
has passed, so that state neither grows with a key's history nor is rewritten
as a whole.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, FractionalType, IntegralType, StructType

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Entry:
    """What a step remembers under a name; ``due`` is the event time in ms at which that has had its time, None for never."""

    value: int
    text: str | None = None
    due: int | None = None


class Memory:
    """A key's entries, read from the state when first asked for and written back at the end of a release."""

    def __init__(self, state) -> None:  # noqa: ANN001
        self._state, self._seen, self._changed, self._dues = state, {}, set(), []

    def _take(self, name: str, entry: Entry | None) -> Entry | None:
        self._seen[name] = entry
        if entry is not None and entry.due is not None:
            heapq.heappush(self._dues, (entry.due, name))
        return entry

    def get(self, name: str) -> Entry | None:
        if name in self._seen:
            return self._seen[name]
        found = self._state.getValue((name,))
        return self._take(name, None if found is None else Entry(*found))

    def put(self, name: str, value: int, text: str | None = None, due: int | None = None) -> None:
        self._take(name, Entry(int(value), text, None if due is None else int(due)))
        self._changed.add(name)

    def pop(self, name: str) -> Entry | None:
        found = self.get(name)
        if found is not None:
            self._take(name, None)
            self._changed.add(name)
        return found

    def load(self) -> None:
        for key, value in self._state.iterator():
            if key[0] not in self._seen:
                self._take(key[0], Entry(*value))

    def items(self) -> list[tuple[str, Entry]]:
        """All entries, by name; reads the whole map."""
        self.load()
        return sorted(((k, v) for k, v in self._seen.items() if v is not None), key=lambda x: x[0])

    def next_due(self) -> tuple[int, str] | None:
        """The earliest (due, name) among the entries read so far."""
        while self._dues:
            due, name = self._dues[0]
            entry = self._seen[name]
            if entry is not None and entry.due == due:
                return due, name
            heapq.heappop(self._dues)
        return None

    def write(self) -> None:
        for name in self._changed:
            entry = self._seen[name]
            if entry is not None:
                self._state.updateValue((name,), (entry.value, entry.text, entry.due))
            elif self._state.containsKey((name,)):
                self._state.removeKey((name,))


Step = Callable[[Memory, dict], list[dict]]
#: Makes rows of an entry whose time has passed, and may put others.
AtDue = Callable[[Memory, str, Entry], list[dict]]


class InOrder(StatefulProcessor):
    """See ``in_order``."""

    def __init__(self, row: StructType, out: list[str], step: Step, clock: str, order: tuple[str, ...], at_due: AtDue | None) -> None:
        self.row, self.out, self.step, self.clock, self.order, self.at_due = row, out, step, clock, order, at_due

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.entries = handle.getMapState("entries", "name string", "value long, text string, due long")
        self.times = handle.getValueState("times", "timer long, due long")  # -1: none; due: no entry's time passes before it

    def _kept(self, rows: pd.DataFrame) -> list[tuple]:
        columns = []
        for field in self.row:
            kind = field.dataType
            of = int if isinstance(kind, IntegralType) else float if isinstance(kind, FractionalType) else bool if isinstance(kind, BooleanType) else str
            columns.append([None if null else of(x) for x, null in zip(rows[field.name].tolist(), rows[field.name].isna().tolist(), strict=True)])
        return list(zip(*columns, strict=True))

    def _wake(self, timer: int, due: int, at: list[int]) -> None:
        """Registers the earliest of the times in ``at`` in place of ``timer``."""
        first = min(at, default=-1)
        if first != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if first >= 0:
                self.handle.registerTimer(first)
        if first < 0 and due < 0:
            self.times.clear()
        else:
            self.times.update((first, due))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        timer, due = self.times.get() or (-1, -1)
        first = [timer] if timer >= 0 else []
        for some in rows:
            kept = self._kept(some)
            if kept:
                self.waiting.appendList(kept)
                first.append(max(0, int(some[self.clock].min())))
        self._wake(timer, due, [min(first)] if first else [])
        yield pd.DataFrame([], columns=self.out)

    def _passed(self, memory: Memory, until: int) -> list[dict]:
        """Drops the entries due until then, in the order of their times."""
        out: list[dict] = []
        while (found := memory.next_due()) and found[0] <= until:
            entry = memory.pop(found[1])
            if self.at_due:
                out += self.at_due(memory, found[1], entry)
        return out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now, due = timerValues.getCurrentWatermarkInMs(), (self.times.get() or (-1, -1))[1]
        names = [f.name for f in self.row]
        at, places = names.index(self.clock), [names.index(c) for c in self.order]
        rows = list(self.waiting.get())
        later = [r for r in rows if r[at] > now]
        memory, out = Memory(self.entries), []
        if 0 <= due <= now:
            memory.load()
            due = -1
        for r in sorted((r for r in rows if r[at] <= now), key=lambda r: [r[i] for i in places]):
            out += self._passed(memory, r[at])
            out += self.step(memory, dict(zip(names, r, strict=True)))
        out += self._passed(memory, now)
        due = min([x for x in (due, (memory.next_due() or (-1,))[0]) if x >= 0], default=-1)
        memory.write()
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        # the timer that has run out is gone already
        self._wake(-1, due, [*([min(r[at] for r in later)] if later else []), *([due] if due >= 0 else [])])
        yield pd.DataFrame(out, columns=self.out)


class Part:
    """One key's entries in the map state of a slot, under names that begin with the key; read already, written one by one."""

    def __init__(self, state, key: tuple, held: dict[str, tuple]) -> None:  # noqa: ANN001
        self._state, self._key, self._held = state, key, held

    def _name(self, key: tuple[str]) -> tuple[str]:
        return (json.dumps([*self._key, key[0]]),)

    def getValue(self, key: tuple[str]) -> tuple | None:  # noqa: N802
        return self._held.get(key[0])

    def containsKey(self, key: tuple[str]) -> bool:  # noqa: N802
        return key[0] in self._held

    def updateValue(self, key: tuple[str], value: tuple) -> None:  # noqa: N802
        self._state.updateValue(self._name(key), value)

    def removeKey(self, key: tuple[str]) -> None:  # noqa: N802
        self._state.removeKey(self._name(key))

    def iterator(self) -> Iterator[tuple]:
        return (((name,), value) for name, value in self._held.items())


class InSlots(InOrder):
    """As ``InOrder`` for all keys of a slot: a call for state or timer is one for many keys and rows."""

    #: Rows in one value of the list state.
    TOGETHER = 5_000

    def __init__(self, by: list[str], *more) -> None:  # noqa: ANN002
        super().__init__(*more)
        self.by = by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.entries = handle.getMapState("entries", "name string", "value long, text string, due long")
        self.times = handle.getValueState("times", "timer long, due long")

    def _packed(self, rows: list) -> list[tuple[str]]:
        return [(json.dumps(rows[i : i + self.TOGETHER]),) for i in range(0, len(rows), self.TOGETHER)]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        timer, due = self.times.get() or (-1, -1)
        first = [timer] if timer >= 0 else []
        for some in rows:
            if len(some):
                self.waiting.appendList(self._packed(self._kept(some)))
                first.append(max(0, int(some[self.clock].min())))
        self._wake(timer, due, [min(first)] if first else [])
        yield pd.DataFrame([], columns=self.out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now, due = timerValues.getCurrentWatermarkInMs(), (self.times.get() or (-1, -1))[1]
        names = [f.name for f in self.row]
        at, places, of = names.index(self.clock), [names.index(c) for c in self.order], [names.index(c) for c in self.by]
        later, ready, held = [], defaultdict(list), defaultdict(dict)
        for (some,) in self.waiting.get():
            for r in json.loads(some):
                if r[at] > now:
                    later.append(r)
                else:
                    ready[tuple(r[i] for i in of)].append(r)
        for (name,), value in self.entries.iterator():
            *own, name = json.loads(name)
            held[tuple(own)][name] = tuple(value)
        out, dues, passed = [], [], 0 <= due <= now
        for own in {**ready, **held} if passed else ready:
            memory = Memory(Part(self.entries, own, held.get(own, {})))
            memory.load()
            for r in sorted(ready.get(own, ()), key=lambda r: [r[i] for i in places]):
                out += self._passed(memory, r[at])
                out += self.step(memory, dict(zip(names, r, strict=True)))
            out += self._passed(memory, now)
            dues += [found[0] for found in [memory.next_due()] if found]
            memory.write()
        due = min([*dues, *([due] if due >= 0 and not passed else [])], default=-1)
        if later:
            self.waiting.put(self._packed(later))
        else:
            self.waiting.clear()
        self._wake(-1, due, [*([min(r[at] for r in later)] if later else []), *([due] if due >= 0 else [])])
        yield pd.DataFrame(out, columns=self.out)


def in_order(df: DataFrame, by: list[str], step: Step, schema: str, columns: list[str], delay: str, order: tuple[str, ...] = ("ts_ms", "event_id"), clock: str = "now", at_due: AtDue | None = None, slots: int | None = None) -> DataFrame:
    """Runs ``step(memory, row) -> rows`` over each key's rows by ``order``; ``schema`` is the output's.

    ``df`` has ts, the event time, and ``clock``, the same in milliseconds, along
    which ``order`` goes; ``columns`` are those that the step takes besides
    ``by``, ``order`` and ``clock``. Rows wait until the watermark, ``delay``
    behind the latest ts, has passed them. An entry whose ``due`` comes is
    dropped before the next row of that time or later is stepped through, or
    once the watermark has passed it; ``at_due(memory, name, entry)`` may make
    rows of it. When a stream ends, what still waits stays in its state and
    comes out when a later row moves the watermark.

    Each key has a state of its own, and costs some calls for it in each batch.
    With ``slots``, keys are dealt to so many states by their hash, which is
    much cheaper where keys are many and have few rows each; a release then
    reads all that its slot holds.
    """
    wanted = list(dict.fromkeys([*by, *columns, *order, clock]))
    row = StructType([df.schema[c] for c in wanted])
    out = [f.name for f in StructType.fromDDL(schema)]
    if slots:
        dealt = df.withWatermark("ts", delay).select(*wanted, "ts", F.pmod(F.xxhash64(*by), F.lit(slots)).alias("_slot")).groupBy("_slot")
        return dealt.transformWithStateInPandas(InSlots(by, row, out, step, clock, order, at_due), schema, "append", "EventTime")
    keyed = df.withWatermark("ts", delay).select(*wanted, "ts").groupBy(*by)
    return keyed.transformWithStateInPandas(InOrder(row, out, step, clock, order, at_due), schema, "append", "EventTime")
