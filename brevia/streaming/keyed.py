"""State machines over the events of each key, in order of time: as a batch and as a stream.

A machine has start(), a tuple of numbers, and step(state, t, ok), the next state and what is said of the event."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds without events after which a key's state is forgotten (R2).
IDLE = 300.0
#: Seconds that an event of a stream may be behind the latest one.
LATE = 86_400.0


class Machine:
    #: Names and SQL types of what step() says, and Arrow's types.
    says: tuple[tuple[str, str], ...]
    #: Number of values of a state; all are doubles, null allowed.
    width: int

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, t: float, ok: bool) -> tuple[tuple, tuple]:
        raise NotImplementedError


ARROW = {"boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


class Passage:
    """A key's way through a machine: what both the batch and the stream do with each event, in order of time. The state is made anew
    after `idle` seconds without an event (R2), at a reset of the key, and when a change takes effect for all keys: changes are
    (second from which it holds, machine from then on); a reset of all is a change to the same machine."""

    def __init__(self, machine: Machine, idle: float | None = None, changes: tuple[tuple[float, Machine], ...] = ()):
        changes = sorted(changes, key=lambda c: c[0])
        self.times, self.machines, self.idle = [c[0] for c in changes], [machine, *[c[1] for c in changes]], idle

    def start(self) -> tuple:
        """(state or None, second of the last event, number of the machine)."""
        return None, None, 0.0

    def step(self, passage: tuple, t: float, ok: bool, reset: bool) -> tuple[tuple, tuple | None]:
        state, last, epoch = passage
        now = float(bisect.bisect_right(self.times, t))
        machine = self.machines[int(now)]
        if reset:
            return (None, None, now), None
        if state is None or now != epoch or self.idle is not None and last is not None and t - last > self.idle:
            state = machine.start()
        state, said = machine.step(state, t, ok)
        return (state, t, now), said


def _rows(events: DataFrame, key: str, ok: Column, resets: DataFrame | None, *more: Column) -> DataFrame:
    rows = events.select(F.col(key), seconds(F.col("ts")).alias("t"), F.col("event_id").cast("long").alias("event_id"), ok.alias("ok"), F.lit(False).alias("reset"), *more)
    if resets is None:
        return rows
    own = resets.select(F.col(key), seconds(F.col("ts")).alias("t"), F.lit(None).cast("long").alias("event_id"), F.lit(True).alias("ok"), F.lit(True).alias("reset"), *more)
    return rows.unionByName(own)


def decide(events: DataFrame, key: str, machine: Machine, ok: Column | None = None, resets: DataFrame | None = None, changes: tuple = (), idle: float | None = None) -> DataFrame:
    """(key, event_id, what the machine says) of (key, event_id, ts). A key's events are in one task, sorted, and pass through
    it batch by batch: time is linear in them, and a task holds one batch and one state. resets: (key, ts) at which a key's state is
    forgotten, before events of the same time; changes and idle: see Passage."""
    rows = _rows(events, key, F.lit(True) if ok is None else ok, resets)
    names, kinds = [n for n, _ in machine.says], [ARROW[t] for _, t in machine.says]
    passage = Passage(machine, idle, changes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            at, out = [], []
            for row, (k, t, good, reset) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True)):
                if k != now:
                    now, state = k, passage.start()
                state, said = passage.step(state, t, good, reset)
                if said is not None:
                    at.append(row), out.append(said)
            cols, at = zip(*out, strict=True) if out else [[]] * len(names), pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), *[pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]], [key, "event_id", *names])

    kind = rows.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", "event_id long", *[f"{n} {t}" for n, t in machine.says]])
    return rows.repartition(key).sortWithinPartitions(F.col(key), F.col("t"), F.col("reset").desc(), F.col("event_id")).mapInArrow(run, schema)


def decide_stream(events: DataFrame, key: str, machine: Machine, idle: float = IDLE, resets: DataFrame | None = None, changes: tuple = (), late: float = LATE) -> DataFrame:
    """The same of a stream of (key, event_id, ts, ok): states live in the state store. A key is forgotten after `idle` seconds of event
    time, as in the batch, so a slow replay decides as the events did; the store lets its state go when the watermark has passed
    that time. The watermark is `late` seconds behind the latest event; what comes later still gets no decision. resets may be a
    stream, too. Events of a key are taken in order of time within a batch."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = events.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", "event_id long", *[f"{n} {t}" for n, t in machine.says]])
    names, width, passage = [n for n, _ in machine.says], machine.width, Passage(machine, idle, changes)
    plain = lambda x: None if x is None or x != x else x

    def run(keys: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = passage.start()
        if held.exists:
            *own, last, epoch, there = (plain(x) for x in held.get)
            state = (tuple(own) if there else None, last, epoch)
        rows = pd.concat(list(parts)).sort_values(["t", "reset", "event_id"], ascending=[True, False, True], kind="stable")
        out = []
        for event_id, t, ok, reset in zip(rows["event_id"], rows["t"], rows["ok"], rows["reset"], strict=True):
            state, said = passage.step(state, float(t), bool(ok), bool(reset))
            if said is not None:
                out.append((keys[0], int(event_id), *said))
        own, last, epoch = state
        held.update((*(own or [None] * width), last, epoch, float(own is not None)))
        held.setTimeoutTimestamp(max(int(((last or float(rows["t"].max())) + idle) * 1000) + 1, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "event_id", *names])

    rows = _rows(events, key, F.col("ok"), resets, (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 MILLISECOND")).alias("after"))
    rows = rows.withWatermark("after", f"{int(late * 1000)} milliseconds")  # a millisecond on: an event at 0 isn't late
    state = ", ".join([*[f"s{k} double" for k in range(width)], "last double", "epoch double", "there double"])
    return rows.groupBy(key).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.EventTimeTimeout)
