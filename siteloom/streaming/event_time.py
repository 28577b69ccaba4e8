"""State in event time: a key's rows are held back until the watermark has passed them, then stepped through in order.

Whatever micro-batches rows arrive in, a key's state sees them by time, so results equal those of the batch
operators over all rows that the watermark has passed; rows behind the watermark are dropped by Spark. Deadlines
of a state run on the same clock: they fire between the rows that come before and after them, and they also drop
state that is no longer needed. Streams must run with RocksDB as their state store (`ordered_state`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

from siteloom.operators.runs import DAY_LIMIT, MAX_ATTEMPTS, ORPHANED_S, STUCK_S

#: (from, event, to) of a run's life; other events are rejected.
TRANSITIONS = {("new", "created"): "pending", ("pending", "claimed"): "processing", ("processing", "returned"): "pending", ("processing", "completed"): "completed", ("processing", "failed"): "failed", ("pending", "failed"): "failed"}
SECOND = 1_000_000
DAY = 24 * 3600 * SECOND
#: A run's state goes when its status has not changed for so long; later events find it new.
RUN_TTL = 7 * DAY
#: Groups of keys that share their state's calls, and the name of a key's text in them.
PARTS, KEY = 256, "state_key"
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def ordered_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


class Machine:
    """What a key's state does: its schemas, the step of a row, and the deadline of a state.

    row: (state or None, time, values) to (state, output rows); expire: (state, time) to (state or None, output
    rows). Times are microseconds. Output rows begin after the key.
    """

    values = state = out = ""

    def row(self, state: tuple | None, at: int, values: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        return None

    def expire(self, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        return None, []


class InOrder(StatefulProcessor):
    """Runs a machine over the keys of a part, each over its rows (us, tie, values) as the watermark passes them.

    A call of the state costs about a millisecond, so a part's keys share theirs: what a batch brings is held as
    one Arrow block, and all states of the part are read and written at once. One timer is set, the earliest.
    """

    def __init__(self, machine: Machine, columns: pa.Schema):
        self.machine, self.columns, self.made = machine, columns, [KEY, *(f.split()[0] for f in machine.out.split(", "))]

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "block binary")
        self.kept = handle.getListState("state", f"{KEY} string, {self.machine.state}")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, us: int) -> None:
        ms, before = -(-us // 1000), self.timer.get()
        if before is None or ms < before[0]:
            if before is not None:
                self.handle.deleteTimer(before[0])
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def _block(self, rows: pa.Table) -> tuple[bytes]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.columns) as writer:
            writer.write_table(rows)
        return (sink.getvalue().to_pybytes(),)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [pa.Table.from_pandas(r[self.columns.names], self.columns, preserve_index=False) for r in rows]
        self.held.appendList([self._block(r) for r in new])
        self._wake(min(pc.min(r["us"]).as_py() for r in new))
        return iter(())

    def _run(self, state: tuple | None, rows: Iterable[tuple], passed: int) -> tuple[tuple | None, list[tuple]]:
        """A key's state and output rows after its rows and the deadlines up to `passed`."""
        out, machine = [], self.machine

        def fire(before: int) -> None:
            nonlocal state
            while state is not None and (at := machine.deadline(state)) is not None and at <= before:
                state, made = machine.expire(state, at)
                out.extend(made)

        for _, us, _, *values in rows:
            fire(us - 1)
            state, made = machine.row(state, us, tuple(values))
            out.extend(made)
        fire(passed)
        return state, out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, machine = timerValues.getCurrentWatermarkInMs() * 1000, self.machine
        rows = pa.concat_tables([pa.ipc.open_stream(b).read_all() for (b,) in self.held.get()] or [self.columns.empty_table()])
        states = {k: tuple(s) for k, *s in self.kept.get()}
        ready = pc.less_equal(rows["us"], passed)
        due, rest = rows.filter(ready), rows.filter(pc.invert(ready))
        due = due.sort_by([(KEY, "ascending"), ("us", "ascending"), ("tie", "ascending")])
        ends = [k for k, s in states.items() if (at := machine.deadline(s)) is not None and at <= passed]
        todo = dict.fromkeys(ends, ())
        todo.update((k, list(g)) for k, g in groupby(zip(*(c.to_pylist() for c in due.columns), strict=True), key=lambda r: r[0]))
        out = []
        for k, of_key in todo.items():
            state, made = self._run(states.pop(k, None), of_key, passed)
            out.extend((k, *r) for r in made)
            if state is not None:
                states[k] = state
        if due.num_rows:
            self.held.put([self._block(rest)]) if rest.num_rows else self.held.clear()
        if todo:
            self.kept.put([(k, *s) for k, s in states.items()]) if states else self.kept.clear()
        ahead = [at for s in states.values() if (at := machine.deadline(s)) is not None]
        if rest.num_rows:
            ahead.append(pc.min(rest["us"]).as_py())
        self.timer.clear()
        if ahead:
            self._wake(min(ahead))
        if out:
            frame = pd.DataFrame(out, columns=self.made)
            yield frame.assign(**{c: frame[c].dt.tz_localize("UTC") for c in frame if frame[c].dtype.kind == "M"})

    def close(self) -> None:
        pass


def in_event_time(rows: DataFrame, key: str, time: str, tie: str, machine: Machine, delay: str, parts: int = PARTS) -> DataFrame:
    """The machine's output rows for each key of a stream whose rows are at most `delay` out of order.

    Keys are dealt over `parts` by their hash; a stream must keep the number with which it began.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in machine.values.split(", ")]
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))  # a null key is a key like others
    read = rows.withWatermark(time, delay).select(F.pmod(F.xxhash64(text), F.lit(parts)).alias("part"), time, text.alias(KEY), F.unix_micros(time).alias("us"), F.col(tie).alias("tie"), *names)
    columns = to_arrow_schema(read.select(KEY, "us", "tie", *names).schema)
    made = read.groupBy("part").transformWithStateInPandas(InOrder(machine, columns), f"{KEY} string, {machine.out}", "append", "eventTime", eventTimeColumnName="")
    own = F.when(F.col(KEY) != "", F.substr(KEY, F.lit(2))).cast(kind).alias(key)
    return made.select(own, *(c for c in made.columns if c != KEY))


class Lifecycle(Machine):
    """A run's status and attempts, guarded by the state before; event times of its last change."""

    values, state = "event_id long, event string", "status string, attempts int, since long, reported boolean"
    out = "event_id long, event string, status string, attempts int, accepted boolean"

    def __init__(self, ttl: int = RUN_TTL):
        self.ttl = ttl

    def row(self, state, at, values):
        status, attempts, since, reported = state or ("new", 0, at, False)
        event_id, event = values
        to = TRANSITIONS.get((status, event))
        if to:
            status, attempts, since, reported = to, attempts + (event == "claimed"), at, False
        return (status, attempts, since, reported), [(event_id, event, status, attempts, to is not None)]

    def deadline(self, state):
        return state[2] + self.ttl


class Stuck(Lifecycle):
    """Puts out runs that stand still: claims of over 15 minutes, and pending runs of over 10, each once."""

    out = "at timestamp, status string, attempts int, action string"

    def row(self, state, at, values):
        return super().row(state, at, values)[0], []

    def deadline(self, state):
        status, _, since, reported = state
        if reported or status not in ("pending", "processing"):
            return super().deadline(state)
        return since + (STUCK_S if status == "processing" else ORPHANED_S) * SECOND + 1

    def expire(self, state, at):
        status, attempts, since, reported = state
        if at >= since + self.ttl:
            return None, []
        return (status, attempts, since, True), [(pd.Timestamp(at, unit="us"), status, attempts, "requeue" if attempts < MAX_ATTEMPTS else "fail")]


class Quota(Machine):
    """A rolling day of a user's starts; its state holds at most `limit` of them."""

    values, state, out = "id long", "held array<long>", "id long, used int, accepted boolean"

    def __init__(self, limit: int):
        self.limit = limit

    def row(self, state, at, values):
        held = [t for t in (state[0] if state else ()) if t > at - DAY]
        ok = len(held) < self.limit
        held += [at] if ok else []
        return (held,), [(values[0], len(held), ok)]

    def deadline(self, state):
        return (max(state[0]) if len(state[0]) else 0) + DAY


def run_lifecycle(events: DataFrame, delay: str = "10 minutes", ttl: int = RUN_TTL) -> DataFrame:
    """(run_id, event_id, event, status, attempts, accepted) of events(run_id, event_id, at, event), by event time."""
    return in_event_time(events, "run_id", "at", "event_id", Lifecycle(ttl), delay)


def stuck_in_stream(events: DataFrame, delay: str = "10 minutes", ttl: int = RUN_TTL) -> DataFrame:
    """(run_id, at, status, attempts, action) of runs that stand still, when the watermark passes their deadline."""
    return in_event_time(events, "run_id", "at", "event_id", Stuck(ttl), delay)


def quota(runs: DataFrame, limit: int = DAY_LIMIT, delay: str = "10 minutes") -> DataFrame:
    """(user_id, id, used, accepted) of runs(user_id, id, started_at), by event time."""
    return in_event_time(runs, "user_id", "started_at", "id", Quota(limit), delay)
