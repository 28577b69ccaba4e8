"""Streaming forms over arriving files: replays, states across batches, and their plain counterparts."""

from __future__ import annotations

import random
import time
from pathlib import Path
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteloom.streaming import event_time as ET
from siteloom.streaming import keyed as K
from siteloom.streaming import runs as ST


class Arrivals:
    """A folder in which rows arrive; run() lets a stream catch up and returns all that it has put out."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.at, self.schema, self.n = spark, tmp_path, schema, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).repartition(2).write.mode("append").parquet(f"{self.at}/in")

    def source(self):
        return self.spark.readStream.schema(self.spark.createDataFrame([], self.schema).schema).parquet(f"{self.at}/in")

    def run(self, make):
        made = make(self.source())
        made.writeStream.format("parquet").option("checkpointLocation", f"{self.at}/state").trigger(availableNow=True).start(f"{self.at}/out").awaitTermination()
        return self.spark.read.schema(made.schema).parquet(f"{self.at}/out")


HOUR = 3_600_000_000


def stream_in_event_time(spark, tmp_path, rows, schema, time, make, seed, parts=3):
    """rows (with microseconds in `us`) dealt over micro-batches, up to an hour out of order."""
    rng = random.Random(seed)
    box = Arrivals(spark, tmp_path, schema)
    plain = box.source
    arrival = sorted(rows, key=lambda r: r[-1] + rng.randint(0, HOUR - 1))
    cut = -(-len(arrival) // parts)
    box.source = lambda: plain().withColumn(time, F.timestamp_micros("us"))
    with ET.ordered_state(spark):
        for k in range(0, len(arrival), cut):
            box.add(arrival[k : k + cut])
            out = box.run(lambda s: make(s, "1 hour"))
    settled = (max(r[-1] for r in rows) // 1000 - 3_600_000) * 1000
    return out.collect(), settled


def steps(machine, rows, settled):
    """A machine over rows (us, tie, *values) in order: what in_event_time must put out."""
    state, out = None, []
    for us, _, *values in [*sorted(rows), (settled + 1, None)]:
        while state is not None and (at := machine.deadline(state)) is not None and at < us and at <= settled:
            state, made = machine.expire(state, at)
            out += made
        if us <= settled:
            state, made = machine.row(state, us, tuple(values))
            out += made
    return out


@pytest.mark.parametrize("name", ["lifecycle", "stuck"])
def test_runs_in_event_time(spark, tmp_path, name):
    rng = random.Random(7)
    rows = [(rng.randint(1, 5), k, rng.choice(["created", "claimed", "returned", "completed", "failed", "claimed", "created"]), rng.randint(0, 9 * HOUR)) for k in range(240)]
    make = {"lifecycle": ET.run_lifecycle, "stuck": ET.stuck_in_stream}[name]
    machine = {"lifecycle": ET.Lifecycle(3 * HOUR), "stuck": ET.Stuck(3 * HOUR)}[name]
    got, settled = stream_in_event_time(spark, tmp_path, rows, "run_id long, event_id long, event string, us long", "at", lambda s, delay: make(s, delay, 3 * HOUR), 1)
    want = [(k, *r) for k in range(1, 6) for r in steps(machine, [(us, i, i, e) for run, i, e, us in rows if run == k], settled)]
    plain = lambda r: tuple(str(x) for x in r)
    assert len(got) > 5 and sorted(map(plain, got)) == sorted(map(plain, want))


def test_lifecycle_by_hand():
    machine = ET.Lifecycle()
    got = steps(machine, [(2, 2, 2, "claimed"), (1, 1, 1, "created"), (3, 3, 3, "returned"), (4, 4, 4, "claimed"), (5, 5, 5, "completed"), (6, 6, 6, "failed")], 10)
    assert got == [(1, "created", "pending", 0, True), (2, "claimed", "processing", 1, True), (3, "returned", "pending", 1, True), (4, "claimed", "processing", 2, True), (5, "completed", "completed", 2, True), (6, "failed", "completed", 2, False)]


def test_stuck_by_hand():
    minute = 60_000_000
    rows = [(0, 1, 1, "created"), (9 * minute, 2, 2, "claimed"), (24 * minute, 3, 3, "returned"), (25 * minute, 4, 4, "claimed")]
    got = steps(ET.Stuck(), rows, 100 * minute)
    assert [(r[0].value // 1000, *r[1:]) for r in got] == [(40 * minute + 1, "processing", 2, "requeue")]
    assert [r[1:] for r in steps(ET.Stuck(), [(0, 1, 1, "created")], 10 * minute)] == []
    assert [r[1:] for r in steps(ET.Stuck(), [(0, 1, 1, "created")], 11 * minute)] == [("pending", 0, "requeue")]


def test_quota_is_a_rolling_day(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(1, 3), k, rng.randint(0, 80 * HOUR)) for k in range(150)]
    got, settled = stream_in_event_time(spark, tmp_path, rows, "user_id long, id long, us long", "started_at", lambda s, delay: ET.quota(s, 2, delay), 2)
    want = [(u, *r) for u in (1, 2, 3) for r in steps(ET.Quota(2), [(us, i, i) for user, i, us in rows if user == u], settled)]
    assert len(got) > 100 and sorted(map(tuple, got)) == sorted(want)
    by_hand = [(0, 1, 1), (HOUR, 2, 2), (2 * HOUR, 3, 3), (24 * HOUR, 5, 5), (24 * HOUR + 1, 6, 6), (25 * HOUR, 7, 7)]
    assert steps(ET.Quota(2), by_hand, 99 * HOUR) == [(1, 1, True), (2, 2, True), (3, 2, False), (5, 2, True), (6, 2, False), (7, 2, True)]


class Handle:
    """A state store of one part in memory, which counts the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getListState(self, name, schema):  # noqa: N802
        return Cell(self, [])

    def getValueState(self, name, schema):  # noqa: N802
        return Cell(self, None)

    def registerTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.calls += 1
        self.timers.remove(ms)


class Cell:
    def __init__(self, handle, empty):
        self.handle, self.empty, self.value = handle, empty, empty

    def get(self):
        self.handle.calls += 1
        return self.value

    def put(self, value):
        self.handle.calls += 1
        self.value = value

    update = put

    def appendList(self, rows):  # noqa: N802
        self.put([*self.value, *rows])

    def clear(self):
        self.put(self.empty)


def test_keys_of_a_part_share_the_calls_of_its_state():
    columns = pa.schema([(ET.KEY, pa.string()), ("us", pa.int64()), ("tie", pa.int64()), ("id", pa.int64())])
    rows = [(f"={n % 300}", HOUR * (n // 300 + 1), n, n) for n in range(900)]
    handle, clock = Handle(), SimpleNamespace(getCurrentWatermarkInMs=lambda: 2 * HOUR // 1000)
    part = ET.InOrder(ET.Quota(1), columns)
    part.init(handle)
    for half in (rows[450:], rows[:450]):
        assert list(part.handleInputRows((0,), iter([pd.DataFrame(half, columns=columns.names)]), clock)) == []
    assert handle.timers == {HOUR // 1000}
    handle.timers.clear()
    (made,) = part.handleExpiredTimer((0,), clock, None)
    assert sorted(made.itertuples(index=False, name=None)) == sorted((k, i, 1, us == HOUR) for k, us, i, _ in rows if us <= 2 * HOUR)
    assert handle.timers == {3 * HOUR // 1000} and handle.calls < 25


def test_event_time_keeps_keys_as_they_are(spark, tmp_path):
    """Text keys, an empty one and a null one, with all of them in one part."""
    keys = ["", None, "=", "a b"]
    rows = [(keys[n % 4], n, HOUR * (n + 1)) for n in range(40)]
    make = lambda s, delay: ET.in_event_time(s, "user_id", "started_at", "id", ET.Quota(2), delay, parts=1)
    got, settled = stream_in_event_time(spark, tmp_path, rows, "user_id string, id long, us long", "started_at", make, 5)
    want = [(u, *r) for u in keys for r in steps(ET.Quota(2), [(us, i, i) for user, i, us in rows if user == u], settled)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_session_setting_comes_back(spark):
    before = spark.conf.get(ET.STORE, None)
    with ET.ordered_state(spark):
        assert spark.conf.get(ET.STORE) == ET.ROCKSDB
    assert spark.conf.get(ET.STORE, None) == before


def test_page_changes(spark, tmp_path):
    box = Arrivals(spark, tmp_path, "norm_url string, seen_id long, hash string")
    make = lambda s: ST.page_changes(s, ttl=None)
    box.add([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, "")])
    box.run(make)
    box.add([("a", 5, "y"), ("a", 6, "x"), ("b", 7, "")])
    got = {r["seen_id"]: (r["hash"], r["change"]) for r in box.run(make).collect()}
    assert got == {1: ("x", "new"), 3: ("y", "changed"), 4: ("", "new"), 6: ("x", "changed")}


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path, "data").rglob("*.parquet")}


def test_a_replayed_batch_keeps_its_publications(spark, tmp_path):
    schema = "run_id long, target_id long, status string"
    table = K.KeyedTable(spark, f"{tmp_path}/published", schema, ["run_id", "target_id"], 4)
    table.merge(spark.createDataFrame([(9, 9, "failed")], schema), -1, lambda held, new: new)
    publish = K.idempotent_publish(table)
    first = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (9, 9, "z")], "run_id long, target_id long, more string")
    for batch_id, rows in ((0, first), (0, first), (1, first), (2, spark.createDataFrame([(2, 1), (1, 1)], "run_id long, target_id long")), (2, first)):
        publish(rows, batch_id)
    assert sorted(map(tuple, table.read(before=2).collect())) == [(1, 1, "published"), (9, 9, "failed"), (9, 9, "published")]
    publish(spark.createDataFrame([(2, 1), (1, 1)], "run_id long, target_id long"), 2)
    assert sorted(map(tuple, table.read().where("status = 'published'").select("run_id", "target_id").collect())) == [(1, 1), (2, 1), (9, 9)]


def test_upserts_rewrite_only_what_they_hit(spark, tmp_path):
    rng, held = random.Random(5), {}
    table = K.KeyedTable(spark, f"{tmp_path}/t", "id long, a long, b string", ["id"], 8)
    assert table.read().collect() == []
    upsert = K.latest_wins(table, ["a"], "at")
    for batch in range(4):
        rows = [(rng.randint(0, 400 if batch == 0 else 5), k, rng.choice([None, 1, 2]), rng.choice("xyz")) for k in range(300 if batch == 0 else 6)]
        frame = spark.createDataFrame(rows, "id long, at long, a long, b string")
        before = files(table.path)
        upsert(frame, batch)
        after, versions = files(table.path), table.versions()
        assert before.items() <= after.items()
        hit = {r[0] for r in frame.select(table.part()).collect()}
        assert {k for k, v in versions.items() if v == batch} == hit
        new = {i: (a, b) for i, _, a, b in sorted(rows, key=lambda r: r[1])}
        for i, (a, b) in new.items():
            held[i] = (a, held[i][1] if i in held else b)
        assert {r["id"]: (r["a"], r["b"]) for r in table.read().collect()} == held
        upsert(frame, batch)
        assert table.versions() == versions and {r["id"]: (r["a"], r["b"]) for r in table.read().collect()} == held


def test_a_batch_without_a_manifest_is_not_read(spark, tmp_path):
    table = K.KeyedTable(spark, f"{tmp_path}/t", "id long", ["id"], 2)
    one = spark.createDataFrame([(1,)], "id long")
    table.merge(one, 0, lambda held, new: new)
    table.merge(spark.createDataFrame([(2,), (3,)], "id long"), 1, lambda held, new: held.union(new))
    Path(table.path, "manifest/1/_SUCCESS").unlink()
    assert [r["id"] for r in table.read().collect()] == [1]


@pytest.mark.parametrize("delay", ["10 seconds"])
def test_hours_close_behind_the_watermark(spark, tmp_path, delay):
    import datetime as dt

    box = Arrivals(spark, tmp_path, "id long, website_id long, started_at timestamp, status string")
    make = lambda s: ST.hourly_run_stats(s, delay)
    box.add([(1, 1, dt.datetime(2024, 1, 1, 1, 5), "completed"), (2, 1, dt.datetime(2024, 1, 1, 1, 59), "failed")])
    box.run(make)
    box.add([(3, 1, dt.datetime(2024, 1, 1, 3, 0), "completed"), (4, 1, dt.datetime(2024, 1, 1, 1, 30), "completed")])
    got = box.run(make).collect()
    assert [(r["bucket_start"].hour, r["runs"], r["completed"], r["failed"]) for r in got] == [(1, 3, 2, 1)]


def test_late_rows_are_counted_and_gaps_filled(spark, tmp_path):
    import datetime as dt

    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    box = Arrivals(spark, tmp_path, "id long, website_id long, started_at timestamp, status string")
    make = lambda s: ST.hourly_run_stats(s, "10 seconds")
    dropped = ST.Dropped()
    spark.streams.addListener(dropped)
    box.add([(1, 1, at(1, 5), "completed"), (2, 1, at(4, 0), "failed"), (3, 2, at(2, 0), "failed")])
    box.run(make)
    box.add([(4, 1, at(1, 7), "completed"), (5, 2, at(2, 9), "failed"), (6, 2, at(2, 10), "failed"), (7, 1, at(6, 0), "completed")])
    made = box.run(make)
    late = ST.late_rows(spark.read.schema(box.source().schema).parquet(f"{box.at}/in"), made, F.lit(at(6, 0)))
    assert sorted((r["website_id"], r["bucket_start"].hour, r["late"]) for r in late.collect()) == [(1, 1, 1), (2, 2, 2)]
    for _ in range(100):
        if dropped.counts:
            break
        time.sleep(0.1)
    spark.streams.removeListener(dropped)
    assert sum(r["dropped"] for r in dropped.table(spark).collect()) == 2  # of website 2, two rows in one group
    sites = spark.createDataFrame([(1,), (2,), (3,)], "website_id long")
    filled = {(r["website_id"], r["bucket_start"].hour): r["runs"] for r in ST.filled_hours(sites, made, F.lit(at(1, 0)), F.lit(at(5, 0))).collect()}
    assert filled == {(s, h): int((s, h) in {(1, 1), (1, 4), (2, 2)}) for s in (1, 2, 3) for h in (1, 2, 3, 4)}


def test_arriving_parts_hold_each_row_once(spark):
    """The parts are read apart, so that rows whose order is told anew by every reading must not be lost or doubled."""
    from siteloom.plans import run_queries as RQ

    drawn = F.udf(lambda k: random.randrange(1000), "long").asNondeterministic()
    rows = spark.range(400).withColumn("o", drawn("id"))
    got = [r["id"] for r in RQ._to_end(spark, rows, "o", lambda s: s.select("id")).collect()]
    assert sorted(got) == list(range(400))
