"""Streams that keep state, and keyed tables, beyond what their queries show."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from heronflow.sources.versioned import KeyedTable, change_status
from heronflow.streaming import enrich, merge, profiles

SCHEMA = "device_id bigint, ts timestamp_ntz, payload_size bigint, protocol string"


def day(n, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


def test_profiles_leave_no_state_behind(spark, tmp_path):
    rows = [(d, day(k, d % 24), 10, "TCP" if k % 2 else "UDP") for d in range(20) for k in (0, 1, 2, 9)] + [(1, day(0), 5, "TCP")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(profiles.PROVIDER)
    spark.conf.set(profiles.PROVIDER, profiles.ROCKS)
    try:
        def run():
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            q = profiles.daily_profiles(stream, 5, "1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
            q = q.trigger(availableNow=True).start()
            q.awaitTermination()
            return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]

        full = run()
        for later in (100, 101):  # the first closes the days, and the profiles' own timers fire with the second
            spark.createDataFrame([(99, day(later), 1, "TCP")], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
            late = run()
    finally:
        spark.conf.set(profiles.PROVIDER, before)
    assert max(full) > 40 and late[-1] < 12  # of all devices only the last one is left
    got = {(r.device_id, r.day): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    first = (day(0).date() - dt.date(1970, 1, 1)).days
    assert len(got) == 80 and got[1, first].observations == 2 and got[1, first].tcp == 1
    assert got[4, first + 2].profile_observations == 3 and got[4, first + 9].profile_observations == 1


class Held:
    """A handle of one device that counts what is asked of it."""

    def __init__(self):
        self.timers, self.calls, self.states = set(), 0, []

    def getValueState(self, *_):
        def call(f):
            def counted(*a):
                self.calls += 1
                return f(*a)

            return counted

        held = [None]
        put = lambda v: held.__setitem__(0, v)
        self.states.append(held)
        return SimpleNamespace(get=call(lambda: held[0]), update=call(put), clear=call(lambda: put(None)))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_state_of_profiles_is_read_once_a_device_and_batch():
    """Not once a day of the device, which took most of the time on large tables."""
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    one, held = profiles.DeviceProfiles(5), Held()
    one.init(held)
    rows = lambda days: iter([(None, 7, d, 10, d % 2) for d in days for _ in range(3)] + [(None, 7, None, 1, 1), (None, 7, days[0], None, None)])
    list(one.handleInputRows((7,), rows([5, *range(30, 60)]), None))
    list(one.handleInputRows((7,), rows([*range(20), *range(30, 60)]), None))
    assert held.calls <= 11 and held.timers == {1 * profiles.DAY_MS}

    def fire(watermark):
        at = min(held.timers)
        assert at <= watermark * profiles.DAY_MS
        out = list(one.handleExpiredTimer((7,), TimerValues(0, watermark * profiles.DAY_MS), ExpiredTimerInfo(at)))
        held.timers.remove(at)
        return out

    calls = held.calls
    assert [tuple(r) for r in fire(2)] == [(7, 0, 4, 30, 0, 1, 4, 30), (7, 1, 3, 30, 3, 2, 7, 60)]
    out = {r[1]: tuple(r)[2:] for r in fire(60)}
    assert held.calls - calls <= 12 and sorted(out) == [*range(2, 20), *range(30, 60)]
    assert out[5][:3] == (7, 60, 6) and out[19][3] == 20 and out[30] == (6, 60, 0, 1, 6, 60) and out[59][3] == 30
    assert held.timers == {66 * profiles.DAY_MS} and fire(66) == [] and held.states == [[None]] * 3 and not held.timers


def test_records_without_partner_and_times_apart(spark, tmp_path):
    fields = "ts timestamp_ntz, k bigint, v string, seq bigint"
    one = [(day(0), 1, "a", 1), (day(0), 1, "b", 2), (day(1), 2, "c", 1), (day(90), 0, None, 1)]
    two = [(day(0, 1), 1, "x", 1), (day(2), 3, "y", 1), (day(90), 0, None, 1)]
    streams = []
    for name, rows in (("one", one), ("two", two)):
        spark.createDataFrame(rows, fields).coalesce(1).write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(fields).parquet(str(tmp_path / name)))
    out = merge.merged(*streams, ["v"], "seq", "1 day", apart="2 hours", keys=["k"])
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.k, r.v, r.side) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "b", "both"), (2, "c", "first"), (3, "y", "second")}


def test_a_repeated_batch_takes_its_version_again(spark, tmp_path):
    dimension = KeyedTable(spark, str(tmp_path / "dim"), ["key"], 4)
    dimension.merge(spark.createDataFrame([(1, "old", 1)], "key int, name string, at int"), "at")
    pins = KeyedTable(spark, str(tmp_path / "pins"), ["batch"], 1)
    run = enrich.enrich_batch(dimension, pins, "key", str(tmp_path / "out"))
    batch = spark.createDataFrame([(1,), (2,)], "key int")
    run(batch, 0)
    dimension.merge(spark.createDataFrame([(1, "new", 2), (2, "two", 2)], "key int, name string, at int"), "at")
    run(batch, 0)
    run(batch, 1)
    got = sorted((r.batch, r.key, r.name or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 1, "old"), (0, 2, ""), (1, 1, "new"), (1, 2, "two")]


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["a", "b"], 4)
    with pytest.raises(ValueError, match="no version"):
        table.read()
    fields = "a int, b string, status string, at int, gone boolean"
    make = lambda *rows: spark.createDataFrame(rows, fields)
    assert table.merge(make(*((k, "x", "open", 1, False) for k in range(50))), "at", "gone", ("s", 1)) == 1
    parts = table.manifest()["parts"]
    assert table.merge(make((3, "x", "open", 1, None), (3, "x", "done", 2, None), (4, "x", None, 1, True), (99, "x", "z", 1, True)), "at", "gone", ("s", 2)) == 2
    kept = [b for b, p in table.manifest()["parts"].items() if parts.get(b) == p]
    assert kept, "buckets that no change touches stay as they are"
    assert table.merge(make((3, "x", "never", 9, None)), "at", "gone", ("s", 2)) == 2  # taken before
    rows = {r.a: r.status for r in table.read().collect()}
    assert len(rows) == 49 and rows[3] == "done" and 4 not in rows
    assert table.read(1).count() == 50  # older versions stay
    with pytest.raises(Exception, match="(?i)exist"):
        table._commit({**table.manifest(), "version": 2})  # another writer was first
    assert change_status(table, spark.createDataFrame([(5, "x", "acknowledged", 1), (6, "x", "closed", 1), (77, "x", "resolved", 1)], "a int, b string, status string, at int"), "at") == 3
    assert {r.a: r.status for r in table.read().where(F.col("a").isin(5, 6, 77)).collect()} == {5: "acknowledged", 6: "open"}
    assert table.merge(make(*((k, "x", None, 5, True) for k in range(50))), "at", "gone") == 4
    assert table.read().count() == 0


def test_steps_of_a_batch_that_comes_again(spark, tmp_path):
    from heronflow.sources.sinks import each_batch, merging

    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 2)
    seen = []
    run = each_batch(merging(table, "at", "s"), lambda b, n: seen.append((n, b.count())))
    run(spark.createDataFrame([(1, "a", 1)], "k int, v string, at int"), 0)
    run(spark.createDataFrame([(1, "b", 2), (2, "c", 2)], "k int, v string, at int"), 1)
    run(spark.createDataFrame([(1, "never", 9)], "k int, v string, at int"), 1)
    assert {r.k: r.v for r in table.read().collect()} == {1: "b", 2: "c"} and table.versions() == [1, 2] and len(seen) == 3


def test_messages_that_come_twice_on_a_stream(spark, tmp_path):
    from heronflow.sources import transport

    rows = spark.range(20).selectExpr("cast(id as string) as message_id", "'high' as priority", "struct(id as value) as payload", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id) as ts")
    sent = transport.to_mqtt(rows)
    sent.union(sent.limit(5)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sent.schema).parquet(str(tmp_path / "in"))
    q = transport.from_mqtt(stream, "struct<value:bigint>").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 20


def test_profile_store_has_few_files_for_many_devices(spark, tmp_path):
    from heronflow import history

    fields = "device_id string, protocols array<string>, observations bigint"
    rows = [(f"aa:{k}", ["TCP"], k) for k in range(400)] + [("aa-1", ["UDP"], 7), (None, None, 9)]
    history.save_profiles(spark.createDataFrame(rows, fields), str(tmp_path / "p"))
    history.save_profiles(spark.createDataFrame([("aa:1", ["ICMP"], 0), ("new", None, 1)], fields), str(tmp_path / "p"))
    got = {r.device_id: (r.protocols, r.observations) for r in history.load_profiles(spark, str(tmp_path / "p"), fields).collect()}
    assert got == {d: (p, n) for d, p, n in rows} | {"aa:1": (["ICMP"], 0), "new": (None, 1)}
    manifest = history._profile_table(spark, str(tmp_path / "p")).manifest()
    assert len(manifest["parts"]) <= 64 and len(list(tmp_path.rglob("data-*/*/*.parquet"))) < 200
