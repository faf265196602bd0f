"""Mergeable sketches, captures, prefixes, feature selection, sequence models."""

import ipaddress
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronflow import drift, sketches
from heronflow.ml import boost, select, sequence
from heronflow.operators import prefixes
from heronflow.sources import pcap


def test_hll_of_windows_is_hll_of_all(spark):
    rows = spark.range(20_000).selectExpr("date_add(date'2024-01-01', cast(id % 10 as int)) as day", "cast(id * 7 % 9001 as string) as v")
    days = sketches.hll_registers(rows, ["day"], "v", 12)
    assert days.groupBy("day").count().agg(F.max("count")).first()[0] <= 4096
    united = sketches.hll_estimates(days.groupBy("register").agg(F.max("rank").alias("rank")).withColumn("k", F.lit(1)), ["k"], 12).first().estimate
    direct = sketches.hll_estimates(sketches.hll_registers(rows, [F.lit(1)], "v", 12).withColumnRenamed("_k0", "k"), ["k"], 12).first().estimate
    assert united == direct and abs(united - 9001) < 3 * 1.04 / 64 * 9001
    for p, n in ((4, 3), (10, 200), (16, 50_000)):
        few = spark.range(n).selectExpr("id as v")
        got = sketches.hll_estimates(sketches.hll_registers(few, [F.lit(1)], "v", p).withColumnRenamed("_k0", "k"), ["k"], p).first().estimate
        assert abs(got - n) <= max(1.0, 4 * 1.04 / 2 ** (p / 2) * n)


def test_heavy_hitters_lose_none(spark):
    pick = random.Random(4)
    values = [f"hot{k}" for k in range(5) for _ in range(400)] + [f"v{pick.randrange(3000)}" for _ in range(8000)] + [None] * 50
    pick.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    summary = sketches.frequent_summary(df, "v", 40)
    assert summary.count() <= 6 * 40 + 1
    lost = summary.agg(F.sum("lost")).first()[0]
    assert lost <= 10_000 / 41
    got = {r.v: (r.n, r.low <= r.n <= r.high) for r in sketches.heavy_hitters(df, "v", 0.03).collect()}
    assert got == {f"hot{k}": (400, True) for k in range(5)}
    assert sketches.heavy_hitters(df.where("v is null"), "v", 0.1).collect() == []


def test_drift_sketches(spark):
    make = np.random.default_rng(1)
    rows = [(k % 4, float(a), float(b)) for k, (a, b) in enumerate(zip(make.normal(size=4000), make.normal(0.5, 1, size=4000), strict=True))]
    df = spark.createDataFrame(rows, "day int, a double, b double")
    days = drift.quantile_sketches(df, ["a", "b"], ["day"])
    assert days.count() == 8
    base = drift.united(days.where("column = 'a'"))
    same, moved = (drift.sketch_psi(base, base.withColumn("column", F.lit("a")) if c == "a" else drift.united(days.where("column = 'b'")).withColumn("column", F.lit("a"))).first().psi for c in "ab")
    assert same < 0.001 and 0.15 < moved < 0.4
    d = drift.sketch_ks(base, drift.united(days.where("column = 'b'")).withColumn("column", F.lit("a"))).first()
    exact = drift.ks_distance(df.select(F.col("a").alias("v")), df.select(F.col("b").alias("v"))).first().d
    assert abs(d.d - exact) <= d.error < 0.03


def test_pcap_ranges_and_captures_in_captures(spark, tmp_path):
    """Payloads that are captures themselves lead the search astray; the walk
    from the range before puts it right."""
    pick = random.Random(2)
    inner = pcap.to_pcap([(k * 1_000_000, bytes([k])) for k in range(200)])[24:]
    packets = [(k * 1_000_003, inner if k % 5 == 0 else pick.randbytes(pick.randrange(0, 300))) for k in range(300)]
    (tmp_path / "a.pcap").write_bytes(pcap.to_pcap(packets))
    (tmp_path / "cut.pcap").write_bytes(pcap.to_pcap(packets[:3] + [(5, b"y" * 60)])[:-10])
    (tmp_path / "odd.pcap").write_bytes(b"nothing of the kind")
    (tmp_path / "empty.pcap").write_bytes(b"")
    for size in (1 << 20, 9000):
        rows = pcap.read_pcap(spark, str(tmp_path), size).collect()
        got = sorted((r.ts, bytes(r.data)) for r in rows if r.interface == "a.pcap")
        assert [d for _, d in got] == [d for _, d in packets]
        assert len([r for r in rows if r.interface == "cut.pcap"]) == 3 and {r.interface for r in rows} == {"a.pcap", "cut.pcap"}


def test_pcap_sink_and_stream(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(500).selectExpr("timestamp_micros(id * 1000001) as ts", "case when id % 100 = 7 then null else cast(repeat('z', cast(id as int)) as binary) end as data")
    pcap.write_pcap(rows.repartition(4), out)
    pcap.write_pcap(rows.limit(3), out)
    assert pcap.read_pcap(spark, out).count() == 498 and not list((tmp_path / "out").glob("_temporary*"))
    pcap.write_pcap(rows.limit(2), out, "overwrite")
    assert pcap.read_pcap(spark, out).count() == 2
    q = pcap.stream_pcap(spark, out).writeStream.format("memory").queryName("captured").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("captured").count() == 2


ADDRESSES = ["1.2.3.4", "255.255.255.255", "::", "::1", "1::", "2001:db8::8:800:200c:417a", "FE80::1", "::ffff:10.1.2.3", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:7:8", "1::2::3", "1:2:3", "256.1.1.1", "1.2.3", "g::1", "12345::", "1:2:3:4:5:6:7:8:9", "", None, ":1", "1:", ":::"]


def test_addresses(spark):
    def want(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        return f"{int(a) if a.version == 6 else int(a) + 0xFFFF00000000:032x}"

    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string")
    assert {r.a: r.h for r in df.select("a", prefixes.address_hex(F.col("a")).alias("h")).collect()} == {a: want(a) if a else None for a in ADDRESSES}


@pytest.mark.parametrize("small", [200_000, 0])
def test_longest_prefix(spark, small):
    pick = random.Random(8)
    nets = {ipaddress.ip_network((pick.getrandbits(128) >> (128 - n) << (128 - n) if n else 0, n)) for n in (0, 1, 3, 7, 64, 127, 128)}
    base = pick.getrandbits(128)
    nets |= {ipaddress.ip_network((base >> (128 - n) << (128 - n), n)) for n in range(1, 129, 6)}
    asked = [str(ipaddress.IPv6Address(base ^ (1 << k))) for k in range(0, 128, 5)] + ["10.0.0.1", "no address", None]
    df = spark.createDataFrame([(a, 1) for a in asked + asked[:2]], "ip string, n int")
    table = spark.createDataFrame([(str(n), n.prefixlen) for n in nets] + [("10.0.0.0/8", 8)], "prefix string, len int")
    got = {r.ip: r.len for r in prefixes.longest_prefix_join(df, "ip", table, small).collect()}

    def longest(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        return 8 if a.version == 4 else max((n.prefixlen for n in nets if a in n), default=None)

    assert got == {a: longest(a) if a else None for a in asked}
    assert prefixes.longest_prefix_join(df, "ip", table, small).count() == len(asked) + 2


def test_mutual_information(spark):
    rows = [(k % 2, float(k % 2), float(k % 7), None if k % 2 else 1.0) for k in range(1400)]
    df = spark.createDataFrame(rows, "label int, same double, other double, missing double")
    got = {r.feature: r.information for r in select.mutual_information(df, ["same", "other", "missing"], "label").collect()}
    assert abs(got["same"] - np.log(2)) < 1e-9 and abs(got["missing"] - np.log(2)) < 1e-9 and got["other"] < 1e-3
    assert select.mutual_information(df, ["same", "other"], "label", top=1).first().feature == "same"


def test_autoregression_finds_what_the_deviation_does_not(spark):
    """A wave of large swing: a value in its range but at the wrong time."""
    make = np.random.default_rng(6)
    rows, odd = [], set()
    for d in range(6):
        wave = 100 * np.sin(np.arange(400) * 0.6) + make.normal(0, 2, 400)
        for k in (97, 211, 305):
            wave[k] = -wave[k] if abs(wave[k]) > 30 else 60.0
            odd.add((d, k))
        rows += [(d, k, float(v)) for k, v in enumerate(wave)]
    df = spark.createDataFrame(rows, "d int, k int, v double")
    model = sequence.fit(df, "v", ["d"], ["k"], 3)
    x = [(v3, v2, v1, v0) for (d3, _, v3), (_, _, v2), (_, _, v1), (d0, _, v0) in zip(rows, rows[1:], rows[2:], rows[3:], strict=False) if d3 == d0]
    a = np.array([[1, r[2], r[1], r[0]] for r in x])
    want = np.linalg.lstsq(a, np.array([r[3] for r in x]), rcond=None)[0]
    assert np.allclose([model.intercept, *model.weights], want, rtol=1e-6, atol=1e-6)
    scored = sequence.score(df, model, "v", ["d"], ["k"])
    plain = df.withColumn("anomaly_score", boost.window_zscore("v", ["d"], ["k"], 8))

    def hits(frame):
        top = frame.orderBy(F.desc("anomaly_score")).limit(len(odd)).collect()
        return len({(r.d, r.k) for r in top} & odd)

    assert hits(scored) > hits(plain) and hits(scored) >= 9
    assert sequence.fit(df.where("d > 9"), "v", ["d"], ["k"], 2).weights == [0.0, 0.0]


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap.to_pcap([(k, b"x" * 50) for k in range(2000)]))
    rows = pcap.read_pcap(spark, str(tmp_path), 512)
    assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and rows.count() == 2000
