"""Hand-computed cases of the operators, and properties that hold for any data."""

import datetime as dt
import math
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heronflow import alerts, detect, drift, enrich, features, flows, profiles, registry, rules, schemas, sketches
from heronflow.functions import dns_tls
from heronflow.ml import evaluate, forest, preprocess
from heronflow.sources import logs, transport

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)
FLOW = "flow_id string, ts timestamp_ntz, device_id string, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, bytes_sent bigint, bytes_received bigint, packets_sent bigint, packets_received bigint, duration_ms bigint"
QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def flow_rows(n, step=10, **over):
    base = {"device_id": "d", "source_ip": "10.0.0.1", "source_port": 1000, "protocol": "TCP", "bytes_sent": 1000, "bytes_received": 500, "packets_sent": 10, "packets_received": 5}
    rows = []
    for k in range(n):
        r = base | {"flow_id": f"f{k}", "ts": T0 + dt.timedelta(seconds=step * k), "destination_ip": f"192.0.2.{k}", "destination_port": 80 + k, "duration_ms": 500 if k % 2 == 0 else 2000} | {a: (b[k] if isinstance(b, list) else b) for a, b in over.items()}
        rows.append(tuple(r[c.split()[0]] for c in FLOW.split(", ")))
    return rows


def test_directional_and_timing_cases(spark):
    three = spark.createDataFrame(flow_rows(3), FLOW)
    d = features.directional(three).first()
    assert d.avg_fan_out == 3.0 and d.protocol_diversity == 1.0 and d.avg_fan_in == 0.0
    t = features.timing(spark.createDataFrame(flow_rows(4), FLOW), ["device_id"]).first()
    assert (t.inter_arrival_mean, t.inter_arrival_std, t.burst_ratio) == (10.0, 0.0, 0.5) and t.periodicity_score > 0.5
    assert features.timing(spark.createDataFrame(flow_rows(1), FLOW), ["device_id"]).first().inter_arrival_mean == 0.0


def test_directional_nulls_and_none(spark):
    rows = [("a", "b", 1, 80, "TCP"), ("a", "b", 2, 80, "TCP"), ("a", None, 3, 80, "UDP"), ("b", "a", 4, 80, None), (None, "a", None, 80, "TCP")]
    df = spark.createDataFrame(rows, "source_ip string, destination_ip string, source_port int, destination_port int, protocol string")
    d = features.directional(df).first()
    assert (d.avg_fan_out, d.avg_fan_in, d.fan_out_ratio, d.fan_in_ratio) == (1.0, 4 / 3, 3 / 5, 4 / 5)
    assert abs(d.src_port_entropy - math.log2(5)) < 1e-9 and d.dst_port_entropy == 0.0 and d.protocol_diversity == 2.0
    none = features.directional(df.where("false")).first()
    assert none.avg_fan_out is None and none.protocol_entropy is None and none.protocol_diversity == 0.0


def test_flow_assembly_cases(spark):
    schema = "packet_id bigint, ts timestamp_ntz, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, payload_size bigint, tcp_flags array<string>, tcp_sequence_number bigint"
    rows = [(k, T0 + dt.timedelta(seconds=k), "a", "b", 1, 2, "TCP", 100, ["SYN"] if k == 0 else ["ACK", "FIN"], [5, 5, 0, None][k]) for k in range(4)] + [(9, T0, "a", "b", 1, 2, "GRE", 1, None, None), (10, T0, "", "b", 1, 2, "UDP", 1, None, None)]
    (r,) = flows.assemble_flows(spark.createDataFrame(rows, schema)).collect()
    assert (r.bytes_sent, r.packets_sent, r.duration_ms, r.retransmissions, r.tcp_flags, r.syn_fin_ratio) == (400, 4, 3000, 1, ["ACK", "FIN", "SYN"], 1.0)
    assert (r.inter_arrival_mean_ms, r.inter_arrival_std_ms) == (1000.0, 0.0)


def test_session_border(spark):
    rows = [(T0 + dt.timedelta(seconds=s), "a", "b", 1, 2, "UDP", 10) for s in (0, 20, 41)]
    out = flows.session_flows(spark.createDataFrame(rows, "ts timestamp_ntz, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, payload_size bigint"))
    assert sorted((r.packets, r.duration_ms) for r in out.collect()) == [(1, 1), (2, 20000)]


def test_closed_windows_count_a_border_twice(spark):
    rows = [(T0 + dt.timedelta(minutes=m),) for m in (0, 4, 5, 12)]
    out = features.closed_windows(spark.createDataFrame(rows, "ts timestamp_ntz"), F.lit(T0).cast("timestamp_ntz"), 5)
    assert sorted(r.window_no for r in out.collect()) == [0, 0, 0, 1, 2]


def test_dns_and_tls_cases(spark):
    row = spark.createDataFrame([("example.com", "TLSv1.2", "ja3", None)], "q string, v string, j string, s string")
    d = row.select(*(c.alias(n) for n, c in dns_tls.dns_features(F.col("q")).items())).first()
    assert d.dns_query_length == 11 and d.dns_subdomain_count == 1 and abs(d.dns_query_entropy - 3.095795255000934) < 1e-9
    t = row.select(*(c.alias(n) for n, c in dns_tls.tls_features(F.col("q"), F.col("v"), F.col("j"), F.col("s")).items())).first()
    assert (t.tls_sni_length, t.tls_version_score, t.tls_ja3_present, t.tls_ja3s_present) == (11, 0.8, 1.0, 0.0)
    a = spark.createDataFrame([(["10.1.1.1", "127.0.0.1"], "NXDOMAIN"), ([], "NOERROR")], "a array<string>, c string")
    got = a.select(*(c.alias(n) for n, c in dns_tls.dns_answer_features(F.col("a"), F.col("c")).items())).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.0, 2.0, 0.5), (0.0, 1.0, 0.0, 0.0)]


def test_fusion_of_the_worked_example(spark):
    types = "signature_matches array<struct<rule_id:string,rule_name:string,signature_score:double>>, ml_predictions array<struct<model_name:string,anomaly_score:double>>"
    rows = [([("R", "r", 1.0)], [("a", 0.7)]), ([], []), ([("R", "r", 0.9), ("S", "s", 0.5)], [("a", 0.9), ("b", 0.9)])]
    out = detect.fused(spark.createDataFrame(rows, types)).withColumn("ok", detect.is_consistent()).collect()
    kept = detect.classified(detect.reported(detect.fused(spark.createDataFrame(rows, types))), {"S": "dos", "R": "malware"}, {"S": ["T1"]}).collect()
    assert [(r.attack_category, "T1" in r.mitre_tactics) for r in kept] == [("malware", False), ("malware", True)]
    assert abs(out[0].threat_score - 0.88) < 1e-9 and out[0].severity == "CRITICAL" and not out[0].ok
    assert out[1].threat_score == 0 and not out[1].ok
    assert abs(out[2].signature_score - 0.95) < 1e-9 and abs(out[2].confidence - 1.0) < 1e-9 and out[2].severity == "CRITICAL" and out[2].ok


def test_rules_never_match_on_nothing(spark):
    df = spark.createDataFrame([(None, "x")], "a int, b string")
    for c in ({"field": "a", "operator": "eq", "value": 1}, {"field": "zz", "operator": "eq", "value": 1}, {"field": "b", "operator": "eq", "value": ""}, {"field": "b", "operator": "like", "value": "x"}):
        assert not df.select(rules.matches({"conditions": [c]}, df.columns)).first()[0]
    assert not df.select(rules.matches({"conditions": []}, df.columns)).first()[0]
    assert [r["id"] for r in rules.active([{"id": "a"}, {"id": "b", "enabled": False}, {"id": "c"}], {"a", "b"})] == ["a"]


def test_alert_admission_cases(spark):
    rows = [("d", T0 + dt.timedelta(minutes=m), k, "high", 0.8, 0.9) for k, m in enumerate((0, 3, 5, 9, 10, 16))] + [("d", T0, 9, "low", 0.8, 0.9), ("e", T0, 8, "high", 0.5, 0.9)]
    df = spark.createDataFrame(rows, "device_id string, ts timestamp_ntz, k int, severity string, threat_score double, confidence double")
    out = alerts.cooled_down(df.where(alerts.passes("medium", 0.6, 0.6)), ["device_id"], ["k"], 5)
    assert sorted(r.k for r in out.collect()) == [0, 2, 4, 5]
    assert alerts.hourly_cap(df, ["device_id"], ["ts", "k"], 2).count() == 3


def test_event_validation_and_enrichment(spark):
    schema = "timestamp string, event_type string, threat_score double, bytes_sent bigint, bytes_received bigint, packets_sent bigint, packets_received bigint, duration_ms bigint, source_port int, destination_port int"
    rows = [("2024-01-01T00:00:00Z", "network_flow", None, 1000, 500, 10, 5, 1000, 40000, 443), ("2024-01-01T00:00:00", "threat_detection", 0.5, None, None, None, None, 0, 22, 40000), (None, "other", 2.0, -1, 0, 0, 0, 0, 0, 0)]
    good, bad = enrich.processed(spark.createDataFrame(rows, schema))
    first, second = good.orderBy("event_type").collect()
    assert (first.bytes_total, first.packets_total, first.bytes_per_second, first.packets_per_second, first.service, first.flow_direction) == (1500, 15, 1500.0, 15.0, "https", "outbound")
    assert (second.bytes_per_second, second.service, second.flow_direction) == (None, "ssh", "inbound")
    assert len(bad.first()["errors"]) == 4


def test_device_features_copy_no_rows(spark):
    rows = flow_rows(3, destination_ip="192.0.2.1") + flow_rows(2, destination_ip="192.0.2.2") + flow_rows(2, destination_ip=None)
    out = features.device(spark.createDataFrame(rows, FLOW))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning") == 1
    (got,) = out.collect()
    assert (got.unique_destinations, got.unique_sources, got.communication_diversity) == (2.0, 1.0, 3.0)


def test_profiles_cases(spark):
    mac = spark.createDataFrame([("00-40-8C-11-22-33",), ("b827.eb11.2233",), ("00:40:8c:zz:22:33",), (None,)], "mac string")
    assert sorted((r.vendor or "") for r in profiles.vendor_lookup(mac, profiles.oui_table(spark)).collect()) == ["", "", "Axis Communications", "Raspberry Pi Foundation"]
    made = profiles.created_profiles(mac, spark).collect()
    assert sorted(r.device_type for r in made) == ["camera", "sensor", "unknown", "unknown"] and all(len(r.hour_of_day) == 24 for r in made)
    busy = flow_rows(20, bytes_sent=1000, bytes_received=500, duration_ms=1000, destination_ip="192.0.2.1")
    known = profiles.protocol_baseline(spark.createDataFrame(busy, FLOW)).join(profiles.destinations(spark.createDataFrame(busy, FLOW)), "device_id").join(profiles.bandwidth_baseline(spark.createDataFrame(busy, FLOW), F.lit(0)), "device_id").withColumn("hour_of_day", F.array_repeat(F.lit(0.5), 24))
    odd = flow_rows(1, bytes_sent=150_000, bytes_received=0, duration_ms=1000, protocol="UDP", destination_ip="203.0.113.9")
    assert sorted(r.type for r in profiles.anomalies(spark.createDataFrame(odd, FLOW), known).collect()) == ["bandwidth_anomaly", "destination_anomaly", "protocol_anomaly"]


def test_baselines_in_one_pass_are_those_one_by_one(spark):
    rows = flow_rows(30, destination_ip="192.0.2.1", duration_ms=1000) + flow_rows(1, protocol="udp", destination_ip="192.0.2.2", duration_ms=0) + flow_rows(9, destination_ip="192.0.2.3", duration_ms=500)
    rows += flow_rows(9, device_id="few", destination_ip="192.0.2.9", duration_ms=100) + flow_rows(12, device_id="idle", destination_ip=None, duration_ms=0, protocol="ICMP")
    for k in range(25):
        rows += flow_rows(1, device_id="many", destination_ip=f"192.0.2.{k}", duration_ms=k + 1, protocol=f"P{k}") + flow_rows(1, device_id="nulls", destination_ip="192.0.2.1", protocol=None if k % 2 else "TCP", duration_ms=7)
    df = spark.createDataFrame(rows, FLOW)
    apart = profiles.protocol_baseline(df).join(profiles.destinations(df, 3), "device_id").join(profiles.bandwidth_baseline(df, F.lit(0)), "device_id")
    out = profiles.baselines(df, 3)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    columns = ["device_id", "observations", "normal_protocols", "allowed_destinations", "median_bps", "typical_bandwidth_bps"]
    got, want = (sorted((tuple(r) for r in x.select(columns).collect()), key=repr) for x in (out, apart))
    assert got == want and len(got) == 5


def test_alerts_meet_their_flows_where_they_are(spark, tmp_path):
    """Twins of one id give each alert with each flow, as a join by id does, and flows are made once."""
    from heronflow import plans

    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("needs the driver tables")
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{source}/lineitem.parquet").where("l_orderkey % 5 = 0")
    lines.union(lines.withColumn("l_quantity", F.lit(50.0))).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    out = plans.QUERIES["detection_with_flow"](spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_") == 2  # one for the mean of all
    found = plans.scoring.all_detections(spark, str(tmp_path)).where("severity in ('CRITICAL', 'HIGH')").select("flow_id", "severity")
    want = found.join(plans.scoring.flows(spark, str(tmp_path)), "flow_id").select("flow_id", "severity", "source_ip", "bytes_sent")
    rows = sorted(map(tuple, out.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > len(set(rows))


def test_log_parsers(spark, tmp_path):
    (tmp_path / "conn.log").write_text("#fields\n1700000000.5\tC1\t10.0.0.1\t1234\t10.0.0.2\t80\ttcp\thttp\t1.5\t500\t1000\n1700000001\tC2\t10.0.0.1\t-\t10.0.0.2\t53\tgre\t-\t-\t-\t-\nshort\tline\n")
    (tmp_path / "dns.log").write_text("\t".join(["1700000002", "C3", "10.0.0.1", "5353", "8.8.8.8", "53", "udp", "1", "-", "example.com", "1", "A", "-", "-", "0", "NOERROR", "-", "-", "-", "-", "-", "1.2.3.4,5.6.7.8"]) + "\n")
    conn = logs.conn_log(spark, str(tmp_path / "conn.log")).collect()
    assert [(r.payload_size, r.protocol, r.duration_s, r.ts) for r in conn] == [(1500, "TCP", 1.5, dt.datetime(2023, 11, 14, 22, 13, 20, 500000))]
    both = logs.log_folder(spark, [str(tmp_path / "conn.log"), str(tmp_path / "dns.log"), str(tmp_path / "weird.log")])
    assert {(r.protocol, r.dns_query, tuple(r.dns_answers or ())) for r in both.collect()} == {("TCP", None, ()), ("DNS", "example.com", ("1.2.3.4", "5.6.7.8"))}


def test_eve_lines(spark, tmp_path):
    lines = [
        '{"timestamp":"2024-01-01T00:00:00.000000+0000","event_type":"flow","src_ip":"a","dest_ip":"b","src_port":1,"dest_port":2,"proto":"TCP","flow":{"bytes_toserver":500,"bytes_toclient":1000},"tcp":{"syn":true,"fin":false,"ack":true}}',
        '{"timestamp":"2024-01-01T00:00:01Z","event_type":"dns","src_ip":"a","dest_ip":"b","proto":"UDP","dns":{"rrname":"x.y","rrtype":"A","rcode":"NOERROR","answers":[{"rdata":"1.1.1.1"},{}]}}',
        '{"timestamp":"2024-01-01T00:00:02Z","event_type":"alert","src_ip":"a","dest_ip":"b","proto":"TCP","alert":{"gid":1,"signature_id":7,"signature":"S","severity":"high"}}',
        "{broken",
    ]
    (tmp_path / "eve.json").write_text("\n".join(lines))
    events = logs.eve_events(spark, str(tmp_path / "eve.json"))
    records = {r.protocol: r for r in logs.eve_records(events).collect()}
    assert records["TCP"].payload_size == 1500 and records["TCP"].tcp_flags == ["SYN", "ACK"] and records["UDP"].dns_answers == ["1.1.1.1"]
    (alert,) = logs.eve_alerts(events).collect()
    assert (alert.rule_id, alert.severity, alert.category) == ("1:7", "high", "unknown")
    assert records["TCP"].ts == dt.datetime(2024, 1, 1)


def test_packet_headers(spark):
    v4 = bytes(12) + b"\x08\x00" + bytes([0x45]) + bytes(8) + bytes([6]) + bytes(2) + bytes([10, 0, 0, 1]) + bytes([192, 0, 2, 7]) + (1234).to_bytes(2, "big") + (443).to_bytes(2, "big") + bytes(10)
    v6 = bytes(12) + b"\x86\xdd" + bytes(6) + bytes([58, 64]) + bytes(15) + b"\x01" + bytes(15) + b"\x02"
    arp = bytes(12) + b"\x08\x06" + bytes(28)
    got = logs.parsed_packets(spark.createDataFrame([(bytearray(x),) for x in (v4, v6, arp)], "data binary")).collect()
    assert [(r.protocol, r.source_port, r.destination_port) for r in got] == [("TCP", 1234, 443), ("ICMPv6", None, None)]
    assert (got[0].source_ip, got[0].destination_ip, got[0].length) == ("10.0.0.1", "192.0.2.7", len(v4)) and got[1].destination_ip.endswith("0002")


def test_flow_validation(spark):
    rows = flow_rows(5, source_ip=["10.0.0.1", "::1", "999.1.1.1", "fe80::1:2", "1:2:3"], protocol=["tcp", "UDP", "TCP", "ICMPv6", "TCP"])
    bad = {r.flow_id: r.violations for r in schemas.split_valid(spark.createDataFrame(rows, FLOW), schemas.flow_rules())[1].collect()}
    assert bad == {"f2": ["source_ip"], "f3": ["protocol"], "f4": ["source_ip"]}


def test_p_values():
    assert drift.ks_pvalue(0.0, 100, 100) == 1.0 and abs(drift.ks_pvalue(0.19206, 100, 100) - 0.05) < 0.002
    assert abs(drift.chi_square_pvalue(3.841458820694124, 1) - 0.05) < 1e-9 and abs(drift.chi_square_pvalue(18.307038053275146, 10) - 0.05) < 1e-9


def test_psi_modes(spark):
    a = spark.createDataFrame([(float(k),) for k in range(100)], "v double")
    b = a.where("v < 50")
    assert math.isinf(drift.psi(a, b, 10, None).first().psi) and 1 < drift.psi(a, b).first().psi < 4


@QUICK
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40))
def test_properties_of_drift_and_entropy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert drift.ks_distance(df, df).first().d == 0
    assert abs(drift.js_distance(df.union(spark.createDataFrame([(20.0,)], "v double")), df.union(spark.createDataFrame([(20.0,)], "v double"))).first().js or 0) < 1e-6
    h = features.entropy(df.withColumn("k", F.lit(1)), ["k"], "v").first().entropy
    want = -sum(values.count(x) / len(values) * math.log2(values.count(x) / len(values)) for x in set(values))
    assert abs(h - want) < 1e-9


@QUICK
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=2, max_size=40))
def test_auc_is_the_share_of_pairs(spark, rows):
    if len({t for t, _ in rows}) < 2:
        return
    got = evaluate.auc(spark.createDataFrame([(t, float(s)) for t, s in rows], "t int, s double"), "t", "s").first().auc
    pairs = [(a > b) + (a == b) / 2 for t, a in rows if t for u, b in rows if not u]
    assert abs(got - sum(pairs) / len(pairs)) < 1e-9


def test_sketches_do_not_lose(spark):
    df = spark.createDataFrame([(k % 37,) for k in range(500)], "v int")
    exact = {r.v: r["count"] for r in df.groupBy("v").count().collect()}
    got = {r.v: r.estimate for r in sketches.estimates(df, "v", sketches.count_min(df, "v", 20, 3), 20, 3).collect()}
    assert all(got[v] >= n for v, n in exact.items())
    bits, k = sketches.bloom_size(40, 0.01)
    held = sketches.bloom(df.where("v < 20"), "v", bits, k)
    assert {r.v for r in sketches.maybe_in(df, "v", held, bits, k).collect()} >= set(range(20))
    assert abs(sketches.distinct_estimate(spark.range(20_000), "id").first().estimate - 20_000) < 1200


def test_forest_finds_what_is_far_off(spark):
    rows = [(k, float(k % 10), float(k % 7)) for k in range(400)] + [(1000, 90.0, 90.0)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    scored = forest.score(df, ["a", "b"], forest.fit(df, "id", ["a", "b"], trees=30, sample=128))
    assert scored.orderBy(F.desc("anomaly_score")).first().id == 1000


def test_scaling_and_quarantine(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 4.0), (3.0, float("nan")), (100.0, 8.0)], "a double, b double")
    assert [r.a for r in preprocess.iqr_capped(df.select("a"), ["a"]).collect()][3] < 100
    assert sum(r.a for r in preprocess.scaled(df.select("a"), ["a"], "standard").collect()) == pytest.approx(0, abs=1e-9)
    assert df.where(preprocess.invalid(["a", "b"])).count() == 2


def test_exact_quantiles(spark):
    import random

    import numpy as np

    from heronflow.operators.quantiles import exact_quantiles

    rng = random.Random(1)
    rows = [(rng.choice([None, 1.0, 2.0, rng.gauss(0, 9)]), float(k % 3), None) for k in range(2000)]
    got = exact_quantiles(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], [0.0, 0.25, 0.5, 0.9, 1.0])
    for k, c in enumerate("ab"):
        values = [r[k] for r in rows if r[k] is not None]
        assert all(abs(x - np.quantile(values, q)) < 1e-9 for q, x in got[c].items())
    assert set(got["c"].values()) == {None}


def test_a_busy_key_is_cooled_down_in_parts(spark, monkeypatch):
    import random

    rng = random.Random(2)
    for span in (1, 3, 16):
        monkeypatch.setattr(alerts, "SPAN", span)
        seconds = sorted(rng.sample(range(20_000), 700))
        rows = [("d", T0 + dt.timedelta(seconds=s), k) for k, s in enumerate(seconds)]
        want, last = [], None
        for k, s in enumerate(seconds):
            if last is None or s - last >= 120:
                want.append(k)
                last = s
        out = alerts.cooled_down(spark.createDataFrame(rows, "device_id string, ts timestamp_ntz, k int"), ["device_id"], ["k"], 2)
        assert sorted(r.k for r in out.collect()) == want


def test_rows_are_computed_once_for_the_cooldown(spark):
    """They once were for the times, and again for the rows at these times."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    # Of two rows at one time the first passes; times that are not known never do.
    rows = [("d", T0 + dt.timedelta(minutes=m), k) for k, m in enumerate((0, 3, 3, 1, 6, 6, 9))] + [("d", None, 7), ("e", T0, 8)]
    df = spark.createDataFrame(rows, "device_id string, ts timestamp_ntz, k int")
    out = alerts.cooled_down(df.mapInArrow(count, df.schema), ["device_id"], ["k"], 3)
    assert out.columns == df.columns and sorted(r.k for r in out.collect()) == [0, 1, 4, 6, 8]
    assert seen.value == len(rows)


def test_what_may_be_missing_from_the_entry(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    for folder, path, wanted in ((tmp_path, f"{tmp_path}:{root}", "no_such_module"), (root, f"{root}", "")):
        done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=folder, env={**os.environ, "PYTHONPATH": path}, capture_output=True, text=True)
        assert wanted in done.stderr and bool(done.returncode) == bool(wanted)


def test_registry_changes(spark):
    rows = [("m", "1.9.0", "production"), ("m", "1.10.0", "archived"), ("m", "1.2.0", "archived"), ("n", "1.0.0", "production")]
    df = spark.createDataFrame(rows, "model string, version string, stage string")
    stages = lambda d: {(r.model, r.version): r.stage for r in d.collect()}
    assert stages(registry.promoted(df, "m", "1.2.0"))[("m", "1.9.0")] == "archived"
    back = stages(registry.rolled_back(df, "m"))
    assert back[("m", "1.10.0")] == "production" and back[("m", "1.9.0")] == "archived" and back[("n", "1.0.0")] == "production"
    assert registry.registered(df, df.limit(1)).count() == 4 and registry.without_version(df, "m", "1.9.0").count() == 4


def test_document_queries(spark):
    df = spark.createDataFrame([(1, "Port scan", None), (2, "login", 5), (3, "SCAN again", 9)], "k int, t string, n int")
    find = lambda q: [r.k for r in transport.search(df, q, [("k", "asc")]).collect()]
    assert find({"match": {"t": "scan"}}) == [1, 3] and find({"exists": {"field": "n"}}) == [2, 3] and find({"match_all": {}}) == [1, 2, 3]
    assert find({"bool": {"should": [{"term": {"k": 1}}, {"range": {"n": {"gt": 5}}}], "must_not": [{"term": {"n": 5}}]}}) == [1, 3]


def test_pcap_round_trip(spark, tmp_path):
    from heronflow.sources import pcap

    packets = [(1_700_000_000_000_000 + k, bytes(12) + b"\x08\x00" + bytes([0x45]) + bytes(8) + bytes([17]) + bytes(2) + bytes([10, 0, 0, k]) + bytes([10, 0, 1, k]) + bytes([0, 53, 0, 80])) for k in range(5)]
    (tmp_path / "a.pcap").write_bytes(pcap.to_pcap(packets))
    (tmp_path / "b.pcap").write_bytes(b"nothing of the kind")
    got = logs.parsed_packets(pcap.read_pcap(spark, str(tmp_path))).orderBy("ts").collect()
    assert [(r.source_ip, r.source_port, r.protocol, r.interface) for r in got] == [(f"10.0.0.{k}", 53, "UDP", "a.pcap") for k in range(5)]


def test_rolled_up_counts(spark):
    from heronflow import stats

    lines = spark.createDataFrame([("pod-a  100m  64Mi",), ("pod-b 300m 128Mi",), ("NAME CPU MEMORY",)], "value string")
    assert tuple(stats.pod_metrics(lines).first()) == (2, 200.0, 96.0)
    checks = spark.createDataFrame([(True, 1.0), (True, 2.0), (False, 3.0)], "passed boolean, duration_s double")
    assert stats.validation_report(checks).first()["healthy"] is False


def test_streamed_cooldown_and_scans(spark, tmp_path):
    from heronflow.streaming import flows as streams

    rows = [("d", T0 + dt.timedelta(minutes=m)) for m in (9, 3, 5, 0, 10, 16)]
    end = [("e", T0 + dt.timedelta(days=1))]
    for k, part in enumerate((rows[:3], rows[3:], end)):
        spark.createDataFrame(part, "k string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    started = streams.cooled_down(stream, "k", 5, "1 hour").writeStream.format("memory").queryName("cooled").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert started.awaitTermination(120)
    start = int(T0.replace(tzinfo=dt.UTC).timestamp())
    assert sorted((r.t // 1_000_000 - start) // 60 for r in spark.table("cooled").where("k = 'd'").collect()) == [0, 5, 10, 16]


def test_sinks(spark, tmp_path):
    from heronflow.sources import sinks

    df = spark.createDataFrame([(k, f"v{k}") for k in range(25)], "k int, v string")
    assert sinks.bulk_index(df, f"{tmp_path}/docs", "k") == 25
    sinks.ndjson(df.coalesce(1), f"{tmp_path}/lines", 10)
    assert len(list((tmp_path / "lines").glob("*.json"))) == 3 and spark.read.json(f"{tmp_path}/lines").count() == 25
    new = spark.createDataFrame([(3, "new"), (99, "new")], "k int, v string")
    df.write.parquet(f"{tmp_path}/old")
    merged = {r.k: r.v for r in sinks.upsert(spark, f"{tmp_path}/old", new, ["k"]).collect()}
    assert merged[3] == merged[99] == "new" and len(merged) == 26


def test_boosting_and_sequences(spark):
    from heronflow.ml import boost

    rows = [(float(k % 10), "a" if k % 3 else "b", float(k % 10 > 5)) for k in range(300)]
    df = spark.createDataFrame(rows, "x double, c string, y double")
    out = boost.probability(boost.boosted(df, ["x"], "y", ["c"], rounds=5, depth=2), df)
    assert out.where((F.col("score") >= 0.5) == (F.col("y") == 1)).count() == 300
    z = df.withColumn("id", F.monotonically_increasing_id()).select(boost.window_zscore("x", ["c"], ["id"], 5).alias("z"))
    assert z.where("z < 0 or z >= 1").count() == 0


def test_pipeline_snapshots(spark):
    from datetime import datetime

    from heronflow import stats

    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    rows = [
        ("a", t(0, 5), t(0, 30), False),
        ("a", t(0, 10), t(2, 0), True),
        ("a", t(0, 10), t(2, 0), None),
        ("a", t(3), None, True),
        ("a", None, t(1), True),
        (None, t(5), t(5), False),
    ]
    df = spark.createDataFrame(rows, "stage string, arrived timestamp_ntz, left_at timestamp_ntz, failed boolean")
    out = stats.pipeline_snapshots(df, "1 hour")
    got = {(r.stage, r.snapshot.hour): (r.received, r.processed, r.errors, r.waiting, round(r.per_second * 3600, 6)) for r in out.collect()}
    assert got == {("a", 1): (3, 1, 0, 2, 1.0), ("a", 3): (3, 3, 1, 0, 1.0), ("a", 4): (4, 3, 1, 1, 0.75), (None, 6): (1, 1, 0, 0, 1.0)}
    assert stats.pipeline_snapshots(df.where("false"), "1 hour").count() == 0
