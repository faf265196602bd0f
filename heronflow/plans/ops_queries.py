"""Queries of joins, sets, ranking, enrichment, alerts, drift, sampling, sketches
and the model registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronflow import alerts, detect, drift, enrich, flows as assembly, sampling, sketches
from heronflow.operators import ranking, relational
from heronflow.plans.catalog import query
from heronflow.plans.feature_queries import NUDGE, _r, rounded
from heronflow.plans.scoring import SCORED_SQL, all_detections, scored_flows
from heronflow.sources.checkpoints import stored
from heronflow.sources.fixtures import FLOWS_SQL, PACKETS_SQL, flows, packets

# --- joins and sets -----------------------------------------------------------

_KEYS = "ts, source_ip, destination_ip, source_port, destination_port, protocol"
_SIDES = f"""one AS (SELECT {_KEYS}, payload_size, CAST(device_id AS VARCHAR) AS uri, CAST(NULL AS INT) AS status, packet_id AS seq FROM packets WHERE packet_id % 3 <> 0
    UNION ALL SELECT {_KEYS}, payload_size + 1, 'again', NULL, packet_id + 100000 FROM packets WHERE packet_id % 30 = 1),
  two AS (SELECT {_KEYS}, payload_size * 2 AS payload_size, CAST(NULL AS VARCHAR) AS uri, 200 AS status, packet_id AS seq FROM packets WHERE packet_id % 3 <> 1)"""


def decoder_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = packets(spark, sf_dir)
    keys = ["ts", *assembly.FIVE_TUPLE]
    null_int = F.lit(None).cast("int").alias("status")
    one = rows.where("packet_id % 3 <> 0").select(*keys, "payload_size", F.col("device_id").cast("string").alias("uri"), null_int, F.col("packet_id").alias("seq"))
    again = rows.where("packet_id % 30 = 1").select(*keys, (F.col("payload_size") + 1).alias("payload_size"), F.lit("again").alias("uri"), null_int, (F.col("packet_id") + 100000).alias("seq"))
    two = rows.where("packet_id % 3 <> 1").select(*keys, (F.col("payload_size") * 2).alias("payload_size"), F.lit(None).cast("string").alias("uri"), F.lit(200).alias("status"), F.col("packet_id").alias("seq"))
    return one.union(again), two


@query(
    f"""WITH {PACKETS_SQL}, {_SIDES}, a AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY seq DESC) = 1), b AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY seq DESC) = 1)
    SELECT coalesce(a.ts, b.ts) AS ts, coalesce(a.source_ip, b.source_ip) AS source_ip, coalesce(a.uri, b.uri) AS uri, coalesce(a.status, b.status) AS status, CASE WHEN a.ts IS NOT NULL THEN a.payload_size ELSE b.payload_size END AS payload_size,
      CASE WHEN a.ts IS NOT NULL AND b.ts IS NOT NULL THEN 'both' WHEN a.ts IS NOT NULL THEN 'first' ELSE 'second' END AS side
    FROM a FULL JOIN b ON a.ts = b.ts AND a.source_ip = b.source_ip AND a.destination_ip = b.destination_ip AND a.source_port = b.source_port AND a.destination_port = b.destination_port AND a.protocol = b.protocol"""
)
def decoder_merge_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-86, OP-111."""
    out = assembly.merge_records(*decoder_sides(spark, sf_dir), ["uri", "status", "payload_size"], ["seq"])
    return out.select("ts", "source_ip", "uri", "status", "payload_size", "side")


@query(f"WITH {PACKETS_SQL}, {_SIDES} SELECT protocol, count(*) AS n, CAST(sum(payload_size) AS BIGINT) AS bytes FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY protocol")
def decoder_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-130, OP-213."""
    one, two = decoder_sides(spark, sf_dir)
    return one.unionByName(two).groupBy("protocol").agg(F.count("*").alias("n"), F.sum("payload_size").alias("bytes"))


_PERIODS = "early AS (SELECT device_id, destination_ip FROM packets WHERE ts < TIMESTAMP '2024-01-08'), late AS (SELECT device_id, destination_ip FROM packets WHERE ts >= TIMESTAMP '2024-01-25')"


def _periods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = packets(spark, sf_dir)
    pick = lambda c: rows.where(c).select("device_id", "destination_ip")
    return pick("ts < timestamp_ntz'2024-01-08'"), pick("ts >= timestamp_ntz'2024-01-25'")


@query(f"WITH {PACKETS_SQL}, {_PERIODS} SELECT * FROM early UNION SELECT * FROM late")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-131, OP-132."""
    early, late = _periods(spark, sf_dir)
    return early.union(late).distinct()


@query(f"WITH {PACKETS_SQL}, {_PERIODS} SELECT * FROM early INTERSECT SELECT * FROM late")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-133."""
    early, late = _periods(spark, sf_dir)
    return early.intersect(late)


@query(f"WITH {PACKETS_SQL}, {_PERIODS} SELECT * FROM early EXCEPT SELECT * FROM late")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-134."""
    early, late = _periods(spark, sf_dir)
    return early.subtract(late)


@query(f"WITH {FLOWS_SQL} SELECT n_name, count(*) AS n, CAST(sum(bytes_sent) AS BIGINT) AS bytes FROM flows LEFT JOIN customer ON device_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def device_enrichment_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-89: flows with their device's dimension rows."""
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    out = flows(spark, sf_dir).join(customer, F.col("device_id") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.groupBy("n_name").agg(F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"))


_RANGES = [("10.0.0.0", "10.0.0.255", "lab"), ("10.0.1.0", "10.0.3.127", "office"), ("10.0.3.128", "10.0.5.255", "plant"), ("198.51.100.0", "198.51.100.63", "cloud-a"), ("198.51.100.64", "198.51.100.90", "cloud-b")]
_IP_INT = "(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT))"


@query(
    f"""WITH {FLOWS_SQL}, ranges(low, high, place) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _RANGES)}), r AS (SELECT {_IP_INT.format("low")} AS low, {_IP_INT.format("high")} AS high, place FROM ranges)
    SELECT place, count(*) AS n FROM (SELECT {_IP_INT.format("destination_ip")} AS ip FROM flows) LEFT JOIN r ON ip BETWEEN low AND high GROUP BY place"""
)
def geoip_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-90: addresses against intervals, by equal /16 and a residual test."""
    ranges = spark.createDataFrame(_RANGES, "low string, high string, place string")
    found = relational.ip_range_join(flows(spark, sf_dir).select("flow_id", "destination_ip"), "destination_ip", ranges)
    return found.groupBy("place").agg(F.count("*").alias("n"))


@query(f"WITH {FLOWS_SQL}, {PACKETS_SQL} SELECT f.destination_ip, count(*) AS n FROM flows f WHERE NOT EXISTS (SELECT 1 FROM flows g WHERE g.ts < TIMESTAMP '1996-01-01' AND g.destination_ip = f.destination_ip AND g.bytes_sent > 95000) GROUP BY ALL")
def allowlist_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-92c."""
    rows = flows(spark, sf_dir)
    allowed = rows.where("ts < timestamp_ntz'1996-01-01' and bytes_sent > 95000").select("destination_ip").distinct()
    return rows.join(allowed, "destination_ip", "left_anti").groupBy("destination_ip").agg(F.count("*").alias("n"))


@query(f"WITH {FLOWS_SQL} SELECT protocol, count(*) AS n FROM flows WHERE protocol IN (SELECT unnest(['TCP', 'ICMP', 'HTTP'])) GROUP BY protocol")
def protocol_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-45, OP-92b: an allow-list that is changed as a table."""
    enabled = spark.createDataFrame([("TCP",), ("ICMP",), ("HTTP",)], "protocol string")
    return flows(spark, sf_dir).join(F.broadcast(enabled), "protocol", "left_semi").groupBy("protocol").agg(F.count("*").alias("n"))


@query(f"WITH {SCORED_SQL} SELECT d.flow_id, d.severity, f.source_ip, f.bytes_sent FROM scored d JOIN flows f USING (flow_id) WHERE d.severity IN ('CRITICAL', 'HIGH')")
def detection_with_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-92e: each alert with its own flow, not the first of its batch. Flows of
    one id are of one order, on which they were joined, so an id's alerts and flows
    meet where they are: flows are neither made a second time nor sent by id."""
    rows = detect.fused(scored_flows(spark, sf_dir, "l_orderkey"))
    alert = detect.worth_reporting() & F.col("severity").isin("CRITICAL", "HIGH")
    rows = rows.select("l_orderkey", "flow_id", "source_ip", "bytes_sent", F.when(alert, F.col("severity")).alias("severity"))
    found = rows.withColumn("severity", F.collect_list("severity").over(Window.partitionBy("l_orderkey", "flow_id")))
    return found.select("flow_id", F.explode("severity").alias("severity"), "source_ip", "bytes_sent")


# --- ranking ------------------------------------------------------------------


@query(f"WITH {FLOWS_SQL} SELECT destination_ip, count(*) AS n FROM flows GROUP BY ALL ORDER BY n DESC, destination_ip DESC LIMIT 10")
def top_k_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-118, OP-190."""
    return sketches.top_k(flows(spark, sf_dir), "destination_ip", 10)


@query(f"WITH {SCORED_SQL} SELECT flow_id, severity, ts FROM scored ORDER BY ts DESC, flow_id LIMIT 20")
def latest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-115, OP-116."""
    return all_detections(spark, sf_dir).orderBy(F.desc("ts"), "flow_id").limit(20).select("flow_id", "severity", "ts")


@query(f"WITH {FLOWS_SQL} SELECT flow_id, ts FROM flows ORDER BY ts, flow_id LIMIT 25 OFFSET 50")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-125: one page of a listing."""
    return flows(spark, sf_dir).select("flow_id", "ts").orderBy("ts", "flow_id").offset(50).limit(25)


@query("SELECT event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts) AS r FROM events) WHERE r <= 3")
def priority_dequeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-124: the next three of each queue, by priority, then age."""
    return ranking.first_of_each(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], [F.desc("value"), F.col("ts")], 3).select("event_type", "ts", "value")


_FEATURES = "(SELECT flow_id, 'size' AS feature, m1 AS importance FROM scored UNION ALL SELECT flow_id, 'duration', m2 FROM scored UNION ALL SELECT flow_id, 'rules', signature_score FROM scored)"


@query(f"WITH {SCORED_SQL} SELECT flow_id, feature, {_r('importance', 'importance')} FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY importance DESC, feature) AS r FROM {_FEATURES}) WHERE r <= 2")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-119: the two most important features of each detection."""
    ml = F.map_from_entries(F.transform("ml_predictions", lambda p: F.struct(p["model_name"], p["anomaly_score"])))
    both = F.map_concat(ml, F.create_map(F.lit("rules"), F.col("signature_score")))
    return rounded(ranking.top_entries(all_detections(spark, sf_dir).select("flow_id", both.alias("m")), "m", 2, "feature", "importance"))


#: Versions of a model for each event type: twelve, of which 1.10.0 comes after 1.7.1.
_VERSIONS_SQL = """v AS (SELECT event_type AS model, concat_ws('.', e % 3, e, e % 2) AS version, CASE e WHEN 5 THEN 'production' WHEN 2 THEN 'archived' WHEN 8 THEN 'archived' ELSE 'staging' END AS stage, e AS day, n
    FROM (SELECT event_type, event_id % 12 AS e, count(*) AS n FROM events GROUP BY ALL)), n AS (SELECT *, [CAST(x AS INT) FOR x IN string_split(version, '.')] AS k FROM v)"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("model"), (F.col("event_id") % 12).cast("int").alias("day")).count().drop("count")
    e = F.col("day")
    stage = F.when(e == 5, "production").when(e.isin(2, 8), "archived").otherwise("staging")
    return rows.select("model", F.concat_ws(".", e % 3, e, e % 2).alias("version"), stage.alias("stage"), "day")


@query(f"WITH {_VERSIONS_SQL} SELECT model, version, stage FROM n QUALIFY row_number() OVER (PARTITION BY model ORDER BY k DESC) = 1")
def registry_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-121, OP-224."""
    return ranking.latest_versions(_registry(spark, sf_dir), 1).select("model", "version", "stage")


@query(f"WITH {_VERSIONS_SQL} SELECT model, version FROM n QUALIFY NOT (row_number() OVER (PARTITION BY model ORDER BY k DESC) > 2 AND stage <> 'production')")
def registry_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-122: keep the two newest and what is in production."""
    return ranking.cleaned_up(_registry(spark, sf_dir), 2, ["production"]).select("model", "version")


# --- events and alerts ----------------------------------------------------------

_EVENTS = f"""{SCORED_SQL}, raw AS (SELECT flow_id, CASE WHEN packets_sent % 11 = 0 THEN NULL WHEN packets_sent % 13 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS timestamp,
    CASE WHEN packets_sent % 17 = 0 THEN 'mystery' ELSE 'network_flow' END AS event_type, CASE WHEN packets_sent % 19 = 0 THEN 1.5 ELSE threat_score END AS threat_score,
    CASE WHEN packets_sent % 23 = 0 THEN -bytes_sent ELSE bytes_sent END AS bytes_sent, bytes_received, packets_sent, packets_received, CASE WHEN duration_ms % 7 = 0 THEN NULL ELSE duration_ms END AS duration_ms, source_port, destination_port, ts FROM scored),
  checked AS (SELECT *, [x FOR x IN [CASE WHEN timestamp IS NULL THEN 'missing timestamp' END, CASE WHEN event_type IS NULL THEN 'missing event_type' END, CASE WHEN timestamp IS NOT NULL AND try_cast(timestamp AS TIMESTAMP) IS NULL THEN 'invalid timestamp' END,
    CASE WHEN event_type NOT IN ('network_flow', 'threat_detection', 'device_profile_update') THEN 'unknown event_type' END, CASE WHEN threat_score NOT BETWEEN 0 AND 1 THEN 'threat_score out of range' END, CASE WHEN bytes_sent < 0 THEN 'negative bytes_sent' END] IF x IS NOT NULL] AS errors FROM raw)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_detections(spark, sf_dir)
    k = F.col("packets_sent")
    return rows.select(
        "flow_id",
        F.when(k % 11 == 0, None).when(k % 13 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        F.when(k % 17 == 0, "mystery").otherwise("network_flow").alias("event_type"),
        F.when(k % 19 == 0, 1.5).otherwise(F.col("threat_score")).alias("threat_score"),
        F.when(k % 23 == 0, -F.col("bytes_sent")).otherwise(F.col("bytes_sent")).alias("bytes_sent"),
        "bytes_received",
        "packets_sent",
        "packets_received",
        F.when(F.col("duration_ms") % 7 == 0, None).otherwise(F.col("duration_ms")).alias("duration_ms"),
        "source_port",
        "destination_port",
        "ts",
        "severity",
    )


@query(f"WITH {_EVENTS} SELECT array_to_string(errors, ';') AS errors, count(*) AS n FROM checked GROUP BY ALL")
def events_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-153."""
    return _events(spark, sf_dir).withColumn("errors", F.array_join(enrich.errors(), ";")).groupBy("errors").agg(F.count("*").alias("n"))


_WELL = "CASE {} WHEN 80 THEN 'http' WHEN 443 THEN 'https' WHEN 53 THEN 'dns' WHEN 22 THEN 'ssh' WHEN 21 THEN 'ftp' WHEN 25 THEN 'smtp' WHEN 110 THEN 'pop3' WHEN 143 THEN 'imap' END"


@query(
    f"""WITH {_EVENTS} SELECT flow_id, bytes_sent + bytes_received AS bytes_total, packets_sent + packets_received AS packets_total, {_r("CASE WHEN coalesce(duration_ms, 1) > 0 THEN (bytes_sent + bytes_received) * 1000.0 / coalesce(duration_ms, 1) END", "bytes_per_second", 3)},
    {_r("CASE WHEN coalesce(duration_ms, 1) > 0 THEN (packets_sent + packets_received) * 1000.0 / coalesce(duration_ms, 1) END", "packets_per_second", 3)}, coalesce({_WELL.format("destination_port")}, {_WELL.format("source_port")}) AS service,
    CASE WHEN {_WELL.format("destination_port")} IS NOT NULL THEN 'outbound' WHEN {_WELL.format("source_port")} IS NOT NULL THEN 'inbound' ELSE 'unknown' END AS flow_direction FROM checked WHERE len(errors) = 0"""
)
def events_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-151."""
    good, _ = enrich.processed(_events(spark, sf_dir))
    return rounded(good.select("flow_id", "bytes_total", "packets_total", "bytes_per_second", "packets_per_second", "service", "flow_direction"), 3)


@query(f"WITH {_EVENTS} SELECT flow_id, array_to_string(errors, ';') AS errors FROM checked WHERE len(errors) > 0")
def events_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-35."""
    _, bad = enrich.processed(_events(spark, sf_dir))
    return bad.select("flow_id", F.array_join("errors", ";").alias("errors"))


@query(
    f"""WITH {SCORED_SQL} SELECT flow_id, CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END AS alert_priority, {_r("CASE WHEN n_signature > 0 THEN top END", "max_signature_score")}, {_r("greatest(m1, m2)", "max_ml_score")}, {_r("ml_score", "avg_ml_score")},
    CASE WHEN threat_score >= 0.9 THEN 'critical' WHEN threat_score >= 0.7 THEN 'high' WHEN threat_score >= 0.5 THEN 'medium' WHEN threat_score >= 0.3 THEN 'low' ELSE 'info' END AS ladder FROM scored"""
)
def detections_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-152, OP-154."""
    out = enrich.enriched_detections(all_detections(spark, sf_dir)).withColumn("ladder", enrich.severity_of_score(F.col("threat_score")))
    return rounded(out.select("flow_id", "alert_priority", "max_signature_score", "max_ml_score", "avg_ml_score", "ladder"))


@query(
    f"""WITH RECURSIVE {SCORED_SQL}, a AS (SELECT device_id, ts, flow_id FROM scored WHERE severity IN ('MEDIUM', 'HIGH', 'CRITICAL') AND threat_score >= 0.4 AND confidence >= 0.6 QUALIFY row_number() OVER (PARTITION BY device_id, ts ORDER BY flow_id) = 1),
    admitted AS (SELECT device_id, min(ts) AS ts FROM a GROUP BY device_id UNION ALL SELECT device_id, t FROM (SELECT p.device_id, min(a.ts) AS t FROM admitted p JOIN a ON a.device_id = p.device_id AND a.ts >= p.ts + INTERVAL 129600 MINUTES GROUP BY p.device_id, p.ts))
    SELECT a.device_id, a.ts, flow_id FROM admitted JOIN a ON a.device_id = admitted.device_id AND a.ts = admitted.ts"""
)
def alerts_admitted_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-112, OP-156: thresholds, then 90 days of quiet a device."""
    found = all_detections(spark, sf_dir).where(alerts.passes("medium", 0.4, 0.6)).select("device_id", "ts", "flow_id")
    return alerts.cooled_down(found, ["device_id"], ["flow_id"], 129600)


@query(f"WITH {SCORED_SQL} SELECT flow_id FROM scored QUALIFY row_number() OVER (PARTITION BY severity, date_trunc('hour', ts) ORDER BY ts, flow_id) <= 2")
def alerts_hourly_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-156, G5."""
    return alerts.hourly_cap(all_detections(spark, sf_dir).select("flow_id", "severity", "ts"), ["severity"], ["ts", "flow_id"], 2).select("flow_id")


@query(f"WITH {SCORED_SQL} SELECT time_bucket(INTERVAL 30 DAYS, ts, TIMESTAMP '1970-01-01') AS window_start, severity, count(*) AS n FROM scored GROUP BY ALL")
def severity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-150."""
    return all_detections(spark, sf_dir).groupBy(F.window("ts", "30 days").alias("w"), "severity").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "severity", "n")


@query(f"WITH {SCORED_SQL} SELECT attack_category, severity, count(*) AS n FROM scored GROUP BY ROLLUP (attack_category, severity)")
def alerts_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-150, with subtotals."""
    return all_detections(spark, sf_dir).rollup("attack_category", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {FLOWS_SQL} SELECT CASE WHEN d >= 2000 THEN 'delete' WHEN d >= 1000 THEN 'cold' WHEN d >= 300 THEN 'warm' ELSE 'hot' END AS phase, count(*) AS n FROM (SELECT date_diff('day', CAST(ts AS DATE), DATE '2001-12-31') AS d FROM flows) GROUP BY ALL")
def retention_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-36."""
    age = F.datediff(F.lit("2001-12-31").cast("date"), F.to_date("ts"))
    return flows(spark, sf_dir).groupBy(enrich.retention_phase(age, 300, 1000, 2000).alias("phase")).agg(F.count("*").alias("n"))


@query(f"WITH {PACKETS_SQL} SELECT packet_id, count(*) OVER (PARTITION BY device_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM packets")
def sliding_counts_range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-105, OP-182: events of the last day, lower end included."""
    w = Window.partitionBy("device_id").orderBy(assembly.micros()).rangeBetween(-86_400_000_000, 0)
    return packets(spark, sf_dir).select("packet_id", F.count("*").over(w).alias("n"))


@query(
    f"""WITH {FLOWS_SQL}, {PACKETS_SQL}, p AS (SELECT device_id, count(*) AS flows, CAST(sum(bytes_sent) AS BIGINT) AS bytes FROM flows GROUP BY device_id), t AS (SELECT device_id, count(*) AS alerts FROM packets WHERE large GROUP BY device_id)
    SELECT device_id, flows, bytes, coalesce(alerts, 0) AS alerts, {_r("least(1, 0.12 * coalesce(alerts, 0))", "risk")} FROM p LEFT JOIN t USING (device_id) ORDER BY device_id LIMIT 100"""
)
def device_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.13, OP-158: devices with totals, alerts and risk."""
    own = flows(spark, sf_dir).groupBy("device_id").agg(F.count("*").alias("flows"), F.sum("bytes_sent").alias("bytes"))
    bad = packets(spark, sf_dir).where("large").groupBy("device_id").agg(F.count("*").alias("alerts"))
    out = own.join(bad, "device_id", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))
    return rounded(out.withColumn("risk", F.least(F.lit(1.0), 0.12 * F.col("alerts"))).orderBy("device_id").limit(100))


# --- drift ----------------------------------------------------------------------

_HALVES = "base AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), cur AS (SELECT l_extendedprice * 1.1 AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.where("l_shipdate < timestamp_ntz'1996-01-01'").select(F.col("l_extendedprice").alias("v")), rows.where("l_shipdate >= timestamp_ntz'1998-01-01'").select((F.col("l_extendedprice") * F.lit(1.1)).alias("v"))


@query(
    f"""WITH {_HALVES}, b AS (SELECT v, 1 AS a, 0 AS c FROM base UNION ALL SELECT v, 0, 1 FROM cur), g AS (SELECT v, sum(a) AS a, sum(c) AS c FROM b GROUP BY v), s AS (SELECT sum(a) OVER (ORDER BY v) AS sa, sum(c) OVER (ORDER BY v) AS sc FROM g)
    SELECT {_r("max(abs(sa / (SELECT count(*) FROM base) - sc / (SELECT count(*) FROM cur)))", "d")}, (SELECT count(*) FROM base) AS n, (SELECT count(*) FROM cur) AS m FROM s"""
)
def drift_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-160."""
    return rounded(drift.ks_distance(*_halves(spark, sf_dir)))


def _sql_bins(bins: int, common: bool) -> str:
    span = "SELECT v FROM base UNION ALL SELECT v FROM cur" if common else "SELECT v FROM base"
    return f"""span AS (SELECT min(v) AS low, max(v) AS high FROM ({span})), placed AS (SELECT s, greatest(1, least({bins}, ceil((v - low) / ((high - low) / {bins})))) AS k
      FROM (SELECT v, 0 AS s FROM base UNION ALL SELECT v, 1 FROM cur), span WHERE v BETWEEN low AND high), c AS (SELECT k, count(*) FILTER (s = 0) AS a, count(*) FILTER (s = 1) AS b FROM placed GROUP BY k),
      sh AS (SELECT coalesce(a, 0) / (SELECT sum(a) FROM c) AS p, coalesce(b, 0) / (SELECT sum(b) FROM c) AS q FROM (SELECT unnest(range(1, {bins + 1})) AS k) LEFT JOIN c USING (k))"""


@query(f"WITH {_HALVES}, {_sql_bins(10, False)} SELECT {_r('sum((greatest(q, 0.001) - greatest(p, 0.001)) * ln(greatest(q, 0.001) / greatest(p, 0.001)))', 'psi')} FROM sh")
def drift_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-161."""
    return rounded(drift.psi(*_halves(spark, sf_dir)))


@query(
    f"""WITH {_HALVES}, {_sql_bins(50, True)}, e AS (SELECT (p + 1e-10) / (SELECT sum(p + 1e-10) FROM sh) AS p, (q + 1e-10) / (SELECT sum(q + 1e-10) FROM sh) AS q FROM sh)
    SELECT {_r("sqrt(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2)", "js")} FROM e"""
)
def drift_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-162."""
    return rounded(drift.js_distance(*_halves(spark, sf_dir)))


@query(
    f"""WITH a AS (SELECT p_brand AS v, count(*) AS a FROM part WHERE p_size < 20 GROUP BY v), b AS (SELECT p_brand AS v, count(*) AS b FROM part WHERE p_size >= 25 GROUP BY v), j AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (v)),
    e AS (SELECT b, greatest(0.5, a * (SELECT sum(b) FROM j) / (SELECT sum(a) FROM j)) AS x FROM j) SELECT {_r("sum((b - x) * (b - x) / x)", "chi2")}, count(*) - 1 AS dof FROM e"""
)
def drift_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-92d, OP-163."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("v"), "p_size")
    return rounded(drift.chi_square(rows.where("p_size < 20"), rows.where("p_size >= 25")))


_METRICS_SQL = "m AS (SELECT event_type AS model, 'value of ' || user_id % 40 AS metric, avg(value) FILTER (event_id % 2 = 0) AS base, avg(value) FILTER (event_id % 2 = 1) AS now FROM events GROUP BY ALL)"


@query(f"WITH {_METRICS_SQL} SELECT model, metric, {_r('(base - now) / base', 'relative_drop')} FROM m WHERE base > 0 AND (base - now) / base > 0.1")
def perf_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-147: metrics stored of two periods, and those that fell."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("metric", F.concat(F.lit("value of "), F.col("user_id") % 40))
    of = lambda half: events.where(F.col("event_id") % 2 == half).groupBy(F.col("event_type").alias("model"), "metric").agg(F.avg("value").alias("value"))
    return rounded(drift.degradation(stored(of(0)), stored(of(1))).select("model", "metric", "relative_drop"))


# --- sampling and sketches --------------------------------------------------------

_U = "(('0x' || substr(md5(CAST({} AS VARCHAR) || '#0'), 1, 8))::BIGINT / 4294967296.0)"


@query(f"SELECT event_id FROM events WHERE {_U.format('event_id')} < least(1.0, 0.1 * (1 + value / 500))")
def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-191."""
    return sampling.bernoulli(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", 0.1, F.col("value") / 500).select("event_id")


@query(f"SELECT event_id FROM events ORDER BY {_U.format('event_id')}, event_id LIMIT 100")
def sample_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-188."""
    return sampling.reservoir(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), "event_id", 100)


@query(f"SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY {_U.format('event_id')}, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n, count(*) OVER () AS t FROM events) WHERE r <= greatest(1, floor(200 * n / t))")
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-193."""
    return sampling.stratified(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type"), "event_id", "event_type", 200).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, greatest(1, count(*) OVER () // 120) AS s FROM events) WHERE i >= 3 AND (i - 3) % s = 0 AND (i - 3) / s < 120")
def sample_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-192."""
    return sampling.systematic(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"), ["ts", "event_id"], 120, 3).select("event_id")


_CELL = "(('0x' || substr(md5('{k}#' || {v}), 1, 8))::BIGINT % {w})"


@query(
    f"""WITH {PACKETS_SQL}, cells AS (SELECT k AS row, ('0x' || substr(md5(k || '#' || destination_ip), 1, 8))::BIGINT % 50 AS cell, destination_ip FROM packets, (SELECT unnest(range(5)) AS k)), s AS (SELECT row, cell, count(*) AS n FROM cells GROUP BY ALL)
    SELECT destination_ip, min(n) AS estimate FROM (SELECT DISTINCT * FROM cells) JOIN s USING (row, cell) GROUP BY destination_ip"""
)
def count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-186: a narrow sketch, so that estimates do exceed counts."""
    rows = packets(spark, sf_dir)
    return sketches.estimates(rows, "destination_ip", sketches.count_min(rows, "destination_ip", 50, 5), 50, 5)


@query(
    f"""WITH {PACKETS_SQL}, n AS (SELECT count(DISTINCT device_id) AS n FROM packets WHERE large), size AS (SELECT greatest(1, CAST(ceil(-n * ln(0.2) / (ln(2) * ln(2))) AS BIGINT)) AS m, n FROM n), k AS (SELECT m, greatest(1, CAST(round(m / n * ln(2)) AS BIGINT)) AS k FROM size),
    bits AS (SELECT DISTINCT ('0x' || substr(md5(i || '#' || device_id), 1, 8))::BIGINT % m AS bit FROM (SELECT device_id, m, unnest(range(k)) AS i FROM packets, k WHERE large)),
    asked AS (SELECT DISTINCT device_id, ('0x' || substr(md5(i || '#' || device_id), 1, 8))::BIGINT % m AS bit FROM (SELECT device_id, m, unnest(range(k)) AS i FROM packets, k))
    SELECT device_id FROM asked LEFT JOIN bits USING (bit) GROUP BY device_id HAVING count(bits.bit) = count(*)"""
)
def bloom_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-189: devices that may have a large packet; bits and hashes by their
    number and an error of a fifth."""
    rows = packets(spark, sf_dir)
    large = rows.where("large")
    bits, hashes = sketches.bloom_size(max(1, large.agg(F.count_distinct("device_id").alias("n")).first()["n"]), 0.2)
    return sketches.maybe_in(rows, "device_id", sketches.bloom(large, "device_id", bits, hashes), bits, hashes)


@query(f"WITH {FLOWS_SQL} SELECT protocol, count(DISTINCT flow_id) AS exact, true AS within FROM flows GROUP BY protocol")
def hll_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-187: if the estimate is within three times its standard error."""
    rows = flows(spark, sf_dir)
    estimate = rows.groupBy("protocol").agg(F.approx_count_distinct("flow_id", 0.02).alias("estimate"))
    exact = rows.groupBy("protocol").agg(F.count_distinct("flow_id").alias("exact"))
    return exact.join(estimate, "protocol").select("protocol", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.06 * F.col("exact")).alias("within"))


__all__ = ["NUDGE"]
