"""Queries of device profiles and the dimension joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow import profiles
from heronflow.plans.catalog import query
from heronflow.plans.feature_queries import _r, rounded
from heronflow.sources.fixtures import FLOWS_SQL, PACKETS_SQL, flows, packets

_OUI_ROWS = list(profiles.OUI.items())
_OUI_SQL = "oui(oui, vendor) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _OUI_ROWS) + ")"
_MACS_SQL = f"""macs AS (SELECT c_custkey AS device_id, CASE c_custkey % 3 WHEN 0 THEN upper(replace(p, ':', '-')) || '-00-11-22' WHEN 1 THEN replace(p, ':', '') || 'aabbcc' ELSE p || ':01:02:zz' END AS mac
  FROM (SELECT c_custkey, list_extract({[a for a, _ in _OUI_ROWS]}, CAST(c_custkey % {len(_OUI_ROWS)} AS INT) + 1) AS p FROM customer))"""
_PREFIX_SQL = "CASE WHEN regexp_matches(lower(regexp_replace(mac, '[-:.]', '', 'g')), '^[0-9a-f]{12}$') THEN substr(lower(regexp_replace(mac, '[-:.]', '', 'g')), 1, 2) || ':' || substr(lower(regexp_replace(mac, '[-:.]', '', 'g')), 3, 2) || ':' || substr(lower(regexp_replace(mac, '[-:.]', '', 'g')), 5, 2) END"


def _macs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*(F.lit(a) for a, _ in _OUI_ROWS)), (F.col("c_custkey") % len(_OUI_ROWS)).cast("int") + 1)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("device_id"), prefix.alias("p"))
    k = F.col("device_id") % 3
    mac = F.when(k == 0, F.concat(F.upper(F.replace("p", F.lit(":"), F.lit("-"))), F.lit("-00-11-22"))).when(k == 1, F.concat(F.replace("p", F.lit(":"), F.lit("")), F.lit("aabbcc"))).otherwise(F.concat("p", F.lit(":01:02:zz")))
    return rows.select("device_id", mac.alias("mac"))


@query(f"WITH {_OUI_SQL}, {_MACS_SQL} SELECT device_id, mac, oui.oui, vendor FROM (SELECT *, {_PREFIX_SQL} AS k FROM macs) LEFT JOIN oui ON k = oui.oui")
def vendor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-24, OP-87."""
    return profiles.vendor_lookup(_macs(spark, sf_dir), profiles.oui_table(spark)).select("device_id", "mac", "oui", "vendor")


_KNOWN = [(v, kind) for kind, vendors in profiles.VENDORS.items() for v in vendors]
_WORDS = [(w, kind) for kind, found in profiles.KEYWORDS.items() for w in found]
_TYPE_SQL = (
    "CASE WHEN vendor IS NULL THEN 'unknown' "
    + " ".join(f"WHEN lower(vendor) = '{v}' THEN '{k}'" for v, k in _KNOWN)
    + " "
    + " ".join(f"WHEN contains(lower(vendor), '{v}') OR contains('{v}', lower(vendor)) THEN '{k}'" for v, k in _KNOWN)
    + " "
    + " ".join(f"WHEN contains(lower(vendor), '{w}') THEN '{k}'" for w, k in _WORDS)
    + " ELSE 'unknown' END"
)


@query(f"WITH {_OUI_SQL} SELECT vendor, {_TYPE_SQL} AS device_type FROM (SELECT DISTINCT vendor FROM oui UNION ALL SELECT DISTINCT n_name FROM nation UNION ALL SELECT unnest(['Acme Smart Home', 'Zeta Video', 'HVAC Works', 'lux', 'Soil Sensor Co', NULL]))")
def device_type_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-88: types of vendors by containment in either direction."""
    extra = spark.createDataFrame([(x,) for x in ("Acme Smart Home", "Zeta Video", "HVAC Works", "lux", "Soil Sensor Co", None)], "vendor string")
    names = profiles.oui_table(spark).select("vendor").distinct().union(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").distinct()).union(extra)
    return names.select("vendor", profiles.device_type(F.col("vendor")).alias("device_type"))


@query(f"WITH {_OUI_SQL} SELECT {_TYPE_SQL} AS device_type, count(DISTINCT vendor) AS vendors, count(*) AS prefixes FROM oui GROUP BY ALL")
def oui_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-70."""
    return profiles.oui_table(spark).groupBy(profiles.device_type(F.col("vendor")).alias("device_type")).agg(F.count_distinct("vendor").alias("vendors"), F.count("*").alias("prefixes"))


@query(
    f"""WITH {FLOWS_SQL}, c AS (SELECT device_id, protocol AS p, count(*) AS n FROM flows GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY device_id) AS total, row_number() OVER (PARTITION BY device_id ORDER BY n DESC, p) AS r FROM c)
    SELECT device_id, CAST(max(total) AS BIGINT) AS observations, array_to_string(list_sort(CASE WHEN max(total) >= 10 THEN CASE WHEN count(*) FILTER (n / total > 0.05) > 0 THEN list(p) FILTER (n / total > 0.05) ELSE list(p) FILTER (r = 1) END
      ELSE list_distinct(['HTTP', 'UDP'] || coalesce(list(p) FILTER (n / total > 0.05), [])) END), ',') AS normal_protocols FROM m GROUP BY device_id"""
)
def profile_protocol_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-61, OP-110."""
    return profiles.protocol_baseline(flows(spark, sf_dir), ["HTTP", "UDP"]).withColumn("normal_protocols", F.array_join("normal_protocols", ","))


@query(
    f"""WITH {FLOWS_SQL}, c AS (SELECT device_id, destination_ip, count(*) AS n FROM flows GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY n DESC, destination_ip) AS r FROM c)
    SELECT device_id, array_to_string(list_sort(list(destination_ip)), ',') AS allowed_destinations FROM r WHERE r <= 20 GROUP BY device_id"""
)
def profile_destinations_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-62."""
    return profiles.destinations(flows(spark, sf_dir), 20).withColumn("allowed_destinations", F.array_join("allowed_destinations", ","))


@query(
    f"""WITH {FLOWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, flow_id DESC) AS r FROM flows),
    m AS (SELECT device_id, count(*) AS n, CAST(floor(quantile_cont(CASE WHEN duration_ms > 0 THEN (bytes_sent + bytes_received) * 8 / (duration_ms / 1000) END, 0.5)) AS BIGINT) AS median_bps FROM r WHERE r <= 100 GROUP BY device_id)
    SELECT device_id, median_bps, CAST(CASE WHEN n >= 10 AND median_bps IS NOT NULL THEN CASE WHEN abs(median_bps - 1000) / 1000 > 0.5 THEN floor(0.3::DOUBLE * 1000 + 0.7::DOUBLE * median_bps) ELSE floor(0.7::DOUBLE * 1000 + 0.3::DOUBLE * median_bps) END ELSE 1000 END AS BIGINT) AS typical_bandwidth_bps FROM m"""
)
def profile_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-63, OP-104."""
    return profiles.bandwidth_baseline(flows(spark, sf_dir), F.lit(1000))


_HOURS, _DAYS = profiles.DEFAULTS["sensor"][2:]


@query(
    f"""WITH {FLOWS_SQL}, h AS (SELECT device_id, hour(ts) AS k, count(*) AS n FROM flows GROUP BY ALL), g AS (SELECT device_id, max(n) AS top, sum(n) AS total FROM h GROUP BY device_id),
    s AS (SELECT device_id, k, CASE WHEN total >= 24 THEN 0.6 * {_HOURS}[k + 1] + 0.4 * coalesce(n, 0) / top ELSE {_HOURS}[k + 1] END AS a FROM g CROSS JOIN (SELECT unnest(range(24)) AS k) LEFT JOIN h USING (device_id, k)),
    d AS (SELECT device_id, isodow(ts) - 1 AS k, count(*) AS n FROM flows GROUP BY ALL), e AS (SELECT device_id, max(n) AS top, sum(n) AS total FROM d GROUP BY device_id),
    t AS (SELECT device_id, k, CASE WHEN total >= 24 THEN 0.6 * {_DAYS}[k + 1] + 0.4 * coalesce(n, 0) / top ELSE {_DAYS}[k + 1] END AS a FROM e CROSS JOIN (SELECT unnest(range(7)) AS k) LEFT JOIN d USING (device_id, k))
    SELECT device_id, {_r("hours", "hours")}, {_r("peak", "peak")}, {_r("days", "days")} FROM (SELECT device_id, sum(a * (k + 1)) AS hours, max(a) AS peak FROM s GROUP BY device_id) JOIN (SELECT device_id, sum(a * (k + 1)) AS days FROM t GROUP BY device_id) USING (device_id)"""
)
def profile_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-64, told by its weighted sums."""
    out = profiles.activity_schedule(flows(spark, sf_dir), _HOURS, _DAYS)
    weighted = lambda c: F.aggregate(F.transform(c, lambda a, k: a * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select("device_id", weighted("hour_of_day").alias("hours"), F.array_max("hour_of_day").alias("peak"), weighted("day_of_week").alias("days")))


@query(
    f"""WITH {FLOWS_SQL}, c AS (SELECT device_id, protocol, count(*) AS n FROM flows GROUP BY ALL), k AS (SELECT device_id, sum(n) AS n, count(*) AS kinds, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY device_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, flow_id DESC) AS r FROM flows), g AS (SELECT device_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY device_id ORDER BY ts, flow_id)) / 1e6 AS gap FROM r WHERE r <= 24),
    t AS (SELECT device_id, 1 / (1 + CASE WHEN avg(gap) > 0 THEN coalesce(stddev_samp(gap), 0) / avg(gap) ELSE 1 END) AS regular FROM g GROUP BY device_id)
    SELECT device_id, CAST(n AS BIGINT) AS observation_count, {_r("least(0.9, ln(1 + n) / 10) * 0.5 + CASE WHEN kinds > 1 THEN 1 - h / log2(kinds) ELSE 1 - h END * 0.3 + CASE WHEN n > 24 THEN regular ELSE 0.5 END * 0.2", "confidence_score", 4)} FROM k JOIN t USING (device_id)"""
)
def profile_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-60, OP-65."""
    return rounded(profiles.confidence(flows(spark, sf_dir)), 4)


@query(
    f"""WITH {PACKETS_SQL}, c AS (SELECT device_id, hour(ts) AS h, count(*) AS n FROM packets GROUP BY ALL)
    SELECT device_id, {_r("CASE WHEN sum(n) >= 24 THEN 1 - (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(24) ELSE 0 END", "strength")} FROM c GROUP BY device_id"""
)
def profile_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-67, OP-68."""
    return rounded(profiles.pattern_strength(packets(spark, sf_dir), F.hour("ts"), 24, 24))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles learned from the first half of each device's time."""
    old = flows(spark, sf_dir).where("ts < timestamp_ntz'1998-01-01'")
    return profiles.baselines(old, 100).where("observations >= 10").withColumn("hour_of_day", F.array(*(F.lit(0.1 if h == 3 else 0.5) for h in range(24))))


@query(
    f"""WITH {FLOWS_SQL}, old AS (SELECT * FROM flows WHERE ts < TIMESTAMP '1998-01-01'), new AS (SELECT * FROM flows WHERE ts >= TIMESTAMP '1998-01-01'),
    c AS (SELECT device_id, protocol AS p, count(*) AS n FROM old GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY device_id) AS total FROM c),
    p AS (SELECT device_id, list(p) FILTER (n / total > 0.05) AS protocols FROM m WHERE total >= 10 GROUP BY device_id),
    dc AS (SELECT device_id, destination_ip, count(*) AS n FROM old GROUP BY ALL), dr AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY n DESC, destination_ip) AS r FROM dc), d AS (SELECT device_id, list(destination_ip) AS dests FROM dr WHERE r <= 100 GROUP BY device_id),
    br AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, flow_id DESC) AS r FROM old),
    b AS (SELECT device_id, count(*) AS n, floor(quantile_cont(CASE WHEN duration_ms > 0 THEN (bytes_sent + bytes_received) * 8 / (duration_ms / 1000) END, 0.5)) AS bps FROM br WHERE r <= 100 GROUP BY device_id),
    j AS (SELECT new.*, protocols, dests, CASE WHEN n >= 10 THEN coalesce(bps, 0) ELSE 0 END AS bps, CASE WHEN duration_ms > 0 THEN (bytes_sent + bytes_received) * 8 / (duration_ms / 1000) ELSE 0 END AS own FROM new JOIN p USING (device_id) JOIN d USING (device_id) JOIN b USING (device_id)),
    a AS (SELECT 'protocol_anomaly' AS type, 'medium' AS severity, device_id FROM j WHERE NOT list_contains(protocols, protocol) UNION ALL SELECT 'destination_anomaly', 'high', device_id FROM j WHERE NOT list_contains(dests, destination_ip)
      UNION ALL SELECT 'bandwidth_anomaly', 'medium', device_id FROM j WHERE bps > 0 AND own / bps > 5 UNION ALL SELECT 'temporal_anomaly', 'low', device_id FROM j WHERE hour(ts) = 3)
    SELECT device_id, type, severity, count(*) AS n FROM a GROUP BY ALL"""
)
def device_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-91, OP-145: later flows against profiles of earlier ones."""
    found = profiles.anomalies(flows(spark, sf_dir).where("ts >= timestamp_ntz'1998-01-01'"), _profiles(spark, sf_dir))
    return found.groupBy("device_id", "type", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {PACKETS_SQL}, w AS (SELECT source_ip, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS w, count(*) AS n FROM packets GROUP BY ALL) SELECT source_ip, min(w) AS first_window, max(n) AS active FROM w WHERE n > 20 GROUP BY source_ip")
def port_scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-146, with windows of a week for so thin a table."""
    return profiles.port_scans(packets(spark, sf_dir), 20, "7 days")


@query(
    f"""WITH {FLOWS_SQL}, n AS (SELECT device_id, count(*) AS n FROM flows GROUP BY device_id) SELECT device_id, {_r("least(0.95, 1 - exp(-n / 1000))", "confidence")}, n >= 100 AND least(0.95, 1 - exp(-n / 1000)) >= 0.7 AS is_mature FROM n"""
)
def simple_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-51c, OP-66."""
    n = flows(spark, sf_dir).groupBy("device_id").agg(F.count("*").alias("n"))
    score = profiles.simple_confidence(F.col("n"))
    return rounded(n.select("device_id", score.alias("confidence"), profiles.is_mature(F.col("n"), score).alias("is_mature")))
