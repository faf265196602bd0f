"""Queries of flow assembly and the feature families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow import features, flows as assembly
from heronflow.functions import dns_tls
from heronflow.operators import relational
from heronflow.plans.catalog import query
from heronflow.sources.fixtures import FLOWS_SQL, PACKETS_SQL, flows, packets


#: Moves exact halves off the border, where engines round differently.
NUDGE = 1 + 1e-12


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c) * NUDGE, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) * {NUDGE!r}, {digits}) AS {name}"


_DERIVED = """derived AS (
  SELECT *, bytes_sent + bytes_received AS total_bytes, packets_sent + packets_received AS total_packets,
    CASE WHEN packets_sent > 0 THEN bytes_sent / packets_sent ELSE 0 END AS sent_each,
    CASE WHEN packets_received > 0 THEN bytes_received / packets_received ELSE 0 END AS received_each FROM flows
)"""


@query(
    f"""WITH {FLOWS_SQL}, {_DERIVED} SELECT flow_id, total_bytes, total_packets, {_r("sent_each", "bytes_per_packet_sent")}, {_r("received_each", "bytes_per_packet_received")},
    packets_sent > 0 AND packets_received > 0 AS is_bidirectional FROM derived"""
)
def flow_derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-41."""
    return rounded(features.derived(flows(spark, sf_dir)).select("flow_id", "total_bytes", "total_packets", "bytes_per_packet_sent", "bytes_per_packet_received", "is_bidirectional"))


@query(
    f"""WITH {PACKETS_SQL}, gaps AS (
      SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY source_ip, destination_ip, source_port, destination_port, protocol ORDER BY ts, packet_id)) / 1000.0 AS gap FROM packets
    )
    SELECT source_ip, destination_ip, source_port, destination_port, protocol, min(ts) AS ts, CAST(sum(payload_size) AS BIGINT) AS bytes_sent, count(*) AS packets_sent,
      CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS duration_ms, {_r("coalesce(avg(gap), 0)", "inter_arrival_mean_ms", 3)},
      {_r("coalesce(stddev_samp(gap), 0)", "inter_arrival_std_ms", 3)},
      coalesce(array_to_string(list_sort(list_distinct(flatten(list(tcp_flags) FILTER (tcp_flags IS NOT NULL)))), ','), '') AS tcp_flags,
      count(nullif(tcp_sequence_number, 0)) - count(DISTINCT nullif(tcp_sequence_number, 0)) AS retransmissions,
      CAST(coalesce(list_contains(flatten(list(tcp_flags) FILTER (tcp_flags IS NOT NULL)), 'SYN'), false) AS DOUBLE) AS syn_fin_ratio
    FROM gaps GROUP BY ALL"""
)
def flow_assembly_5tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-53, OP-54, OP-100."""
    out = assembly.assemble_flows(packets(spark, sf_dir))
    return out.select(
        *assembly.FIVE_TUPLE,
        "ts",
        "bytes_sent",
        "packets_sent",
        "duration_ms",
        F.round(F.col("inter_arrival_mean_ms") * NUDGE, 3).alias("inter_arrival_mean_ms"),
        F.round(F.col("inter_arrival_std_ms") * NUDGE, 3).alias("inter_arrival_std_ms"),
        F.array_join("tcp_flags", ",").alias("tcp_flags"),
        "retransmissions",
        "syn_fin_ratio",
    )


@query(
    f"""WITH {PACKETS_SQL}, marked AS (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY device_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM packets
    ), numbered AS (SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY ts) AS s FROM marked)
    SELECT device_id, count(*) AS packets, CAST(sum(payload_size) AS BIGINT) AS bytes, min(ts) AS first_seen, max(ts) AS last_seen,
      CAST(greatest(1, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000)) AS BIGINT) AS duration_ms FROM numbered GROUP BY device_id, s"""
)
def flow_sessions_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-180: sessions of a device that six hours of silence end."""
    return assembly.session_flows(packets(spark, sf_dir), "6 hours", ["device_id"])


@query(f"WITH {PACKETS_SQL} SELECT source_ip, destination_ip, source_port, destination_port, protocol, count(*) AS packets, CAST(sum(payload_size) AS BIGINT) AS bytes, min(ts) AS first_seen, max(ts) AS last_seen FROM packets GROUP BY ALL")
def flow_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-80."""
    return assembly.flow_counters(packets(spark, sf_dir))


_TEMPORAL = f"""
    counts AS (SELECT w, destination_port, count(*) AS n FROM rows GROUP BY ALL),
    ports AS (SELECT w, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM counts GROUP BY w)
    SELECT w AS window_start, CAST(count(*) AS DOUBLE) AS flow_count, CAST(sum(total_bytes) AS DOUBLE) AS total_bytes, CAST(sum(total_packets) AS DOUBLE) AS total_packets,
      {_r("avg(duration_ms)", "avg_duration", 4)}, {_r("coalesce(stddev_samp(duration_ms) FILTER (duration_ms > 0), 0)", "duration_std", 4)},
      CAST(coalesce(max(duration_ms) FILTER (duration_ms > 0), 0) AS DOUBLE) AS duration_max, CAST(coalesce(min(duration_ms) FILTER (duration_ms > 0), 0) AS DOUBLE) AS duration_min,
      CAST(count(DISTINCT protocol) AS DOUBLE) AS protocol_diversity, {_r("count(*) FILTER (protocol = 'TCP') / count(*)", "tcp_ratio", 4)}, {_r("count(*) FILTER (protocol = 'UDP') / count(*)", "udp_ratio", 4)},
      CAST(count(DISTINCT destination_port) AS DOUBLE) AS unique_dst_ports, {_r("any_value(h)", "port_entropy", 4)},
      {_r("coalesce(avg(sent_each) FILTER (packets_sent > 0), 0)", "avg_bytes_per_packet", 4)}, {_r("coalesce(stddev_samp(sent_each) FILTER (packets_sent > 0), 0)", "bytes_per_packet_std", 4)}
    FROM rows JOIN ports USING (w) GROUP BY w"""


@query(f"WITH {FLOWS_SQL}, {_DERIVED}, rows AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM derived), {_TEMPORAL}")
def temporal_features_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-55, OP-181 over an hour."""
    return rounded(features.temporal(flows(spark, sf_dir), "1 hour"), 4)


_AS_FLOWS = "flows AS (SELECT ts, protocol, destination_port, payload_size AS bytes_sent, 0 AS bytes_received, 1 AS packets_sent, 0 AS packets_received, packet_id % 3000 AS duration_ms, CAST(packet_id AS VARCHAR) AS flow_id, device_id, source_ip, destination_ip, source_port FROM packets)"


def packet_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each packet as a flow of its own, with a made-up duration."""
    rows = packets(spark, sf_dir)
    return rows.select("ts", "protocol", "destination_port", F.col("payload_size").alias("bytes_sent"), F.lit(0).alias("bytes_received"), F.lit(1).alias("packets_sent"), F.lit(0).alias("packets_received"), (F.col("packet_id") % 3000).alias("duration_ms"), F.col("packet_id").cast("string").alias("flow_id"), "device_id", "source_ip", "destination_ip", "source_port")


@query(f"WITH {PACKETS_SQL}, {_AS_FLOWS}, {_DERIVED}, rows AS (SELECT *, time_bucket(INTERVAL 5 MINUTES, ts) AS w FROM derived), {_TEMPORAL}")
def temporal_features_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-55, OP-181 over the default five minutes."""
    return rounded(features.temporal(packet_flows(spark, sf_dir), "5 minutes"), 4)


@query(
    f"""WITH {FLOWS_SQL} SELECT protocol, {_r("avg(bytes_sent)", "mean", 4)}, {_r("coalesce(stddev_samp(bytes_sent), 0)", "std", 4)}, min(bytes_sent) AS min, max(bytes_sent) AS max, count(bytes_sent) AS count,
    {_r("quantile_cont(bytes_sent, 0.5)", "median", 4)}, {_r("quantile_cont(bytes_sent, 0.95)", "percentile_95", 4)}, CAST(sum(bytes_sent) AS BIGINT) AS sum FROM flows GROUP BY protocol"""
)
def aggregate_function_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-52."""
    return rounded(features.aggregate_set(flows(spark, sf_dir), ["protocol"], "bytes_sent"), 4)


@query(
    f"""WITH {FLOWS_SQL}, {_DERIVED}, gaps AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY device_id ORDER BY ts, flow_id)) / 1e6 AS gap FROM derived)
    SELECT device_id, CAST(count(DISTINCT destination_ip) AS DOUBLE) AS unique_destinations, CAST(count(DISTINCT source_ip) AS DOUBLE) AS unique_sources,
      CAST(count(DISTINCT destination_ip) + count(DISTINCT source_ip) AS DOUBLE) AS communication_diversity, {_r("coalesce(avg(gap), 0)", "avg_inter_flow_time", 3)},
      {_r("coalesce(stddev_samp(gap), 0)", "inter_flow_time_std", 3)}, {_r("count(*) FILTER (protocol = 'TCP') / count(*)", "tcp_preference", 3)}, {_r("count(*) FILTER (protocol = 'UDP') / count(*)", "udp_preference", 3)},
      {_r("count(*) FILTER (protocol = 'ICMP') / count(*)", "icmp_preference", 3)}, CAST(sum(total_bytes) AS DOUBLE) AS total_bandwidth_bytes,
      {_r("coalesce(sum(total_bytes) * 8 / (sum(duration_ms) FILTER (duration_ms > 0) / 1000), 0)", "avg_bandwidth_bps", 3)} FROM gaps GROUP BY device_id"""
)
def device_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-56, OP-101."""
    return rounded(features.device(flows(spark, sf_dir)), 3)


@query(
    f"""WITH {FLOWS_SQL}, out AS (SELECT source_ip, count(DISTINCT destination_ip) AS fan_out, count(*) AS n FROM flows GROUP BY source_ip),
    into_ AS (SELECT destination_ip, count(*) AS fan_in FROM flows GROUP BY destination_ip),
    m AS (SELECT avg(fan_out) AS avg_fan_out, sum(coalesce(fan_in, 0)) / count(*) AS avg_fan_in, sum(fan_out) / sum(n) AS fan_out_ratio, sum(coalesce(fan_in, 0)) / sum(n) AS fan_in_ratio
      FROM out LEFT JOIN into_ ON out.source_ip = into_.destination_ip),
    s AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT count(*) AS n FROM flows GROUP BY source_port)),
    d AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT count(*) AS n FROM flows GROUP BY destination_port)),
    p AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) AS k FROM (SELECT count(*) AS n FROM flows GROUP BY protocol))
    SELECT {_r("avg_fan_out", "avg_fan_out")}, {_r("avg_fan_in", "avg_fan_in")}, {_r("fan_out_ratio", "fan_out_ratio")}, {_r("fan_in_ratio", "fan_in_ratio")},
      {_r("s.h", "src_port_entropy")}, {_r("d.h", "dst_port_entropy")}, {_r("p.h", "protocol_entropy")}, CAST(p.k AS DOUBLE) AS protocol_diversity, {_r("(s.h + d.h) / 2", "port_distribution_entropy")} FROM m, s, d, p"""
)
def directional_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-57, OP-92."""
    return rounded(features.directional(flows(spark, sf_dir)))


@query(
    f"""WITH {PACKETS_SQL}, {_AS_FLOWS}, gaps AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY device_id ORDER BY ts, flow_id)) / 1e6 AS gap FROM flows),
    hours AS (SELECT device_id, CAST(count(*) AS DOUBLE) AS time_diversity, max(c) / sum(c) AS peak FROM (SELECT device_id, hour(ts) AS h, count(*) AS c FROM flows GROUP BY ALL) GROUP BY device_id)
    SELECT device_id, count(*) AS n, {_r("coalesce(avg(gap), 0)", "inter_arrival_mean", 3)}, {_r("coalesce(stddev_samp(gap), 0)", "inter_arrival_std", 3)}, {_r("coalesce(min(gap), 0)", "inter_arrival_min", 3)},
      {_r("coalesce(max(gap), 0)", "inter_arrival_max", 3)}, {_r("CASE WHEN count(*) > 3 AND avg(gap) > 0 THEN 1 / (1 + stddev_samp(gap) / avg(gap)) ELSE 0 END", "periodicity_score", 3)},
      {_r("coalesce(count(*) FILTER (duration_ms BETWEEN 1 AND 999) / nullif(count(*) FILTER (duration_ms > 0), 0), 0)", "burst_ratio", 3)}, any_value(time_diversity) AS time_diversity, {_r("any_value(peak)", "peak_hour_ratio", 3)}
    FROM gaps JOIN hours USING (device_id) GROUP BY device_id"""
)
def timing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-58, OP-102."""
    return rounded(features.timing(packet_flows(spark, sf_dir), ["device_id"]), 3)


@query(
    f"""WITH {FLOWS_SQL}, counts AS (SELECT device_id, destination_ip, count(*) AS n FROM flows GROUP BY ALL)
    SELECT device_id, {_r("log2(sum(n)) - sum(n * log2(n)) / sum(n)", "entropy")} FROM counts GROUP BY device_id"""
)
def entropy_by_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-59, OP-109."""
    return rounded(features.entropy(flows(spark, sf_dir), ["device_id"], "destination_ip"))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host")).where("host <> ''")


_HOSTS = "hosts AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) <> '')"
_CHARS = "entropies AS (SELECT page_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT page_id, c, count(*) AS n FROM (SELECT page_id, unnest(string_split(host, '')) AS c FROM hosts) WHERE c <> '' GROUP BY ALL) GROUP BY page_id)"


@query(
    f"""WITH {_HOSTS}, {_CHARS} SELECT page_id, CAST(length(host) AS DOUBLE) AS dns_query_length, CAST(len(string_split(host, '.')) - 1 AS DOUBLE) AS dns_subdomain_count, {_r("h", "dns_query_entropy")},
    {_r("length(regexp_replace(host, '[^0-9]', '', 'g')) / length(host)", "dns_digit_ratio")}, {_r("length(regexp_replace(host, '[^aeiouAEIOU]', '', 'g')) / length(host)", "dns_vowel_ratio")},
    CAST(regexp_matches(host, '[0-9]') AS DOUBLE) AS dns_has_numbers, CAST(contains(host, '-') AS DOUBLE) AS dns_has_hyphens, CAST(length(host) > 50 OR length(host) < 3 AS DOUBLE) AS dns_length_suspicious
    FROM hosts JOIN entropies USING (page_id)"""
)
def dns_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hosts(spark, sf_dir)
    return rounded(rows.select("page_id", *(c.alias(n) for n, c in dns_tls.dns_features(F.col("host")).items())))


@query(
    f"""WITH {_HOSTS}, {_CHARS}, shaped AS (SELECT *, ['TLSv1.3', 'TLSv1.2', 'TLSv1.1', 'TLSv1.0', 'other', NULL][CAST(page_id % 6 AS INT) + 1] AS version, CASE WHEN page_id % 2 = 0 THEN md5(host) END AS ja3 FROM hosts JOIN entropies USING (page_id))
    SELECT page_id, CAST(length(host) AS DOUBLE) AS tls_sni_length, {_r("h", "tls_sni_entropy")}, CAST(len(string_split(host, '.')) - 1 AS DOUBLE) AS tls_sni_subdomain_count,
    CAST(regexp_matches(host, '^[0-9]+([.][0-9]+){{3}}$') AS DOUBLE) AS tls_sni_has_ip, CAST(regexp_matches(host, '[.](tk|ml|ga|cf|bit|onion)$') AS DOUBLE) AS tls_sni_suspicious_tld,
    CAST(ja3 IS NOT NULL AS DOUBLE) AS tls_ja3_present, CAST(coalesce(('0x' || substr(md5(ja3), 1, 8))::BIGINT % 1000000, 0) AS DOUBLE) AS tls_ja3_hash, 0.0::DOUBLE AS tls_ja3s_present, 0.0::DOUBLE AS tls_ja3s_hash,
    CAST(CASE version WHEN 'TLSv1.3' THEN 1.0 WHEN 'TLSv1.2' THEN 0.8 WHEN 'TLSv1.1' THEN 0.4 WHEN 'TLSv1.0' THEN 0.2 WHEN 'other' THEN 0.5 ELSE 0 END AS DOUBLE) AS tls_version_score FROM shaped"""
)
def tls_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = F.array(*(F.lit(v) for v in ("TLSv1.3", "TLSv1.2", "TLSv1.1", "TLSv1.0", "other", None)))
    rows = _hosts(spark, sf_dir).withColumns({"version": F.element_at(versions, (F.col("page_id") % 6).cast("int") + 1), "ja3": F.when(F.col("page_id") % 2 == 0, F.md5("host"))})
    made = dns_tls.tls_features(F.col("host"), F.col("version"), F.col("ja3"), F.lit(None).cast("string"))
    return rounded(rows.select("page_id", *(c.alias(n) for n, c in made.items())))


_SCALED = {
    "flow_count": "ln(1 + flow_count) / 10",
    "total_bytes": "ln(1 + total_bytes) / 20",
    "avg_duration": "greatest(0, least(1, avg_duration))",  # "duration" holds "ratio", which comes first
    "protocol_diversity": "ln(1 + protocol_diversity) / 10",
    "tcp_ratio": "greatest(0, least(1, tcp_ratio))",
    "port_entropy": "greatest(0, least(1, port_entropy))",
    "unique_dst_ports": "greatest(0, least(1, unique_dst_ports / 100))",
}


@query(f"WITH {FLOWS_SQL}, {_DERIVED}, rows AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM derived), wide AS (WITH {_TEMPORAL}) SELECT window_start, {', '.join(_r(e, n, 4) for n, e in _SCALED.items())} FROM wide")
def normalized_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rounded(features.temporal(flows(spark, sf_dir), "1 hour"), 4).select("window_start", *_SCALED)
    return rounded(features.normalised(wide, list(_SCALED)), 4)


@query(
    f"""WITH {FLOWS_SQL}, {_DERIVED} SELECT flow_id, {_r("CASE WHEN bytes_received > 0 THEN bytes_sent / bytes_received ELSE 0 END", "bytes_ratio")}, {_r("CASE WHEN packets_received > 0 THEN packets_sent / packets_received ELSE 0 END", "packets_ratio")},
    {_r("CASE WHEN duration_ms > 0 THEN total_bytes / (duration_ms / 1000) ELSE 0 END", "bytes_per_second")}, {_r("CASE WHEN duration_ms > 0 THEN total_packets / (duration_ms / 1000) ELSE 0 END", "packets_per_second")},
    {_r("CASE WHEN total_packets > 0 THEN total_bytes / total_packets ELSE 0 END", "avg_packet_size")}, CAST(source_port > 1024 AS INT) AS is_high_src_port, CAST(destination_port > 1024 AS INT) AS is_high_dst_port,
    {_r("ln(1 + duration_ms / 1000)", "log_duration")}, {_r("ln(1 + total_bytes)", "log_total_bytes")}, {_r("hour(ts) / 24", "time_of_day")}, {_r("(isodow(ts) - 1) / 7", "day_of_week")} FROM derived"""
)
def training_feature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-219, OP-261."""
    names = ["bytes_ratio", "packets_ratio", "bytes_per_second", "packets_per_second", "avg_packet_size", "is_high_src_port", "is_high_dst_port", "log_duration", "log_total_bytes", "time_of_day", "day_of_week"]
    return rounded(features.training_features(flows(spark, sf_dir)).select("flow_id", *names))


@query(
    f"""WITH {PACKETS_SQL}, rows AS (SELECT *, count(*) OVER (PARTITION BY device_id) AS n, row_number() OVER w AS k, list(CAST(payload_size AS DOUBLE)) OVER (PARTITION BY device_id ORDER BY ts, packet_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS s
      FROM packets WINDOW w AS (PARTITION BY device_id ORDER BY ts, packet_id))
    SELECT device_id, packet_id, CAST(list_sum(s) AS DOUBLE) AS total, CAST(s[1] AS DOUBLE) AS first_value FROM rows WHERE len(s) = 8"""
)
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-106: sums and heads of the windows of eight packets."""
    rows = features.sequences(packets(spark, sf_dir), ["device_id"], ["ts", "packet_id"], "payload_size", 8)
    return rows.select("device_id", "packet_id", F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x).alias("total"), F.col("sequence")[0].alias("first_value"))


@query(
    f"""WITH {PACKETS_SQL}, d AS (SELECT payload_size - lag(payload_size) OVER w AS d1, destination_port - lag(destination_port) OVER w AS d2, tcp_sequence_number - lag(tcp_sequence_number) OVER w AS d3 FROM packets WINDOW w AS (PARTITION BY device_id ORDER BY ts, packet_id)),
    v AS (SELECT var_pop(d1) AS a, var_pop(d2) AS b, var_pop(d3) AS c FROM d)
    SELECT {_r("a / (a + b + c)", "payload_size")}, {_r("b / (a + b + c)", "destination_port")}, {_r("c / (a + b + c)", "tcp_sequence_number")} FROM v"""
)
def difference_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-107: variance of first differences of each feature, normalised."""
    from pyspark.sql import Window

    w = Window.partitionBy("device_id").orderBy("ts", "packet_id")
    names = ["payload_size", "destination_port", "tcp_sequence_number"]
    found = packets(spark, sf_dir).select(*((F.col(c) - F.lag(c).over(w)).alias(c) for c in names)).agg(*(F.var_pop(c).alias(c) for c in names))
    total = sum((F.col(c) for c in names), F.lit(0.0))
    return rounded(found.select(*((F.col(c) / total).alias(c) for c in names)))


@query(
    f"""WITH {PACKETS_SQL}, spans AS (SELECT g AS window_start, g + INTERVAL 6 HOURS AS window_end FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-10', INTERVAL 6 HOURS)) AS g))
    SELECT window_start, count(*) AS n, CAST(sum(payload_size) AS BIGINT) AS bytes FROM packets JOIN spans ON ts BETWEEN window_start AND window_end GROUP BY window_start"""
)
def window_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-42, OP-92a: explicit windows, closed at both ends."""
    rows = features.closed_windows(packets(spark, sf_dir), F.lit("2024-01-01").cast("timestamp_ntz"), 360)
    return rows.groupBy("window_start").agg(F.count("*").alias("n"), F.sum("payload_size").alias("bytes"))


@query(
    f"""WITH {PACKETS_SQL}, spans AS (SELECT device_id, min(ts) AS a, max(ts) AS b FROM packets GROUP BY device_id, packet_id // 400)
    SELECT x.device_id, count(*) AS n FROM spans x JOIN spans y ON x.device_id = y.device_id AND x.a < y.b AND y.a < x.b GROUP BY x.device_id"""
)
def window_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-43: pairs of a device's intervals that overlap (strictly)."""
    spans = packets(spark, sf_dir).groupBy("device_id", F.expr("packet_id div 400").alias("k")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return relational.overlap_join(spans, "device_id", 86_400).groupBy("device_id").agg(F.count("*").alias("n"))
