"""Queries of roll-ups, scaling and remaining scalar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow import registry, sampling, stats
from heronflow.plans.catalog import query
from heronflow.plans.feature_queries import _r, rounded
from heronflow.plans.ops_queries import _HALVES, _halves, _sql_bins
from heronflow.plans.scoring import SCORED_SQL, scored_flows
from heronflow.sources import sinks, transport
from heronflow.sources.fixtures import FLOWS_SQL, PACKETS_SQL, flows, packets


@query(f"WITH {SCORED_SQL} SELECT count(*) AS flows, count(*) FILTER (n_signature > 0) AS signature_detections, count(*) AS ml_detections, count(*) FILTER (n_signature > 0) AS hybrid, {_r('count(*) FILTER (n_signature > 0) / count(*)', 'signature_rate')}, 1.0::DOUBLE AS ml_rate, {_r('count(*) FILTER (n_signature > 0) / count(*)', 'hybrid_rate')} FROM ranked")
def detection_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-71."""
    rows = scored_flows(spark, sf_dir).select(F.size("signature_matches").alias("n_signature"), F.size("ml_predictions").alias("n_ml"))
    return rounded(stats.detection_statistics(rows))


@query(
    f"""WITH {FLOWS_SQL}, n AS (SELECT device_id, count(*) AS observation_count, least(0.95, count(*) / 50.0) AS confidence_score FROM flows GROUP BY device_id)
    SELECT CASE WHEN device_id % 3 = 0 THEN 'camera' ELSE 'sensor' END AS device_type, count(*) AS devices, {_r("avg(confidence_score)", "avg_confidence")}, {_r("count(*) FILTER (observation_count >= 100 AND confidence_score >= 0.7) / count(*)", "maturity_rate")} FROM n GROUP BY ALL"""
)
def profile_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-69."""
    n = flows(spark, sf_dir).groupBy("device_id").agg(F.count("*").alias("observation_count"))
    rows = n.withColumns({"confidence_score": F.least(F.lit(0.95), F.col("observation_count") / 50.0), "device_type": F.when(F.col("device_id") % 3 == 0, "camera").otherwise("sensor")})
    return rounded(stats.profile_statistics(rows))


@query("SELECT event_type || ':' || (user_id % 5) AS kind, count(*) AS n, count(*) FILTER (value > 400) AS critical FROM events GROUP BY ALL ORDER BY n DESC, kind LIMIT 5")
def error_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-78, OP-120."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("category"), (F.col("user_id") % 5).cast("string").alias("component"), F.when(F.col("value") > 400, "critical").otherwise("low").alias("severity"))
    return stats.error_statistics(rows).limit(5)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-256."""
    return stats.newest(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts"), ["ts", "event_id"], 100)


@query("SELECT event_type, count(*) AS checks, count(*) FILTER (value > 200) AS passed FROM events GROUP BY event_type HAVING count(*) FILTER (value > 200) / count(*) > 0")
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-242, by type."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("passed", F.col("value") > 200)
    return rows.groupBy("event_type").agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed")).where("passed > 0")


@query(f"SELECT count(*) AS checks, count(*) FILTER (value > 200) AS passed, {_r('count(*) FILTER (value > 200) / count(*)', 'success')}, {_r('sum(value)', 'total_s', 3)}, {_r('avg(value)', 'avg_s')}, count(*) FILTER (value > 200) / count(*) >= 0.7 AS healthy FROM events")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-242."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("value") > 200).alias("passed"), F.col("value").alias("duration_s"))
    out = stats.validation_report(rows)
    return rounded(out.withColumn("total_s", F.round("total_s", 3)))


@query(f"SELECT count(*) AS n, {_r('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e9', 'seconds')}, {_r('count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)', 'per_second', 6)} FROM events")
def capture_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-84, OP-218, OP-240; the span in thousands of seconds."""
    return rounded(stats.rate(spark.read.parquet(f"{sf_dir}/events.parquet")).select("n", (F.col("seconds") / F.lit(1000)).alias("seconds"), "per_second"))


@query(f"WITH {PACKETS_SQL} SELECT count(*) FILTER (c) AS pods, {_r('avg(payload_size % 900) FILTER (c)', 'avg_cpu_m')}, {_r('avg(packet_id % 500) FILTER (c)', 'avg_memory_mi')} FROM (SELECT *, packet_id % 10 <> 0 AS c FROM packets)")
def pod_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-250: parsed from lines of text."""
    unit = F.when(F.col("packet_id") % 10 == 0, "n/a").otherwise("Mi")
    line = F.concat(F.lit("pod-"), "packet_id", F.lit("   "), (F.col("payload_size") % 900).cast("string"), F.lit("m  "), (F.col("packet_id") % 500).cast("string"), unit)
    return rounded(stats.pod_metrics(packets(spark, sf_dir).select(line.alias("value"))))


@query(
    f"""WITH {_HALVES}, {_sql_bins(10, False)}, b AS (SELECT v, 1 AS a, 0 AS c FROM base UNION ALL SELECT v, 0, 1 FROM cur), g AS (SELECT v, sum(a) AS a, sum(c) AS c FROM b GROUP BY v), s AS (SELECT sum(a) OVER (ORDER BY v) AS sa, sum(c) OVER (ORDER BY v) AS sc FROM g)
    SELECT 'v' AS feature, (SELECT {_r("max(abs(sa / (SELECT count(*) FROM base) - sc / (SELECT count(*) FROM cur)))", "d")} FROM s) AS d, (SELECT count(*) FROM base) AS n, (SELECT count(*) FROM cur) AS m,
      (SELECT {_r("sum((greatest(q, 0.001) - greatest(p, 0.001)) * ln(greatest(q, 0.001) / greatest(p, 0.001)))", "psi")} FROM sh) AS psi"""
)
def data_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-166, OP-234."""
    return rounded(stats.data_drift(*_halves(spark, sf_dir), ["v", "absent"]))


@query(f"WITH {SCORED_SQL}, b AS (SELECT least(9, CAST(floor(threat_score * 10) AS BIGINT)) AS band, count(*) AS n FROM ranked GROUP BY ALL) SELECT band, n, {_r('sum(n) OVER (ORDER BY band) / sum(n) OVER ()', 'share')} FROM b")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-150."""
    from heronflow import detect

    return rounded(stats.score_bands(detect.fused(scored_flows(spark, sf_dir)), "threat_score"))


@query(
    f"""WITH {FLOWS_SQL}, n AS (SELECT device_id, count(*) AS k FROM flows GROUP BY device_id), t AS (SELECT *, greatest(1, least(10, CAST(trunc(4 * greatest(k / 40.0, (k % 7) / 3.0)) AS INT))) AS target FROM n)
    SELECT device_id, target, abs(target - 4) / 4 >= 0.2 AND device_id % 600 >= 300 AS act, {_r("greatest(0.01, least(1, CASE WHEN k / 60.0 > 0.8 THEN 0.25 WHEN k / 60.0 > 0.6 THEN 0.35 WHEN k / 60.0 < 0.3 THEN 0.6 ELSE 0.5 END))", "rate")} FROM t"""
)
def scaling_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-149, OP-195."""
    n = flows(spark, sf_dir).groupBy("device_id").agg(F.count("*").alias("k"))
    t = n.withColumn("target", registry.target_replicas(F.lit(4), [F.col("k") / 40.0, (F.col("k") % 7) / 3.0], 1, 10))
    out = t.select("device_id", "target", registry.should_scale(F.lit(4), F.col("target"), F.col("device_id") % 600).alias("act"), sampling.adaptive_rate(F.lit(0.5), F.col("k") / 60.0).alias("rate"))
    return rounded(out)


@query(
    """WITH m AS (SELECT event_type AS stage, ts AS arrived, CASE WHEN value <= 300 THEN ts + to_minutes(CAST(floor(value * 20) AS BIGINT)) END AS left_at, event_id % 17 = 0 AS failed FROM events),
    moves AS (SELECT stage, date_trunc('day', arrived) AS d, 1 AS i, 0 AS o, 0 AS f FROM m UNION ALL SELECT stage, date_trunc('day', left_at), 0, 1, CAST(failed AS INT) FROM m WHERE left_at IS NOT NULL),
    days AS (SELECT stage, d, sum(i) AS i, sum(o) AS o, sum(f) AS f FROM moves GROUP BY stage, d),
    sums AS (SELECT stage, d, sum(i) OVER w AS i, sum(o) OVER w AS o, sum(f) OVER w AS f, min(d) OVER w AS first FROM days WINDOW w AS (PARTITION BY stage ORDER BY d))
    SELECT stage, d + INTERVAL 1 DAY AS snapshot, CAST(i AS BIGINT) AS received, CAST(o AS BIGINT) AS processed, CAST(f AS BIGINT) AS errors, CAST(i - o AS BIGINT) AS waiting, round(o * 1000 / (epoch(d + INTERVAL 1 DAY) - epoch(first)), 6) AS per_1000_seconds FROM sums"""
)
def pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-85: counters, queues and rates of each stage, day by day; some rows
    take days to go through, some never do."""
    leaves = F.when(F.col("value") <= 300, F.col("ts") + F.make_dt_interval(mins=F.floor(F.col("value") * 20).cast("int")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("stage"), F.col("ts").alias("arrived"), leaves.alias("left_at"), (F.col("event_id") % 17 == 0).alias("failed"))
    out = stats.pipeline_snapshots(rows, "1 day")
    return out.withColumn("per_1000_seconds", F.round(F.col("per_second") * 1000, 6)).drop("per_second")


@query("SELECT event_type AS component, count(*) FILTER (value > 100) / count(*) >= 0.8 AS healthy FROM events GROUP BY event_type")
def component_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-77, OP-241: which components are healthy."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.groupBy(F.col("event_type").alias("component")).agg((F.count_if(F.col("value") > 100) / F.count("*") >= 0.8).alias("healthy"))


@query("WITH c AS (SELECT event_type AS component, count(*) FILTER (value > 100) / count(*) >= 0.8 AS healthy FROM events GROUP BY event_type) SELECT count(*) FILTER (healthy) / count(*) AS health, CASE WHEN count(*) FILTER (healthy) / count(*) >= 0.8 THEN 'healthy' WHEN count(*) FILTER (healthy) / count(*) >= 0.5 THEN 'degraded' ELSE 'unhealthy' END AS status, coalesce(array_to_string(list_sort(list(component) FILTER (NOT healthy)), ','), '') AS unhealthy FROM c")
def system_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-77, OP-241."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    states = rows.groupBy(F.col("event_type").alias("component")).agg((F.count_if(F.col("value") > 100) / F.count("*") >= 0.8).alias("healthy"))
    return registry.component_health(states).withColumn("unhealthy", F.array_join("unhealthy", ","))


@query(f"WITH {SCORED_SQL} SELECT flow_id, '[' || severity || '] ' || attack_category || ' on ' || device_id || ', score ' || printf('%.2f', floor(threat_score * 100 + 1e-7) / 100) AS message FROM scored WHERE severity = 'CRITICAL'")
def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-39: a score in a message is cut to two digits, not rounded up."""
    from heronflow.plans.scoring import all_detections

    return all_detections(spark, sf_dir).where("severity = 'CRITICAL'").select("flow_id", sinks.notification().alias("message"))


@query("""WITH r AS (SELECT event_type AS codec, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS original, CAST(sum(octet_length(encode(props))) AS BIGINT) AS compressed, count(*) / 100.0 AS seconds, user_id % 7 AS run FROM events GROUP BY ALL),
  t AS (SELECT *, original / greatest(1, compressed) AS r, original / greatest(1e-9, seconds) AS s FROM r)
  SELECT run, arg_max(codec, {'a': r, 'b': codec}) AS by_ratio, arg_max(codec, {'a': s, 'b': codec}) AS by_speed, round(max(r), 6) AS best_ratio FROM t GROUP BY run""")
def codec_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-81: the best codec of each of seven runs, by ratio and by speed."""
    size, time = F.sum(F.floor(F.col("value") * 100)), F.count("*") / 100.0
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy((F.col("user_id") % 7).alias("run"), F.col("event_type").alias("codec")).agg(size.alias("original"), F.sum(F.octet_length("props")).alias("compressed"), time.alias("seconds"))
    ratio, speed = (sinks.best_codec(rows, by, ["run"]) for by in ("ratio", "speed"))
    return ratio.select("run", F.col("codec").alias("by_ratio"), F.round("best_ratio", 6).alias("best_ratio")).join(speed.select("run", F.col("codec").alias("by_speed")), "run")


@query("SELECT event_type, round(count(*) FILTER (('0x' || substr(md5(CAST(event_id AS VARCHAR) || '#0'), 1, 8))::BIGINT / 4294967296.0 < 0.25) / count(*), 6) AS actual_rate FROM events GROUP BY event_type")
def sampling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-82: the share that a sample of a quarter did take, by type."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = sampling.actual_rate(rows, sampling.uniform("event_id") < 0.25, ["event_type"])
    return out.select("event_type", F.round("actual_rate", 6).alias("actual_rate"))


@query("SELECT round(avg(value), 6) AS avg_latency_ms, round(sum(event_id % 3) / count(*), 6) AS retry_rate, count(*) FILTER (value <= 300) AS delivered FROM events")
def transport_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-83: latency and retries of all receipts."""
    receipts = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("value").alias("latency_ms"), (F.col("event_id") % 3).alias("retries"), (F.col("value") <= 300).alias("delivered"))
    out = transport.transport_statistics(receipts)
    return out.select(F.round("avg_latency_ms", 6).alias("avg_latency_ms"), F.round("retry_rate", 6).alias("retry_rate"), "delivered")
