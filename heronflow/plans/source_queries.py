"""Queries of sources, documents and streams over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow import sampling
from heronflow.plans.catalog import query
from heronflow.sources import logs, transport
from heronflow.sources.checkpoints import new_folder
from heronflow.sources.fixtures import FLOWS_SQL, PACKETS_SQL, flows, packets, packets_of
from heronflow.streaming import flows as streams

_FIND = {"bool": {"must": [{"terms": {"protocol": ["TCP", "UDP"]}}, {"range": {"bytes_sent": {"gte": 90000, "lt": 95000}}}], "must_not": [{"term": {"destination_port": 22}}]}}


@query(f"WITH {FLOWS_SQL} SELECT flow_id, ts, bytes_sent FROM flows WHERE protocol IN ('TCP', 'UDP') AND bytes_sent >= 90000 AND bytes_sent < 95000 AND destination_port <> 22 ORDER BY ts DESC, flow_id LIMIT 30")
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-26, §2.13."""
    return transport.search(flows(spark, sf_dir), _FIND, [("ts", "desc"), ("flow_id", "asc")], 30).select("flow_id", "ts", "bytes_sent")


@query("SELECT CAST(event_id AS VARCHAR) AS message_id, event_type AS priority, value FROM events")
def bus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-18, OP-22: to the bus's shape and back."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("message_id"), F.col("event_type").alias("priority"), F.struct("value").alias("payload"), "ts")
    return transport.from_bus(transport.to_bus(rows), "struct<value:double>").select("message_id", "priority", "payload.value")


@query("SELECT CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes, count(*) AS messages, min(ts) AS oldest FROM events WHERE value > 300")
def buffer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-38."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("value > 300").withColumnRenamed("props", "message")
    return transport.buffer_status(rows, F.lit(None).cast("timestamp")).select("bytes", "messages", "oldest")


@query(
    """SELECT c_custkey AS row, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS src_port, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS dns_AA,
    CASE WHEN c_nationkey % 2 = 1 THEN c_mktsegment ELSE 'normal' END AS threat_label, c_nationkey % 2 = 1 AS is_threat FROM customer"""
)
def csv_typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-16, OP-17: text columns with null tokens to typed ones."""
    text = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").cast("string").alias("row"),
        F.when(F.col("c_custkey") % 5 == 0, "-").otherwise(F.col("c_nationkey").cast("string")).alias("src_port"),
        F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 2 == 0, "T").otherwise("F").alias("dns_AA"),
        (F.col("c_nationkey") % 2).cast("string").alias("label"),
        F.col("c_mktsegment").alias("type"),
    )
    return logs.typed_rows(text).select(F.col("row").cast("bigint").alias("row"), "src_port", "dns_AA", "threat_label", "is_threat")


def _streamed(spark: SparkSession, sf_dir: str, build, mode: str) -> DataFrame:
    """Run a stream over the events' files to its end; its result as a table.

    A last row far in the future moves the watermark past all windows.
    """
    folder = new_folder(spark, "stream")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    end = events.limit(1).withColumns({"ts": F.lit("2100-01-01").cast("timestamp_ntz"), "user_id": F.lit(-1).cast("bigint")})
    events.repartition(4, "event_id").write.parquet(f"{folder}/in")
    end.write.mode("append").parquet(f"{folder}/late")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in").union(spark.readStream.schema(events.schema).parquet(f"{folder}/late"))
    query_ = build(packets_of(stream)).writeStream.format("parquet" if mode == "append" else "memory").outputMode(mode)
    query_ = query_.option("checkpointLocation", f"{folder}/state")
    if mode == "append":
        query_.option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{folder}/out")
    raise ValueError(mode)


@query(
    f"""WITH {PACKETS_SQL}, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY device_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM packets),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY ts) AS s FROM marked) SELECT device_id, count(*) AS packets, CAST(sum(payload_size) AS BIGINT) AS bytes, min(ts) AS first_seen FROM numbered GROUP BY device_id, s"""
)
def stream_session_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-180 as a stream, to be equal to the batch."""
    return _streamed(spark, sf_dir, lambda p: streams.sessions(p, "6 hours", "40 days", ["device_id"]), "append").where("device_id >= 0").select("device_id", "packets", "bytes", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"))


@query(f"WITH {PACKETS_SQL} SELECT protocol, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n FROM packets GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-183 as a stream."""
    build = lambda p: streams.window_counts(p.where("device_id >= 0 or ts > timestamp_ntz'2099-01-01'"), ["protocol"], {"day": "1 day"}, "40 days")[0]
    out = _streamed(spark, sf_dir, build, "append")
    return out.select("protocol", F.col("window.start").cast("timestamp_ntz").alias("day"), "n").where("day < timestamp_ntz'2099-01-01'")


@query(f"""WITH {PACKETS_SQL}, l AS (SELECT *, (packet_id % 100) / 100.0 AS level, payload_size % 5 AS priority FROM packets)
  SELECT protocol, priority, count(*) AS n FROM l WHERE level < 0.8 OR (level < 0.95 AND priority >= 2) OR priority >= 3 GROUP BY ALL""")
def queue_under_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-198: what a queue takes, empty to full; between the marks nothing of
    low priority."""
    rows = packets(spark, sf_dir).withColumns({"level": (F.col("packet_id") % 100) / 100.0, "priority": F.col("payload_size") % 5})
    kept = rows.where(streams.keep_under_load(F.col("level"), F.col("priority"), F.col("packet_id"), rate=0.0))
    return kept.groupBy("protocol", "priority").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {PACKETS_SQL}, a AS (SELECT DISTINCT CAST(device_id AS VARCHAR) AS device, ts FROM packets WHERE large),
    admitted AS (SELECT device, min(ts) AS ts FROM a GROUP BY device UNION ALL SELECT device, t FROM (SELECT p.device, min(a.ts) AS t FROM admitted p JOIN a ON a.device = p.device AND a.ts >= p.ts + INTERVAL 3 DAYS GROUP BY p.device, p.ts))
    SELECT device, ts FROM admitted"""
)
def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-112 as a stream, to be equal to the batch: three days of quiet."""
    build = lambda p: streams.cooled_down(p.where("large or device_id < 0").withColumn("device", F.col("device_id").cast("string")), "device", 3 * 24 * 60, "40 days")
    out = _streamed(spark, sf_dir, build, "append").where("device <> '-1'")
    return out.select("device", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"))


@query(f"""WITH {PACKETS_SQL}, l AS (SELECT *, (packet_id % 100) / 100.0 AS level, payload_size % 5 AS priority FROM packets)
  SELECT priority, count(*) AS offered, count(*) FILTER (level < 0.8 OR (level < 0.95 AND (priority >= 2 OR ('0x' || substr(md5(CAST(packet_id AS VARCHAR) || '#0'), 1, 8))::BIGINT / 4294967296.0 < 0.5)) OR priority >= 3) AS taken FROM l GROUP BY ALL""")
def queue_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-198: between the marks half of low priority is taken."""
    rows = packets(spark, sf_dir).withColumns({"level": (F.col("packet_id") % 100) / 100.0, "priority": F.col("payload_size") % 5})
    kept = streams.keep_under_load(F.col("level"), F.col("priority"), F.col("packet_id"), chance=sampling.uniform("packet_id"))
    return rows.groupBy("priority").agg(F.count("*").alias("offered"), F.count_if(kept).alias("taken"))
