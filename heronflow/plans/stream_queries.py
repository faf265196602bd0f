"""Queries of streams that keep state, each with the SQL of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.flows import FIVE_TUPLE
from heronflow.plans.catalog import ORACLE, query
from heronflow.plans.ops_queries import decoder_sides
from heronflow.sources.checkpoints import new_folder
from heronflow.sources.fixtures import PACKETS_SQL, packets
from heronflow.sources.versioned import KeyedTable, change_status
from heronflow.streaming import enrich, merge, profiles

#: Time of the rows that only move the watermark past all others.
END = "timestamp_ntz'2100-01-01'"


def _stream(rows: DataFrame, folder: str, files: int = 3) -> DataFrame:
    """``rows`` as a stream of ``files`` batches, not in the order of time, and a
    last one that moves the watermark."""
    spark = rows.sparkSession
    rows.repartition(files).write.parquet(folder)
    rows.limit(1).withColumn("ts", F.expr(END)).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(folder)


def _ended(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream has given when all its input is read."""
    out = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


_CHANGED = "SELECT c_custkey, (c_nationkey + 1) % 25 AS c_nationkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 50 <> 0 UNION ALL SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 50 <> 0"


@query(
    f"""WITH {PACKETS_SQL}, changed AS ({_CHANGED}), seen AS (
      SELECT 1 AS dimension_version, c_nationkey, payload_size FROM packets LEFT JOIN customer ON c_custkey = device_id WHERE ts < TIMESTAMP '2024-01-16'
      UNION ALL SELECT 2, changed.c_nationkey, payload_size FROM packets LEFT JOIN changed ON c_custkey = device_id WHERE ts >= TIMESTAMP '2024-01-16')
    SELECT dimension_version, c_nationkey, count(*) AS n, CAST(sum(payload_size) AS BIGINT) AS bytes FROM seen GROUP BY ALL"""
)
def stream_enrichment_reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-89: the dimension gets updates and deletes between two runs of one
    stream."""
    folder = new_folder(spark, "enrich")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("device_id"), F.col("c_nationkey").cast("bigint").alias("c_nationkey"))
    dimension = KeyedTable(spark, f"{folder}/dimension", ["device_id"])
    dimension.merge(customer.withColumn("at", F.lit(1)), "at")
    rows = packets(spark, sf_dir).select("device_id", "ts", "payload_size")
    rows.where("ts < timestamp_ntz'2024-01-16'").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    enrich.enriched(stream, dimension, "device_id", f"{folder}/out", folder).awaitTermination()
    changes = customer.where("device_id % 3 = 0 or device_id % 50 = 0").select("device_id", ((F.col("c_nationkey") + 1) % 25).alias("c_nationkey"), F.lit(2).alias("at"), (F.col("device_id") % 50 == 0).alias("gone"))
    dimension.merge(changes, "at", "gone")
    rows.where("ts >= timestamp_ntz'2024-01-16'").write.mode("append").parquet(f"{folder}/in")
    enrich.enriched(stream, dimension, "device_id", f"{folder}/out", folder).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("dimension_version", "c_nationkey").agg(F.count("*").alias("n"), F.sum("payload_size").alias("bytes"))


@query(ORACLE["decoder_merge_full_outer"])
def stream_decoder_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-86, OP-111 as streams, to be equal to the batch."""
    folder = new_folder(spark, "decoders")
    one, two = (_stream(side.select("ts", *FIVE_TUPLE, "uri", "status", "payload_size", "seq"), f"{folder}/{k}") for k, side in enumerate(decoder_sides(spark, sf_dir)))
    out = _ended(merge.merged(one, two, ["uri", "status", "payload_size"], "seq", "40 days"), folder)
    rows = out.where("ts < timestamp'2099-01-01'")
    return rows.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "source_ip", "uri", "status", "payload_size", "side")


@query(
    f"""WITH {PACKETS_SQL}, days AS (SELECT device_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, count(*) AS observations, CAST(sum(payload_size) AS BIGINT) AS bytes, count(*) FILTER (protocol = 'TCP') AS tcp FROM packets GROUP BY ALL),
    marked AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY device_id ORDER BY day) <= 5 THEN 0 ELSE 1 END AS new FROM days),
    runs AS (SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY day) AS run FROM marked)
    SELECT device_id, day, observations, bytes, tcp, count(*) OVER w AS profile_days, CAST(sum(observations) OVER w AS BIGINT) AS profile_observations, CAST(sum(bytes) OVER w AS BIGINT) AS profile_bytes
    FROM runs WINDOW w AS (PARTITION BY device_id, run ORDER BY day)"""
)
def stream_device_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-185: profiles that begin anew after five days of silence."""
    folder = new_folder(spark, "profiles")
    rows = packets(spark, sf_dir).select("ts", "device_id", "payload_size", "protocol")
    before = spark.conf.get(profiles.PROVIDER)
    spark.conf.set(profiles.PROVIDER, profiles.ROCKS)
    try:
        return _ended(profiles.daily_profiles(_stream(rows, f"{folder}/in"), 5, "40 days"), folder)
    finally:
        spark.conf.set(profiles.PROVIDER, before)


@query(
    """WITH first AS (SELECT o_orderkey, o_orderpriority AS body, 'open' AS status FROM orders),
    second AS (SELECT f.o_orderkey, CASE WHEN f.o_orderkey % 3 = 1 THEN 'late' ELSE f.body END AS body, status FROM first f WHERE NOT (f.o_orderkey % 11 = 0 AND f.o_orderkey % 3 = 1)
      UNION ALL SELECT -o_orderkey, 'late', 'open' FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 11 <> 0),
    third AS (SELECT o_orderkey, body, CASE WHEN o_orderkey >= 0 AND o_orderkey % 4 = 0 THEN 'acknowledged' WHEN o_orderkey >= 0 AND o_orderkey % 4 = 2 THEN 'resolved' ELSE status END AS status FROM second)
    SELECT body, CASE WHEN o_orderkey >= 0 AND o_orderkey % 8 = 0 AND status = 'acknowledged' THEN 'resolved' ELSE status END AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM third GROUP BY ALL"""
)
def merged_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-30, OP-252, alert status: two merges, the second of them twice, then
    two changes of status of which some are not allowed."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderpriority").alias("body"))
    alerts = KeyedTable(spark, new_folder(spark, "alerts"), ["o_orderkey"])
    alerts.merge(orders.withColumns({"status": F.lit("open"), "at": F.lit(1)}), "at", batch=("orders", 1))
    some = orders.where("o_orderkey % 3 = 1")
    gone = (F.col("o_orderkey") % 11 == 0).alias("gone")
    later = some.select("o_orderkey", F.lit("late").alias("body"), F.lit("open").alias("status"), F.lit(2).alias("at"), gone)
    early = later.withColumns({"body": F.lit("early"), "at": F.lit(1)})
    new = later.where("not gone").withColumn("o_orderkey", -F.col("o_orderkey"))
    for _ in range(2):
        alerts.merge(later.union(early).union(new), "at", "gone", batch=("orders", 2))
    keys = orders.select("o_orderkey", F.lit(1).alias("at"))
    even = keys.where("o_orderkey % 2 = 0").withColumn("status", F.when(F.col("o_orderkey") % 4 == 0, "acknowledged").otherwise("resolved"))
    change_status(alerts, even, "at", ("status", 1))
    change_status(alerts, keys.where("o_orderkey % 8 = 0 or o_orderkey % 4 = 2 or o_orderkey % 4 = 1").withColumn("status", F.when(F.col("o_orderkey") % 8 == 0, "resolved").when(F.col("o_orderkey") % 4 == 1, "closed").otherwise("acknowledged")), "at", ("status", 2))
    return alerts.read().groupBy("body", "status").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
