"""Envelopes and bus messages in the shape of Spark's Kafka sources and sinks,
the messages of two other buses, receipts, and document-store queries (OP-18 to
OP-22, OP-26, OP-38, OP-83, OP-251)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: JSON keeps microseconds only if it is told to.
MICROS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def to_bus(messages: DataFrame) -> DataFrame:
    """OP-22: message_id, priority, payload (any type), ts to key, value,
    headers; the message id is the key."""
    header = lambda k, c: F.struct(F.lit(k).alias("key"), c.cast("string").cast("binary").alias("value"))
    return messages.select(
        F.col("message_id").alias("key"),
        F.to_json(F.struct("message_id", "priority", "payload", "ts"), MICROS).alias("value"),
        F.array(header("message_id", F.col("message_id")), header("priority", F.col("priority"))).alias("headers"),
    )


def from_bus(rows: DataFrame, payload: str) -> DataFrame:
    """Back from key and value; ``payload``: its DDL."""
    body = F.from_json(F.col("value").cast("string"), f"message_id string, priority string, payload {payload}, ts timestamp_ntz", MICROS)
    return rows.select(body.alias("b")).select("b.*")


def kafka_options(servers: str, topic: str, group: str | None = None) -> dict[str, str]:
    """OP-18: options of Spark's Kafka source; headers are read, too."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "includeHeaders": "true", "startingOffsets": "earliest", "failOnDataLoss": "false"}
    return options | ({"kafka.group.id": group} if group else {})


def read_kafka(spark: SparkSession, servers: str, topic: str, payload: str, stream: bool = True) -> DataFrame:
    """OP-18: messages of a topic; needs Spark's Kafka package."""
    reader = (spark.readStream if stream else spark.read).format("kafka").options(**kafka_options(servers, topic))
    return from_bus(reader.load(), payload)


def write_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """OP-18: a batch is written at once; of a stream the query is returned."""
    rows = to_bus(messages)
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "includeHeaders": "true"}
    if rows.isStreaming:
        return rows.writeStream.format("kafka").options(**options, checkpointLocation=checkpoint).start()
    return rows.write.format("kafka").options(**options).save()


def to_nats(messages: DataFrame) -> DataFrame:
    """OP-19: subject by priority; headers are part of the JSON, as that bus's
    messages are bytes only."""
    headers = F.struct("message_id", "priority")
    return messages.select(F.concat_ws(".", F.lit("messages"), F.col("priority")).alias("subject"), F.to_json(F.struct(headers.alias("headers"), F.col("payload").alias("data"), F.col("ts").alias("timestamp")), MICROS).alias("data"))


def from_nats(rows: DataFrame, payload: str) -> DataFrame:
    body = F.from_json("data", f"headers struct<message_id:string,priority:string>, data {payload}, timestamp timestamp_ntz", MICROS).alias("b")
    return rows.select(body).select("b.headers.message_id", "b.headers.priority", F.col("b.data").alias("payload"), F.col("b.timestamp").alias("ts"))


def to_mqtt(messages: DataFrame, root: str = "events") -> DataFrame:
    """OP-20: topic levels of root and priority, the whole message as payload,
    delivered at least once (quality 1) and so with its id to tell repeats."""
    body = F.to_json(F.struct("message_id", "priority", "payload", "ts"), MICROS)
    return messages.select(F.concat_ws("/", F.lit(root), F.col("priority")).alias("topic"), body.alias("payload"), F.lit(1).alias("qos"))


def from_mqtt(rows: DataFrame, payload: str, late: str = "10 minutes") -> DataFrame:
    """Back, each message id once; on a stream, if it comes again within
    ``late``, so that ids are not kept for ever."""
    back = from_bus(rows.select(F.col("payload").alias("value")), payload)
    if rows.isStreaming:
        return back.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["message_id"])
    return back.dropDuplicates(["message_id"])


def sent(messages: DataFrame, accepted: Column, tries: Column) -> tuple[DataFrame, DataFrame]:
    """OP-251: a receipt for each message, and those that were not accepted as
    rows for the buffer."""
    receipts = messages.select("message_id", accepted.alias("delivered"), F.greatest(F.lit(0), tries - 1).alias("retries"))
    return receipts, messages.where(~F.coalesce(accepted, F.lit(False)))


def fan_out(batch: DataFrame, writers: dict) -> dict[str, bool]:
    """OP-21: one batch to several sinks; a failed one does not stop the rest.
    For use in foreachBatch; the batch is read once."""
    batch.persist()
    done = {}
    try:
        for name, write in writers.items():
            try:
                write(batch)
                done[name] = True
            except Exception:  # noqa: BLE001 - reported to the caller
                done[name] = False
    finally:
        batch.unpersist()
    return done


def matching(query: dict) -> Column:
    """OP-26: a document-store query (match_all, term, terms, match, range,
    exists, bool) as a Column."""
    (kind, body), *_ = query.items()
    if kind == "match_all":
        return F.lit(True)
    if kind == "term":
        (field, value), *_ = body.items()
        return F.col(field) == (value["value"] if isinstance(value, dict) else value)
    if kind == "terms":
        (field, values), *_ = body.items()
        return F.col(field).isin(*values)
    if kind == "match":
        (field, text), *_ = body.items()
        words = str(text["query"] if isinstance(text, dict) else text).lower().split()
        have = F.split(F.lower(F.col(field).cast("string")), r"\W+")
        return reduce(lambda a, b: a | b, (F.array_contains(have, w) for w in words))
    if kind == "range":
        (field, ends), *_ = body.items()
        tests = {"gt": F.col(field).__gt__, "gte": F.col(field).__ge__, "lt": F.col(field).__lt__, "lte": F.col(field).__le__}
        return reduce(lambda a, b: a & b, (tests[k](v) for k, v in ends.items()))
    if kind == "exists":
        return F.col(body["field"]).isNotNull()
    if kind == "bool":
        out = F.lit(True)
        for q in [*body.get("must", []), *body.get("filter", [])]:
            out = out & matching(q)
        for q in body.get("must_not", []):
            out = out & ~F.coalesce(matching(q), F.lit(False))
        if body.get("should"):
            out = out & reduce(lambda a, b: a | b, map(matching, body["should"]))
        return out
    raise ValueError(f"no such query: {kind}")


def search(df: DataFrame, query: dict, sort: list[tuple[str, str]] | None = None, size: int = 10) -> DataFrame:
    """Documents that match, sorted, the first ``size``."""
    found = df.where(F.coalesce(matching(query), F.lit(False)))
    if sort:
        found = found.orderBy(*(F.desc(c) if how == "desc" else F.asc(c) for c, how in sort))
    return found.limit(size)


def buffer_status(buffer: DataFrame, as_of: Column) -> DataFrame:
    """OP-38: messages waiting, the age of the oldest, and bytes (G18: of the
    message column)."""
    return buffer.agg(F.count("*").alias("messages"), F.min("ts").alias("oldest"), F.coalesce(F.sum(F.octet_length("message")), F.lit(0)).alias("bytes")).withColumn("as_of", as_of)


def transport_statistics(receipts: DataFrame) -> DataFrame:
    """OP-83: mean latency and retries a message."""
    return receipts.agg(F.avg("latency_ms").alias("avg_latency_ms"), (F.sum("retries") / F.count("*")).alias("retry_rate"), F.count_if("delivered").alias("delivered"))
