"""Event validation and enrichment, routing, dashboards (OP-33 to OP-36,
OP-150 to OP-154, OP-244)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
SERVICES = {80: "http", 443: "https", 53: "dns", 22: "ssh", 21: "ftp", 25: "smtp", 110: "pop3", 143: "imap"}
PRIORITIES = {"critical": 1, "high": 2, "medium": 3, "low": 4}
EVENT_TYPES = ("network_flow", "threat_detection", "device_profile_update")
LADDER = ((0.9, "critical"), (0.7, "high"), (0.5, "medium"), (0.3, "low"))
COUNTERS = ("bytes_sent", "bytes_received", "packets_sent", "packets_received", "duration_ms")


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _checks(timestamp: str) -> dict[str, Column]:
    """What can be wrong with an event, and when it is."""
    return {
        f"missing {timestamp}": F.col(timestamp).isNull(),
        "missing event_type": F.col("event_type").isNull(),
        "invalid timestamp": F.col(timestamp).isNotNull() & F.expr(f"try_to_timestamp(`{timestamp}`)").isNull(),
        "unknown event_type": ~F.col("event_type").isin(*EVENT_TYPES),
        "threat_score out of range": ~F.col("threat_score").between(0, 1),
    } | {f"negative {c}": F.col(c) < 0 for c in COUNTERS}


def errors(timestamp: str = "timestamp") -> Column:
    """OP-153: what is wrong with an event; none: valid."""
    return F.array_compact(F.array(*(F.when(wrong, F.lit(text)) for text, wrong in _checks(timestamp).items())))


def is_valid(timestamp: str = "timestamp") -> Column:
    """No error, without making the list; each column is looked at once."""
    known = F.expr(f"try_to_timestamp(`{timestamp}`)").isNotNull() & F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(c) >= 0, F.lit(True)) for c in COUNTERS), known & F.coalesce(F.col("threat_score").between(0, 1), F.lit(True)))


def enriched(events: DataFrame) -> DataFrame:
    """OP-151: totals, rates, service and direction of flow events. A missing
    duration counts as 1 ms; without a positive one there are no rates."""
    bytes_total = F.coalesce("bytes_sent", F.lit(0)) + F.coalesce("bytes_received", F.lit(0))
    packets_total = F.coalesce("packets_sent", F.lit(0)) + F.coalesce("packets_received", F.lit(0))
    duration = F.coalesce("duration_ms", F.lit(1))
    to, source = (_map(SERVICES)[F.coalesce(c, F.lit(0))] for c in (F.col("destination_port"), F.col("source_port")))
    return events.withColumns(
        {
            "bytes_total": bytes_total,
            "packets_total": packets_total,
            "bytes_per_second": F.when(duration > 0, bytes_total * 1000.0 / duration),
            "packets_per_second": F.when(duration > 0, packets_total * 1000.0 / duration),
            "service": F.coalesce(to, source),
            "flow_direction": F.when(to.isNotNull(), "outbound").when(source.isNotNull(), "inbound").otherwise("unknown"),
        }
    )


def enriched_detections(df: DataFrame) -> DataFrame:
    """OP-152: alert priority and the greatest and mean score of each kind."""
    out = df.withColumn("alert_priority", F.coalesce(_map(PRIORITIES)[F.lower("severity")], F.lit(4)))
    for kind, column, field in (("signature", "signature_matches", "signature_score"), ("ml", "ml_predictions", "anomaly_score")):
        scores = F.col(column)[field]
        out = out.withColumns({f"max_{kind}_score": F.array_max(scores), f"avg_{kind}_score": F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))})
    return out


def severity_of_score(score: Column) -> Column:
    """OP-154."""
    out = F.when(score >= LADDER[0][0], LADDER[0][1])
    for least, name in LADDER[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("info")


def processed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OP-35, OP-153: valid events, enriched, and the others with their errors."""
    return enriched(events.where(is_valid())), events.where(~is_valid()).withColumn("errors", errors())


def entered(events: DataFrame, as_of: Column, pipeline: str) -> DataFrame:
    """OP-244: events with the time and the name of their pipeline. Flows get
    totals and service, detections a priority; columns of the other kind are
    null."""
    stamped = events.withColumns({"processed_at": as_of, "pipeline_name": F.lit(pipeline)})
    flows = enriched(stamped.where("event_type = 'network_flow'"))
    found = stamped.where("event_type = 'threat_detection'").withColumn("alert_priority", F.coalesce(_map(PRIORITIES)[F.lower("severity")], F.lit(4)))
    rest = stamped.where("event_type is null or event_type not in ('network_flow', 'threat_detection')")
    return flows.unionByName(found, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)


def write_routed(events: DataFrame, folder: str, time: str = "ts", batch: int = 0) -> None:
    """OP-33, OP-34: by route, type and day; critical and high ones also take the
    route alerts. One write, so both routes are there or neither; a batch that
    comes again replaces what it has written."""
    both = F.when(F.col("severity").isin("critical", "high"), F.array(F.lit("events"), F.lit("alerts"))).otherwise(F.array(F.lit("events")))
    dated = events.withColumns({"event_date": F.to_date(time), "batch": F.lit(batch), "route": both}).withColumn("route", F.explode("route"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("route", "batch", "event_type", "event_date").parquet(folder)


def retention_phase(age_days: Column, warm: int, cold: int, delete: int) -> Column:
    """OP-36: where the data of an age is kept."""
    return F.when(age_days >= delete, "delete").when(age_days >= cold, "cold").when(age_days >= warm, "warm").otherwise("hot")
