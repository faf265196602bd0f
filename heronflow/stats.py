"""Roll-ups of detections, profiles, errors, validations and capture
(OP-69, OP-71, OP-77, OP-78, OP-120, OP-166, OP-217, OP-242, OP-250, OP-256)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronflow import drift

#: How much a feature counts, where no model says.
FEATURE_IMPORTANCE = {
    "bytes_per_packet": 0.15,
    "duration_seconds": 0.12,
    "inter_arrival_mean": 0.10,
    "port_entropy": 0.08,
    "fan_out_ratio": 0.07,
    "protocol_diversity": 0.06,
    "dns_entropy": 0.05,
    "tls_ja3_present": 0.04,
}


def detection_statistics(flows: DataFrame) -> DataFrame:
    """OP-71: of scored flows (n_signature, n_ml): counts and rates."""
    n = F.greatest(F.lit(1), F.count("*"))
    rule, model = F.count_if(F.col("n_signature") > 0), F.count_if(F.col("n_ml") > 0)
    both = F.count_if((F.col("n_signature") > 0) & (F.col("n_ml") > 0))
    counts = {"flows": F.count("*"), "signature_detections": rule, "ml_detections": model, "hybrid": both, "signature_rate": rule / n, "ml_rate": model / n, "hybrid_rate": both / n}
    return flows.agg(*(c.alias(k) for k, c in counts.items()))


def profile_statistics(profiles: DataFrame) -> DataFrame:
    """OP-69: by device type: how many, mean confidence, share of mature ones."""
    mature = (F.col("observation_count") >= 100) & (F.col("confidence_score") >= 0.7)
    return profiles.groupBy("device_type").agg(F.count("*").alias("devices"), F.avg("confidence_score").alias("avg_confidence"), (F.count_if(mature) / F.count("*")).alias("maturity_rate"))


def error_statistics(errors: DataFrame) -> DataFrame:
    """OP-78, OP-120: errors by category and component, most common first."""
    out = errors.groupBy(F.concat_ws(":", "category", "component").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"))
    return out.orderBy(F.desc("n"), "kind")


def newest(rows: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """OP-256: what a ring buffer of n rows would hold."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def validation_report(checks: DataFrame) -> DataFrame:
    """OP-242: of checks (passed, duration_s): counts, success, durations; fit
    from 70 % on."""
    share = F.count_if("passed") / F.count("*")
    return checks.agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"), share.alias("success"), F.sum("duration_s").alias("total_s"), F.avg("duration_s").alias("avg_s"), (share >= 0.7).alias("healthy"))


def pod_metrics(lines: DataFrame) -> DataFrame:
    """OP-250: lines of ``name cpu(m) memory(Mi)`` to means over pods; other
    lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(F.get(parts, F.lit(1)).alias("cpu"), F.get(parts, F.lit(2)).alias("memory")).where("cpu rlike '^[0-9]+m$' and memory rlike '^[0-9]+Mi$'")
    number = lambda c: F.regexp_replace(c, "[a-zA-Z]+$", "").cast("double")
    return rows.agg(F.count("*").alias("pods"), F.avg(number("cpu")).alias("avg_cpu_m"), F.avg(number("memory")).alias("avg_memory_mi"))


def rate(rows: DataFrame, time: str = "ts") -> DataFrame:
    """OP-84, OP-218, OP-240: rows a second over the time they span."""
    span = (F.max(F.unix_micros(F.col(time).cast("timestamp"))) - F.min(F.unix_micros(F.col(time).cast("timestamp")))) / 1e6
    return rows.agg(F.count("*").alias("n"), span.alias("seconds"), F.when(span > 0, F.count("*") / span).otherwise(0.0).alias("per_second"))


def pipeline_snapshots(rows: DataFrame, every: str, stage: str = "stage", arrived: str = "arrived", left: str = "left_at", failed: str = "failed") -> DataFrame:
    """OP-85: counters, rate and queue of each stage at the end of each window in
    which something happened to it.

    ``received``, ``processed`` and ``errors`` count from the beginning;
    ``waiting`` are the rows that arrived and have not left; ``per_second`` is
    what was processed over the time since the first window of the stage began.
    Rows without a time of arrival have not arrived; those without a time of
    leaving still wait; a null in ``failed`` is no failure; a null stage is a
    stage of its own. Rows are counted by window first, so only a stage's
    windows are sorted, never its rows.
    """
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    bad = F.when(F.col(failed), one).otherwise(none)
    moves = F.array(
        F.struct(F.col(arrived).alias("_t"), one.alias("_in"), none.alias("_out"), none.alias("_bad")),
        F.struct(F.when(F.col(arrived).isNotNull(), F.col(left)).alias("_t"), none.alias("_in"), one.alias("_out"), bad.alias("_bad")),
    )
    steps = rows.select(F.col(stage).alias("stage"), F.inline(moves)).where("_t is not null")
    counts = steps.groupBy("stage", F.window("_t", every).alias("_w")).agg(*(F.sum(c).alias(c) for c in ("_in", "_out", "_bad")))
    sofar = Window.partitionBy("stage").orderBy("_w.end").rowsBetween(Window.unboundedPreceding, 0)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    uptime = (micros(F.col("_w.end")) - F.min(micros(F.col("_w.start"))).over(sofar)) / 1e6
    received, processed = (F.sum(c).over(sofar) for c in ("_in", "_out"))
    return counts.select(
        "stage",
        F.col("_w.end").alias("snapshot"),
        received.alias("received"),
        processed.alias("processed"),
        F.sum("_bad").over(sofar).alias("errors"),
        (received - processed).alias("waiting"),
        (processed / uptime).alias("per_second"),
    )


def current_sample(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """OP-166: the last n rows."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n)


def data_drift(base: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """OP-166, OP-234: feature, d, n, m and psi of each common column."""
    common = [c for c in columns if c in base.columns and c in current.columns]

    def one(c: str) -> DataFrame:
        a, b = (df.select(F.col(c).cast("double").alias("v")).where("v is not null") for df in (base, current))
        return drift.ks_distance(a, b).crossJoin(drift.psi(a, b)).select(F.lit(c).alias("feature"), "d", "n", "m", "psi")

    return reduce(lambda a, b: a.union(b), map(one, common))


def importance_map() -> Column:
    """OP-217."""
    return F.create_map(*[F.lit(x) for kv in FEATURE_IMPORTANCE.items() for x in kv])


def score_bands(scores: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """OP-150: a histogram of scores in [0, 1] with running shares."""
    counts = scores.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(column) * bins)).alias("band")).agg(F.count("*").alias("n"))
    w = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)  # at most ``bins`` rows
    return counts.withColumn("share", F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()))
