"""Packets and records to flows (OP-53, OP-54, OP-80, OP-86, OP-100, OP-111,
OP-180)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIVE_TUPLE = ["source_ip", "destination_ip", "source_port", "destination_port", "protocol"]


def micros(column: str = "ts") -> Column:
    """Microseconds of a timestamp without time zone, as in UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def with_gaps(df: DataFrame, keys: list[str], order: list[str], name: str = "gap_ms", per: float = 1000.0) -> DataFrame:
    """Time since the row before, of the same keys, in units of ``per`` us."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, (micros() - F.lag(micros()).over(w)) / F.lit(per))


def assemble_flows(packets: DataFrame) -> DataFrame:
    """One flow a five-tuple: sums, inter-arrival times and TCP summaries.

    Only supported protocols with both addresses (OP-44). The standard
    deviation is that of a sample, 0 for fewer than two gaps; flags are distinct
    and sorted; retransmissions are non-zero sequence numbers seen again. One
    shuffle: the gap window and the aggregate share the five-tuple.
    """
    usable = packets.where(F.upper("protocol").isin("TCP", "UDP", "ICMP", "ICMPV6") & (F.col("source_ip") != "") & (F.col("destination_ip") != ""))
    tcp = F.upper("protocol") == "TCP"
    sequence = F.when(tcp & (F.col("tcp_sequence_number") != 0), F.col("tcp_sequence_number"))
    flags = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(tcp, F.col("tcp_flags"))))))
    out = (
        with_gaps(usable, FIVE_TUPLE, ["ts", "packet_id"])
        .groupBy(*FIVE_TUPLE)
        .agg(
            F.min("ts").alias("ts"),
            F.sum("payload_size").alias("bytes_sent"),
            F.lit(0).cast("bigint").alias("bytes_received"),
            F.count("*").alias("packets_sent"),
            F.lit(0).cast("bigint").alias("packets_received"),
            F.floor((F.max(micros()) - F.min(micros())) / 1000).alias("duration_ms"),
            F.coalesce(F.avg("gap_ms"), F.lit(0.0)).alias("inter_arrival_mean_ms"),
            F.coalesce(F.stddev_samp("gap_ms"), F.lit(0.0)).alias("inter_arrival_std_ms"),
            flags.alias("tcp_flags"),
            (F.count(sequence) - F.count_distinct(sequence)).alias("retransmissions"),
        )
    )
    ones = lambda flag: F.array_contains("tcp_flags", flag).cast("double")
    # Flags are distinct, so each is there once or not at all.
    return out.withColumns({"jitter_ms": F.col("inter_arrival_std_ms"), "syn_fin_ratio": ones("SYN")})


def session_flows(packets: DataFrame, gap: str = "20 seconds", keys: list[str] | None = None) -> DataFrame:
    """OP-180: a flow ends when nothing came for longer than ``gap``; works on
    batches and, behind a watermark, on streams."""
    keys = keys or FIVE_TUPLE
    return (
        packets.groupBy(F.session_window("ts", gap).alias("session"), *keys)
        .agg(F.count("*").alias("packets"), F.sum("payload_size").alias("bytes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        .withColumn("duration_ms", F.greatest(F.lit(1), F.floor((micros("last_seen") - micros("first_seen")) / 1000)))
        .drop("session")
    )


def flow_counters(packets: DataFrame) -> DataFrame:
    """OP-80: packets, bytes, first and last time by five-tuple."""
    return packets.groupBy(*FIVE_TUPLE).agg(F.count("*").alias("packets"), F.sum("payload_size").alias("bytes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """OP-111: of rows with equal keys the last in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge_records(first: DataFrame, second: DataFrame, fields: list[str], order: list[str], keys: list[str] | None = None) -> DataFrame:
    """OP-86: full outer join of two decoders' records on time and five-tuple.

    Of each side the last duplicate counts; null keys are equal to each other;
    ``first`` wins where both have a value, and always for payload_size (G7).
    """
    keys = keys or ["ts", *FIVE_TUPLE]
    a, b = keep_last(first, keys, order).alias("a"), keep_last(second, keys, order).alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    marked_a, marked_b = a.withColumn("_a", F.lit(True)).alias("a"), b.withColumn("_b", F.lit(True)).alias("b")
    joined = marked_a.join(marked_b, same, "full_outer")
    pick = lambda c: F.when(F.col("_a"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
    merged = {k: pick(k) for k in keys} | {f: pick(f) if f == "payload_size" else F.coalesce(F.col(f"a.{f}"), F.col(f"b.{f}")) for f in fields}
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first").otherwise("second")
    return joined.select(*(c.alias(n) for n, c in merged.items()), side.alias("side"))
