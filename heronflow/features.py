"""Feature families over flows (OP-41 to OP-44, OP-52 to OP-60, OP-219, OP-261)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronflow.flows import micros, with_gaps


def ratio(over: Column, under: Column) -> Column:
    """over / under, 0 where under is not positive."""
    return F.when(under > 0, over / under).otherwise(0.0)


def derived(flows: DataFrame) -> DataFrame:
    """OP-41: totals, bytes a packet, direction."""
    return flows.withColumns(
        {
            "total_bytes": F.col("bytes_sent") + F.col("bytes_received"),
            "total_packets": F.col("packets_sent") + F.col("packets_received"),
            "bytes_per_packet_sent": ratio(F.col("bytes_sent"), F.col("packets_sent")),
            "bytes_per_packet_received": ratio(F.col("bytes_received"), F.col("packets_received")),
            "is_bidirectional": (F.col("packets_sent") > 0) & (F.col("packets_received") > 0),
        }
    )


def aggregate_set(flows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """OP-52: the configurable aggregates of one column."""
    c = F.col(column)
    return flows.groupBy(*keys).agg(
        F.avg(c).alias("mean"),
        F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.count(c).alias("count"),
        F.percentile(c, 0.5).alias("median"),
        F.percentile(c, 0.95).alias("percentile_95"),
        F.sum(c).alias("sum"),
    )


def entropy(df: DataFrame, keys: list[str], column: str, name: str = "entropy") -> DataFrame:
    """OP-59: Shannon entropy (bits) of a column's values within each group, by
    counts of values and then groups: what is shuffled is counts."""
    counts = df.groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    n, log = F.sum("_n"), F.sum(F.col("_n") * F.log2("_n"))
    return counts.groupBy(*keys).agg((F.log2(n) - log / n).alias(name))


def temporal(flows: DataFrame, window: Column | str, extra: list[str] | None = None) -> DataFrame:
    """OP-55: sixteen features of the flows of each window."""
    rows = derived(flows)
    keys = [F.window("ts", window).alias("w") if isinstance(window, str) else window.alias("w"), *(extra or [])]
    names = ["w", *(extra or [])]
    on = F.col("duration_ms") > 0
    sent = F.when(F.col("packets_sent") > 0, F.col("bytes_per_packet_sent"))
    base = rows.groupBy(*keys).agg(
        F.count("*").cast("double").alias("flow_count"),
        F.sum("total_bytes").cast("double").alias("total_bytes"),
        F.sum("total_packets").cast("double").alias("total_packets"),
        F.avg("duration_ms").alias("avg_duration"),
        F.coalesce(F.stddev_samp(F.when(on, F.col("duration_ms"))), F.lit(0.0)).alias("duration_std"),
        F.coalesce(F.max(F.when(on, F.col("duration_ms"))), F.lit(0)).cast("double").alias("duration_max"),
        F.coalesce(F.min(F.when(on, F.col("duration_ms"))), F.lit(0)).cast("double").alias("duration_min"),
        F.count_distinct("protocol").cast("double").alias("protocol_diversity"),
        (F.count_if(F.col("protocol") == "TCP") / F.count("*")).alias("tcp_ratio"),
        (F.count_if(F.col("protocol") == "UDP") / F.count("*")).alias("udp_ratio"),
        F.count_distinct("destination_port").cast("double").alias("unique_dst_ports"),
        F.coalesce(F.avg(sent), F.lit(0.0)).alias("avg_bytes_per_packet"),
        F.coalesce(F.stddev_samp(sent), F.lit(0.0)).alias("bytes_per_packet_std"),
    )
    ports = entropy(rows.select(*keys, "destination_port"), names, "destination_port", "port_entropy")
    out = base.join(ports, names)
    return out.select(F.col("w.start").alias("window_start"), *(extra or []), *(c for c in out.columns if c not in names))


def device(flows: DataFrame) -> DataFrame:
    """OP-56: behaviour of each device; gaps are between its flows in order of time.

    Flows of one time have no gap between them in any order, so time alone orders
    them. Rows go once to their device's task, with what is needed only, and are
    sorted there by time and by each address: an address counts where it first
    comes. Sorts can spill; sets of addresses, or a copy of each row for each
    distinct count, would be held in memory.
    """
    every = Window.partitionBy("device_id")
    first = lambda c: (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.lag(c).over(every.orderBy(c)))).cast("bigint")
    used = derived(flows).select("device_id", "ts", "protocol", "destination_ip", "source_ip", "total_bytes", "duration_ms")
    rows = with_gaps(used, ["device_id"], ["ts"], "gap_s", 1e6).drop("ts")
    rows = rows.withColumn("destination", first("destination_ip")).drop("destination_ip")
    rows = rows.withColumn("source", first("source_ip")).drop("source_ip")
    share = lambda p: (F.count_if(F.col("protocol") == p) / F.count("*")).alias(f"{p.lower()}_preference")
    seconds = F.sum(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))) / 1000
    return rows.groupBy("device_id").agg(
        F.sum("destination").cast("double").alias("unique_destinations"),
        F.sum("source").cast("double").alias("unique_sources"),
        (F.sum("destination") + F.sum("source")).cast("double").alias("communication_diversity"),
        F.coalesce(F.avg("gap_s"), F.lit(0.0)).alias("avg_inter_flow_time"),
        F.coalesce(F.stddev_samp("gap_s"), F.lit(0.0)).alias("inter_flow_time_std"),
        share("TCP"),
        share("UDP"),
        share("ICMP"),
        F.sum("total_bytes").cast("double").alias("total_bandwidth_bytes"),
        F.coalesce(F.sum("total_bytes") * 8 / seconds, F.lit(0.0)).alias("avg_bandwidth_bps"),
    )


def directional(flows: DataFrame) -> DataFrame:
    """OP-57: one row of fan-out, fan-in, port and protocol measures, in one pass.

    Each flow is counted under its pair of addresses, its two ports and its
    protocol; what is shuffled is counts. Counts of pairs then go to both of
    their addresses, so fan-in needs neither a join nor a nested loop. A null
    address, port or protocol is a value of its own in the entropies and as a
    source; it is no destination and no protocol that is counted. Without flows
    all measures are null but ``protocol_diversity``, which is 0.
    """
    pair, source_port, destination_port, protocol = (F.lit(k) for k in range(4))
    text = lambda c: F.col(c).cast("string")
    one = lambda kind, a, b=F.lit(None).cast("string"): F.struct(kind.alias("kind"), a.alias("a"), b.alias("b"))
    seen = F.array(one(pair, text("source_ip"), text("destination_ip")), one(source_port, text("source_port")), one(destination_port, text("destination_port")), one(protocol, text("protocol")))
    counts = flows.select(F.inline(seen)).groupBy("kind", "a", "b").agg(F.count("*").alias("n"))

    n, zero, is_pair = F.col("n"), F.lit(0).cast("bigint"), F.col("kind") == pair
    there = F.when(is_pair, F.col("b")).otherwise(F.col("a")).isNotNull().cast("bigint")
    sums = lambda ip, out, distinct, weighted, into: F.struct("kind", ip.alias("ip"), out.alias("out"), distinct.alias("distinct"), weighted.alias("weighted"), into.alias("into"))
    leaving = sums(F.when(is_pair, F.col("a")), n, there, n * F.log2(n.cast("double")), zero)
    entering = F.when(is_pair & F.col("b").isNotNull(), sums(F.col("b"), zero, zero, F.lit(0.0), n))
    moves = counts.select(F.inline(F.array_compact(F.array(leaving, entering))))
    by_value = moves.groupBy("kind", "ip").agg(*(F.sum(c).alias(c) for c in ("out", "distinct", "weighted", "into")))

    source = is_pair & (F.col("out") > 0)
    of = lambda rows, c: F.sum(F.when(rows, F.col(c)))
    spread = lambda kind: F.log2(of(F.col("kind") == kind, "out")) - of(F.col("kind") == kind, "weighted") / of(F.col("kind") == kind, "out")
    metrics = by_value.agg(
        (of(source, "distinct") / F.count_if(source)).alias("avg_fan_out"),
        (of(source, "into") / F.count_if(source)).alias("avg_fan_in"),
        (of(source, "distinct") / of(source, "out")).alias("fan_out_ratio"),
        (of(source, "into") / of(source, "out")).alias("fan_in_ratio"),
        spread(source_port).alias("src_port_entropy"),
        spread(destination_port).alias("dst_port_entropy"),
        spread(protocol).alias("protocol_entropy"),
        F.coalesce(of(F.col("kind") == protocol, "distinct"), zero).cast("double").alias("protocol_diversity"),
    )
    return metrics.withColumn("port_distribution_entropy", (F.col("src_port_entropy") + F.col("dst_port_entropy")) / 2)


def timing(flows: DataFrame, keys: list[str], id_column: str = "flow_id") -> DataFrame:
    """OP-58: inter-arrival times (s), periodicity, bursts and hours, by key."""
    rows = with_gaps(flows, keys, ["ts", id_column], "gap_s", 1e6)
    zero = F.lit(0.0)
    mean, std = F.avg("gap_s"), F.stddev_samp("gap_s")
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(mean, zero).alias("inter_arrival_mean"),
        F.coalesce(std, zero).alias("inter_arrival_std"),
        F.coalesce(F.min("gap_s"), zero).alias("inter_arrival_min"),
        F.coalesce(F.max("gap_s"), zero).alias("inter_arrival_max"),
        F.when((F.count("*") > 3) & (mean > 0), 1 / (1 + std / mean)).otherwise(0.0).alias("periodicity_score"),
        F.when(F.count_if(F.col("duration_ms") > 0) > 0, F.count_if(F.col("duration_ms").between(1, 999)) / F.count_if(F.col("duration_ms") > 0)).otherwise(0.0).alias("burst_ratio"),
    )
    hours = rows.groupBy(*keys, F.hour("ts").alias("h")).agg(F.count("*").alias("c")).groupBy(*keys).agg(F.count("*").cast("double").alias("time_diversity"), (F.max("c") / F.sum("c")).alias("peak_hour_ratio"))
    return base.join(hours, keys)


#: What a feature's name holds, and how it is scaled; the first that fits counts.
SCALES = (
    (("ratio", "entropy"), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))),
    (("count", "diversity"), lambda x: F.log1p(x) / 10),
    (("bytes", "bandwidth"), lambda x: F.log1p(x) / 20),
    (("time", "duration"), lambda x: F.least(F.lit(1.0), x / 3600)),
    (("",), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / 100))),
)


def normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Feature columns scaled by what their names say."""
    scale = lambda c: next(f for parts, f in SCALES if any(p in c for p in parts))(F.col(c))
    return df.withColumns({c: scale(c) for c in columns})


def training_features(flows: DataFrame) -> DataFrame:
    """OP-261: eleven derived columns of the training set, and OP-219's."""
    rows = derived(flows)
    seconds = F.col("duration_ms") / 1000
    tiny = 1e-8
    return rows.withColumns(
        {
            "bytes_ratio": ratio(F.col("bytes_sent"), F.col("bytes_received")),
            "packets_ratio": ratio(F.col("packets_sent"), F.col("packets_received")),
            "bytes_per_second": ratio(F.col("total_bytes"), seconds),
            "packets_per_second": ratio(F.col("total_packets"), seconds),
            "avg_packet_size": ratio(F.col("total_bytes"), F.col("total_packets")),
            "is_high_src_port": (F.col("source_port") > 1024).cast("int"),
            "is_high_dst_port": (F.col("destination_port") > 1024).cast("int"),
            "log_duration": F.log1p(seconds),
            "log_total_bytes": F.log1p("total_bytes"),
            "bytes_per_packet": F.col("total_bytes") / (F.col("total_packets") + tiny),
            "port_ratio": F.col("source_port") / (F.col("destination_port") + tiny),
            # Of the record's own time; the original draws them at random (G10).
            "time_of_day": F.hour("ts") / 24.0,
            "day_of_week": F.weekday("ts") / 7.0,
        }
    )


def sequences(df: DataFrame, keys: list[str], order: list[str], column: str, length: int) -> DataFrame:
    """OP-106: each ``length`` consecutive values of a key, stride 1. A key of
    fewer values gives one sequence, padded with zeros in front."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumns({"sequence": F.collect_list(F.col(column).cast("double")).over(w.rowsBetween(1 - length, 0)), "_k": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys))})
    short = F.concat(F.array_repeat(F.lit(0.0), length - F.size("sequence")), F.col("sequence"))
    rows = rows.where((F.size("sequence") == length) | ((F.col("_n") < length) & (F.col("_k") == F.col("_n"))))
    return rows.select(*keys, *order, F.when(F.size("sequence") < length, short).otherwise(F.col("sequence")).alias("sequence"))


def closed_windows(df: DataFrame, start: Column, minutes: int = 5) -> DataFrame:
    """OP-92a: rows with the explicit windows of ``minutes`` from ``start`` on
    that hold them. Both ends belong to a window (OP-42), so a row on a border
    has two. The window's number is computed: nothing is joined."""
    width = minutes * 60_000_000
    since = micros() - F.unix_micros(start.cast("timestamp"))
    k = F.floor(since / width)
    numbers = F.when((since % width == 0) & (k > 0), F.array(k - 1, k)).otherwise(F.array(k))
    rows = df.withColumn("window_no", F.explode(numbers)).where("window_no >= 0")
    begin = lambda n: (F.timestamp_micros(F.unix_micros(start.cast("timestamp")) + n * width)).cast("timestamp_ntz")
    return rows.withColumns({"window_start": begin(F.col("window_no")), "window_end": begin(F.col("window_no") + 1)})
