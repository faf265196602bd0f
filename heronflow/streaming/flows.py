"""Structured Streaming forms: session flows, window counts, alert cooldown,
port scans, routed sinks (OP-37, OP-112, OP-146, OP-180 to OP-185, OP-196,
OP-198)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronflow.flows import session_flows


def timed(events: DataFrame, late: str) -> DataFrame:
    """With a watermark; event time must have a time zone, which is UTC here."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sessions(packets: DataFrame, gap: str = "20 seconds", late: str = "10 seconds", keys: list[str] | None = None) -> DataFrame:
    """OP-180: flows that silence ends; packets later than ``late`` are dropped
    (OP-184: the original trusts arrival order)."""
    return session_flows(timed(packets, late), gap, keys)


def window_counts(events: DataFrame, keys: list[str], sizes: dict[str, str], late: str) -> list[DataFrame]:
    """OP-183: the same counts over windows of several lengths."""
    marked = timed(events, late)
    return [marked.groupBy(F.window("ts", size), *keys).agg(F.count("*").alias("n")).withColumn("span", F.lit(name)) for name, size in sizes.items()]


def sliding_counts(events: DataFrame, keys: list[str], size: str, slide: str, late: str) -> DataFrame:
    """OP-182."""
    return timed(events, late).groupBy(F.window("ts", size, slide), *keys).agg(F.count("*").alias("n"))


def first_port_scans(packets: DataFrame, most: int, window: str, late: str) -> DataFrame:
    """OP-146: windows in which a source has over ``most`` packets."""
    counts = timed(packets, late).groupBy(F.window("ts", window), "source_ip").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most)


def cooled_down(alerts: DataFrame, key: str, minutes: int, late: str = "0 seconds") -> DataFrame:
    """OP-112 on a stream: of each key (text) alerts ``minutes`` apart at least,
    in the order of event time. Times wait in the state until the watermark,
    ``late`` behind the newest, has passed them, so that those that come out of
    order are judged in order; what is later still is dropped. The state of a
    key is the last time let through and those that wait; it goes when the
    watermark is a cooldown past the last. Event-time timeouts ask for no batch
    of their own, so a stream that reads what is there ends."""
    gap = minutes * 60_000_000

    def admit(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        waiting = sorted([*waiting, *(t for b in batches for t in b["t"].tolist())])
        passed = state.getCurrentWatermarkMs() * 1000
        ready = bisect_left(waiting, passed)
        out = []
        for t in waiting[:ready]:
            if last is None or t - last >= gap:
                out.append(t)
                last = t
        waiting = waiting[ready:]
        if not waiting and (last is None or last + gap < passed):
            if state.exists:
                state.remove()
        else:
            state.update((last, waiting))
            until = waiting[0] if waiting else last + gap
            state.setTimeoutTimestamp(max(until // 1000, passed // 1000) + 1)
        yield pd.DataFrame({key: [k[0]] * len(out), "t": out})

    rows = timed(alerts, late).select(F.col(key).cast("string").alias(key), "ts", F.unix_micros("ts").alias("t"))
    return rows.groupBy(key).applyInPandasWithState(admit, f"{key} string, t bigint", "last bigint, waiting array<bigint>", "append", "EventTimeTimeout")


def running_profiles(observed: DataFrame) -> DataFrame:
    """OP-185: per device the count, bytes and last time so far (complete mode:
    Spark keeps the state)."""
    return observed.groupBy("device_id").agg(F.count("*").alias("observations"), F.sum("payload_size").alias("bytes"), F.max("ts").alias("last_seen"))


def keep_under_load(level: Column, priority: Column, item: Column, high: float = 0.8, full: float = 0.95, rate: float = 0.5, chance: Column | None = None) -> Column:
    """OP-198: what a queue of fill ``level`` takes: everything below ``high``;
    from there a share ``rate`` of the priorities under 2, told by a hash (or by
    ``chance``, a number from 0 to 1); from ``full`` only priorities from 3 on."""
    share = F.pmod(F.xxhash64(item), F.lit(1_000_000)) < int(rate * 1_000_000) if chance is None else chance < rate
    return F.when(level >= full, priority >= 3).when(level >= high, (priority >= 2) | share).otherwise(True)


def adjusted_rate(current: Column, kept: Column, seen: Column, since_s: Column, low: float = 0.01, high: float = 1.0, every_s: int = 60) -> Column:
    """OP-196: at most once in ``every_s`` seconds, if the share that was kept is
    off the rate by over 0.05, a tenth of the difference is made up for."""
    actual = kept / F.nullif(seen, F.lit(0))
    moved = F.greatest(F.lit(low), F.least(F.lit(high), current + (current - actual) * 0.1))
    return F.when((since_s >= every_s) & (F.abs(actual - current) > 0.05), moved).otherwise(current)
