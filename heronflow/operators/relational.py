"""Joins that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ip_number(address: Column) -> Column:
    parts = F.split(address, r"\.")
    return sum((parts[k].cast("bigint") * 256 ** (3 - k) for k in range(4)), F.lit(0).cast("bigint"))


def ip_range_join(df: DataFrame, column: str, ranges: DataFrame) -> DataFrame:
    """OP-90: left join of addresses with intervals (low, high, ...).

    Intervals are cut at /16 borders and joined on the border's number, with the
    interval as a residual test, so it is a hash join whatever their number. An
    address in several intervals gets a row for each.
    """
    low, high = ip_number(F.col("low")), ip_number(F.col("high"))
    cut = ranges.withColumns({"_low": low, "_high": high}).withColumn("_net", F.explode(F.sequence(F.floor(F.col("_low") / 65536), F.floor(F.col("_high") / 65536))))
    asked = df.withColumn("_ip", ip_number(F.col(column)))
    joined = asked.join(cut, (F.floor(asked["_ip"] / 65536) == cut["_net"]) & asked["_ip"].between(cut["_low"], cut["_high"]), "left")
    return joined.drop("_ip", "_low", "_high", "_net")


def overlap_join(spans: DataFrame, key: str, bucket_s: int) -> DataFrame:
    """OP-43: all pairs (a, b, a2, b2) of intervals of one key that overlap
    (strictly), each with itself too. Intervals are joined by equal key and time
    bucket, and a pair counts in the first bucket that both have."""
    first, last = (F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bucket_s * 1_000_000)) for c in ("a", "b"))
    cut = spans.select(key, "a", "b", first.alias("_first"), F.explode(F.sequence(first, last)).alias("_bucket"))
    other = cut.select(key, F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("_first").alias("_first2"), "_bucket")
    met = cut.join(other, [key, "_bucket"]).where((F.col("a") < F.col("b2")) & (F.col("a2") < F.col("b")))
    return met.where(F.col("_bucket") == F.greatest("_first", "_first2")).select(key, "a", "b", "a2", "b2")
