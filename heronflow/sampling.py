"""Deterministic sampling (OP-188, OP-191 to OP-195). Chance is replaced by a
hash of the id and a seed, so a sample can be drawn again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bands of the hash that strata are counted by.
BANDS = 4_096


def uniform(column: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the value and the seed only."""
    hashed = F.md5(F.concat_ws("#", F.col(column).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def bernoulli(df: DataFrame, column: str, rate: float, priority: Column | None = None, seed: int = 0) -> DataFrame:
    """OP-191: each row with chance rate * (1 + priority), at most 1."""
    chance = F.least(F.lit(1.0), rate * (1 + (priority if priority is not None else F.lit(0))))
    return df.where(uniform(column, seed) < chance)


def reservoir(df: DataFrame, column: str, k: int, seed: int = 0) -> DataFrame:
    """OP-188: k rows, all equally likely: those of the least hash (top-k)."""
    return df.orderBy(uniform(column, seed), column).limit(k)


def stratified(df: DataFrame, column: str, stratum: str, k: int, seed: int = 0) -> DataFrame:
    """OP-193: of each stratum its share of k, at least one row: those of the
    least hash. No stratum is sorted whole: counts of the hashes' first
    :data:`BANDS` bands tell which band holds a stratum's last row, rows of
    lower bands are in, and only that band's rows are ranked."""
    rows = df.withColumn("_u", uniform(column, seed)).withColumn("_band", F.floor(F.col("_u") * BANDS))
    counts = rows.groupBy(F.col(stratum).alias("_s"), "_band").agg(F.count("*").alias("_n"))
    # At most BANDS rows a stratum.
    below = Window.partitionBy("_s").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_s")
    total = F.broadcast(counts.agg(F.sum("_n").alias("_total")))
    marked = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(below), F.lit(0)), "_of": F.sum("_n").over(every)}).crossJoin(total)
    want = marked.withColumn("_want", F.greatest(F.lit(1), F.floor(k * F.col("_of") / F.col("_total")))).where("_before < _want").select("_s", "_band", "_before", "_n", "_want")
    held = rows.join(want.withColumnRenamed("_band", "_b"), rows[stratum].eqNullSafe(F.col("_s")) & (F.col("_band") == F.col("_b")))
    whole = held.where(F.col("_before") + F.col("_n") <= F.col("_want"))
    w = Window.partitionBy("_s").orderBy("_u", column)
    last = held.where(F.col("_before") + F.col("_n") > F.col("_want")).withColumn("_r", F.row_number().over(w) + F.col("_before")).where("_r <= _want")
    return whole.select(df.columns).union(last.select(df.columns))


def systematic(df: DataFrame, order: list[str], k: int, start: int = 0) -> DataFrame:
    """OP-192: every (n / k)-th row in order, from ``start`` on. Rows are
    numbered by range partition, from the sum of those before, not in one task."""
    placed = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    per = placed.groupBy("_p").agg(F.count("*").alias("_c"))
    offsets = per.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    numbered = placed.join(F.broadcast(offsets), "_p").withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + F.col("_o"))
    total = F.broadcast(df.agg(F.greatest(F.lit(1), F.floor(F.count("*") / k)).alias("_step")))
    return numbered.crossJoin(total).where((F.col("_i") >= start) & ((F.col("_i") - start) % F.col("_step") == 0) & ((F.col("_i") - start) / F.col("_step") < k)).drop("_p", "_o", "_i", "_step")


def recent(df: DataFrame, as_of: Column, seconds: int, order: list[str], k: int) -> DataFrame:
    """OP-194: rows of the last ``seconds``, sampled systematically."""
    return systematic(df.where(F.col("ts") >= as_of - F.make_dt_interval(secs=F.lit(seconds))), order, k)


def adaptive_rate(rate: Column, load: Column, low: float = 0.01, high: float = 1.0) -> Column:
    """OP-195."""
    changed = F.when(load > 0.8, rate * 0.5).when(load > 0.6, rate * 0.7).when(load < 0.3, rate * 1.2).otherwise(rate)
    return F.greatest(F.lit(low), F.least(F.lit(high), changed))


def actual_rate(df: DataFrame, sampled: Column, keys: list[str] | None = None) -> DataFrame:
    """OP-82."""
    return df.groupBy(*(keys or [])).agg((F.count_if(sampled) / F.count("*")).alias("actual_rate"))
