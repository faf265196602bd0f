"""Exact quantiles of several columns without gathering their values."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronflow.sources.checkpoints import stored

#: Parts that a column's values are cut into by approximate quantiles.
PARTS = 64


def bin_number(v: Column, bounds: list[float], first: int = 0) -> Column:
    """How many bounds are below a value: a binary search as nested conditions."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(v <= bounds[middle], bin_number(v, bounds[:middle], first)).otherwise(bin_number(v, bounds[middle + 1 :], first + middle + 1))


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], keep: bool = True) -> dict[str, dict[float, float | None]]:
    """The ``shares`` quantiles of each column, interpolated between ranks; null
    for a column without values.

    The columns alone are stored first, as they are read three times (``keep``
    false: ``df`` is a stored table). Approximate quantiles, a fixed number for each
    column, cut its values into parts; the parts' totals tell in which part a rank
    lies, and only values of those parts are shuffled, counted and ordered. Nothing
    but the bounds, the totals and the results comes to the driver.
    """
    if keep:
        df = stored(df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in columns)))
    cuts = df.agg(*(F.percentile_approx(F.col(f"`{c}`").cast("double"), [k / PARTS for k in range(1, PARTS)], 10 * PARTS).alias(f"_{k}") for k, c in enumerate(columns))).first()
    bounds = [sorted(set(cuts[k] or [])) for k in range(len(columns))]
    value = [F.col(f"`{c}`").cast("double") for c in columns]
    part = [bin_number(v, b) for b, v in zip(bounds, value, strict=True)]
    held = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), p.alias("part"))) for k, (p, v) in enumerate(zip(part, value, strict=True))]
    totals: list[dict[int, int]] = [{} for _ in columns]
    for r in df.select(F.inline(F.array_compact(F.array(*held)))).groupBy("k", "part").count().collect():
        totals[r["k"]][r["part"]] = r["count"]
    asked, parts_of = [], []
    for k, sizes in enumerate(totals):
        total, before = sum(sizes.values()), 0
        ranks = {f((total - 1) * q) for q in shares for f in (math.floor, math.ceil)} if total else set()
        parts_of.append([])
        for p in sorted(sizes):
            inside = [r for r in sorted(ranks) if before <= r < before + sizes[p]]
            asked += [(k, p, before, r, total) for r in inside]
            parts_of[k] += [p] if inside else []
            before += sizes[p]
    spark = df.sparkSession
    asked = F.broadcast(spark.createDataFrame(asked, "k int, part int, before bigint, rank bigint, total bigint"))
    held = [F.when(v.isNotNull() & p.isin(wanted), F.struct(F.lit(k).alias("k"), p.alias("part"), v.alias("v"))) for k, (p, v, wanted) in enumerate(zip(part, value, parts_of, strict=True)) if wanted]
    held = held or [F.lit(None).cast("struct<k:int,part:int,v:double>")]
    counts = df.select(F.inline(F.array_compact(F.array(*held)))).groupBy("k", "part", "v").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("k", "part").orderBy("v")))
    placed = upto.join(asked, ["k", "part"]).withColumns({"high": F.col("before") + F.col("upto"), "low": F.col("before") + F.col("upto") - F.col("n")})
    found = placed.where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at: dict[int, dict[int, float]] = {}
    totals_of: dict[int, int] = {}
    for r in found.select("k", "rank", "v", "total").collect():
        at.setdefault(r["k"], {})[r["rank"]] = r["v"]
        totals_of[r["k"]] = r["total"]

    def quantile(k: int, q: float) -> float | None:
        if k not in at:
            return None
        place = (totals_of[k] - 1) * q
        low = int(place)
        high = low if place == low else low + 1
        return at[k][low] + (at[k][high] - at[k][low]) * (place - low)

    return {c: {q: quantile(k, q) for q in shares} for k, c in enumerate(columns)}


def joined_literals(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """``df`` with a constant column for each of the values."""
    return reduce(lambda d, kv: d.withColumn(kv[0], F.lit(kv[1]).cast("double")), values.items(), df)
