"""Distribution drift (OP-147, OP-160 to OP-164, OP-168, OP-170, OP-234). Samples are DataFrames with
one column ``v``; sums and counts do the work, so each fits any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ks_distance(base: DataFrame, current: DataFrame) -> DataFrame:
    """OP-160: one row of d, n, m. Counts by distinct value are accumulated by
    range partition: values are sorted across tasks, then each partition starts
    from the sum of those before it, so no task sees them all."""
    both = base.select("v", F.lit(1).alias("a"), F.lit(0).alias("b")).union(current.select("v", F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = both.where("v is not null").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    placed = counts.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    per = placed.groupBy("p").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.withColumns({"sa": F.coalesce(F.sum("pa").over(before), F.lit(0)), "sb": F.coalesce(F.sum("pb").over(before), F.lit(0))})
    totals = per.agg(F.sum("pa").alias("n"), F.sum("pb").alias("m"))
    w = Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    steps = placed.withColumns({"ca": F.sum("a").over(w), "cb": F.sum("b").over(w)}).join(F.broadcast(starts), "p").crossJoin(F.broadcast(totals))
    return steps.agg(F.max(F.abs((F.col("ca") + F.col("sa")) / F.col("n") - (F.col("cb") + F.col("sb")) / F.col("m"))).alias("d"), F.first("n").alias("n"), F.first("m").alias("m"))


def ks_pvalue(d: float, n: int, m: int, terms: int = 100) -> float:
    """Asymptotic two-sided p-value (Kolmogorov's series)."""
    x = d * math.sqrt(n * m / (n + m))
    if x < 1e-9:
        return 1.0
    if x < 1.18:  # the other form of the series converges faster here
        s = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, terms))
        return min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / x * s))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, terms))))


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Number of the equal-width bin, right-closed, the lowest edge included."""
    width = (high - low) / bins
    return F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((v - low) / width)))


def _shares(base: DataFrame, current: DataFrame, bins: int, common: bool) -> DataFrame:
    """k, p, q: share of each sample in each bin of the baseline's range (what
    of ``current`` is outside is left out) or of both samples' range."""
    both = base.select("v", F.lit(0).alias("s")).union(current.select("v", F.lit(1).alias("s"))).where("v is not null")
    span = (both if common else both.where("s = 0")).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    inside = both.crossJoin(F.broadcast(span)).where(F.col("v").between(F.col("low"), F.col("high")))
    counts = inside.groupBy(_bin(F.col("v"), F.col("low"), F.col("high"), bins).alias("k")).agg(F.count_if(F.col("s") == 0).alias("a"), F.count_if(F.col("s") == 1).alias("b"))
    totals = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    every = base.sparkSession.range(1, bins + 1).select(F.col("id").alias("k"))
    return every.join(F.broadcast(counts), "k", "left").crossJoin(F.broadcast(totals)).select("k", (F.coalesce("a", F.lit(0)) / F.col("ta")).alias("p"), (F.coalesce("b", F.lit(0)) / F.col("tb")).alias("q"))


def psi(base: DataFrame, current: DataFrame, bins: int = 10, eps: float | None = 1e-3) -> DataFrame:
    """OP-161: population stability index. With ``eps`` empty bins count as so
    much; with None as in the original: a bin empty on one side gives infinity,
    one empty on both is skipped."""
    shares = _shares(base, current, bins, common=False)
    if eps is not None:
        p, q = F.greatest("p", F.lit(eps)), F.greatest("q", F.lit(eps))
        return shares.agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    p, q = F.col("p"), F.col("q")
    one = ((p == 0) | (q == 0)) & (p != q)
    part = F.when(one, F.lit(float("inf"))).when(p == 0, 0.0).otherwise((q - p) * F.ln(F.nullif(q, F.lit(0.0)) / F.nullif(p, F.lit(0.0))))
    return shares.agg(F.sum(part).alias("psi"))


def js_distance(base: DataFrame, current: DataFrame, bins: int = 50, eps: float = 1e-10) -> DataFrame:
    """OP-162: Jensen-Shannon distance, natural logarithm."""
    shares = _shares(base, current, bins, common=True).select((F.col("p") + eps).alias("p"), (F.col("q") + eps).alias("q"))
    shares = shares.crossJoin(F.broadcast(shares.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq")))).select((F.col("p") / F.col("sp")).alias("p"), (F.col("q") / F.col("sq")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    return shares.agg(F.sqrt(F.sum(F.col("p") * F.ln(F.col("p") / m) + F.col("q") * F.ln(F.col("q") / m)) / 2).alias("js"))


def chi_square(base: DataFrame, current: DataFrame) -> DataFrame:
    """OP-163: of category counts; expected ones are scaled to the current
    total. Categories that only one side has count as 0.5 expected at least."""
    a = base.groupBy("v").agg(F.count("*").alias("a"))
    b = current.groupBy("v").agg(F.count("*").alias("b"))
    both = a.join(b, a.v.eqNullSafe(b.v), "full_outer").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    totals = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    scaled = F.greatest(F.lit(0.5), F.col("a") * F.col("tb") / F.col("ta"))
    return both.crossJoin(F.broadcast(totals)).agg(F.sum((F.col("b") - scaled) ** 2 / scaled).alias("chi2"), (F.count("*") - 1).alias("dof"))


def chi_square_pvalue(chi2: float, dof: int) -> float:
    """Upper tail, by the series of the regularised gamma function."""
    a, x = dof / 2, chi2 / 2
    if x <= 0 or dof <= 0:
        return 1.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return min(1.0, max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))))


def severity(value: Column, threshold: Column | float) -> Column:
    """OP-168: by how many times the threshold is exceeded."""
    times = value / threshold
    return F.when(times >= 10, "CRITICAL").when(times >= 5, "HIGH").when(times >= 2, "MEDIUM").otherwise("LOW")


def psi_band(value: Column) -> Column:
    """OP-170."""
    return F.when(value < 0.1, "stable").when(value < 0.2, "moderate").otherwise("significant")


def degradation(baseline: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """OP-147: metrics that fell by over ``threshold`` of their baseline."""
    drop = (F.col("base") - F.col("now")) / F.col("base")
    both = baseline.withColumnRenamed("value", "base").join(current.withColumnRenamed("value", "now"), ["model", "metric"])
    return both.where(F.col("base") > 0).withColumn("relative_drop", drop).where(F.col("relative_drop") > threshold)


# --- from sketches ---------------------------------------------------------------

#: Size of the quantile sketches and the error of their ranks (the library's for
#: this size, with 99 % confidence); points at which two of them are compared.
SKETCH_K, RANK_ERROR, POINTS = 400, 0.0075, 200


def quantile_sketches(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Keys, column, n and a mergeable KLL sketch of each column's values: all
    columns in one pass. Kept as rows, these are baselines by window."""
    parts = df.groupBy(*keys).agg(*(F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(SKETCH_K)).alias(f"_s{k}") for k, c in enumerate(columns)), *(F.count(c).alias(f"_n{k}") for k, c in enumerate(columns)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_n{k}").alias("n"), F.col(f"_s{k}").alias("sketch")) for k, c in enumerate(columns))))
    return parts.select(*keys, rows.alias("r")).select(*keys, "r.*").where("n > 0")


def united(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sketches of several windows as one, by column and ``keys``."""
    return sketches.groupBy(*(keys or []), "column").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def _quantiles(sketch: str, parts: int) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.array(*(F.lit(k / parts) for k in range(parts + 1))))


def _rank(quantiles: Column, v: Column) -> Column:
    """The share of values up to ``v``, at most 1 / POINTS too low."""
    return F.greatest(F.size(F.filter(quantiles, lambda q: q <= v)) - 1, F.lit(0)) / POINTS


def _both(base: DataFrame, current: DataFrame) -> DataFrame:
    """column, and of each side the sketch and its quantiles."""
    sides = [df.select("column", F.col("sketch").alias(n), _quantiles("sketch", POINTS).alias(f"q{n}")) for df, n in ((base, "a"), (current, "b"))]
    return sides[0].join(sides[1], "column")


def sketch_ks(base: DataFrame, current: DataFrame) -> DataFrame:
    """OP-160 from sketches: column, d, and ``error``, by which it is off the
    exact distance at most: both rank errors, and one step between the quantiles
    at which the two are compared."""
    apart = F.transform(F.array_union("qa", "qb"), lambda v: F.abs(_rank(F.col("qa"), v) - _rank(F.col("qb"), v)))
    return _both(base, current).select("column", F.array_max(apart).alias("d"), F.lit(2 * RANK_ERROR + 1 / POINTS).alias("error"))


def sketch_psi(base: DataFrame, current: DataFrame, bins: int = 10, eps: float = 1e-3) -> DataFrame:
    """OP-161 from sketches, over bins that each have an equal share of the
    baseline."""
    edges = F.array_distinct(F.slice(_quantiles("a", bins), 2, bins - 1))

    def shares(q: str) -> Column:
        upto = F.concat(F.array(F.lit(0.0)), F.transform("edges", lambda v: _rank(F.col(q), v)), F.array(F.lit(1.0)))
        return F.zip_with(F.slice(upto, 2, F.size("edges") + 1), F.slice(upto, 1, F.size("edges") + 1), lambda x, y: F.greatest(x - y, F.lit(eps)))

    pairs = F.zip_with(shares("qa"), shares("qb"), lambda p, q: (q - p) * F.ln(q / p))
    return _both(base, current).withColumn("edges", edges).select("column", F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x).alias("psi"))
