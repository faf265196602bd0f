"""Column statistics, selection and scaling (OP-72 to OP-74, OP-108, OP-144,
OP-220). One aggregate over all columns at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.operators.quantiles import exact_quantiles, joined_literals
from heronflow.sources.checkpoints import stored


def _per_column(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    """feature and one column for each measure, from a single aggregate."""
    wide = df.agg(*(f(F.col(c)).alias(f"{c}__{m}") for c in columns for m, f in measures.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), *(F.col(f"{c}__{m}").alias(m) for m in measures)) for c in columns))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def feature_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """OP-72."""
    df = stored(df.select(*columns))  # its rows are made once
    d = lambda f: lambda c: f(c).cast("double")
    out = _per_column(df, columns, {"mean": F.avg, "std": F.stddev_samp, "min": d(F.min), "max": d(F.max), "missing_count": lambda c: F.count_if(c.isNull())})
    middle = {c: q[0.5] for c, q in exact_quantiles(df, columns, [0.5], keep=False).items()}
    medians = df.sparkSession.createDataFrame(list(middle.items()), "feature string, median double")
    return out.join(F.broadcast(medians), "feature").select("feature", "mean", "std", "min", "max", "median", "missing_count")


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    return _per_column(df, columns, {"variance": F.var_samp})


def selected_features(df: DataFrame, columns: list[str], least: float = 0.01) -> list[str]:
    """OP-73: columns whose sample variance is over ``least``."""
    keep = {r["feature"] for r in variances(df, columns).where(F.col("variance") > least).collect()}
    return [c for c in columns if c in keep]


def variance_importance(df: DataFrame, columns: list[str]) -> DataFrame:
    """OP-108: each column's share of all variances."""
    v = variances(df, columns)
    return v.crossJoin(F.broadcast(v.agg(F.sum("variance").alias("_t")))).select("feature", (F.col("variance") / F.col("_t")).alias("importance"))


def _joined(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    stats = df.agg(*(f(F.col(c)).alias(f"_{m}_{c}") for c in columns for m, f in measures.items()))
    return df.crossJoin(F.broadcast(stats))


def _quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, stored once, with its columns' quartiles."""
    df = stored(df)
    found = exact_quantiles(df, columns, [0.25, 0.5, 0.75], keep=False)
    return joined_literals(df, {f"_q{k}_{c}": found[c][k / 4] for c in columns for k in (1, 2, 3)})


def iqr_capped(df: DataFrame, columns: list[str], times: float = 1.5) -> DataFrame:
    """Values beyond ``times`` interquartile ranges are pulled to the border."""
    rows = _quartiles(df, columns)

    def capped(c: str) -> Column:
        q1, q3 = F.col(f"_q1_{c}"), F.col(f"_q3_{c}")
        return F.greatest(q1 - times * (q3 - q1), F.least(q3 + times * (q3 - q1), F.col(c)))

    return rows.withColumns({c: capped(c) for c in columns}).select(df.columns)


def scaled(df: DataFrame, columns: list[str], kind: str = "robust") -> DataFrame:
    """standard (population deviation), minmax or robust (median and
    interquartile range); a range of zero leaves the shifted value."""
    if kind == "robust":
        rows = _quartiles(df, columns).withColumns({f"_a_{c}": F.col(f"_q2_{c}") for c in columns} | {f"_b_{c}": F.col(f"_q3_{c}") - F.col(f"_q1_{c}") for c in columns})
    else:
        rows = _joined(df, columns, {"standard": {"a": F.avg, "b": F.stddev_pop}, "minmax": {"a": F.min, "b": lambda c: F.max(c) - F.min(c)}}[kind])
    by = lambda c: F.when(F.col(f"_b_{c}") == 0, 1.0).otherwise(F.col(f"_b_{c}"))
    return rows.withColumns({c: (F.col(c) - F.col(f"_a_{c}")) / by(c) for c in columns}).select(df.columns)


def imputed(df: DataFrame, columns: list[str], kind: str = "median") -> DataFrame:
    if kind == "median":
        rows = joined_literals(df, {f"_m_{c}": q[0.5] for c, q in exact_quantiles(df, columns, [0.5]).items()})
    else:
        rows = _joined(df, columns, {"m": {"mean": F.avg, "most_frequent": F.mode}[kind]})
    return rows.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}).select(df.columns)


def invalid(columns: list[str]) -> Column:
    """OP-144: a feature is null, no number, or infinite; for a quarantine."""
    out = F.lit(False)
    for c in columns:
        x = F.col(c).cast("double")
        out = out | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return out


def one_hot(df: DataFrame, column: str, values: list[str], drop_first: bool = True) -> DataFrame:
    kept = sorted(values)[int(drop_first) :]
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in kept})


def split(df: DataFrame, column: str, shares: dict[str, int], seed: int = 42) -> DataFrame:
    """A part for each row by a hash of its id: the same for the same id."""
    slot = F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(sum(shares.values())))
    out, upto = None, 0
    for name, n in shares.items():
        upto += n
        out = F.when(slot < upto, name) if out is None else out.when(slot < upto, name)
    return df.withColumn("part", out)


class Preprocessor:
    """OP-220: what scaling and imputation need, fitted once, kept as a table
    (feature, middle, centre, span) and applied to any rows: null becomes the
    median, then values are shifted and divided as :func:`scaled` does."""

    def __init__(self, fitted: dict[str, tuple[float, float, float]]) -> None:
        self.fitted = fitted

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], kind: str = "robust") -> Preprocessor:
        q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        if kind == "robust":
            sides = {c: (q[c][0.5], q[c][0.75] - q[c][0.25] if q[c][0.5] is not None else None) for c in columns}
        else:
            centre, span = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, lambda c: F.max(c) - F.min(c))}[kind]
            row = df.agg(*(f(F.col(c)).cast("double").alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("a", centre), ("b", span)))).first()
            sides = {c: (row[f"a{k}"], row[f"b{k}"]) for k, c in enumerate(columns)}
        return cls({c: (q[c][0.5] or 0.0, sides[c][0] or 0.0, sides[c][1] or 1.0) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(a)) / F.lit(b) for c, (m, a, b) in self.fitted.items()})

    def save(self, spark: SparkSession, folder: str) -> None:
        rows = [(c, *v) for c, v in self.fitted.items()]
        spark.createDataFrame(rows, "feature string, middle double, centre double, span double").coalesce(1).write.mode("overwrite").parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Preprocessor:
        return cls({r.feature: (r.middle, r.centre, r.span) for r in spark.read.parquet(folder).collect()})


def categorical_columns(df: DataFrame, columns: list[str], most: int = 0) -> list[str]:
    """OP-142: columns of text or booleans; with ``most`` also whole numbers of
    at most so many different values, counted in one pass of sketches and then
    exactly."""
    kinds = dict(df.select(*columns).dtypes)
    plain = [c for c in columns if kinds[c] in ("string", "boolean")]
    whole = [c for c in columns if kinds[c] in ("tinyint", "smallint", "int", "bigint") and most]
    if not whole:
        return plain
    near = df.agg(*(F.approx_count_distinct(c, 0.05).alias(c) for c in whole)).first()
    few = [c for c in whole if near[c] <= 2 * most]
    exact = df.agg(*(F.count_distinct(c).alias(c) for c in few)).first() if few else {}
    return [c for c in columns if c in plain or (c in few and exact[c] <= most)]
