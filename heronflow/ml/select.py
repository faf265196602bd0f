"""Feature selection by mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronflow.operators.quantiles import bin_number, exact_quantiles


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 10, top: int = 20) -> DataFrame:
    """The ``top`` features by mutual information with the label, in nats.

    Values are cut at the quantiles of their column into bins of equal
    frequency; null is a bin of its own. One pass counts (feature, bin, label) of
    all features; what is left has so many rows at most, whatever the input.
    """
    cuts = exact_quantiles(df, columns, [k / bins for k in range(1, bins)])
    edges = [sorted({v for v in cuts[c].values() if v is not None}) for c in columns]
    cells = [F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), bin_number(F.col(c).cast("double"), e)).alias("bin"), F.col(label).alias("label")) for c, e in zip(columns, edges, strict=True)]
    counts = df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.feature", "c.bin", "c.label").agg(F.count("*").alias("n"))
    of = lambda *keys: F.sum("n").over(Window.partitionBy("feature", *keys))
    part = F.col("n") / of() * F.ln(F.col("n") * of() / (of("bin") * of("label")))
    return counts.select("feature", part.alias("p")).groupBy("feature").agg(F.sum("p").alias("information")).orderBy(F.desc("information"), "feature").limit(top)
