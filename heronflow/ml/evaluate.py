"""Classification metrics (OP-75, OP-76, OP-258)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics(df: DataFrame, truth: str, predicted: Column, keys: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall, f1 of 0/1 columns; 0 where undefined."""
    t, p = F.col(truth) == 1, predicted == 1
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    counts = df.groupBy(*(keys or [])).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    out = counts.withColumns(
        {
            "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties by half. Counts by score are accumulated
    by range partition, so it does not need one task."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("a"), F.count_if(F.col(truth) == 0).alias("b"))
    placed = counts.repartitionByRange("s").withColumn("p", F.spark_partition_id())
    per = placed.groupBy("p").agg(F.sum("b").alias("pb"))
    starts = per.select("p", F.coalesce(F.sum("pb").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sb"))
    w = Window.partitionBy("p").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    below = placed.withColumn("cb", F.sum("b").over(w)).join(F.broadcast(starts), "p")
    won = F.col("a") * (F.col("cb") - F.col("b") + F.col("sb") + F.col("b") / 2)
    return below.agg((F.sum(won) / (F.sum("a") * F.sum("b"))).alias("auc"))


def vote(predictions: list[Column]) -> Column:
    """OP-75: 1 if at least half of the models say 1."""
    return (sum((p.cast("double") for p in predictions), F.lit(0.0)) / len(predictions) >= 0.5).cast("int")


def best_by(results: DataFrame, name: str, measure: str) -> DataFrame:
    """OP-258, OP-260: the model of the greatest measure; ties by name."""
    return results.agg(F.max_by(name, F.struct(measure, name)).alias(name), F.max(measure).alias(measure))
