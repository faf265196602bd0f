"""Top rows of groups, and version order (OP-119, OP-121, OP-122, OP-124)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark prunes groups before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def top_entries(df: DataFrame, column: str, n: int, key: str, value: str) -> DataFrame:
    """The n greatest entries of a map column, within the row; ties by key."""
    entries = F.transform(F.map_entries(column), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("name")))
    top = F.slice(F.array_sort(entries), 1, n)
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(top).alias("e")).select(*others, F.col("e.name").alias(key), (-F.col("e.minus")).alias(value))


def version_key(version: Column) -> Column:
    """Numbers of a dotted version; arrays compare as versions do."""
    return F.transform(F.split(version, r"\."), lambda x: x.cast("int"))


def latest_versions(registry: DataFrame, n: int) -> DataFrame:
    return first_of_each(registry.withColumn("_k", version_key(F.col("version"))), ["model"], [F.desc("_k")], n).drop("_k")


def cleaned_up(registry: DataFrame, keep: int, protected: list[str]) -> DataFrame:
    """The newest ``keep`` versions of each model, and all in protected stages."""
    w = Window.partitionBy("model").orderBy(F.desc(version_key(F.col("version"))))
    return registry.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= keep) | F.col("stage").isin(*protected)).drop("_r")


def compatible(a: Column, b: Column) -> Column:
    """OP-229: the same major version."""
    return version_key(a)[0] == version_key(b)[0]
