"""Writers (OP-30 to OP-34, OP-36, OP-37, OP-39, OP-40, OP-51d, OP-197,
OP-245, OP-249, OP-252)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.sources.versioned import KeyedTable


def bulk_index(df: DataFrame, path: str, id_column: str) -> int:
    """OP-30, OP-31: append documents; how many were written is observed while
    writing, not counted again."""
    from pyspark.sql import Observation

    seen = Observation()
    df.withColumn("_id", F.col(id_column).cast("string")).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def ndjson(df: DataFrame, path: str, batch: int = 500) -> None:
    """OP-32: JSON lines, at most ``batch`` a file."""
    df.write.mode("append").option("maxRecordsPerFile", batch).json(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> DataFrame:
    """OP-252: the table at ``path`` with the rows of ``new`` in place of those
    of the same keys, to be written elsewhere and then swapped."""
    old = spark.read.parquet(path)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def json_event(kind: str, *columns: str) -> Column:
    """OP-40: one structured log line."""
    return F.to_json(F.struct(F.lit(kind).alias("event_type"), *columns))


def expired_partitions(partitions: DataFrame, as_of: Column, days: int, date: str = "event_date") -> DataFrame:
    """OP-36: partitions to delete."""
    return partitions.where(F.datediff(as_of, F.col(date)) >= days)


def notification(severity: str = "severity") -> Column:
    """OP-39: the text of an alert; delivery is the caller's. The score is cut
    to two digits, so that none looks higher than it is."""
    score = F.floor(F.col("threat_score") * 100 + 1e-7) / 100
    return F.format_string("[%s] %s on %s, score %.2f", F.upper(severity), F.col("attack_category"), F.col("device_id").cast("string"), score)


def each_batch(*steps: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """OP-37, OP-202, OP-245: several steps on each micro-batch, read once."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for step in steps:
                step(batch, number)
        finally:
            batch.unpersist()

    return run


def merging(table: KeyedTable, order: str, source: str) -> Callable[[DataFrame, int], None]:
    """OP-37: a step that merges each batch into a table by key; a batch that is
    run again after a failure changes nothing."""
    return lambda batch, number: table.merge(batch, order, batch=(source, number)) and None


def best_codec(results: DataFrame, by: str = "ratio", keys: list[str] | None = None) -> DataFrame:
    """OP-81: of codec, original, compressed, seconds: the best by ratio, speed,
    or both."""
    r = F.col("original") / F.greatest(F.lit(1), F.col("compressed"))
    speed = F.col("original") / F.greatest(F.lit(1e-9), F.col("seconds"))
    score = {"ratio": r, "speed": speed, "balance": r * F.ln(1 + speed)}[by]
    return results.groupBy(*(keys or [])).agg(F.max_by("codec", F.struct(score, F.col("codec"))).alias("codec"), F.max(r).alias("best_ratio"))


#: The library function of each codec.
CODECS = {"gzip": ("gzip", "compress", "decompress"), "zlib": ("zlib", "compress", "decompress"), "bz2": ("bz2", "compress", "decompress")}


def _coded(data: Column, codec: str, way: int) -> Column:
    import importlib

    module, *names = CODECS[codec]

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        use = getattr(importlib.import_module(module), names[way])
        return values.map(lambda x: None if x is None else use(bytes(x)))

    return run(data)


def compressed(data: Column, codec: str) -> Column:
    """OP-249: a binary column, compressed value by value."""
    return _coded(data, codec, 0)


def decompressed(data: Column, codec: str) -> Column:
    return _coded(data, codec, 1)


def compress_and_sample(df: DataFrame, id_column: str, rate: float, codec: str) -> DataFrame:
    """OP-197: a sample by hash of the id, each row as compressed JSON."""
    from heronflow.sampling import bernoulli

    body = F.to_json(F.struct(*df.columns)).cast("binary")
    return bernoulli(df, id_column, rate).select(id_column, compressed(body, codec).alias("data"))


def without_fields(events: DataFrame, names: tuple[str, ...] = ("@version", "host")) -> DataFrame:
    """OP-51d: fields go, and an event with an attack category is tagged so."""
    kept = events.drop(*names)
    tag = F.concat(F.lit("attack_"), F.col("attack_category"))
    return kept.withColumn("tags", F.when(F.col("attack_category").isNotNull(), F.array_append("tags", tag)).otherwise(F.col("tags")))
