"""OP-89 on a stream: a left join with a dimension that changes meanwhile.

Every batch reads the dimension's last version and writes what it joins to a
folder of its own number. Before that it notes the version for its number, so a
batch that is run again after a failure takes the same version, overwrites its
own folder and leaves no row twice. What the dimension becomes later doesn't
change rows that are out already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heronflow.sources.versioned import KeyedTable

BROADCAST_ROWS = 200_000


def joined(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join; a dimension of up to :data:`BROADCAST_ROWS` rows is broadcast."""
    small = dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(dimension) if small else dimension, key, "left")


def enrich_batch(dimension: KeyedTable, pins: KeyedTable, key: str, out: str):
    """A function for foreachBatch."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        noted = pins.read().where(F.col("batch") == number).first() if pins.versions() else None
        version = noted.version if noted else (dimension.versions() or [0])[-1]
        if not noted:
            pins.merge(spark.createDataFrame([(number, version, number)], "batch bigint, version bigint, at bigint"), "at", batch=("stream", number))
        rows = joined(batch, dimension.read(version), key).withColumn("dimension_version", F.lit(version))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return run


def enriched(stream: DataFrame, dimension: KeyedTable, key: str, out: str, state: str, **trigger) -> StreamingQuery:
    """Starts the query; rows are found below ``out``, by batch."""
    pins = KeyedTable(stream.sparkSession, f"{state}/pins", ["batch"], 1)
    return stream.writeStream.foreachBatch(enrich_batch(dimension, pins, key, out)).option("checkpointLocation", f"{state}/query").trigger(**(trigger or {"availableNow": True})).start()
