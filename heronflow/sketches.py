"""Sketches over columns (OP-118, OP-186, OP-187, OP-189, OP-190), with md5 in place of
the original's process-bound hash (G11)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def hashed(value: Column, row: int, width: int) -> Column:
    text = F.concat_ws("#", F.lit(str(row)), value.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(width))


def count_min(df: DataFrame, column: str, width: int = 1000, depth: int = 5) -> DataFrame:
    """row, cell, n: a sketch as a table of at most width * depth rows; values
    are counted first, so each is hashed once a partition."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("row"), hashed(F.col(column), k, width).alias("cell")) for k in range(depth))))
    return counts.select(cells.alias("c"), "_n").groupBy("c.row", "c.cell").agg(F.sum("_n").alias("n"))


def estimates(values: DataFrame, column: str, sketch: DataFrame, width: int = 1000, depth: int = 5) -> DataFrame:
    """The least count over the rows of the sketch, for each value."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("row"), hashed(F.col(column), k, width).alias("cell")) for k in range(depth))))
    asked = values.select(column).distinct().select(column, cells.alias("c")).select(column, "c.row", "c.cell")
    return asked.join(F.broadcast(sketch), ["row", "cell"], "left").groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def bloom_size(capacity: int, error: float) -> tuple[int, int]:
    """Bits and hashes for a capacity and an error rate."""
    bits = max(1, math.ceil(-capacity * math.log(error) / math.log(2) ** 2))
    return bits, max(1, round(bits / capacity * math.log(2)))


def _hashes(column: str, bits: int, hashes: int) -> Column:
    return F.explode(F.array_distinct(F.array(*(hashed(F.col(column), k, bits) for k in range(hashes))))).alias("bit")


def bloom(df: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """The filter as a bitmap: word and mask, 64 bits a row, of the words that
    are not zero. Bits are joined by OR on the map side already."""
    bit = df.select(_hashes(column, bits, hashes))
    return bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))


def maybe_in(df: DataFrame, column: str, bitmap: DataFrame, bits: int, hashes: int, broadcast_words: int = 200_000) -> DataFrame:
    """Distinct values all of whose bits are set: no false negative. A bitmap
    of up to ``broadcast_words`` words is broadcast, a larger one shuffled."""
    asked = df.select(column).distinct().select(column, _hashes(column, bits, hashes)).withColumn("word", F.expr("bit div 64"))
    held = F.broadcast(bitmap) if bits <= 64 * broadcast_words else bitmap
    hit = asked.join(held, "word", "left").withColumn("hit", F.coalesce(F.expr("shiftright(mask, cast(bit % 64 as int)) & 1"), F.lit(0)))
    return hit.groupBy(column).agg(F.min("hit").alias("all")).where(F.col("all") == 1).select(column)


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """OP-118: the k most frequent values, ties by the greater value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc(column)).limit(k)


def distinct_estimate(df: DataFrame, column: str, error: float = 0.02) -> DataFrame:
    """OP-187: Spark's HyperLogLog++."""
    return df.agg(F.approx_count_distinct(column, error).alias("estimate"))


# --- mergeable sketches ---------------------------------------------------------


def hll_registers(df: DataFrame, keys: list[Column | str], column: str, p: int = 12) -> DataFrame:
    """OP-187: a HyperLogLog of 2^p registers as rows: the keys, register and
    rank, the most zeros (and one) that a hash of the register begins with. A
    register without a row is empty. Sketches are united by the greatest rank,
    so those of small windows are kept in place of the raw data."""
    hexes = F.md5(F.col(column).cast("string"))
    high, low = (F.conv(F.substring(hexes, k, 8), 16, 10).cast("bigint") for k in (1, 9))
    rank = F.when(low == 0, 33).otherwise(33 - F.length(F.bin(low)))
    names = [k if isinstance(k, str) else f"_k{n}" for n, k in enumerate(keys)]
    rows = df.where(F.col(column).isNotNull()).select(*(F.col(k) if isinstance(k, str) else k.alias(n) for k, n in zip(keys, names, strict=True)), F.shiftright(high, 32 - p).alias("register"), rank.alias("rank"))
    return rows.groupBy(*names, "register").agg(F.max("rank").alias("rank"))


def hll_sliding(sketches: DataFrame, day: str, keys: list[str], days: int) -> DataFrame:
    """Sketches by ``day`` (a date) united over the ``days`` days that end at
    each day; a sketch takes part in as many windows."""
    ends = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    spread = sketches.select("*", ends.alias("_d")).withColumn(day, F.date_add(day, F.col("_d"))).drop("_d")
    return spread.groupBy(day, *keys, "register").agg(F.max("rank").alias("rank"))


def hll_estimates(sketches: DataFrame, keys: list[str], p: int = 12) -> DataFrame:
    """The keys and ``estimate``; by empty registers where the count is small.
    The standard error is 1.04 / sqrt(2^p) of it."""
    m = 1 << p
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = sketches.groupBy(*keys).agg(F.count("*").alias("_r"), F.sum(F.pow(F.lit(0.5), F.col("rank"))).alias("_z"))
    raw = F.lit(alpha * m * m) / (F.col("_z") + (m - F.col("_r")))
    few = (raw <= 2.5 * m) & (F.col("_r") < m)
    return sums.select(*keys, F.when(few, F.lit(float(m)) * F.ln(F.lit(float(m)) / (m - F.col("_r")))).otherwise(raw).alias("estimate"))


def frequent_summary(df: DataFrame, column: str, counters: int) -> DataFrame:
    """OP-190: Space-Saving counters, in the form that subtracts: item, low and
    lost. Each task keeps ``counters`` items; when there are more, what the
    largest of the others has goes from all, and is added to ``lost``. A true
    count is from low to low plus the sum of ``lost``, which is at most the
    rows over counters + 1. Summaries are merged by adding up."""
    kind = df.schema[column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lost = pd.Series(dtype="int64"), 0
        for batch in batches:
            found = batch.column(0).drop_null().value_counts()
            counts = pd.Series(found.field(1).to_pylist(), index=found.field(0).to_pylist(), dtype="int64")
            held = held.add(counts, fill_value=0).astype("int64")
            if len(held) > counters:
                cut = int(held.nlargest(counters + 1).iloc[-1])
                held, lost = held[held > cut] - cut, lost + cut
        if len(held) or lost:
            rows = [(i, int(n), 0) for i, n in held.items()] + [(None, 0, lost)]
            items, low, less = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(items, arrow_kind), pa.array(low, pa.int64()), pa.array(less, pa.int64())], ["item", "low", "lost"])

    arrow_kind = to_arrow_type(kind)
    parts = df.select(F.col(column)).mapInArrow(run, f"item {kind.simpleString()}, low bigint, lost bigint")
    return parts.groupBy("item").agg(F.sum("low").alias("low"), F.sum("lost").alias("lost"))


def heavy_hitters(df: DataFrame, column: str, share: float) -> DataFrame:
    """Every value with over ``share`` of the rows, its count, and the bounds
    that the summary of one pass gives it; a second pass counts the candidates,
    of which there are 2 / share at most."""
    summary = frequent_summary(df, column, math.ceil(2 / share))
    top = summary.agg(F.sum("lost").alias("lost")).first()["lost"] or 0
    total = df.where(F.col(column).isNotNull()).count()
    held = summary.where(F.col("item").isNotNull() & (F.col("low") + top > share * total)).select("item", "low", (F.col("low") + top).alias("high"))
    counts = df.join(F.broadcast(held), F.col(column) == F.col("item")).groupBy("item", "low", "high").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > share * total).select(F.col("item").alias(column), "n", "low", "high")
