"""OP-86, OP-111 and OP-130 on streams: two decoders' records of one time and
five-tuple become one row.

Of a decoder's records of one key the last counts: an aggregate that the
watermark closes. The sides then meet in a full outer join whose state is
bounded by the watermark as well: a row that finds no partner comes out once no
partner can come any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronflow.flows import FIVE_TUPLE
from heronflow.streaming.flows import timed


def last_records(records: DataFrame, values: list[str], order: str, late: str, keys: list[str] | None = None) -> DataFrame:
    """The last record by ``order`` of each time and five-tuple."""
    keys = keys or FIVE_TUPLE
    whole = F.struct(*values)
    return timed(records, late).groupBy("ts", *keys).agg(F.max_by(whole, order).alias("r")).select("ts", *keys, "r")


def merged(one: DataFrame, two: DataFrame, values: list[str], order: str, late: str, apart: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows with the values of the first side, or else those of the second; side
    tells which had it. With ``apart`` times may differ by so much: each pair
    within it is a row."""
    keys = keys or FIVE_TUPLE
    a = last_records(one, values, order, late, keys).alias("a")
    b = last_records(two, values, order, late, keys).alias("b")
    same: Column = F.col("a.ts") == F.col("b.ts")
    if apart:
        same = (F.col("a.ts") >= F.col("b.ts") - F.expr(f"interval {apart}")) & (F.col("a.ts") <= F.col("b.ts") + F.expr(f"interval {apart}"))
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    both = a.join(b, same, "full_outer")
    side = F.when(F.col("a.ts").isNull(), "second").when(F.col("b.ts").isNull(), "first").otherwise("both")
    return both.select(
        F.coalesce("a.ts", "b.ts").alias("ts"), *(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), *(F.coalesce(f"a.r.{v}", f"b.r.{v}").alias(v) for v in values), side.alias("side")
    )


def union_all(one: DataFrame, two: DataFrame, late: str) -> DataFrame:
    """OP-130: the records of both, under one watermark."""
    return timed(one.unionByName(two, allowMissingColumns=True), late)
