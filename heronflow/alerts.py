"""Alert admission: thresholds, cooldown, hourly cap (OP-112, OP-156)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heronflow.flows import micros
from heronflow.sources.checkpoints import stored

RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def severity_rank(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.lower(severity)]


def passes(severity: str, score: float, confidence: float) -> Column:
    """At least a rule's severity, score and confidence."""
    return (severity_rank(F.col("severity")) >= RANK[severity]) & (F.col("threat_score") >= score) & (F.col("confidence") >= confidence)


FIRST = -(1 << 62)
#: Cooldowns that one part of a key's time covers.
SPAN = 16


def _steps(t: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """From the first moment that times may pass on, up to each of the first
    result, the last one to pass is that of the second."""
    after = np.searchsorted(t, t + gap).tolist()
    last = t.tolist()
    for i in range(len(last) - 1, -1, -1):
        if after[i] < len(last):
            last[i] = last[after[i]]
    last = np.asarray(last, np.int64)
    ends = np.flatnonzero(np.r_[last[1:] != last[:-1], True])
    return t[ends], last[ends]


def _passing(t: np.ndarray, may: int, gap: int) -> list[int]:
    out, i = [], int(np.searchsorted(t, may))
    while i < len(t):
        out.append(int(t[i]))
        i = int(np.searchsorted(t, out[-1] + gap))
    return out


def cooled_down(df: DataFrame, keys: list[str], order: list[str], minutes: int) -> DataFrame:
    """Rows that come ``minutes`` or more after the last one that was let
    through, of the same keys; keys must not be null.

    Whether a row passes depends on those before it. The rows of a key, one for
    each distinct time, are cut into parts of :data:`SPAN` cooldowns and stored
    part by part, so ``df`` is computed once. A part first tells, as a
    step function, which of its times is the last to pass if times from some
    moment on may; paths through a part soon meet, so it has few steps. The
    steps of a key are then gone through in order, which gives the moment from
    which times may pass in each part, and each part lets its rows through. So
    a busy key is spread over its parts, and only steps are brought together.
    """
    gap = minutes * 60_000_000
    part = F.floor(F.col("_t") / (SPAN * gap)).cast("bigint")
    # Rows are shuffled once: those of a part hold all of the same time.
    dealt = df.withColumn("_t", micros()).where("_t is not null").withColumn("_part", part).repartition(*keys, "_part")
    # Of rows at the same time the first passes.
    w = Window.partitionBy(*keys, "_part", "_t").orderBy(*order)
    first = dealt.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    packed = stored(first.groupBy(*keys, "_part").agg(F.collect_list(F.struct("_t", F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))).alias("_rows")))
    packed = packed.withColumn("_ts", F.col("_rows._t"))
    schema = lambda rest: StructType([*df.select(*keys).schema.fields, *StructType.fromDDL(rest).fields])

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [_steps(np.sort(t), gap) for t in rows["_ts"]]
            yield rows[[*keys, "_part"]].assign(_upto=[a.tolist() for a, _ in found], _last=[b.tolist() for _, b in found])

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            may = []
            for found in rows["_steps"]:
                now, out = FIRST, []
                for r in found:
                    out.append(now)
                    i = bisect_left(r["_upto"], now)
                    now = int(r["_last"][i]) + gap if i < len(r["_last"]) else now
                may.append(out)
            yield rows[keys].assign(_parts=[[r["_part"] for r in found] for found in rows["_steps"]], _may=may)

    @F.pandas_udf("array<int>")
    def passing(times: pd.Series, may: pd.Series) -> pd.Series:
        """Places, from 0, of the times that pass."""
        out = []
        for t, m in zip(times, may, strict=True):
            by_time = np.argsort(t)
            out.append(by_time[np.searchsorted(t[by_time], np.array(_passing(t[by_time], int(m), gap), np.int64))].tolist())
        return pd.Series(out)

    step_rows = packed.select(*keys, "_part", "_ts").mapInPandas(steps, schema("_part bigint, _upto array<bigint>, _last array<bigint>"))
    by_key = step_rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_part", "_upto", "_last"))).alias("_steps"))
    start_rows = by_key.mapInPandas(starts, schema("_parts array<bigint>, _may array<bigint>"))
    start_rows = start_rows.select(*keys, F.explode(F.arrays_zip(F.col("_parts").alias("_part"), F.col("_may").alias("_may"))).alias("s")).select(*keys, "s._part", "s._may")
    passed = packed.join(start_rows, [*keys, "_part"]).withColumn("_at", passing("_ts", "_may"))
    kept = passed.select(F.explode(F.transform("_at", lambda k: F.col("_rows")[k]["row"])).alias("row"))
    return kept.select("row.*")


def hourly_cap(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of a key in each hour; the original's cap never
    takes effect (G5)."""
    w = Window.partitionBy(*keys, F.date_trunc("hour", "ts")).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
