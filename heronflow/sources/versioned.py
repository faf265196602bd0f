"""Keyed tables with atomic merges (OP-30, OP-37, OP-252, alert status).

A table is a folder of Parquet files in buckets of the key's hash, and a small
manifest for each version: which folder holds each bucket, and the last batch
taken of every source. A merge reads and rewrites only the buckets that its
changes touch and then puts the next manifest in place by a rename that fails if
another writer was first. Readers see whole versions; a merge that dies leaves
files that no manifest names; a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeyedTable:
    """``keys`` are never null. ``buckets`` bounds what the driver knows: choose
    it so that one has some hundred megabytes; it can't change later."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 16) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder, keys, buckets

    # --- manifests -------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, "versions", *parts]))

    def versions(self) -> list[int]:
        """Numbers of the versions there are, from 1."""
        top = self._path()
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        names = (f.getPath().getName() for f in files.listStatus(top))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Of the last version, or an older one; the empty one before the first."""
        found = self.versions()
        if version is None and not found:
            return {"version": 0, "batches": {}, "parts": {}, "schema": None}
        number = found[-1] if version is None else version
        return json.loads(self.spark.read.text(self._path(f"{number}.json").toString(), wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        part, whole = self._path(f".{uuid.uuid4().hex}"), self._path(f"{manifest['version']}.json")
        out = part.getFileSystem(conf).create(part)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), conf).rename(part, whole, options)

    # --- rows ------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [manifest["parts"][b] for b in buckets if b in manifest["parts"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _held(self, data: str) -> set[str]:
        """Buckets that a write has left rows in."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(data)
        names = (f.getPath().getName() for f in top.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(top))
        return {n.removeprefix("_bucket=") for n in names if n.startswith("_bucket=")}

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        if not manifest["schema"]:
            raise ValueError(f"no version of {self.folder} yet")
        return self._rows(manifest, list(manifest["parts"]))

    def merge(self, changes: DataFrame, order: str, deleted: str | None = None, batch: tuple[str, int] | None = None, keep: Column | None = None) -> int:
        """Puts the rows of ``changes`` in the place of those with their key; of
        several changes of one key the last by ``order`` counts. Where
        ``deleted`` is true the key goes. ``batch``: source and number; one that
        was taken before is skipped. ``keep``: of old.* and new.*, a condition
        under which the old row stays. Returns the number of the version.
        """
        before = self.manifest()
        if batch and before["batches"].get(batch[0], -1) >= batch[1]:
            return before["version"]
        names = [c for c in changes.columns if c not in (order, deleted)]
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        whole = F.struct(*[F.col(c) for c in names], gone.alias("_gone"))
        last = changes.groupBy(*[F.col(k).alias(f"_{k}") for k in self.keys]).agg(F.max_by(whole, F.col(order)).alias("new")).select("new.*")
        fresh = f"{self.folder}/changes-{uuid.uuid4().hex}"  # read three times
        last.withColumn("_bucket", self._bucket()).write.parquet(fresh)
        last = self.spark.read.parquet(fresh)
        touched = [str(r[0]) for r in last.select("_bucket").distinct().collect()]  # buckets at most
        schema = before["schema"] or changes.select(*names).schema.jsonValue()
        old = self._rows({**before, "schema": schema}, touched).alias("old")
        new = last.alias("new")
        both = old.join(new, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in self.keys], "full_outer")
        in_old, in_new = F.col(f"old.{self.keys[0]}").isNotNull(), F.col(f"new.{self.keys[0]}").isNotNull()
        stays = in_old & (~in_new | (F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False)))
        columns = [F.when(stays, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in names]
        merged = both.where(stays | ~F.coalesce("new._gone", F.lit(False))).select(*columns).withColumn("_bucket", self._bucket())
        data = f"{self.folder}/data-{uuid.uuid4().hex}"
        merged.repartitionByRange("_bucket", *self.keys).write.partitionBy("_bucket").parquet(data)
        held = self._held(data)
        parts = {b: p for b, p in before["parts"].items() if b not in touched} | {b: f"{data}/_bucket={b}" for b in touched if b in held}
        batches = before["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._commit({"version": before["version"] + 1, "batches": batches, "parts": parts, "schema": schema})
        return before["version"] + 1


#: An alert's states and those that each may become.
STATES = {"open": ("acknowledged", "resolved", "false_positive"), "acknowledged": ("resolved", "false_positive"), "resolved": ("open",), "false_positive": ("open",)}


def change_status(alerts: KeyedTable, changes: DataFrame, order: str, batch: tuple[str, int] | None = None) -> int:
    """Alert status update: key and status of ``changes``; a change that
    :data:`STATES` doesn't allow, or of an alert there isn't, has no effect."""
    last = changes.groupBy(*alerts.keys).agg(F.max_by("status", order).alias("_status"), F.max(order).alias(order))
    known = alerts.read()
    rows = known.join(last, alerts.keys).select(*[F.col("_status").alias(c) if c == "status" else F.col(c) for c in known.columns], order)
    allowed = F.lit(False)
    for state, others in STATES.items():
        allowed = allowed | ((F.col("old.status") == state) & F.col("new.status").isin(*others))
    return alerts.merge(rows, order, batch=batch, keep=~allowed)
