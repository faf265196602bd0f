"""What the training-data operators share.

Rules that hold for every operator here, unless its own docstring differs:

* a null text counts as an empty text, a null ``doc_id`` is kept as it is;
* repeated rows each get a result of their own;
* an empty table gives an empty result with the same columns;
* input columns that have the name of an output column are replaced by it,
  other columns are ignored or carried along.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What the contracts call white space between words: blank, and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"

#: Rows of a few narrow columns that are broadcast at most: some 10 MB.
BROADCAST_ROWS = 200_000
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Documents go to Python up to :data:`BATCH_ROWS` and, but for a single
    longer row, :data:`BATCH_BYTES` at a time; the defaults are ten times as many
    rows, and 64 MB, of which the JVM and Python hold several. A lower setting
    stays."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, most)


def released(result=None):
    """``result``, after free memory was given back to the system. Python workers
    are kept for later tasks and other stages; what their allocators hold on to
    counts as the executor's all that time."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
    return result


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; when a task is through, its memory is given back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return whole


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that the caller is about to add (any case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or it with so many underscores before it that no column of
    ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. A
    local session (tests) may have none and gets one in its temporary folder; on
    a cluster that would be a folder of one machine, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or f"{tempfile.gettempdir()}/checkpoints"


def shared(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept where every executor can read it again."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared folder: for wide
    rows, that are compressed and of which later steps read a few columns.
    Columns are stored by place, so names that clash do no harm."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.toDF(*[f"c{k}" for k in range(len(df.columns))]).write.parquet(path)
    return df.sparkSession.read.parquet(path).toDF(*df.columns)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` computed once, and marked for broadcast if it is small: a few
    narrow columns of at most ``rows`` rows. Beyond that Spark shuffles."""
    kept = shared(df)
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


def utf8_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in the table: one cheap scan that sizes the work."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def positions(rows: DataFrame, group: str, order: list[Column], keep: list[Column | str]) -> DataFrame:
    """``group``, the columns of ``keep`` and ``pos``: the place of a row in its
    group, from 0, in the order given.

    Rows are sorted across tasks by range, so a group of any size is spread over
    many. What is broadcast is a start for each group that a border cuts: one a
    partition at most. The sorted rows are stored, as borders are drawn from a
    sample and must not change when a task is run again.
    """
    by = [F.col(group), *order]
    marked = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).select(group, *keep, F.monotonically_increasing_id().alias("_row")))
    marked = marked.withColumn("_part", F.shiftright("_row", 33))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy(group, "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.sum("_n").over(before)).where("_start > 0").drop("_n")
    first = F.min("_row").over(Window.partitionBy(group, "_part"))
    placed = marked.withColumn("_first", first).join(F.broadcast(starts), [group, "_part"], "left")
    return placed.withColumn("pos", F.col("_row") - F.col("_first") + F.coalesce("_start", F.lit(0))).drop("_row", "_part", "_first", "_start")


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` inner join ``keyed``, which has one row a key and in ``count``
    how many rows have it. Null keys join.

    A small ``keyed`` is broadcast. Of a larger one, keys of at least one in
    :data:`BROADCAST_ROWS` rows are, of which there can't be more than that; the
    rows of the other keys are shuffled.
    """
    small = keyed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    names = [c for c in keyed.columns if c != key]
    other = keyed.withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    if small:
        return rows.join(F.broadcast(other), same).select(*rows.columns, *names)
    total = keyed.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) * BROADCAST_ROWS >= total
    hot = F.broadcast(other.where(often))
    parts = rows.join(hot, same), rows.join(hot, same, "left_anti").join(other.where(~often), same)
    return parts[0].unionByName(parts[1]).select(*rows.columns, *names)
