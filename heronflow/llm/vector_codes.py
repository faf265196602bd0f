"""Operator 11: vectors as codes of four bytes, by VA-file filtering.

Components become integers, floor(scale * x), and vectors are cut into equal
parts; each part position has a codebook of up to 256 entries, made by rounds of
assignment and integer means. The nearest entry is found as in a VA-file: the
coordinates of the entries are quantised to :data:`BITS` bits a dimension; for a
part to be coded two tables hold, by dimension and cell, the least and the
greatest squared distance to what the cell spans; sums over an entry's cells
bound its distance from both sides. Only entries whose lower bound is not over
the least upper bound are compared, in integers. Ties go to the lower index.

Each round is one pass over the vectors. A task sends one row of sums for each
part and entry at most, whatever it reads; the codebooks, 256 vectors in all, go
through the driver.

Cases: rows whose vector is null or has null, NaN or infinite components are
dropped; the length of vectors is that of the row of the least vec_id (null
last, ties by vector), and vectors of another length are kept with null code and
error; lengths that are no multiple of the number of parts are filled with
zeros; floors beyond 2^26 on either side are held there, so that distances fit
64 bits; repeated rows each count; fewer than 256 rows give as many entries;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.llm.common import spread_join, stored, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BITS, LARGEST, BLOCK = 4, 1 << 26, 512


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has finite components only."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & finite)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def cut(numbers: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x dimensions; zeros fill up the last part."""
    rows, n = numbers.shape
    width = -(-n // parts)
    return np.pad(numbers, ((0, 0), (0, width * parts - n))).reshape(rows, parts, width)


class Cells:
    """The entries of one part position, quantised."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        n, width = entries.shape
        cells = min(n, 1 << BITS)
        rank = np.empty((n, width), np.int64)
        np.put_along_axis(rank, np.argsort(entries, axis=0, kind="stable"), np.arange(n)[:, None], axis=0)
        self.cell = rank * cells // n
        self.low, self.high = np.empty((width, cells), np.int64), np.empty((width, cells), np.int64)
        for d in range(width):
            for c in range(cells):
                held = entries[self.cell[:, d] == c, d]
                self.low[d, c], self.high[d, c] = held.min(), held.max()

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row."""
        found = [self._block(asked[k : k + BLOCK]) for k in range(0, len(asked), BLOCK)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _block(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower = np.zeros((len(asked), len(self.entries)), np.int64)
        upper = lower.copy()
        for d in range(asked.shape[1]):
            below, above = self.low[d] - asked[:, d, None], asked[:, d, None] - self.high[d]
            lower += (np.maximum(np.maximum(below, above), 0) ** 2)[:, self.cell[:, d]]
            upper += (np.maximum(np.abs(below), np.abs(above)) ** 2)[:, self.cell[:, d]]
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        distance = ((asked[row] - self.entries[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(distance, np.searchsorted(row, np.arange(len(asked))))
        hit = np.flatnonzero(distance == least[row])
        return entry[hit[np.unique(row[hit], return_index=True)[1]]], least


def _arrays(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return whole_numbers(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, n))


def _moved(vectors: DataFrame, books: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    parts, (entries, width) = len(books), books[0].shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                cuts = cut(_arrays(batch, n), parts)
                for p in range(parts):
                    code, _ = cells[p].nearest(cuts[:, p])
                    np.add.at(total[p], code, cuts[:, p])
                    count[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(total[p, e].tolist(), pa.list_(pa.int64())), pa.array(count[p, e])], ["part", "entry", "total", "n"])

    rows = vectors.mapInArrow(sums, "part bigint, entry bigint, total array<bigint>, n bigint")
    merged = rows.groupBy("part", "entry").agg(*(F.sum(F.col("total")[d]).alias(f"d{d}") for d in range(width)), F.sum("n").alias("n"))
    moved = [b.copy() for b in books]
    for r in merged.collect():  # parts x entries rows at most
        moved[r.part][r.entry] = [r[f"d{d}"] // r.n for d in range(width)]
    return moved


def fit(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Codebooks, by part position, and the length of the vectors."""
    rows = usable(vectors, column).select(F.col(key).alias("k"), F.col(column).alias("v"))
    first = rows.orderBy(F.col("k").asc_nulls_last(), "v").limit(1).first()
    if first is None or not first.v:
        return [np.zeros((min(1, len(first.v) + 1 if first else 0), 0), np.int64)] * parts, 0
    n = len(first.v)
    rows = rows.where(F.size("v") == n)
    start = cut(whole_numbers(np.array([r.v for r in rows.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()])), parts)
    books = [start[:, p] for p in range(parts)]
    for _ in range(rounds):
        books = _moved(rows.select("v"), books, n)
    return books, n


def encode(vectors: DataFrame, books: list[np.ndarray], n: int, column: str = "embedding") -> DataFrame:
    """Usable rows with ``code``, an array of entry numbers, and ``error`` in
    place of the vector; null for vectors of another length than ``n``."""
    carried = [c for c in vectors.columns if c not in (column, "code", "error")]
    rows = usable(vectors, column).select(F.struct(*carried).alias("row"), F.when(F.size(column) == n, F.col(column)).alias("v"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, code array<int>, error bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books] if n else []
        for batch in batches:
            known = batch.column("v").is_valid().to_numpy(zero_copy_only=False)
            codes, errors = np.zeros((len(known), len(books)), np.int64), np.zeros(len(known), np.int64)
            if n and known.any():
                cuts = cut(_arrays(batch.filter(pa.array(known)), n), len(books))
                for p, c in enumerate(cells):
                    codes[known, p], distance = c.nearest(cuts[:, p])
                    errors[known] += distance
            kept = pa.array([c if k else None for c, k in zip(codes.tolist(), known.tolist(), strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), kept, pa.array(errors, mask=~known)], ["row", "code", "error"])

    return rows.mapInArrow(run, schema).select("row.*", "code", "error")


def decoded(codes: DataFrame, books: list[np.ndarray], n: int) -> DataFrame:
    """``vector``, what the entries of a code stand for, in place of the code."""
    known = F.array(*(F.array(*(F.array(*(F.lit(float(x) / SCALE) for x in e)) for e in b)) for b in books))
    whole = F.flatten(F.transform("code", lambda e, p: known[p][e]))
    return codes.withColumn("vector", F.when(F.col("code").isNotNull(), F.slice(whole, 1, n))).drop("code")


def digest(books: list[np.ndarray]) -> str:
    """Of all components in decimals, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books, n = fit(rows)
    out = stored(encode(rows, books, n).select("vec_id", "label", F.lower(F.array_join(F.transform("code", lambda e: F.lpad(F.hex(e), 2, "0")), "")).alias("code"), "error"))
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n_rows"))
    joined = spread_join(out, stored(sums), "label", "n_rows")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    assigned = """a{k} AS MATERIALIZED (
  SELECT id, rn, label, v.part, min({{'d': v.sq - 2 * list_dot_product(v.x, b.x) + b.sq, 'e': b.entry}}) AS best
  FROM v JOIN b{k} AS b ON b.part = v.part GROUP BY ALL
), """
    moved = """m{k} AS (
  SELECT part, entry, list(CAST(mean AS DOUBLE) ORDER BY place) AS x FROM (
    SELECT a.part, best.e AS entry, place, floor(sum(v.x[place]) / count(*)) AS mean
    FROM a{k} AS a JOIN v ON v.rn = a.rn AND v.part = a.part, (SELECT unnest(range(1, (SELECT any_value(len(x)) FROM v) + 1)) AS place) GROUP BY ALL) GROUP BY ALL
), b{next} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.x, b.x) AS x, list_dot_product(coalesce(m.x, b.x), coalesce(m.x, b.x)) AS sq FROM b{k} AS b LEFT JOIN m{k} AS m USING (part, entry)
), """
    rounds = "".join(assigned.format(k=k) + (moved.format(k=k, next=k + 1) if k < ROUNDS else "") for k in range(ROUNDS + 1))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS whole, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT id, rn, label, part, x, list_dot_product(x, x) AS sq FROM (
    SELECT vec_id AS id, rn, label, part, whole[part * len(whole) // {PARTS} + 1:(part + 1) * len(whole) // {PARTS}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS part))
), b0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, x, sq FROM v WHERE rn <= {ENTRIES}
), {rounds}coded AS (
  SELECT id, rn, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY ALL
)
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(s, ',' ORDER BY part, entry)) FROM (SELECT part, entry, array_to_string(list_transform(x, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ',') AS s FROM b{ROUNDS})) AS codebooks_sha256
FROM coded
"""


SQL = _sql()
