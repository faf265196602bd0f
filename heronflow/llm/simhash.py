"""Operator 8: SimHash near-duplicates by anchor points.

Fingerprint: texts are lower-cased (A-Z), cut into words at white space and
into shingles of four words (a shorter text is one shingle, no word at all
gives fingerprint zero); each shingle is hashed with XXH64, seed 42, and a bit
of the fingerprint is set if it is set in over half of the hashes.

Search: the 64 bits are cut into three segments. Of two fingerprints that
differ in ``t`` bits, some two segments together differ in at most ``2t // 3``.
On each two segments the anchors are the pairs of words of the perfect binary
Golay code (23, 12), whose covering radius is 3 a segment, so every fingerprint
has exactly one nearest anchor, its home, at a distance r. A fingerprint is
replicated to every anchor within r + ``2t // 3``. For two fingerprints that
link, the home of the one with the smaller r is then among the other's anchors:
at each anchor it is enough to compare those at home with all that are there.
Replicas are about 200 a distinct fingerprint; exact copies are one
fingerprint. With 16.8 million anchors on each two segments few fingerprints
meet that do not link. Large groups at an anchor are not expanded to pairs:
what a fingerprint links to leaves the rest, so m fingerprints at an anchor that
all link cost about m comparisons and m - 1 edges; m that do not link cost m a
fingerprint at home, of which 42 bits or more agree within a few.

Cases: null and empty texts have fingerprint zero and link with each other;
ties and repeated rows share a component; an empty table gives an empty result;
documents without an id take part, and a component of only such has a null
``component_id``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.llm.common import releasing, shared, sized, table, texts
from heronflow.llm.components import components

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Generator polynomial of the binary Golay code (23, 12).
GOLAY = 0b110001110101
#: Replicas that a task of the anchor stage gets, about.
TASK_REPLICAS = 1_000_000
#: Fingerprints that a task replicates, about.
TASK_FINGERPRINTS = 5_000
#: Comparisons at one anchor from which linked fingerprints leave the rest.
MANY = 256

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str) -> int:
    from xxhash import xxh64_digest

    words = text.encode("utf-8").lower().split()  # both know ASCII only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    hashes = np.frombuffer(b"".join([xxh64_digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, "doc_id bigint, fp bigint")


@lru_cache(maxsize=8)
def _cosets(slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 and the lower 11 bits of a word; for each
    syndrome the weight r of its coset and the members of weight r to r + slack
    (-1: none); and how far above r each column is."""
    rest = np.arange(1 << 12, dtype=np.int64)

    def syndrome(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words = np.where(words >> bit & 1, words ^ GOLAY << bit - 11, words)
        return words

    upper, lower = syndrome(rest << 11), syndrome(rest[: 1 << 11])
    by: list[list[list[int]]] = [[[] for _ in range(4 + slack)] for _ in range(1 << 11)]
    for weight in range(4 + slack):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.int64)
        for error, s in zip(errors.tolist(), (upper[errors >> 11] ^ lower[errors & 0x7FF]).tolist(), strict=True):
            by[s][weight].append(error)
    radius = np.array([next(w for w, found in enumerate(m) if found) for m in by])
    width = [max(len(m[r + k]) for m, r in zip(by, radius, strict=True)) for k in range(slack + 1)]
    rows = [sum((m[r + k] + [-1] * (width[k] - len(m[r + k])) for k in range(slack + 1)), []) for m, r in zip(by, radius, strict=True)]
    return upper, lower, radius, np.array(rows, np.int64), np.repeat(np.arange(slack + 1), width)


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, index of the fingerprint, and if the anchor is its home."""
    slack = 2 * threshold // 3
    upper, lower, _, members, above = _cosets(slack)
    first, second = np.nonzero(above[:, None] + above[None, :] <= slack)
    home = (above[first] + above[second]) == 0
    near = []
    for start, bits in SEGMENTS:
        words = (fps >> np.uint64(start) & np.uint64((1 << bits) - 1)).astype(np.int64)
        found = members[upper[words >> 11] ^ lower[words & 0x7FF]]
        near.append(np.where(found >= 0, found ^ words[:, None], -1))
    out = []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        a, b = near[i][:, first], near[j][:, second]
        row, column = np.nonzero((a >= 0) & (b >= 0))
        out.append(((np.int64(k) << 46) | (a[row, column] << 23) | b[row, column], row, home[column]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spanning(fps: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges that connect what links among distinct fingerprints."""
    edges, rest = [], np.sort(fps)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            linked = np.bitwise_count(rest ^ queue.pop()) <= threshold
            if linked.any():
                edges += [(root, x) for x in rest[linked]]
                queue += list(rest[linked])
                rest = rest[~linked]
    return edges


def links(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Edges among the fingerprints that meet at the anchors given."""
    order = np.argsort(anchor, kind="stable")
    anchor, fps, home = anchor[order], fps[order], home[order]
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(anchor)])
    at_home = np.add.reduceat(home.astype(np.int64), start) if len(start) else start
    edges = [np.zeros((0, 2), np.uint64)]
    for k in np.flatnonzero((at_home * size > MANY) & (size > 1)):
        found = _spanning(np.unique(fps[start[k] : start[k] + size[k]]), threshold)
        edges.append(np.array(found, np.uint64).reshape(-1, 2))
    few = np.repeat((at_home * size <= MANY) & (size > 1), size) & home
    group = np.repeat(np.arange(len(start)), size)[few]
    for part in np.array_split(np.arange(len(group)), 1 + len(group) // 200_000):
        mine, of = fps[few][part], group[part]
        n = size[of]
        other = fps[np.repeat(start[of] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        mine = np.repeat(mine, n)
        linked = (np.bitwise_count(mine ^ other) <= threshold) & (mine != other)
        edges.append(np.stack([np.maximum(mine, other)[linked], np.minimum(mine, other)[linked]], axis=1))
    return np.unique(np.concatenate(edges), axis=0)


def fingerprint_links(fps: DataFrame, n: int, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (u, v) among ``n`` distinct fingerprints ``fp``: all that link are
    connected through them. Replicas travel packed, one row for each task and
    bucket of anchors."""
    buckets = max(1, -(-n * 200 // TASK_REPLICAS))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(every), 5_000):
                part = every[at : at + 5_000]
                anchor, row, home = anchors(part, threshold)
                # The top bit of an anchor tells who is at home.
                bucket = (anchor.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                packed = (anchor | home.astype(np.int64) << 62)[order]
                held, ends = np.unique(bucket[order], return_index=True)
                ends = np.r_[ends[1:], len(order)]
                start = 0
                keys, values = [], []
                for end in ends.tolist():
                    keys.append(packed[start:end].tobytes())
                    values.append(part[row[order[start:end]]].tobytes())
                    start = end
                yield pa.record_batch([pa.array(held.astype(np.int64)), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], names=["bucket", "anchors", "fps"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = [], []
        for batch in batches:
            keys += batch.column(1).to_pylist()
            values += batch.column(2).to_pylist()
        anchor = np.frombuffer(b"".join(keys), np.int64)
        found = links(anchor & ~np.int64(1 << 62), np.frombuffer(b"".join(values), np.uint64), anchor >> 62 & 1 == 1, threshold).view(np.int64)
        yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    # A number of partitions of its own: so few bytes would be put in one task.
    replicas = fps.select("fp").repartition(max(1, -(-n // TASK_FINGERPRINTS)), "fp").mapInArrow(releasing(replicate), "bucket bigint, anchors binary, fps binary")
    return replicas.repartition(buckets, "bucket").mapInArrow(releasing(compare), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that links lead to."""
    found = shared(fingerprints(docs))
    distinct = shared(found.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    roots = components(fingerprint_links(distinct, distinct.count(), threshold))
    linked = shared(distinct.join(roots.withColumnRenamed("u", "fp"), "fp"))
    least = sized(linked.groupBy("root").agg(F.min("low").alias("component_id")))
    linked = linked.join(least, "root").select("fp", "component_id", F.lit(True).alias("links"))
    # A fingerprint of one document that links to none needs no look-up; what is
    # left is stored, so a fingerprint of very many documents can be split.
    every = distinct.join(linked, "fp", "left").where("n > 1 or links").select("fp", F.when(F.col("links"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"), F.lit(True).alias("shared"))
    out = found.join(sized(every), "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component, that of the least doc_id.
    Rows without an id stay: nothing can name them. Repeated ids count once."""
    return keep_least(docs, near_duplicates(docs, threshold))


def keep_least(docs: DataFrame, near: DataFrame) -> DataFrame:
    """:func:`keep_one` by the doc_id and component_id of ``near``."""
    named = docs.where("doc_id is not null")
    dropped = sized(near.where("doc_id <> component_id").select("doc_id").distinct())
    again = sized(named.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    rest = named.join(dropped, "doc_id", "left_anti")
    once = rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rest.join(again, "doc_id", "left_anti").select(docs.columns).union(once.select(docs.columns)).union(docs.where("doc_id is null"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
