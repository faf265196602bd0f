"""Connected components of an edge list, as Spark joins.

Alternating stars (Kiveris et al. 2014): every node points its larger, then its
smaller neighbours to the least neighbour it knows; each round at least halves
the depth, and what is left at the end is one star a component. No list of
nodes or edges leaves the executors.

Least neighbours are aggregated before they are shuffled. To tell them to the
edges of a node, hubs are set apart: nodes with more than one in
:data:`HUBS` of all edge ends, of which there can be no more than :data:`HUBS`,
are broadcast with their least neighbours, so their edges stay where they are;
only edges of the other nodes are joined by a shuffle.

A round has a task for each :data:`TASK_EDGES` edges. With the session's number of
shuffle partitions, and unions of them, rounds on few edges would write thousands
of files with next to nothing in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronflow.llm.common import shared

HUBS = 4_000
TASK_EDGES = 50_000


def _with_least(rows: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """``rows`` (u, v), some of the ``n`` edge ends ``ends``, with m, the least
    v next to u in ``ends``."""
    low = ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = low.where(F.col("n") > n // HUBS).select("u", "m")
    busy = rows.join(F.broadcast(hubs), "u")
    rest = rows.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    return busy.union(rest.join(low.where(F.col("n") <= n // HUBS).select("u", "m"), "u"))


def _pointed(rows: DataFrame) -> DataFrame:
    """Edges (u, v) with v < u, once each."""
    return rows.where("u > v").distinct()


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, about ``n``, in no more partitions than these need."""
    return rows.coalesce(1 + n // TASK_EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for each node of ``edges`` (u, v): the least node it reaches.

    Self-edges, repeated edges and either direction are allowed; nulls are
    dropped; without edges the result is empty.
    """
    edges = shared(_pointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    n, before = edges.count(), None
    while True:
        both = _dealt(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), n)
        large = _with_least(both.where("v > u"), both, 2 * n).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = shared(_dealt(_pointed(_dealt(large, n)), n))
        told = _with_least(large, large, large.count())
        small = told.select(F.col("v").alias("u"), F.col("m").alias("v")).union(told.select("u", F.col("m").alias("v")))
        edges = shared(_dealt(_pointed(_dealt(small, n)), n))
        # Sums of 40 bits each cannot overflow below 8 million million edges.
        now = edges.agg(F.count("*").alias("n"), F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 24)).alias("h")).first()
        if now == before:
            break
        n, before = now["n"], now
    stars = edges.select("u", F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("u"), "root").distinct())
