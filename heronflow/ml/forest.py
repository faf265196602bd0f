"""Isolation forest (OP-140; Liu, Ting and Zhou 2008).

Each tree is grown from a bounded sample of its own, in a group of one
``applyInPandas``; a forest is a small table of nodes, broadcast for scoring by
a vectorised function.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "tree int, node int, feature int, threshold double, size int"


def average_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, seed: int) -> list[tuple[int, int, float, int]]:
    """node (root 1, children 2i and 2i + 1), feature (-1: leaf), threshold, size."""
    rng = np.random.default_rng(seed)
    limit = max(1, math.ceil(math.log2(max(2, len(x)))))
    out, queue = [], [(1, np.arange(len(x)), 0)]
    while queue:
        node, rows, depth = queue.pop()
        span = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(x.shape[1])
        if depth >= limit or len(rows) <= 1 or not (span > 0).any():
            out.append((node, -1, 0.0, len(rows)))
            continue
        feature = int(rng.choice(np.flatnonzero(span > 0)))
        low = x[rows, feature].min()
        threshold = float(low + rng.random() * span[feature])
        left = x[rows, feature] <= threshold
        out.append((node, feature, threshold, len(rows)))
        queue += [(2 * node, rows[left], depth + 1), (2 * node + 1, rows[~left], depth + 1)]
    return out


def fit(df: DataFrame, id_column: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Nodes of the forest. Every tree gets about ``sample`` rows, drawn by a
    hash of the id; what is shuffled is trees * sample rows."""
    share = min(1.0, 2.0 * trees * sample / max(1, df.count()))
    picked = df.withColumn("_h", F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(1 << 30))).where(F.col("_h") < int(share * (1 << 30)))
    dealt = picked.select(*(F.col(c).cast("double").alias(c) for c in columns), F.explode(F.sequence(F.lit(0), F.lit(max(1, int(min(trees, 2 / share)) - 1)))).alias("_k"), F.col(id_column).alias("_id"))
    dealt = dealt.withColumn("tree", F.pmod(F.xxhash64("_id", "_k", F.lit(seed + 1)), F.lit(trees)).cast("int"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        x = part.sort_values("_id")[columns].to_numpy()
        rng = np.random.default_rng(seed + tree)
        x = x[rng.permutation(len(x))[:sample]]
        return pd.DataFrame([(tree, *n) for n in grow(x, seed + tree)], columns=["tree", "node", "feature", "threshold", "size"])

    return dealt.drop("_k").groupBy("tree").applyInPandas(one, NODES)


def _draw(*parts) -> Column:
    """A number from 0 to 2^32 - 1 by the hash of texts or numbers."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))), 1, 8), 16, 10).cast("bigint")


def _drawn(*parts: object) -> int:
    return int(hashlib.md5("#".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def grow_by_hash(x: np.ndarray, tree: int, sample: int, seed: int) -> list[tuple[int, int, int, float, int]]:
    """tree, node, feature, threshold, size: the feature of a node is the one of
    least hash among those with a range, and its threshold a share of the range."""
    limit, out, queue = max(1, math.ceil(math.log2(max(2, sample)))), [], [(1, np.arange(len(x)), 0)]
    while queue:
        node, rows, depth = queue.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        free = np.flatnonzero(high > low).tolist()
        if depth >= limit or len(rows) < 2 or not free:
            out.append((tree, node, -1, 0.0, len(rows)))
            continue
        feature = min(free, key=lambda k: (_drawn(seed, tree, node, f"c{k}"), k))
        at = float(low[feature] + _drawn(seed, tree, node, "at") / 2**32 * (high[feature] - low[feature]))
        out.append((tree, node, feature, at, len(rows)))
        above = x[rows, feature] > at
        queue += [(2 * node, rows[~above], depth + 1), (2 * node + 1, rows[above], depth + 1)]
    return out


def fit_by_hash(df: DataFrame, id_column: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Nodes of a forest in which every draw is a hash: the same rows give the
    same forest on any cluster, and SQL can grow it too.

    Rows are drawn by their id's hash, each for one tree (small tables: fewer
    than ``sample`` a tree); what is shuffled is trees * sample rows.
    """
    share = min(1.0, trees * sample / max(1, df.count()))
    picked = df.where(_draw(seed, F.col(id_column)) < F.lit(share) * 2**32)
    tree = (_draw(seed, "tree", F.col(id_column)) % trees).cast("int").alias("tree")
    rows = picked.select(tree, F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)).alias("x"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(grow_by_hash(np.stack(part["x"].to_numpy()), int(part["tree"].iloc[0]), sample, seed), columns=["tree", "node", "feature", "threshold", "size"])

    return rows.groupBy("tree").applyInPandas(one, NODES)


class Forest:
    """Trees as arrays over their nodes: feature (-1: leaf), threshold, the places
    of both children, a leaf's being its own, and the path that ends there, over
    the tree's expected one."""

    def __init__(self, nodes: pd.DataFrame):
        self.trees = []
        for _, part in nodes.groupby("tree"):
            part = part.sort_values("node")
            at, feature, size = (part[c].to_numpy() for c in ("node", "feature", "size"))
            inner, depth = feature >= 0, np.frexp(at)[1] - 1
            child = np.repeat(np.arange(len(at)), 2).reshape(-1, 2)
            child[inner] = np.searchsorted(at, np.column_stack([2 * at[inner], 2 * at[inner] + 1]))
            path = (depth + average_path(size)) / max(1e-9, float(average_path(int(size[0]))))
            self.trees.append((feature, np.maximum(feature, 0).astype(np.intp), part["threshold"].to_numpy(), child.ravel(), path, int(depth.max())))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path), in (0, 1]; higher is odder. All rows
        go down a level at a time; those at a leaf stay there."""
        total = np.zeros(len(x))
        flat, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for _, feature, threshold, child, path, levels in self.trees:
            node = np.zeros(len(x), np.intp)
            for _ in range(levels):
                above = flat[row + feature[node]] > threshold[node]
                node *= 2
                node += above
                node = child[node]
            total += path[node]
        return 2 ** (-total / max(1, len(self.trees)))

    def importance(self, columns: list[str]) -> dict[str, float]:
        """Share of the splits of each column."""
        counts = np.bincount(np.concatenate([f[f >= 0] for f, *_ in self.trees]), minlength=len(columns))
        return dict(zip(columns, (counts / max(1, counts.sum())).tolist(), strict=True))


def score(df: DataFrame, columns: list[str], nodes: DataFrame, name: str = "anomaly_score", offset: float = 0.5) -> DataFrame:
    """``df`` with each row's score: the logistic function of by how much its
    raw score, see :meth:`Forest.scores`, exceeds ``offset`` (a half, or the raw
    score that the contamination's share of rows exceeds). The forest is bounded
    by its parameters."""
    held = df.sparkSession.sparkContext.broadcast(Forest(nodes.toPandas()))

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            raw = held.value.scores(np.column_stack([p.to_numpy(float) for p in part]))
            yield pd.Series(1 / (1 + np.exp(offset - raw)))

    return df.withColumn(name, run(*(F.col(c).cast("double") for c in columns)))
