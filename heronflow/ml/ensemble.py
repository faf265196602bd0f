"""Several models side by side (OP-51e, OP-75, OP-99, OP-221 to OP-223, OP-232,
OP-259)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.ml import evaluate, forest
from heronflow.operators.quantiles import exact_quantiles
from heronflow.sources.checkpoints import stored

#: Columns of a flow that are no features.
NO_FEATURES = ("flow_id", "ts", "device_id", "source_ip", "destination_ip", "tcp_flags")
#: Contamination, trees, and the shares of rows and of columns that each forest sees.
CONFIGURATIONS = ((0.1, 200, 0.7, 0.8), (0.15, 150, 0.8, 0.9), (0.08, 250, 0.6, 0.7), (0.12, 180, 0.9, 1.0), (0.2, 100, 0.5, 0.6))


def basic_features(flows: DataFrame) -> DataFrame:
    """OP-51e: flags become their number; what is no feature goes."""
    counted = flows.withColumn("tcp_flags_count", F.coalesce(F.array_size("tcp_flags"), F.lit(0)))
    return counted.drop(*NO_FEATURES)


def feature_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """OP-221: the columns of a model in its order, as doubles; a missing one
    is an error before anything runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"features missing: {', '.join(missing)}")
    return df.select(*(F.col(c).cast("double").alias(c) for c in columns))


def predictions(df: DataFrame, models: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """OP-99: ml_predictions of each row by all models that load. A model is a
    function that gives its score column; one that fails to is left out, as is a
    score that is null. ``failed_models`` names those left out."""
    scores, failed = {}, []
    for name, model in models.items():
        try:
            score = model(df).cast("double")
            df.select(score).schema  # noqa: B018 - analysed here, so that a wrong column fails here
            scores[name] = score
        except Exception:  # noqa: BLE001 - a failed model must not stop the others
            failed.append(name)
    none = F.array().cast("array<struct<model_name:string,anomaly_score:double>>")
    found = [F.when(s.isNotNull(), F.array(F.struct(F.lit(n).alias("model_name"), s.alias("anomaly_score")))).otherwise(none) for n, s in scores.items()]
    return df.withColumns({"ml_predictions": F.concat(*found) if found else none, "failed_models": F.array(*map(F.lit, failed)).cast("array<string>")})


def batch_score(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """OP-222: a batch's score is the greatest of its rows."""
    return scored.groupBy(*(keys or [])).agg(F.max("anomaly_score").alias("anomaly_score"))


def chosen_models(production: dict[str, str], canary: dict[str, str]) -> dict[str, str]:
    """OP-232: versions in use; a canary's takes the place of production's."""
    return production | {k: v for k, v in canary.items() if k in production}


#: A tree's share of the rows is one of so many: what a forest sees does not grow with the table.
TREE_ROWS = 320


def forests(df: DataFrame, id_column: str, columns: list[str], trees: int | None = None) -> list[tuple[float, list[str], DataFrame]]:
    """OP-259: contamination, columns and nodes of one forest a configuration;
    ``trees`` overrides their numbers. A tree sees the configuration's share of
    :data:`TREE_ROWS` rows."""
    out = []
    for k, (contamination, n, rows, share) in enumerate(CONFIGURATIONS):
        mine = columns_of(columns, share, k)
        out.append((contamination, mine, forest.fit_by_hash(df, id_column, mine, trees=trees or n, sample=round(rows * TREE_ROWS), seed=42 + k)))
    return out


def columns_of(columns: list[str], share: float, seed: int) -> list[str]:
    """A forest's share of the columns, drawn by hash."""
    return sorted(columns, key=lambda c: hash_order(c, seed))[: max(1, round(share * len(columns)))]


def hash_order(name: str, seed: int) -> int:
    from zlib import crc32

    return crc32(f"{seed}#{name}".encode())


def majority(df: DataFrame, made: list[tuple[float, list[str], DataFrame]]) -> DataFrame:
    """OP-75, OP-259: ``df`` with ``is_anomaly``, 1 if half of the forests or
    more find a row among their contamination's share of highest scores."""
    out = df
    for k, (_, columns, nodes) in enumerate(made):
        out = forest.score(out, columns, nodes, f"_s{k}")
    out = stored(out)  # cuts and votes read the scores, which are computed once
    cuts = exact_quantiles(out, [f"_s{k}" for k in range(len(made))], sorted({1 - c for c, *_ in made}), keep=False)
    votes = [(F.col(f"_s{k}") >= F.lit(cuts[f"_s{k}"][1 - c])).cast("int") for k, (c, *_) in enumerate(made)]
    return out.select(*df.columns, evaluate.vote(votes).alias("is_anomaly"))


def save_forest(nodes: DataFrame, columns: list[str], folder: str) -> None:
    """OP-223: nodes and feature names."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    nodes.sparkSession.createDataFrame([(k, c) for k, c in enumerate(columns)], "k int, name string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/features")


def load_forest(spark: SparkSession, folder: str) -> tuple[list[str], DataFrame]:
    names = [r["name"] for r in spark.read.parquet(f"{folder}/features").orderBy("k").collect()]
    return names, spark.read.parquet(f"{folder}/nodes")


def importance(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """OP-223: each feature's share of the splits."""
    counts = nodes.where("feature >= 0").groupBy("feature").agg(F.count("*").alias("n"))
    names = nodes.sparkSession.createDataFrame(list(enumerate(columns)), "feature int, name string")
    total = counts.agg(F.sum("n").alias("t"))
    return names.join(counts, "feature", "left").crossJoin(F.broadcast(total)).select("name", (F.coalesce("n", F.lit(0)) / F.col("t")).alias("importance"))
