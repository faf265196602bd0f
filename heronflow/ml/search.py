"""Grid search with cross-validation (OP-258, OP-260), one Spark job for all
fits and one pass for all scores."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronflow.ml import forest

#: A model is fitted on about so many rows, however large the table.
FIT_ROWS = 5_000


def grid(**values: list) -> list[dict]:
    """All combinations, in the order of the arguments."""
    return [dict(zip(values, v, strict=True)) for v in product(*values.values())]


def _fold(id_column: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_column), F.lit(7)), F.lit(folds)).cast("int")


def search(df: DataFrame, id_column: str, columns: list[str], label: str, parameters: list[dict], fit: Callable, predict: Callable, folds: int = 3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Each of ``parameters`` by number ``p``, with tp, fp, fn, tn, precision,
    recall and f1 over all folds.

    ``fit(x, y, **parameters)`` gives a model, ``predict(model, x)`` 0 or 1 for
    each row. A fold's model sees a sample (by hash of the id) of the other
    folds, so a group of ``applyInPandas`` has ``fit_rows`` rows in the mean. The
    models, parameters x folds, are broadcast; every row is then judged by those
    of its own fold, and only counts are shuffled.
    """
    n = max(1, df.count())
    rows = df.select(F.col(id_column).alias("_id"), _fold(id_column, folds).alias("fold"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.col(label).cast("double").alias("y"))
    share = min(1.0, fit_rows * folds / max(1, folds - 1) / n)
    sample = rows.where(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    others = F.array(*(F.lit(f) for f in range(folds)))
    every = F.sequence(F.lit(0), F.lit(len(parameters) - 1))
    dealt = sample.withColumn("held", F.explode(others)).where("held <> fold or " + str(folds) + " = 1").withColumn("p", F.explode(every))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_id", "y"])
        p, held = int(part["p"].iloc[0]), int(part["held"].iloc[0])
        model = fit(np.stack(part["x"].to_numpy()), part["y"].to_numpy(), **parameters[p])
        return pd.DataFrame({"p": [p], "held": [held], "model": [pickle.dumps(model)]})

    models = {(r.p, r.held): r.model for r in dealt.groupBy("p", "held").applyInPandas(one, "p int, held int, model binary").collect()}
    shared = df.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("array<int>")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        made = {k: pickle.loads(v) for k, v in shared.value.items()}
        for fold, x in parts:
            out = np.zeros((len(fold), len(parameters)), np.int64)
            for f in set(fold):
                mine = (fold == f).to_numpy()
                values = np.stack(x[mine].to_numpy())
                for p in range(len(parameters)):
                    if (p, f) in made:
                        out[mine, p] = predict(made[p, f], values)
            yield pd.Series(out.tolist())

    votes = rows.select("y", F.posexplode(judged("fold", "x")).alias("p", "said"))
    of = lambda said, y: F.count_if((F.col("said") == said) & (F.col("y") == y))
    counts = votes.groupBy("p").agg(of(1, 1).alias("tp"), of(1, 0).alias("fp"), of(0, 1).alias("fn"), of(0, 0).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    scored = counts.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn"))})
    return scored.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0)))


def best(results: DataFrame, parameters: list[dict]) -> tuple[dict, float]:
    """The parameters of the greatest f1; of equal ones the first."""
    row = results.orderBy(F.desc("f1"), "p").first()
    return parameters[row.p], row.f1


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int, sample: int, contamination: float) -> tuple:
    """An isolation forest and the score that the contamination's share of the
    rows exceeds; labels are not used."""
    deal = np.random.default_rng(trees + sample)
    grown = [n for t in range(trees) for n in forest.grow_by_hash(x[deal.permutation(len(x))[:sample]], t, sample, 42)]
    made = forest.Forest(pd.DataFrame(grown, columns=["tree", "node", "feature", "threshold", "size"]))
    return made, float(np.quantile(made.scores(x), 1 - contamination))


def predict_forest(model: tuple, x: np.ndarray) -> np.ndarray:
    made, cut = model
    return (made.scores(x) >= cut).astype(np.int64)
