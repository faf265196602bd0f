"""Gradient-boosted trees, principal components and sequence scores with
Spark's own estimators (OP-141 to OP-143, OP-164)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronflow.ml.preprocess import categorical_columns
from heronflow.sources.checkpoints import stored


def boosted(train: DataFrame, columns: list[str], label: str, categorical: list[str] | None = None, rounds: int = 20, depth: int = 4):
    """A fitted pipeline; a fifth of the rows (by hash) stops it early. Columns
    of text and booleans are taken as categories; ``categorical`` adds to them.

    Fitting reads its rows dozens of times. Rows alike are one row of their number's
    weight, and these are stored, so ``train`` itself is worked out once."""
    found = categorical_columns(train, columns)
    columns, categorical = [c for c in columns if c not in found], sorted({*found, *(categorical or [])})
    used = list(dict.fromkeys([*columns, *categorical, label]))
    train = stored(train.groupBy(*used).agg(F.count("*").cast("double").alias("_weight")))
    train = train.withColumns({c: F.col(c).cast("string") for c in categorical})
    index = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categorical]
    parts = [*columns, *(f"{c}__i" for c in categorical)]
    rows = train.withColumn("_hold", F.pmod(F.xxhash64(*columns, *categorical), F.lit(5)) == 0)
    model = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, maxBins=128, stepSize=0.1, validationIndicatorCol="_hold", weightCol="_weight", seed=42)
    return Pipeline(stages=[*index, VectorAssembler(inputCols=parts, outputCol="_x", handleInvalid="keep"), model]).fit(rows)


def probability(model, df: DataFrame, name: str = "score") -> DataFrame:
    """``df`` with the probability of class 1."""
    texts = {s.getInputCol(): F.col(s.getInputCol()).cast("string") for s in model.stages if isinstance(s, StringIndexerModel)}
    names = {c: f"_kept_{c}" for c in texts}
    rows = df.withColumns({n: F.col(c) for c, n in names.items()}).withColumns(texts) if texts else df
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in df.columns), name)


def components(base: DataFrame, column: str, k: int = 3):
    """Scaler and components fitted on an array column of the baseline."""
    from pyspark.ml.functions import array_to_vector

    rows = base.select(array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("v"))
    return Pipeline(stages=[StandardScaler(inputCol="v", outputCol="s", withMean=True), PCA(k=k, inputCol="s", outputCol="c")]).fit(rows)


def projected(model, df: DataFrame, column: str) -> DataFrame:
    """One column ``c``: array of the components of each row."""
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("v"))
    return model.transform(rows).select(vector_to_array("c").alias("c"))


def window_zscore(column: str, keys: list[str], order: list[str], length: int) -> Column:
    """OP-143's stand-in scorer: how far a value is from its window's mean, in
    deviations, squashed to (0, 1). Any sequence model can take its place."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - length, 0)
    z = (F.col(column) - F.avg(column).over(w)) / F.nullif(F.stddev_pop(column).over(w), F.lit(0.0))
    return F.coalesce(1 - F.exp(-F.abs(z) / 2), F.lit(0.0))
