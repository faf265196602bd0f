"""Model versions as a small table; each change is a new table (OP-121, OP-148,
OP-149, OP-226 to OP-231, OP-233, OP-241)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronflow.operators.ranking import version_key


def registered(registry: DataFrame, new: DataFrame) -> DataFrame:
    """OP-227: new rows whose (model, version) is not taken are added."""
    return registry.unionByName(new.join(registry, ["model", "version"], "left_anti"), allowMissingColumns=True)


def promoted(registry: DataFrame, model: str, version: str) -> DataFrame:
    """OP-148: one version to production, the one there to the archive."""
    mine = F.col("model") == model
    stage = F.when(mine & (F.col("version") == version), "production").when(mine & (F.col("stage") == "production"), "archived").otherwise(F.col("stage"))
    return registry.withColumn("stage", stage)


def rolled_back(registry: DataFrame, model: str) -> DataFrame:
    """OP-148: the newest archived version takes production's place."""
    w = Window.partitionBy("model", "stage").orderBy(F.desc(version_key(F.col("version"))))
    ranked = registry.withColumn("_r", F.row_number().over(w))
    mine = F.col("model") == model
    has = F.max(F.when(mine & (F.col("stage") == "archived"), 1)).over(Window.partitionBy("model"))
    stage = F.when(mine & (F.col("stage") == "production") & has.isNotNull(), "archived").when(mine & (F.col("stage") == "archived") & (F.col("_r") == 1), "production").otherwise(F.col("stage"))
    return ranked.withColumn("stage", stage).drop("_r")


def without_version(registry: DataFrame, model: str, version: str) -> DataFrame:
    """OP-228: production versions are protected."""
    return registry.where(~((F.col("model") == model) & (F.col("version") == version) & (F.col("stage") != "production")))


def missing_artifacts(registry: DataFrame, files: DataFrame) -> DataFrame:
    """OP-230: versions whose path is not among the files' paths."""
    return registry.join(files.select(F.col("path").alias("artifact")), "artifact", "left_anti")


def health(registry: DataFrame) -> DataFrame:
    """OP-231."""
    return registry.groupBy("model").agg(F.count("*").alias("versions"), F.count_if(F.col("stage") == "production").alias("in_production"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """OP-226: a JSON registry of model name to version to entry."""
    entry = "map<string,map<string,struct<stage:string,artifact:string,metrics:map<string,double>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", entry)).alias("model", "versions"))
    return rows.select("model", F.explode("versions").alias("version", "e")).select("model", "version", "e.*")


def target_replicas(current: Column, ratios: list[Column], least: int, most: int) -> Column:
    """OP-149: current times the greatest metric / target, truncated, clamped."""
    return F.greatest(F.lit(least), F.least(F.lit(most), (current * F.greatest(*ratios) if len(ratios) > 1 else current * ratios[0]).cast("int")))


def should_scale(current: Column, target: Column, since_s: Column, change: float = 0.2, cooldown_s: int = 300) -> Column:
    """OP-149: a change of a fifth at least, and none in the last five minutes."""
    return (F.abs(target - current) / current >= change) & (since_s >= cooldown_s)


def component_health(rows: DataFrame) -> DataFrame:
    """OP-77, OP-241: healthy share, its class, and who is not healthy."""
    share = F.count_if("healthy") / F.count("*")
    return rows.agg(
        share.alias("health"),
        F.when(share >= 0.8, "healthy").when(share >= 0.5, "degraded").otherwise("unhealthy").alias("status"),
        F.array_sort(F.collect_list(F.when(~F.col("healthy"), F.col("component")))).alias("unhealthy"),
    )


def deployment_counters(deployments: DataFrame) -> DataFrame:
    """OP-233: deployments by how they ended."""
    of = lambda status: F.count_if(F.col("status") == status)
    return deployments.agg(F.count("*").alias("total"), of("completed").alias("completed"), of("failed").alias("failed"), of("rolled_back").alias("rolled_back"))
