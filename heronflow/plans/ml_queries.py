"""Queries of preprocessing, evaluation and models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow import drift
from heronflow.ml import boost, evaluate, forest, preprocess, search
from heronflow.plans.catalog import query
from heronflow.plans.feature_queries import _r, rounded
from heronflow.sources.checkpoints import new_folder, stored
from heronflow.sources.fixtures import FLOWS_SQL, flows

_COLUMNS = ["bytes_sent", "bytes_received", "packets_sent", "duration_ms", "destination_port"]
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, flow_id FROM flows" for c in _COLUMNS)


@query(f"WITH {FLOWS_SQL}, l AS ({_LONG}) SELECT feature, {_r('avg(x)', 'mean', 3)}, {_r('stddev_samp(x)', 'std', 3)}, min(x) AS min, max(x) AS max, {_r('median(x)', 'median', 3)}, count(*) - count(x) AS missing_count FROM l GROUP BY feature")
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-72, OP-74."""
    return rounded(preprocess.feature_statistics(flows(spark, sf_dir), _COLUMNS), 3)


@query(f"WITH {FLOWS_SQL}, l AS ({_LONG}), v AS (SELECT feature, var_samp(x) AS v FROM l GROUP BY feature) SELECT feature, {_r('v / (SELECT sum(v) FROM v)', 'importance')}, v > 0.01 AS kept FROM v")
def variance_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-73, OP-108."""
    rows = flows(spark, sf_dir)
    kept = preprocess.variances(rows, _COLUMNS).select("feature", (F.col("variance") > 0.01).alias("kept"))
    return rounded(preprocess.variance_importance(rows, _COLUMNS).join(kept, "feature"))


_Q = "q AS (SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY feature)"


@query(f"WITH {FLOWS_SQL}, l AS ({_LONG}), {_Q} SELECT feature, {_r('sum(greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), x)))', 'total', 2)} FROM l JOIN q USING (feature) GROUP BY feature")
def iqr_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capping by interquartile ranges, told by the columns' sums."""
    capped = preprocess.iqr_capped(flows(spark, sf_dir).select(*(F.col(c).cast("double").alias(c) for c in _COLUMNS)), _COLUMNS)
    totals = capped.agg(*(F.sum(c).alias(c) for c in _COLUMNS))
    return rounded(totals.unpivot([], _COLUMNS, "feature", "total"), 2)


_QUARTILES = "q AS (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {k / 4}) AS q{k}_{c}" for c in _COLUMNS for k in (1, 2, 3)) + " FROM flows)"


@query(f"WITH {FLOWS_SQL}, {_QUARTILES} SELECT flow_id, {', '.join(_r(f'({c} - q2_{c}) / CASE WHEN q3_{c} = q1_{c} THEN 1 ELSE q3_{c} - q1_{c} END', c) for c in _COLUMNS)} FROM flows, q")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and interquartile scaling of all flows."""
    rows = flows(spark, sf_dir).select("flow_id", *(F.col(c).cast("double").alias(c) for c in _COLUMNS))
    return rounded(preprocess.scaled(rows, _COLUMNS))


_LABELLED = "l AS (SELECT quality AS truth, CAST(least(1.0, n_chars / 4000.0) AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, documents = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    return labels.join(documents, "doc_id").select(F.col("quality").alias("truth"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))


@query(
    f"""WITH {_LABELLED}, c AS (SELECT count(*) FILTER (truth = 1 AND score >= 0.2) AS tp, count(*) FILTER (truth <> 1 AND score >= 0.2) AS fp, count(*) FILTER (truth = 1 AND score < 0.2) AS fn, count(*) FILTER (truth <> 1 AND score < 0.2) AS tn FROM l)
    SELECT *, {_r("(tp + tn) / (tp + tn + fp + fn)", "accuracy")}, {_r("tp / (tp + fp)", "precision")}, {_r("tp / (tp + fn)", "recall")}, {_r("2 * tp / (2 * tp + fp + fn)", "f1")} FROM c"""
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-76."""
    return rounded(evaluate.metrics(_labelled(spark, sf_dir), "truth", (F.col("score") >= 0.2).cast("int")))


@query(f"WITH {_LABELLED} SELECT {_r('sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*)', 'auc')} FROM l a JOIN l b ON a.truth = 1 AND b.truth = 0")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-76."""
    return rounded(evaluate.auc(_labelled(spark, sf_dir), "truth", "score"))


def _hash(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('#', {', '.join(parts)})), 1, 8))::BIGINT)"


def forest_sql(name: str, columns: list[str], trees: int, sample: int, seed: int) -> str:
    """Tables behind WITH that grow a forest of ``flows`` by hashes and score all
    rows: {name}_score of flow_id, copy, raw. ``x`` below is the row's values."""
    limit = max(1, math.ceil(math.log2(max(2, sample))))
    n, x = len(columns), f"[{', '.join(f'CAST({c} AS DOUBLE)' for c in columns)}]"
    sql = f"""{name}_s AS MATERIALIZED (SELECT flow_id, row_number() OVER () AS copy, {x} AS x FROM flows),
    {name}_l0 AS MATERIALIZED (SELECT {_hash(str(seed), "'tree'", "flow_id")} % {trees} AS tree, 1 AS node, x FROM {name}_s WHERE {_hash(str(seed), "flow_id")} < least(1.0, {trees * sample} / (SELECT count(*) FROM flows)) * 4294967296), """
    for d in range(limit + 1):
        free = ", ".join(f"CASE WHEN max(x[{k + 1}]) > min(x[{k + 1}]) THEN {{'h': {_hash(str(seed), 'tree', 'node', f"'c{k}'")}, 'k': {k}}} END" for k in range(n))
        split = f"CASE WHEN count(*) > 1 THEN list_min(list_filter([{free}], lambda s: s IS NOT NULL)).k END" if d < limit else "NULL::INT"
        low, high = (f"[{', '.join(f'{m}(x[{k + 1}])' for k in range(n))}]" for m in ("min", "max"))
        sql += f"""{name}_p{d} AS MATERIALIZED (SELECT tree, node, count(*) AS size, {split} AS f, {low} AS low, {high} AS high FROM {name}_l{d} GROUP BY tree, node),
    {name}_n{d} AS MATERIALIZED (SELECT tree, node, size, f, low[f + 1] + {_hash(str(seed), "tree", "node", "'at'")} / 4294967296 * (high[f + 1] - low[f + 1]) AS cut FROM {name}_p{d}), """
        if d < limit:
            sql += f"{name}_l{d + 1} AS MATERIALIZED (SELECT tree, 2 * node + CASE WHEN x[f + 1] > cut THEN 1 ELSE 0 END AS node, x FROM {name}_l{d} JOIN {name}_n{d} USING (tree, node) WHERE f IS NOT NULL), "
    path = "CASE WHEN {0} > 2 THEN 2 * (ln({0} - 1) + 0.5772156649015329) - 2.0 * ({0} - 1) / {0} WHEN {0} = 2 THEN 1.0 ELSE 0.0 END"
    walk = f"SELECT copy, x, tree, node, size, f, cut, 0 AS depth, size AS n FROM {name}_s, {name}_n0"
    sql += f"{name}_w0 AS ({walk}), "
    for d in range(1, limit + 1):
        sql += f"{name}_w{d} AS (SELECT w.copy, w.x, w.tree, p.node, p.size, p.f, p.cut, {d} AS depth, w.n FROM {name}_w{d - 1} w JOIN {name}_n{d} p ON p.tree = w.tree AND p.node = 2 * w.node + CASE WHEN w.x[w.f + 1] > w.cut THEN 1 ELSE 0 END WHERE w.f IS NOT NULL), "
    ends = " UNION ALL ".join(f"SELECT copy, depth, size, n FROM {name}_w{d} WHERE f IS NULL" for d in range(limit + 1))
    sql += f"""{name}_e AS (SELECT copy, sum((depth + {path.format("size")}) / greatest(1e-9, {path.format("n")})) AS total FROM ({ends}) GROUP BY copy),
    {name}_score AS MATERIALIZED (SELECT flow_id, copy, 1 / (1 + exp(0.5 - pow(2, -total / (SELECT count(*) FROM {name}_n0)))) AS score FROM {name}_e JOIN {name}_s USING (copy))"""
    return sql


@query(f"WITH {FLOWS_SQL}, {forest_sql('a', _COLUMNS, 20, 128, 42)} SELECT protocol, count(*) AS n, {_r('min(score)', 'least', 5)}, {_r('avg(score)', 'mean', 5)}, {_r('max(score)', 'most', 5)} FROM a_score JOIN (SELECT protocol, row_number() OVER () AS copy FROM flows) USING (copy) GROUP BY protocol")
def isolation_forest_by_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-140: scores of a forest that SQL grows too, from the same hashes."""
    rows = flows(spark, sf_dir).select("flow_id", "protocol", *_COLUMNS)
    scored = forest.score(rows, _COLUMNS, forest.fit_by_hash(rows, "flow_id", _COLUMNS, 20, 128))
    s = F.col("anomaly_score")
    return rounded(scored.groupBy("protocol").agg(F.count("*").alias("n"), F.min(s).alias("least"), F.avg(s).alias("mean"), F.max(s).alias("most")), 5)


@query(f"WITH {FLOWS_SQL} SELECT count(*) AS flows, 0 AS outside, true AS ordered FROM flows")
def isolation_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-140: every flow is scored, from 0 to 1, and the tenth of the highest
    scores lies farther from the mean than the others do."""
    rows = flows(spark, sf_dir).select("flow_id", *_COLUMNS)
    scored = stored(forest.score(rows, _COLUMNS, forest.fit(rows, "flow_id", _COLUMNS, trees=50)).drop("flow_id"))
    stats = scored.agg(*(f(c).alias(f"{n}_{c}") for c in _COLUMNS for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    far = sum((F.abs(F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in _COLUMNS), F.lit(0.0))
    cut = scored.agg(F.percentile_approx("anomaly_score", 0.9, 1000).alias("cut"))
    both = scored.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(cut)).withColumn("far", far)
    top = F.col("anomaly_score") >= F.col("cut")
    return both.agg(
        F.count("*").alias("flows"),
        F.count_if(~F.col("anomaly_score").between(0, 1)).cast("int").alias("outside"),
        (F.avg(F.when(top, F.col("far"))) > F.avg(F.when(~top, F.col("far")))).alias("ordered"),
    )


@query(f"WITH {FLOWS_SQL} SELECT count(*) FILTER (bytes_sent > 60000) AS large, count(*) AS n, true AS ordered FROM flows")
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-141, OP-142: large flows from their other features; their
    mean score is higher than that of the others."""
    rows = stored(flows(spark, sf_dir).select("protocol", "packets_sent", "packets_received", "destination_port", (F.col("bytes_sent") > 60000).cast("double").alias("label")))
    model = boost.boosted(rows, ["packets_sent", "packets_received", "destination_port"], "label", ["protocol"], rounds=5, depth=3)
    large = F.col("label") == 1
    means = F.avg(F.when(large, F.col("score"))) > F.avg(F.when(~large, F.col("score")))
    return boost.probability(model, rows).agg(F.count_if(large).alias("large"), F.count("*").alias("n"), means.alias("ordered"))


@query("SELECT unnest([0, 1, 2]) AS component, true AS small")
def drift_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-164: KS distance of the first three components of two halves, which
    are alike: under what twice the critical value at 0.001 allows."""
    halves = [n for (n,) in spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.col("vec_id") % 2).count().select("count").collect()]
    most = 2 * 1.95 * sum(1 / n for n in halves) ** 0.5
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    base, current = rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1")
    model = boost.components(base, "embedding")
    a, b = boost.projected(model, base, "embedding"), boost.projected(model, current, "embedding")
    parts = [drift.ks_distance(a.select(F.col("c")[k].alias("v")), b.select(F.col("c")[k].alias("v"))).select(F.lit(k).alias("component"), (F.col("d") < most).alias("small")) for k in range(3)]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    f"""WITH {FLOWS_SQL}, l AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, protocol FROM flows" for c in _COLUMNS)}), q AS (SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM l WHERE protocol = 'TCP' GROUP BY feature)
    SELECT feature, {_r("avg((x - q2) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END)", "mean")}, {_r("max((x - q2) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END)", "most")} FROM l JOIN q USING (feature) GROUP BY feature"""
)
def preprocessor_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-220: fitted on TCP flows, saved, loaded and applied to all."""
    rows = flows(spark, sf_dir)
    folder = new_folder(spark, "preprocessor")
    preprocess.Preprocessor.fit(rows.where("protocol = 'TCP'"), _COLUMNS).save(spark, folder)
    out = preprocess.Preprocessor.load(spark, folder).transform(rows)
    long = out.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in _COLUMNS))).alias("r")).select("r.*")
    return rounded(long.groupBy("feature").agg(F.avg("x").alias("mean"), F.max("x").alias("most")))


GRID = search.grid(trees=[10, 30], sample=[64, 256], contamination=[0.05, 0.15])


@query()
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-258, OP-260: isolation forests of eight settings, told by how well
    they find the flows that send most."""
    label = (F.col("bytes_sent") > 90_000).cast("int")
    rows = flows(spark, sf_dir).select("flow_id", *_COLUMNS, label.alias("label"))
    return search.search(rows, "flow_id", _COLUMNS, "label", GRID, search.fit_forest, search.predict_forest)
