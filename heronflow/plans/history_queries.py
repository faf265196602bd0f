"""Queries of recent rows, histories, ensembles, registry changes, and the
remaining checks of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow import drift, enrich, history, registry
from heronflow.ml import ensemble, evaluate, preprocess
from heronflow.operators import ranking
from heronflow.plans.catalog import query
from heronflow.plans.feature_queries import _r, rounded
from heronflow.plans.ml_queries import forest_sql
from heronflow.plans.ops_queries import _HALVES, _halves, _registry, _sql_bins, _VERSIONS_SQL
from heronflow.plans.scoring import SCORED_SQL, all_detections
from heronflow.sources import sinks
from heronflow.sources.checkpoints import new_folder
from heronflow.sources.fixtures import FLOWS_SQL, PACKETS_SQL, flows, packets
from heronflow.streaming import flows as streams


def _now() -> Column:
    return F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")



@query(f"WITH {PACKETS_SQL} SELECT count(*) FILTER (ts > TIMESTAMP '2024-01-18') AS observations, count(*) FILTER (ts > TIMESTAMP '2024-01-24') AS alerts, count(*) FILTER (NOT ts > TIMESTAMP '2024-01-18') AS expired FROM packets")
def recent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-51, OP-157, OP-235: what is recent at a given time, and what is not."""
    rows = packets(spark, sf_dir)
    of = {k: history.is_recent(_now(), history.RECENT_DAYS[k]) for k in ("observations", "alerts")}
    return rows.agg(*(F.count_if(c).alias(k) for k, c in of.items()), F.count_if(~F.coalesce(of["observations"], F.lit(False))).alias("expired"))


@query(f"WITH {SCORED_SQL} SELECT severity, count(*) AS n FROM scored WHERE threat_score > 0.3 GROUP BY severity")
def detections_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-50."""
    return all_detections(spark, sf_dir).where("threat_score > 0.3").groupBy("severity").agg(F.count("*").alias("n"))


@query(f"WITH {SCORED_SQL} SELECT flow_id, ['seen', 'attack_' || attack_category] AS tags FROM scored")
def events_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-51d: fields removed, tags added."""
    rows = all_detections(spark, sf_dir).withColumns({"host": F.lit("h"), "tags": F.array(F.lit("seen"))})
    out = sinks.without_fields(rows)
    return out.select("flow_id", "tags", *(c for c in out.columns if c == "host"))


@query(f"WITH {PACKETS_SQL} SELECT payload_size, destination_port, coalesce(len(tcp_flags), 0) AS tcp_flags_count, count(*) AS n FROM packets GROUP BY ALL")
def basic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-51e, OP-221."""
    rows = ensemble.basic_features(packets(spark, sf_dir))
    return ensemble.feature_matrix(rows, ["payload_size", "destination_port", "tcp_flags_count"]).groupBy(F.col("payload_size").cast("bigint").alias("payload_size"), F.col("destination_port").cast("int").alias("destination_port"), F.col("tcp_flags_count").cast("bigint").alias("tcp_flags_count")).agg(F.count("*").alias("n"))


_PROFILES = "device_id string, protocols array<string>, observations bigint"


@query(f"WITH {PACKETS_SQL} SELECT 'aa:' || device_id AS device_id, array_to_string(list_sort(list(DISTINCT protocol)), ',') AS protocols, CASE WHEN device_id % 3 = 0 THEN 0 ELSE count(*) END AS observations FROM packets WHERE device_id % 5 <> 0 GROUP BY device_id")
def profile_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-23, OP-51a: profiles saved, some saved again, some deleted."""
    folder = new_folder(spark, "profiles")
    rows = packets(spark, sf_dir).groupBy("device_id").agg(F.array_sort(F.collect_set("protocol")).alias("protocols"), F.count("*").alias("observations"))
    named = rows.withColumn("device_id", F.concat(F.lit("aa:"), "device_id"))
    history.save_profiles(named, folder)
    history.save_profiles(named.where("cast(substr(device_id, 4) as int) % 3 = 0").withColumn("observations", F.lit(0).cast("bigint")), folder)
    kept = history.load_profiles(spark, folder, _PROFILES).where("cast(substr(device_id, 4) as int) % 5 <> 0")
    return history.without_device(kept, "aa:none").select("device_id", F.array_join("protocols", ",").alias("protocols"), "observations")


@query(
    f"""WITH {PACKETS_SQL}, f AS (SELECT source_ip, destination_ip, source_port, destination_port, protocol, max(ts) AS last_seen FROM packets GROUP BY ALL)
    SELECT source_ip, destination_ip, last_seen FROM f ORDER BY last_seen, source_ip, destination_ip, source_port, destination_port, protocol LIMIT 5"""
)
def oldest_active_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-117."""
    from heronflow.flows import flow_counters

    return history.oldest_active(flow_counters(packets(spark, sf_dir))).select("source_ip", "destination_ip", "last_seen")


@query(f"WITH {PACKETS_SQL} SELECT 0 AS sequence, count(*) AS n, CAST(NULL AS BIGINT) AS bytes FROM packets WHERE large UNION ALL SELECT 1, count(*), CAST(sum(payload_size) AS BIGINT) FROM packets WHERE protocol = 'UDP'")
def alerts_in_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-135: two decoders' alerts, the first one's without a size."""
    rows = packets(spark, sf_dir)
    both = history.concatenated([rows.where("large").select("packet_id"), rows.where("protocol = 'UDP'").select("packet_id", "payload_size")])
    return both.groupBy("sequence").agg(F.count("*").alias("n"), F.sum("payload_size").alias("bytes"))


@query("SELECT o_orderkey % 10 AS k, count(*) AS n, count(*) FILTER (o_orderkey % 7 = 0 OR date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') > 30) AS stale FROM orders GROUP BY ALL")
def stale_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-239."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    updated = F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate"))
    return rows.groupBy((F.col("o_orderkey") % 10).alias("k")).agg(F.count("*").alias("n"), F.count_if(history.is_stale(updated, F.lit("1998-01-01").cast("date"))).alias("stale"))


@query(
    f"""WITH {_HALVES}, {_sql_bins(50, True)}, e AS (SELECT (p + 1e-10) / (SELECT sum(p + 1e-10) FROM sh) AS p, (q + 1e-10) / (SELECT sum(q + 1e-10) FROM sh) AS q FROM sh),
    b AS (SELECT v, 1 AS a, 0 AS c FROM base UNION ALL SELECT v, 0, 1 FROM cur), g AS (SELECT v, sum(a) AS a, sum(c) AS c FROM b GROUP BY v), s AS (SELECT sum(a) OVER (ORDER BY v) AS sa, sum(c) OVER (ORDER BY v) AS sc FROM g)
    SELECT (SELECT {_r("max(abs(sa / (SELECT count(*) FROM base) - sc / (SELECT count(*) FROM cur)))", "d")} FROM s) AS d, (SELECT count(*) FROM base) AS n, (SELECT count(*) FROM cur) AS m,
      {_r("sqrt(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2)", "js")} FROM e"""
)
def prediction_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-165."""
    return rounded(history.prediction_drift(*_halves(spark, sf_dir)))


@query("SELECT name, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT 'price' AS name, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'old', l_quantity FROM lineitem WHERE l_linenumber = 1) GROUP BY name")
def baselines_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-25, OP-167, OP-236: a baseline is replaced by a sample that is large
    enough, and not by one that is not."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    first = rows.where("l_linenumber = 1")
    old = first.select(F.lit("old").alias("name"), F.col("l_quantity").alias("v")).union(first.select(F.lit("price"), F.lit(1.0)))
    changed = history.with_baseline(history.with_baseline(old, rows, "price", "l_extendedprice"), rows.limit(5), "old", "l_extendedprice")
    folder = new_folder(spark, "baselines")
    history.append(changed, folder)
    return spark.read.schema("name string, v double").json(folder).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT event_type AS model, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE ts > TIMESTAMP '2024-01-18' GROUP BY event_type")
def performance_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-169: measurements added in two parts, and the recent ones."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("model"), "value", F.col("ts").cast("string").alias("ts"), "event_id")
    folder = new_folder(spark, "history")
    for part in (0, 1):
        history.append(rows.where(F.col("event_id") % 2 == part), folder)
    back = spark.read.schema("model string, value double, ts string").json(folder).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return history.recent(back, _now(), history.RECENT_DAYS["history"]).groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(f"WITH {FLOWS_SQL} SELECT CASE WHEN packets_sent % 2 = 0 THEN 'size+time' ELSE 'size' END AS models, 'absent' AS failed, count(*) AS n, {_r('max(greatest(least(1.0, bytes_sent / 1e5), CASE WHEN packets_sent % 2 = 0 THEN least(1.0, duration_ms / 2e5) ELSE 0 END))', 'batch')} FROM flows GROUP BY packets_sent % 2 = 0")
def ensemble_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-99, OP-222, OP-232: three models, of which one can't be used, and the
    greatest score of a batch."""
    capped = lambda c: F.least(F.lit(1.0), c)
    models = {
        "size": lambda df: capped(F.col("bytes_sent") / 1e5),
        "absent": lambda df: df["no_such_column"],
        "time": lambda df: F.when(F.col("packets_sent") % 2 == 0, capped(F.col("duration_ms") / 2e5)),
    }
    chosen = ensemble.chosen_models({k: "1.0.0" for k in models}, {"time": "1.1.0", "new": "0.1.0"})
    scored = ensemble.predictions(flows(spark, sf_dir), {k: models[k] for k in chosen})
    rows = scored.select(F.array_join(F.col("ml_predictions")["model_name"], "+").alias("models"), F.array_join("failed_models", "+").alias("failed"), F.array_max(F.col("ml_predictions")["anomaly_score"]).alias("anomaly_score"))
    n = rows.groupBy("models", "failed").agg(F.count("*").alias("n"))
    batch = ensemble.batch_score(rows, ["models", "failed"]).withColumnRenamed("anomaly_score", "batch")
    return rounded(n.join(batch, ["models", "failed"]))


@query(f"WITH {FLOWS_SQL} SELECT count(*) AS n, count(*) FILTER ((CAST(bytes_sent > 50000 AS INT) + CAST(packets_sent > 25 AS INT) + CAST(duration_ms > 60000 AS INT)) / 3 >= 0.5) AS positive FROM flows")
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-75."""
    one = evaluate.vote([F.col("bytes_sent") > 50000, F.col("packets_sent") > 25, F.col("duration_ms") > 60000])
    return flows(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(one == 1).alias("positive"))


_FOREST_COLUMNS = ["bytes_sent", "bytes_received", "packets_sent", "duration_ms"]


def _ensemble_sql(trees: int) -> str:
    parts, votes = [], []
    for k, (c, _, rows, share) in enumerate(ensemble.CONFIGURATIONS):
        mine = ensemble.columns_of(_FOREST_COLUMNS, share, k)
        parts.append(forest_sql(f"f{k}", mine, trees, round(rows * ensemble.TREE_ROWS), 42 + k))
        votes.append(f"CAST(f{k}_score.score >= (SELECT quantile_cont(score, {1 - c!r}) FROM f{k}_score) AS INT)")
    joined = "f0_score " + " ".join(f"JOIN f{k}_score USING (copy)" for k in range(1, len(votes)))
    return f"WITH {FLOWS_SQL}, {', '.join(parts)} SELECT count(*) AS n, count(*) FILTER (({' + '.join(votes)}) / {len(votes)} >= 0.5) AS anomalies, true AS restored, 1.0::DOUBLE AS importance FROM {joined}"


@query(_ensemble_sql(10))
def forest_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-223, OP-259: five forests vote; one is saved and loaded again."""
    rows = flows(spark, sf_dir).select("flow_id", *_FOREST_COLUMNS)
    made = ensemble.forests(rows, "flow_id", _FOREST_COLUMNS, trees=10)
    folder = new_folder(spark, "forest")
    ensemble.save_forest(made[0][2], made[0][1], folder)
    names, nodes = ensemble.load_forest(spark, folder)
    voted = ensemble.majority(rows, [(made[0][0], names, nodes), *made[1:]])
    share = ensemble.importance(nodes, names).agg(F.round(F.sum("importance"), 6).alias("importance"))
    return voted.agg(F.count("*").alias("n"), F.count_if(F.col("is_anomaly") == 1).alias("anomalies")).withColumn("restored", F.lit(names == made[0][1])).crossJoin(share)


@query(f"WITH {PACKETS_SQL} SELECT count(*) FILTER (packet_id % 4 = 0 OR packet_id % 9 = 0) AS quarantined, count(*) AS n FROM packets")
def features_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-144: null, infinite and other values that are no numbers."""
    k = F.col("packet_id")
    rows = packets(spark, sf_dir).select(F.when(k % 4 != 0, F.col("payload_size")).alias("a"), F.when(k % 9 == 0, F.element_at(F.array(F.lit(float("inf")), F.lit(float("nan"))), (k % 2 + 1).cast("int"))).otherwise(1.0).alias("b"))
    return rows.agg(F.count_if(preprocess.invalid(["a", "b"])).alias("quarantined"), F.count("*").alias("n"))


@query(
    f"""WITH {_VERSIONS_SQL} SELECT model, version, CASE WHEN model = 'click' AND version = '1.10.0' THEN 'production' WHEN model IN ('click', 'view') AND stage = 'production' THEN 'archived' WHEN model = 'view' AND version = '2.8.0' THEN 'production' ELSE stage END AS stage
    FROM v WHERE NOT (model = 'click' AND version = '0.9.1') UNION ALL SELECT DISTINCT 'new ' || event_type, '0.1.0', 'staging' FROM events"""
)
def registry_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-148, OP-227, OP-228: a promotion, a rollback, a version added, one
    that is taken, one deleted and one that is protected."""
    now = _registry(spark, sf_dir)
    new = now.where("day = 1").select(F.concat(F.lit("new "), "model").alias("model"), F.lit("0.1.0").alias("version"), F.lit("staging").alias("stage"), "day")
    taken = now.where("day = 5").withColumn("stage", F.lit("staging"))
    now = registry.rolled_back(registry.promoted(registry.registered(now, new.union(taken)), "click", "1.10.0"), "view")
    now = registry.without_version(registry.without_version(now, "click", "0.9.1"), "click", "1.10.0")
    return now.select("model", "version", "stage")


@query(f"WITH {_VERSIONS_SQL} SELECT model, count(*) AS versions, count(*) FILTER (stage = 'production') AS in_production, count(*) FILTER (day % 2 = 0) AS missing, count(*) FILTER (split_part(version, '.', 1) = '2') AS compatible FROM v GROUP BY model")
def registry_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-226, OP-229 to OP-231: a registry file read back, what its artifacts
    lack, and which versions go with 2.3.4."""
    rows = _registry(spark, sf_dir).withColumn("artifact", F.format_string("a%d", "day"))
    entry = F.struct("stage", "artifact", F.map_from_arrays(F.array(F.lit("day")), F.array(F.col("day").cast("double"))).alias("metrics"))
    versions = rows.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("version", entry))).alias("versions"))
    folder = new_folder(spark, "registry")
    versions.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("model", "versions")))).alias("value")).coalesce(1).write.text(folder)
    back = registry.load(spark, folder)
    gone = registry.missing_artifacts(back, rows.where("day % 2 <> 0").select(F.col("artifact").alias("path"))).groupBy("model").agg(F.count("*").alias("missing"))
    fits = back.groupBy("model").agg(F.count_if(ranking.compatible(F.col("version"), F.lit("2.3.4"))).alias("compatible"))
    return registry.health(back).join(gone, "model", "left").join(fits, "model").select("model", "versions", "in_production", F.coalesce("missing", F.lit(0)).alias("missing"), "compatible")


@query("SELECT CASE user_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'rolled_back' ELSE 'running' END AS x, count(*) AS n FROM events GROUP BY ALL")
def deployment_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-233."""
    status = F.element_at(F.array(*map(F.lit, ("completed", "failed", "rolled_back", "running"))), (F.col("user_id") % 4 + 1).cast("int"))
    one = registry.deployment_counters(spark.read.parquet(f"{sf_dir}/events.parquet").select(status.alias("status")))
    known = ["completed", "failed", "rolled_back"]
    every = one.withColumn("running", F.col("total") - sum((F.col(c) for c in known[1:]), F.col(known[0]))).drop("total")
    return every.unpivot([], [*known, "running"], "x", "n").where("n > 0")


@query("SELECT CASE WHEN value / 40 >= 10 THEN 'CRITICAL' WHEN value / 40 >= 5 THEN 'HIGH' WHEN value / 40 >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN value / 1000 < 0.1 THEN 'stable' WHEN value / 1000 < 0.2 THEN 'moderate' ELSE 'significant' END AS band, count(*) AS n FROM events GROUP BY ALL")
def drift_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-168, OP-170."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.groupBy(drift.severity(F.col("value"), 40.0).alias("severity"), drift.psi_band(F.col("value") / 1000).alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH s AS (SELECT event_id, value / 1000 AS rate, user_id % 100 AS kept, 100 AS seen, event_id % 120 AS since FROM events) SELECT event_id, {_r('CASE WHEN since >= 60 AND abs(kept / seen - rate) > 0.05 THEN greatest(0.01, least(1.0, rate + (rate - kept / seen) * 0.1)) ELSE rate END', 'rate')} FROM s")
def sampling_rate_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-196."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rate = streams.adjusted_rate(F.col("value") / 1000, F.col("user_id") % 100, F.lit(100), F.col("event_id") % 120)
    return rounded(rows.select("event_id", rate.alias("rate")))


@query("SELECT CASE event_type WHEN 'click' THEN 'network_flow' WHEN 'view' THEN 'threat_detection' ELSE event_type END AS event_type, count(*) AS n, CAST(coalesce(sum(CASE WHEN event_type = 'click' THEN event_id END), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN 2 END), 0) AS BIGINT) AS priorities, count(*) AS stamped FROM events GROUP BY event_type")
def events_entered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-244: each kind of event with its own columns."""
    kind = F.when(F.col("event_type") == "click", "network_flow").when(F.col("event_type") == "view", "threat_detection").otherwise(F.col("event_type"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(kind.alias("event_type"), F.lit("high").alias("severity"), F.col("event_id").alias("bytes_sent"), *(F.lit(0).cast("bigint").alias(c) for c in ("bytes_received", "packets_sent", "packets_received", "duration_ms")), F.lit(1).alias("source_port"), F.lit(80).alias("destination_port"))
    out = enrich.entered(rows, _now(), "main")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes_total"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("alert_priority"), F.lit(0)).cast("bigint").alias("priorities"), F.count_if((F.col("pipeline_name") == "main") & F.col("processed_at").isNotNull()).alias("stamped"))


@query(f"WITH {FLOWS_SQL} SELECT flow_id, bytes_sent, protocol, ts FROM flows WHERE device_id % 10 = 0")
def protobuf_like_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-257: flows to a nested message with milliseconds, and back."""
    rows = flows(spark, sf_dir).where("device_id % 10 = 0")
    sent = rows.select(F.to_json(F.struct("flow_id", F.struct("bytes_sent", "protocol").alias("body"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("timestamp_ms"))).alias("m"))
    back = sent.select(F.from_json("m", "flow_id string, body struct<bytes_sent:bigint,protocol:string>, timestamp_ms bigint").alias("m"))
    return back.select("m.flow_id", "m.body.bytes_sent", "m.body.protocol", F.timestamp_millis("m.timestamp_ms").cast("timestamp_ntz").alias("ts"))
