"""Queries of the scoring chain: rules, fusion, classification, strict gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow import detect, rules
from heronflow.plans.catalog import query
from heronflow.sources.fixtures import FLOWS_SQL, flows

RULES = [
    {"id": "R1", "name": "Large upload", "weight": 0.9, "conditions": [{"field": "bytes_sent", "operator": "gt", "value": 80000}]},
    {"id": "R2", "name": "Remote shell port", "weight": 0.6, "conditions": [{"field": "destination_port", "operator": "in", "value": [22, 8080]}]},
    {"id": "R3", "weight": 0.4, "conditions": [{"field": "destination_ip", "operator": "contains", "value": "198.51.100.7"}]},
    {"id": "R4", "name": "Watched range", "weight": 0.75, "conditions": [{"field": "source_ip", "operator": "regex", "value": r"\.1[0-9]$"}, {"field": "protocol", "operator": "ne", "value": "TCP"}]},
    {"id": "R5", "name": "Short and busy", "weight": 2.0, "conditions": [{"field": "duration_ms", "operator": "lte", "value": 90000}, {"field": "packets_sent", "operator": "gte", "value": 45}]},
    {"id": "R6", "name": "Never: falsy value", "weight": 1.0, "conditions": [{"field": "duration_ms", "operator": "gte", "value": 0}]},
    {"id": "R7", "name": "Switched off", "weight": 1.0, "enabled": False, "conditions": [{"field": "protocol", "operator": "eq", "value": "TCP"}]},
]
CATEGORIES = {"R1": "exfiltration", "R2": "lateral_movement", "R5": "dos"}
RULE_TACTICS = {"R1": ["T1567"], "R4": ["T1595.001"]}
RULE_ACTIONS = {"R5": ["Block source for an hour"]}


def scored_flows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Flows with rule matches and two stand-in model scores."""
    rows = flows(spark, sf_dir, *more).withColumn("bytes_total", F.col("bytes_sent") + F.col("bytes_received"))
    stats = rows.agg(F.avg("bytes_total").alias("mean"), F.stddev_samp("bytes_total").alias("std"))
    size = 1 / (1 + F.exp(-(F.col("bytes_total") - F.col("mean")) / F.col("std")))
    rows = rows.crossJoin(F.broadcast(stats)).withColumn("duration_score", F.least(F.lit(1.0), F.col("duration_ms") / F.lit(2_000_000.0)))
    active = rules.active(RULES)
    rows = rows.withColumns(rules.match_flags(active, rows.columns) | {"size_score": size})
    scores = {"size": F.col("size_score"), "duration": F.col("duration_score")}
    predictions = F.array(*(F.struct(F.lit(name).alias("model_name"), s.alias("anomaly_score")) for name, s in scores.items()))
    made = detect.evidence(*rules.count_and_top(active), list(scores.values()))
    rows = rows.withColumns({"signature_matches": rules.matches_of_flags(active), "ml_predictions": predictions} | made)
    return rows.drop("mean", "std", "size_score", *rules.match_flags(active, rows.columns))


_MATCHED = {
    "R1": ("bytes_sent > 80000", 0.9),
    "R2": ("destination_port IN (22, 8080)", 0.6),
    "R3": ("contains(destination_ip, '198.51.100.7')", 0.4),
    "R4": (r"regexp_matches(source_ip, '\.1[0-9]$') AND protocol <> 'TCP'", 0.75),
    "R5": ("duration_ms <= 90000 AND packets_sent >= 45", 1.0),
}
_n = " + ".join(f"CAST({c} AS INT)" for c, _ in _MATCHED.values())
_top = ", ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in _MATCHED.values())
_ids = " || ".join(f"CASE WHEN {c} THEN ['{k}'] ELSE CAST([] AS VARCHAR[]) END" for k, (c, _) in _MATCHED.items())
_map = lambda table, key: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE CAST([] AS VARCHAR[]) END"

#: flows, then scored with every column that a detection has.
SCORED_SQL = f"""{FLOWS_SQL}, stats AS (
  SELECT avg(bytes_sent + bytes_received) AS mean, stddev_samp(bytes_sent + bytes_received) AS std FROM flows
), matched AS (
  SELECT flows.*, {_n} AS n_signature, greatest({_top}) AS top, {_ids} AS rule_ids,
    1 / (1 + exp(-(bytes_sent + bytes_received - mean) / std)) AS m1, least(1.0, duration_ms / 2000000.0) AS m2
  FROM flows, stats
), mixed AS (
  SELECT *, CASE WHEN n_signature > 0 THEN least(1.0, top + least(0.2, (n_signature - 1) * 0.05)) ELSE 0 END AS signature_score, (m1 + m2) / 2 AS ml_score FROM matched
), weighed AS (
  SELECT *, least(1.0, 0.6 * signature_score + 0.4 * ml_score) AS threat_score FROM mixed
), confident AS (
  SELECT *, least(1.0, 0.5 + least(0.3, 0.1 * n_signature) + greatest(0.0, 0.2 - abs(m1 - m2) / 2)
    + CASE WHEN threat_score > 0.8 OR threat_score < 0.2 THEN 0.1 ELSE 0 END) AS confidence FROM weighed
), ranked AS (
  SELECT *, CASE WHEN threat_score >= 0.8 * (0.8 + 0.2 * confidence) THEN 'CRITICAL' WHEN threat_score >= 0.6 * (0.8 + 0.2 * confidence) THEN 'HIGH'
    WHEN threat_score >= 0.3 * (0.8 + 0.2 * confidence) THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM confident
), reported AS (
  SELECT *, CASE WHEN list_contains(rule_ids, 'R1') THEN 'exfiltration' WHEN list_contains(rule_ids, 'R2') THEN 'lateral_movement' WHEN list_contains(rule_ids, 'R5') THEN 'dos'
    WHEN greatest(m1, m2) > 0.8 THEN 'malware' WHEN greatest(m1, m2) > 0.6 THEN 'lateral_movement' ELSE 'reconnaissance' END AS attack_category
  FROM ranked WHERE NOT (severity = 'LOW' AND confidence < 0.6)
), scored AS (
  SELECT *, list_sort(list_distinct({_map(detect.CATEGORY_TACTICS, "attack_category")} || CASE WHEN list_contains(rule_ids, 'R1') THEN ['T1567'] ELSE [] END
      || CASE WHEN list_contains(rule_ids, 'R4') THEN ['T1595.001'] ELSE [] END)) AS mitre_tactics,
    list_sort(list_distinct({_map(detect.SEVERITY_ACTIONS, "severity")} || {_map(detect.CATEGORY_ACTIONS, "attack_category")}
      || CASE WHEN list_contains(rule_ids, 'R5') THEN ['Block source for an hour'] ELSE [] END)) AS recommended_actions,
    (severity = 'LOW' AND threat_score BETWEEN 0 AND 0.3 OR severity = 'MEDIUM' AND threat_score BETWEEN 0.3 AND 0.6
      OR severity = 'HIGH' AND threat_score BETWEEN 0.6 AND 0.9 OR severity = 'CRITICAL' AND threat_score BETWEEN 0.9 AND 1) AS is_consistent
  FROM reported
)"""


def all_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detections(scored_flows(spark, sf_dir), CATEGORIES, strict=False, tactics=RULE_TACTICS, actions=RULE_ACTIONS)


@query(
    f"""WITH {SCORED_SQL} SELECT severity, attack_category, count(*) AS n, round(avg(threat_score), 6) AS avg_score, round(max(confidence), 6) AS max_confidence
    FROM scored WHERE is_consistent GROUP BY ALL"""
)
def score_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: score every flow, gate strictly, count by severity and category."""
    found = detect.detections(scored_flows(spark, sf_dir), CATEGORIES, strict=True)
    return found.groupBy("severity", "attack_category").agg(F.count("*").alias("n"), F.round(F.avg("threat_score"), 6).alias("avg_score"), F.round(F.max("confidence"), 6).alias("max_confidence"))


@query(
    f"""WITH {SCORED_SQL} SELECT flow_id, round(threat_score, 6) AS threat_score, round(confidence, 6) AS confidence, severity, attack_category,
    array_to_string(mitre_tactics, ',') AS mitre_tactics, array_to_string(recommended_actions, ';') AS recommended_actions, is_consistent FROM scored"""
)
def detections_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detection with tactics and actions (OP-90s to OP-97)."""
    return all_detections(spark, sf_dir).select(
        "flow_id",
        F.round("threat_score", 6).alias("threat_score"),
        F.round("confidence", 6).alias("confidence"),
        "severity",
        "attack_category",
        F.array_join("mitre_tactics", ",").alias("mitre_tactics"),
        F.array_join("recommended_actions", ";").alias("recommended_actions"),
        "is_consistent",
    )


@query(f"WITH {SCORED_SQL} SELECT severity, is_consistent, count(*) AS n FROM scored GROUP BY ALL")
def detections_strict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the consistency gate keeps and drops, by severity (OP-94)."""
    return all_detections(spark, sf_dir).groupBy("severity", "is_consistent").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SCORED_SQL} SELECT flow_id, CAST(CASE WHEN n_signature > 0 THEN top ELSE 0 END AS DOUBLE) AS max_signature_score, round(greatest(m1, m2), 6) AS max_ml_score,
    array_to_string(rule_ids, ',') AS rule_ids, 'size,duration' AS model_names, confidence >= 0.8 AS is_high_confidence,
    severity = 'CRITICAL' OR (severity = 'HIGH' AND confidence >= 0.9) AS requires_immediate_action FROM scored"""
)
def detection_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.accessors(all_detections(spark, sf_dir))
    return out.select(
        "flow_id",
        F.round("max_signature_score", 6).alias("max_signature_score"),
        F.round("max_ml_score", 6).alias("max_ml_score"),
        F.array_join("rule_ids", ",").alias("rule_ids"),
        F.array_join("model_names", ",").alias("model_names"),
        "is_high_confidence",
        "requires_immediate_action",
    )


_OPERATORS = {
    "op_eq": ("protocol", "eq", "TCP", "protocol = 'TCP'"),
    "op_ne": ("protocol", "ne", "TCP", "protocol <> 'TCP'"),
    "op_gt": ("bytes_sent", "gt", 50000, "bytes_sent > 50000"),
    "op_lt": ("bytes_sent", "lt", 50000, "bytes_sent < 50000"),
    "op_gte": ("packets_sent", "gte", 25, "packets_sent >= 25"),
    "op_lte": ("packets_sent", "lte", 25, "packets_sent <= 25"),
    "op_in": ("destination_port", "in", [53, 443], "destination_port IN (53, 443)"),
    "op_contains": ("destination_ip", "contains", "00.1", "contains(destination_ip, '00.1')"),
    "op_regex": ("source_ip", "regex", "^10.0.[0-3]", "regexp_matches(source_ip, '^10.0.[0-3]')"),
    "op_falsy": ("duration_ms", "gte", 0, "false"),
    "op_missing": ("no_such_field", "eq", 1, "false"),
    "op_unknown": ("protocol", "like", "T%", "false"),
}


@query(f"WITH {FLOWS_SQL} SELECT flow_id, {', '.join(f'{sql} AS {k}' for k, (_, _, _, sql) in _OPERATORS.items())} FROM flows")
def rule_operator_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column for each rule operator (OP-46)."""
    rows = flows(spark, sf_dir)
    return rows.select("flow_id", *(rules.condition(f, o, v, rows.columns).alias(k) for k, (f, o, v, _) in _OPERATORS.items()))
