"""Fusion of rule and model scores into ranked detections (OP-91s to OP-98).

Everything is a projection over flows: no shuffle. ``signature_matches`` and
``ml_predictions`` (array<struct<model_name, anomaly_score>>) are inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Techniques and actions by category and severity.
CATEGORY_TACTICS = {
    "reconnaissance": ["T1046", "T1018"],
    "lateral_movement": ["T1021", "T1570"],
    "exfiltration": ["T1041", "T1048"],
    "dos": ["T1499", "T1498"],
    "malware": ["T1059", "T1055"],
}
SEVERITY_ACTIONS = {
    "CRITICAL": ["Immediately isolate affected device", "Escalate to security team", "Begin incident response procedure"],
    "HIGH": ["Monitor device closely", "Review network logs", "Consider device isolation"],
    "MEDIUM": ["Log for investigation", "Monitor for pattern escalation"],
}
CATEGORY_ACTIONS = {
    "reconnaissance": ["Review firewall rules", "Check for unauthorized scanning"],
    "lateral_movement": ["Audit network segmentation", "Review access controls"],
    "exfiltration": ["Monitor data flows", "Check for data loss prevention alerts"],
    "dos": ["Implement rate limiting", "Check network capacity"],
    "malware": ["Run antivirus scan", "Check for indicators of compromise"],
}
BANDS = {"LOW": (0.0, 0.3), "MEDIUM": (0.3, 0.6), "HIGH": (0.6, 0.9), "CRITICAL": (0.9, 1.0)}


def _scores(column: str, field: str) -> Column:
    return F.col(column)[field]


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _lookup(table: dict[str, list[str]], key: Column) -> Column:
    """The texts of a key; comparisons of literals stay in generated code."""
    out = None
    for k, texts in table.items():
        found = F.array(*map(F.lit, texts))
        out = F.when(key == k, found) if out is None else out.when(key == k, found)
    return _nothing() if out is None else out.otherwise(_nothing())


def evidence(n_signature: Column, top_signature: Column, scores: list[Column]) -> dict[str, Column]:
    """The columns that :func:`fused` works with, for a known list of models:
    sums and greatest values of plain columns, so no array is walked."""
    n = len(scores)
    mean = sum(scores[1:], scores[0]) / n if n else F.lit(0.0)
    squares = [F.pow(s - mean, 2) for s in scores]
    return {
        "n_signature": n_signature,
        "top_signature": top_signature,
        "n_ml": F.lit(n),
        "ml_score": mean,
        "ml_spread": F.sqrt(sum(squares[1:], squares[0]) / n) if n else F.lit(None).cast("double"),
        "top_ml": F.greatest(*scores) if n > 1 else scores[0] if n else F.lit(None).cast("double"),
    }


EVIDENCE = ("n_signature", "top_signature", "n_ml", "ml_score", "ml_spread", "top_ml")


def evidence_of_arrays(df: DataFrame) -> DataFrame:
    """The same from signature_matches and ml_predictions of any length."""
    ml = _scores("ml_predictions", "anomaly_score")
    df = df.withColumns(
        {
            "n_signature": F.size("signature_matches"),
            "top_signature": F.array_max(_scores("signature_matches", "signature_score")),
            "n_ml": F.size("ml_predictions"),
            "ml_score": F.coalesce(_mean(ml), F.lit(0.0)),
            "top_ml": F.array_max(ml),
        }
    )
    return df.withColumn("ml_spread", F.sqrt(_mean(F.transform(ml, lambda x: F.pow(x - F.col("ml_score"), 2)))))


def fused(df: DataFrame, signature_weight: float = 0.6, ml_weight: float = 0.4) -> DataFrame:
    """Adds signature_score, ml_score, threat_score, confidence, severity. Each
    step is a projection of its own, so it is worked out once a row."""
    total = signature_weight + ml_weight
    if not set(EVIDENCE) <= set(df.columns):
        df = evidence_of_arrays(df)
    n_signature = F.col("n_signature")
    df = df.withColumn("signature_score", F.when(n_signature > 0, F.least(F.lit(1.0), F.col("top_signature") + F.least(F.lit(0.2), (n_signature - 1) * 0.05))).otherwise(0.0))
    score = F.col("signature_score") * (signature_weight / total) + F.col("ml_score") * (ml_weight / total)
    df = df.withColumn("threat_score", F.least(F.lit(1.0), score))
    confidence = (
        F.lit(0.5)
        + F.least(F.lit(0.3), 0.1 * n_signature)
        + F.when(F.col("n_ml") > 1, F.greatest(F.lit(0.0), 0.2 - F.col("ml_spread"))).otherwise(0.0)
        + F.when((F.col("threat_score") > 0.8) | (F.col("threat_score") < 0.2), 0.1).otherwise(0.0)
    )
    df = df.withColumn("confidence", F.least(F.lit(1.0), confidence))
    factor = 0.8 + 0.2 * F.col("confidence")
    s = F.col("threat_score")
    return df.withColumn("severity", F.when(s >= 0.8 * factor, "CRITICAL").when(s >= 0.6 * factor, "HIGH").when(s >= 0.3 * factor, "MEDIUM").otherwise("LOW"))


def worth_reporting(require_both: bool = False) -> Column:
    """Some evidence, and not both LOW and under 0.6 confidence (OP-49)."""
    signature, ml = F.col("n_signature") > 0, F.col("n_ml") > 0
    return (signature & ml if require_both else signature | ml) & ~((F.col("severity") == "LOW") & (F.col("confidence") < 0.6))


FUSED = ("signature_score", "threat_score", "confidence", "severity")


def reported(df: DataFrame, require_both: bool = False) -> DataFrame:
    """Each fused flow gives one detection or none. Written as a flat map and
    not as a filter: Spark would copy the whole chain of scores into a filter's
    condition, and into that of each later one."""
    one = F.array(F.struct(*FUSED, is_consistent().alias("is_consistent")))
    rest = [c for c in df.columns if c not in FUSED]
    return df.select(*rest, F.inline(F.when(worth_reporting(require_both), one)))


def classified(df: DataFrame, categories: dict[str, str], tactics: dict[str, list[str]] | None = None, actions: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds attack_category (of the first match that has one, else by the
    highest model score), mitre_tactics and recommended_actions, both sorted."""
    rule_ids = _scores("signature_matches", "rule_id")
    places = [F.when(F.array_contains(rule_ids, r), F.struct(F.array_position(rule_ids, r).alias("at"), F.lit(c).alias("category"))) for r, c in categories.items()]
    nothing = F.lit(None).cast("struct<at:bigint,category:string>")
    from_rules = F.least(*places, nothing, nothing)["category"]
    top = F.col("top_ml")
    from_ml = F.when(top > 0.8, "malware").when(top > 0.6, "lateral_movement").when(top.isNotNull(), "reconnaissance")
    df = df.withColumn("attack_category", F.coalesce(from_rules, from_ml, F.lit("unknown")))
    category = F.col("attack_category")

    def of_rules(table: dict[str, list[str]] | None) -> list[Column]:
        return [F.when(F.array_contains(rule_ids, r), F.array(*map(F.lit, texts))).otherwise(_nothing()) for r, texts in (table or {}).items()]

    return df.withColumns(
        {
            "mitre_tactics": F.sort_array(F.array_distinct(F.concat(_lookup(CATEGORY_TACTICS, category), *of_rules(tactics)))),
            "recommended_actions": F.sort_array(F.array_distinct(F.concat(_lookup(SEVERITY_ACTIONS, F.col("severity")), _lookup(CATEGORY_ACTIONS, category), *of_rules(actions)))),
        }
    )


def is_consistent() -> Column:
    """OP-94: evidence, a score inside its severity's band, and at most 0.8
    confidence on one piece of evidence. The original drops other rows
    silently; here the caller decides."""
    score = F.col("threat_score")
    band = F.lit(False)
    for severity, (low, high) in BANDS.items():
        band = band | ((F.col("severity") == severity) & score.between(low, high))
    pieces = F.col("n_signature") + F.col("n_ml")
    return (pieces > 0) & band & ~((pieces == 1) & (F.col("confidence") > 0.8))


def detections(flows: DataFrame, categories: dict[str, str], strict: bool = True, tactics=None, actions=None) -> DataFrame:
    """Flows with matches and predictions to detections, one row a flow at most."""
    out = reported(fused(flows))
    return classified(out.where("is_consistent") if strict else out, categories, tactics, actions)


def accessors(df: DataFrame) -> DataFrame:
    """OP-98 and OP-51b: summaries and predicates of a detection."""
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "max_signature_score": F.coalesce(F.array_max(_scores("signature_matches", "signature_score")), zero),
            "max_ml_score": F.coalesce(F.array_max(_scores("ml_predictions", "anomaly_score")), zero),
            "model_names": _scores("ml_predictions", "model_name"),
            "rule_ids": _scores("signature_matches", "rule_id"),
            "is_high_confidence": F.col("confidence") >= 0.8,
            "requires_immediate_action": (F.col("severity") == "CRITICAL") | ((F.col("severity") == "HIGH") & (F.col("confidence") >= 0.9)),
        }
    )
