"""Declarative signature rules compiled to Columns (OP-46 to OP-48, OP-90s)."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def condition(field: str, operator: str, value: Any, columns: list[str]) -> Column:
    """One comparison. A falsy field, operator or value, a missing or null
    field and an unknown operator never match."""
    if not field or not operator or not value or field not in columns:
        return F.lit(False)
    c = F.col(field)
    made = {
        "eq": lambda: c == value,
        "ne": lambda: c != value,
        "gt": lambda: c > value,
        "lt": lambda: c < value,
        "gte": lambda: c >= value,
        "lte": lambda: c <= value,
        "in": lambda: c.isin(*value),
        "contains": lambda: F.lower(c.cast("string")).contains(str(value).lower()),
        "regex": lambda: c.cast("string").rlike(str(value)),
    }.get(operator)
    return F.coalesce(made(), F.lit(False)) if made else F.lit(False)


def matches(rule: dict, columns: list[str]) -> Column:
    """All conditions hold; a rule without conditions never matches."""
    conditions = [condition(c.get("field", ""), c.get("operator", ""), c.get("value"), columns) for c in rule.get("conditions", [])]
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(False)


def active(rules: list[dict], enabled: set[str] | None = None) -> list[dict]:
    """Rules that take part; an empty set enables all. Done before planning."""
    return [r for r in rules if (not enabled or r["id"] in enabled) and r.get("enabled", True)]


_MATCHES = "array<struct<rule_id:string,rule_name:string,signature_score:double>>"


def _weight(rule: dict) -> float:
    return min(float(rule.get("weight") or 1.0), 1.0)


def match_flags(rules: list[dict], columns: list[str]) -> dict[str, Column]:
    """A boolean column for each rule, ``matched_<id>``."""
    return {f"matched_{r['id']}": matches(r, columns) for r in rules}


def matches_of_flags(rules: list[dict]) -> Column:
    """array<struct<rule_id, rule_name, signature_score>> in rule order, from
    the flags; joined arrays, which stay in generated code."""
    found = [
        F.when(F.col(f"matched_{r['id']}"), F.array(F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r.get("name") or f"Rule {r['id']}").alias("rule_name"), F.lit(_weight(r)).alias("signature_score")))).otherwise(
            F.array().cast(_MATCHES)
        )
        for r in rules
    ]
    return F.concat(*found) if found else F.array().cast(_MATCHES)


def count_and_top(rules: list[dict]) -> tuple[Column, Column]:
    """How many rules match, and the greatest weight among them, by the flags."""
    flags = [F.col(f"matched_{r['id']}") for r in rules]
    n = sum((f.cast("int") for f in flags), F.lit(0))
    nothing = F.lit(None).cast("double")
    return n, F.greatest(*(F.when(f, F.lit(_weight(r))) for f, r in zip(flags, rules, strict=True)), nothing, nothing)
