"""Operator 5: quality rules with verdicts by host. DataFrame functions only.

Each document gets counts of its whole text and fails the base rules if it has
under 50 words or if over half of its words stand in three-word windows that
occur twice or more in it. Softer rules (:data:`RULES`) have limits that depend
on the host (``source``). A document is suspect if it breaks a base rule or a
softer one at its plain limit. Of each host, the documents are counted that break
a base rule, and those that break each softer rule. Each of these shares is
shrunk towards that of all hosts: a beta prior is fitted to the hosts' shares by
the method of moments, and the posterior mean over the prior's mean is the host's
verdict in that rule, its ``strictness``, between 1 / :data:`RANGE` and
:data:`RANGE`. The limit of a softer rule is divided by the host's strictness in
that rule, or by that in the base rules where that is above one and greater: on a
host that breaks a rule twice as often as hosts do, half as much is let pass of
it, on a good one more, and what a host does well in one rule makes up for
nothing in another. A document is rejected if it fails a base rule, or a softer
rule at its host's limit; a document with nothing to object to stays whatever its
host.

All that is counted of a document comes from its own row, without a shuffle.
Repeated windows are found by sorting the windows' hashes with their places and
comparing neighbours; equal hashes count only if the words are equal too.

Cases: a null text has no words; a null host is a host of its own; with one
host, or hosts that differ by no more than chance would have them differ, every
host has strictness one; an empty table gives an empty result; columns named
like a result are replaced, others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.llm.common import BROADCAST_ROWS, fresh, shared, stored, table, without

MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: Softer rules: symbols a hundred words, and repeated lines a hundred lines, beyond which a document is suspect.
RULES = {"symbols": 30, "dup_lines": 60}
#: What hosts are judged by, each for itself.
JUDGED = ("base", *RULES)
STRICT = tuple(f"strictness_{r}" for r in JUDGED)
#: How much stricter or milder than the plain limits a host's can get.
RANGE = 2.0
#: Hosts with more than this part of all documents are joined by broadcast, at most so many.
HOT_HOSTS = 2_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, not for each use."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in ``words``."""

    def repeated(w: Column) -> Column:
        rest = F.size(w) - 2
        windows = F.arrays_zip(F.slice(w, 1, rest).alias("a"), F.slice(w, 2, rest).alias("b"), F.slice(w, 3, rest).alias("c"))
        hashed = F.transform(windows, lambda x, k: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), k.alias("k")))

        def marked(s: Column) -> Column:
            # A place counts if its neighbour in the order has the same hash and the same words.
            def same(x: Column, y: Column) -> Column:
                return (x["h"] == y["h"]) & (F.get(w, x["k"]) == F.get(w, y["k"])) & (F.get(w, x["k"] + 1) == F.get(w, y["k"] + 1)) & (F.get(w, x["k"] + 2) == F.get(w, y["k"] + 2))

            pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda x, y: F.when(same(x, y), F.array(x["k"], y["k"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

        places = _let(F.sort_array(hashed), marked)
        # A window covers three words, less those that the next one covers.
        covered = _let(
            places,
            lambda p: F.when(F.size(p) == 0, 0).otherwise(
                3 + F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(F.lit(3), b - a)), F.lit(0), lambda a, b: a + b)
            ),
        )
        return F.when(F.size(w) < 4, 0).otherwise(covered)

    return _let(words, repeated)


def _broken(strictness: dict[str, Column] | None = None) -> dict[str, Column]:
    """Which softer rules are broken at limits that ``strictness`` divides."""
    part = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}
    by = strictness or dict.fromkeys(RULES, F.lit(1))
    return {r: 100 * F.col(n) * by[r] > RULES[r] * F.col(of) for r, (n, of) in part.items()}


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def document_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts, n_lines, base_failed and suspect. Narrow."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_word = _let(words, lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("repeated")))
    by_line = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("repeated")))
    out = without(docs, *COUNTS, "n_lines", "base_failed", "suspect")
    w, x = fresh(out, "_words"), fresh(out, "_lines")
    found = {"n_words": f"{w}.n", "word_chars": f"{w}.chars", "n_symbols": None, "n_dup_lines": f"{x}.repeated", "n_repeat_words": f"{w}.repeated", "n_lines": f"{x}.n"}
    symbols = F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))
    out = out.withColumns({w: by_word, x: by_line, "n_symbols": symbols})
    out = out.withColumns({c: F.col(at or c).cast("bigint") for c, at in found.items()}).drop(w, x)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumns({"base_failed": base, "suspect": base | _any(_broken().values())})


def host_verdicts(ruled: DataFrame, host: str = "source") -> DataFrame:
    """host, n_docs, and for each of :data:`JUDGED` n_<rule>, rate_<rule>
    (shrunk) and strictness_<rule>; one row a host."""
    broken = {"base": F.col("base_failed")} | _broken()
    hosts = ruled.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *(F.count_if(broken[r]).alias(f"n_{r}") for r in JUDGED))
    share = {r: F.col(f"n_{r}") / F.col("n_docs") for r in JUDGED}
    moments = hosts.agg(F.avg(1 / F.col("n_docs")).alias("noise"), *(f(share[r]).alias(f"{name}_{r}") for r in JUDGED for name, f in (("mean", F.avg), ("var", F.var_pop))))
    prior = []
    for r in JUDGED:
        mean = F.col(f"mean_{r}")
        # Moments of a beta-binomial: what the shares vary beyond their sampling noise.
        between = F.col(f"var_{r}") - mean * (1 - mean) * F.col("noise")
        prior += [mean, F.when(between > 0, F.greatest(F.lit(1.0), mean * (1 - mean) / between - 1)).alias(f"weight_{r}")]
    # One row of a few numbers joins every host.
    rows = hosts.join(F.broadcast(moments.select(prior)))
    for r in JUDGED:
        n, mean, weight = (F.col(f"{c}_{r}") for c in ("n", "mean", "weight"))
        rate = F.when(weight.isNull(), mean).otherwise((n + mean * weight) / (F.col("n_docs") + weight))
        strict = F.when(weight.isNull() | (mean == 0), 1.0).otherwise(F.greatest(F.lit(1 / RANGE), F.least(F.lit(RANGE), rate / mean)))
        rows = rows.withColumns({f"rate_{r}": rate, f"strictness_{r}": strict})
    return rows.select("host", "n_docs", *(f"{c}_{r}" for r in JUDGED for c in ("n", "rate", "strictness")))


def quality_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with counts, base_failed, suspect, strictness_<rule> (of the
    host, for each of :data:`JUDGED`) and kept. The rules are run once and their rows stored, as the hosts and the
    documents both need them and they cost far more than to write the texts."""
    ruled = stored(document_rules(docs))
    return _verdict(ruled, host_verdicts(ruled))


def _joined(rows: DataFrame, hosts: DataFrame, host: str) -> DataFrame:
    """``rows`` with the strictness of their host. Few hosts are broadcast; of
    many only those with so many documents that they would fill a task, which
    are at most :data:`HOT_HOSTS`, and the rest is joined by a shuffle."""
    same = F.col("source").eqNullSafe(F.col(host))
    hosts = shared(hosts.select(F.col("host").alias(host), "n_docs", *STRICT))
    if hosts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(hosts.drop("n_docs")), same, "left").drop(host)
    most = (hosts.agg(F.sum("n_docs").alias("n")).first()["n"] or 0) // HOT_HOSTS
    hot, cold = hosts.where(F.col("n_docs") > most).drop("n_docs"), hosts.where(F.col("n_docs") <= most).drop("n_docs")
    busy = rows.join(F.broadcast(hot), same, "inner").drop(host)
    rest = rows.join(F.broadcast(hot.select(host)), same, "left_anti").join(cold, same, "left").drop(host)
    return busy.unionByName(rest)


def _verdict(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    rows = without(rows, *STRICT, "kept")
    out = _joined(rows, hosts, fresh(rows, "_host"))
    base, *own = (F.coalesce(c, F.lit(1.0)) for c in STRICT)
    by = {r: F.when(base > 1, F.greatest(s, base)).otherwise(s) for r, s in zip(RULES, own, strict=True)}
    # One condition: a filter on it is not split, so the rules are not run twice.
    return out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~_any(_broken(by).values())))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = shared(document_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    return _verdict(ruled, host_verdicts(ruled)).select("doc_id", *COUNTS, "base_failed", "kept")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d
), places AS (
  SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM w
), counted AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, ws[i], ws[i + 1], ws[i + 2]) AS n FROM places
), covered AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE n > 1) GROUP BY row
), ruled AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (row)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
    100 * n_symbols > {RULES["symbols"]} * n_words AS symbols, 100 * n_dup_lines > {RULES["dup_lines"]} * n_lines AS dup_lines FROM ruled
), told AS (
  SELECT source AS host, unnest(['base', 'symbols', 'dup_lines']) AS rule, unnest([base_failed, symbols, dup_lines]) AS broken FROM judged
), hosts AS (
  SELECT host, rule, count(*) AS n, count(*) FILTER (broken) AS k FROM told GROUP BY ALL
), moments AS (
  SELECT rule, avg(k / n) AS m, var_pop(k / n) - avg(k / n) * (1 - avg(k / n)) * avg(1 / n) AS b FROM hosts GROUP BY rule
), prior AS (
  SELECT rule, m, CASE WHEN b > 0 THEN greatest(1.0, m * (1 - m) / b - 1) END AS weight FROM moments
), strict AS (
  SELECT host, rule, CASE WHEN weight IS NULL OR m = 0 THEN 1.0 ELSE greatest({1 / RANGE}, least({RANGE}, (k + m * weight) / (n + weight) / m)) END AS s FROM hosts JOIN prior USING (rule)
), by_host AS (
  SELECT host, max(s) FILTER (rule = 'base') AS sb, max(s) FILTER (rule = 'symbols') AS ss, max(s) FILTER (rule = 'dup_lines') AS sd FROM strict GROUP BY host
), limits AS (
  SELECT host, CASE WHEN sb > 1 THEN greatest(ss, sb) ELSE ss END AS ss, CASE WHEN sb > 1 THEN greatest(sd, sb) ELSE sd END AS sd FROM by_host
)
SELECT doc_id, {", ".join(COUNTS)}, base_failed,
  NOT base_failed AND NOT (100 * n_symbols * ss > {RULES["symbols"]} * n_words OR 100 * n_dup_lines * sd > {RULES["dup_lines"]} * n_lines) AS kept
FROM judged JOIN limits ON host IS NOT DISTINCT FROM source
"""
