"""Longest-prefix match of IPv4 and IPv6 addresses (OP-90)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What IPv4 addresses are mapped to.
MAPPED = "00000000000000000000ffff"


def _v4(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return F.concat(*(F.lpad(F.lower(F.hex(F.try_element_at(parts, F.lit(k)).try_cast("bigint"))), 2, "0") for k in range(1, 5)))


def address_hex(address: Column) -> Column:
    """The 128 bits of an address as 32 hex digits; IPv4 as ::ffff:a.b.c.d, and
    null where it is none."""
    text = F.lower(F.trim(address))
    ok4 = r"((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)"
    tail = F.regexp_extract(text, rf"^.*:({ok4})$", 1)  # an IPv4 address behind the last colon
    plain = F.when(tail != "", F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), F.substring(_v4(tail), 1, 4), F.lit(":"), F.substring(_v4(tail), 5, 4))).otherwise(text)
    halves = F.split(plain, "::", -1)
    groups = lambda half: F.filter(F.split(half, ":", -1), lambda g: g != "")
    left, right = groups(halves[0]), F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    n = F.size(left) + F.size(right)
    gap = F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0)))
    whole = F.array_join(F.transform(F.concat(left, gap, right), lambda g: F.lpad(g, 4, "0")), "")
    single = r"[0-9a-f]{1,4}(:[0-9a-f]{1,4})*"
    good = (F.size(halves) == 1) & (n == 8) & plain.rlike(f"^{single}$") | (F.size(halves) == 2) & (n < 8) & plain.rlike(f"^({single})?::({single})?$")
    return F.when(text.rlike(f"^{ok4}$"), F.concat(F.lit(MAPPED), _v4(text))).when(good, whole)


def _kept(digits: Column, length: Column) -> Column:
    """The first ``length`` bits: whole digits, then what is left of the next."""
    whole, rest = F.floor(length / 4).cast("int"), (length % 4).cast("int")
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    return F.concat(F.substring(digits, F.lit(1), whole), F.when(rest > 0, F.lower(F.hex(F.floor(digit / F.pow(F.lit(2), 4 - rest))))).otherwise(""))


def longest_prefix_join(df: DataFrame, column: str, prefixes: DataFrame, small: int = 200_000) -> DataFrame:
    """Left join of addresses with the longest of ``prefixes`` (prefix as in
    2001:db8::/32, and more columns) that holds them; of equal prefixes the first
    in the order of their other columns counts.

    A prefix is a key of its length and first bits. Distinct addresses give a key
    for each length there is (129 at most), the keys are joined, and the longest
    hit is kept, so nested ranges of any width cost no more than narrow ones.
    """
    carried = [c for c in prefixes.columns if c != "prefix"]
    split = F.split("prefix", "/")
    shift = F.when(split[0].contains(":"), 0).otherwise(96)
    bits = F.coalesce(F.try_element_at(split, F.lit(2)).cast("int") + shift, F.lit(128))
    held = prefixes.select(bits.alias("_len"), _kept(address_hex(split[0]), bits).alias("_key"), F.struct("prefix", *carried).alias("_found"))
    held = held.where("_key is not null").groupBy("_len", "_key").agg(F.min("_found").alias("_found"))
    lengths = sorted(r[0] for r in held.select("_len").distinct().collect())  # 129 at most
    asked = df.select(F.col(column).alias("_address")).distinct().withColumn("_hex", address_hex(F.col("_address"))).where("_hex is not null")
    keys = asked.select("_address", "_hex", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("_len")).withColumn("_key", _kept(F.col("_hex"), F.col("_len")))
    few = held.limit(small + 1).count() <= small
    hits = keys.join(F.broadcast(held) if few else held, ["_len", "_key"])
    best = hits.groupBy("_address").agg(F.max_by("_found", "_len").alias("_found"))
    joined = df.join(best, df[column].eqNullSafe(best["_address"]), "left")
    return joined.select(*df.columns, F.col("_found.prefix").alias("prefix"), *(F.col(f"_found.{c}").alias(c) for c in carried))
