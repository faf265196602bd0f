"""Queries of mergeable sketches, captures, prefixes, feature selection and
sequence models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow import drift, sketches
from heronflow.ml import select, sequence
from heronflow.operators import prefixes
from heronflow.plans.catalog import query
from heronflow.plans.feature_queries import _r, rounded
from heronflow.sources import pcap
from heronflow.sources.checkpoints import new_folder
from heronflow.sources.fixtures import PACKETS_SQL, packets

_P, _M = 10, 1024


@query(
    f"""WITH {PACKETS_SQL}, d AS (SELECT CAST(ts AS DATE) + CAST(unnest(range(7)) AS INT) AS day, protocol, device_id, md5(CAST(device_id AS VARCHAR)) AS h FROM packets),
    regs AS (SELECT day, protocol, ('0x' || substr(h, 1, 8))::BIGINT >> {32 - _P} AS register, max(CASE WHEN ('0x' || substr(h, 9, 8))::BIGINT = 0 THEN 33 ELSE 33 - length(bin(('0x' || substr(h, 9, 8))::BIGINT)) END) AS rank FROM d GROUP BY ALL),
    s AS (SELECT day, protocol, count(*) AS r, {0.7213 / (1 + 1.079 / _M) * _M * _M!r} / (sum(pow(0.5, rank)) + {_M} - count(*)) AS raw FROM regs GROUP BY ALL)
    SELECT day, protocol, {_r(f"CASE WHEN raw <= {2.5 * _M} AND r < {_M} THEN {_M} * ln({float(_M)} / ({_M} - r)) ELSE raw END", "estimate")}, exact
    FROM s JOIN (SELECT day, protocol, count(DISTINCT device_id) AS exact FROM d GROUP BY ALL) USING (day, protocol)"""
)
def hll_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-187: devices by protocol over the last seven days, from the sketches of
    single days; the SQL takes each window from the raw rows."""
    rows = packets(spark, sf_dir).withColumn("day", F.to_date("ts"))
    days = sketches.hll_registers(rows, ["day", "protocol"], "device_id", _P)
    estimate = sketches.hll_estimates(sketches.hll_sliding(days, "day", ["protocol"], 7), ["day", "protocol"], _P)
    seen = rows.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(6)))).select(F.date_add("day", F.col("d")).alias("day"), "protocol", "device_id")
    exact = seen.groupBy("day", "protocol").agg(F.count_distinct("device_id").alias("exact"))
    return rounded(estimate.join(exact, ["day", "protocol"]))


_COLUMNS = ["payload_size", "destination_port", "device_id"]


@query(
    f"""WITH {PACKETS_SQL}, v AS (SELECT unnest([{", ".join(f"{{'column': '{c}', 'v': CAST({c} AS DOUBLE)}}" for c in _COLUMNS)}], recursive := true), ts < TIMESTAMP '2024-01-12' AS base FROM packets),
    c AS (SELECT "column", v, count(*) FILTER (base) AS a, count(*) FILTER (NOT base) AS b FROM v GROUP BY ALL),
    d AS (SELECT "column", abs(sum(a) OVER w / sum(a) OVER t - sum(b) OVER w / sum(b) OVER t) AS d FROM c WINDOW w AS (PARTITION BY "column" ORDER BY v), t AS (PARTITION BY "column"))
    SELECT "column", {_r("max(d)", "exact")}, true AS within FROM d GROUP BY "column\""""
)
def drift_from_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-160, OP-166: the KS distance of two periods, exactly, and if the one
    from the united sketches of single days is within its error."""
    rows = packets(spark, sf_dir).withColumns({"day": F.to_date("ts"), "base": F.col("ts") < F.expr("timestamp_ntz'2024-01-12'")})
    days = drift.quantile_sketches(rows, _COLUMNS, ["day", "base"])
    both = [drift.united(days.where(c)) for c in ("base", "not base")]
    estimate = drift.sketch_ks(*both)
    exact = None
    for c in _COLUMNS:
        one = drift.ks_distance(*(rows.where(s).select(F.col(c).alias("v")) for s in ("base", "not base"))).select(F.lit(c).alias("column"), F.col("d").alias("exact"))
        exact = exact.union(one) if exact is not None else one
    return rounded(exact.join(estimate, "column").select("column", "exact", (F.abs(F.col("d") - F.col("exact")) <= F.col("error")).alias("within")))


@query(f"WITH {PACKETS_SQL} SELECT destination_ip, count(*) AS n, true AS within FROM packets GROUP BY 1 HAVING count(*) > 0.01 * (SELECT count(*) FROM packets)")
def heavy_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-118, OP-190: every destination of over one in a hundred packets, with
    counters for twice as many; if its bounds hold its count."""
    found = sketches.heavy_hitters(packets(spark, sf_dir), "destination_ip", 0.01)
    return found.select("destination_ip", "n", F.col("n").between(F.col("low"), F.col("high")).alias("within"))


@query(f"WITH {PACKETS_SQL} SELECT packet_id, ts, device_id, payload_size FROM packets")
def pcap_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-210, OP-211: packets to capture files, read back in many small ranges."""
    rows = packets(spark, sf_dir)
    body = F.concat_ws("|", "packet_id", "device_id", "payload_size", F.repeat(F.lit("x"), (F.col("payload_size") % 400).cast("int")))
    folder = new_folder(spark, "pcap")
    dealt = rows.select("ts", "packet_id", "device_id", "payload_size").repartition(max(3, spark.sparkContext.defaultParallelism))
    pcap.write_pcap(dealt.select("ts", body.alias("data")), folder)
    back = pcap.read_pcap(spark, folder, 64 << 10).select("ts", F.split(F.col("data").cast("string"), r"\|").alias("p"))
    return back.select(F.col("p")[0].cast("bigint").alias("packet_id"), "ts", F.col("p")[1].cast("bigint").alias("device_id"), F.col("p")[2].cast("bigint").alias("payload_size"))


_PREFIXES = [("2001:db8::/32", "all"), ("2001:db8:0:1::/64", "lab"), ("2001:db8:0:1::40/122", "rack"), ("2001:db8:0:2::/63", "pair"), ("10.0.0.0/8", "ten"), ("10.0.1.0/24", "office"), ("10.0.1.64/26", "desk"), ("10.0.1.77/32", "printer")]


def _bounds() -> str:
    from ipaddress import ip_network

    rows = []
    for text, place in _PREFIXES:
        net = ip_network(text)
        low, high = int(net[0]), int(net[-1])
        kind = net.version
        rows.append(f"({kind}, {low % 2**80}::HUGEINT, {high % 2**80}::HUGEINT, {net.prefixlen}, '{place}')")
    return ", ".join(rows)


@query(
    f"""WITH p(kind, low, high, len, place) AS (VALUES {_bounds()}), a AS (
      SELECT c_custkey, 6 AS kind, (c_custkey % 5)::HUGEINT * 18446744073709551616 + c_custkey % 200 AS ip FROM customer
      UNION ALL SELECT c_custkey, 4, (10 * 16777216 + c_custkey)::HUGEINT FROM customer)
    SELECT a.kind, coalesce(arg_max(place, len), 'none') AS place, c_custkey FROM a LEFT JOIN p ON p.kind = a.kind AND ip BETWEEN low AND high GROUP BY ALL"""
)
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-90: IPv4 and IPv6 addresses in nested prefixes; the longest counts."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    k = F.col("c_custkey")
    six = keys.select("c_custkey", F.lit(6).alias("kind"), F.concat(F.lit("2001:db8:0:"), F.lower(F.hex(k % 5)), F.lit("::"), F.lower(F.hex(k % 200))).alias("ip"))
    four = keys.select("c_custkey", F.lit(4).alias("kind"), F.concat_ws(".", F.lit("10"), F.expr("(c_custkey div 65536) % 256"), F.expr("(c_custkey div 256) % 256"), k % 256).alias("ip"))
    found = prefixes.longest_prefix_join(six.union(four), "ip", spark.createDataFrame(_PREFIXES, "prefix string, place string"))
    return found.select("kind", F.coalesce("place", F.lit("none")).alias("place"), "c_custkey")


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(
    f"""WITH q AS (SELECT {", ".join(f"quantile_cont(CAST({c} AS DOUBLE), [{', '.join(str(k / 10) for k in range(1, 10))}]) AS {c}" for c in _FEATURES)} FROM lineitem),
    cells AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, len(list_filter(list_distinct(q.{c}), lambda b: b < CAST(l.{c} AS DOUBLE))) AS bin, l_returnflag AS label FROM lineitem l, q" for c in _FEATURES)}),
    n AS (SELECT feature, bin, label, count(*) AS n FROM cells GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, label) AS l FROM n)
    SELECT feature, {_r("sum(n / t * ln(n * t / (b * l)))", "information")} FROM m GROUP BY feature"""
)
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.10: features of line items by what they tell of the return flag."""
    return rounded(select.mutual_information(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _FEATURES, "l_returnflag"))


@query(
    f"""WITH {PACKETS_SQL}, l AS (SELECT payload_size AS y, lag(payload_size) OVER w AS a, lag(payload_size, 2) OVER w AS b FROM packets WINDOW w AS (PARTITION BY device_id ORDER BY ts, packet_id)),
    s AS (SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM l WHERE b IS NOT NULL),
    c AS (SELECT (ya * bb - yb * ab) / (aa * bb - ab * ab) AS w1, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS w2, my, ma, mb FROM s)
    SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(my - w1 * ma - w2 * mb, 2) AS intercept FROM c"""
)
def sequence_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-143: what packet sizes of a device owe to the two before."""
    model = sequence.fit(packets(spark, sf_dir), "payload_size", ["device_id"], ["ts", "packet_id"], 2)
    one = packets(spark, sf_dir).limit(1)
    return one.select(F.round(F.lit(model.weights[0]), 6).alias("w1"), F.round(F.lit(model.weights[1]), 6).alias("w2"), F.round(F.lit(model.intercept), 2).alias("intercept"))
