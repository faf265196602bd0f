"""The driver tables in the shape of the domain: flows and packets.

``flows`` has a row for each line item (its order's customer is the device),
``packets`` one for each event. ``FLOWS_SQL`` and ``PACKETS_SQL`` are the same
as SQL, for use behind WITH.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PORTS = (53, 80, 443, 22, 8080)


def _octets(prefix: str, key: str, parts: int):
    """Dotted address of an integer key, its low bytes last."""
    bytes_ = [F.expr(f"cast(({key} div {256**k}) % 256 as string)") for k in reversed(range(parts))]
    return F.concat_ws(".", F.lit(prefix), *bytes_)


def _port(key: str):
    return F.element_at(F.array(*map(F.lit, PORTS)), F.expr(f"cast({key} % {len(PORTS)} as int) + 1"))


def flows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """``more``: columns of the tables that are carried along."""
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return both.select(
        F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)).alias("flow_id"),
        F.expr("o_orderdate + make_dt_interval(0, l_linenumber)").alias("ts"),
        F.col("o_custkey").alias("device_id"),
        _octets("10", "o_custkey", 3).alias("source_ip"),
        F.when(F.col("l_partkey") % 7 == 0, _octets("10", "l_suppkey", 3)).otherwise(F.concat(F.lit("198.51.100."), (F.col("l_suppkey") % 256).cast("string"))).alias("destination_ip"),
        (1024 + F.col("l_partkey") % 60000).cast("int").alias("source_port"),
        _port("l_partkey").alias("destination_port"),
        F.when(F.col("l_returnflag") == "A", "TCP").when(F.col("l_returnflag") == "N", "UDP").otherwise("ICMP").alias("protocol"),
        F.floor("l_extendedprice").alias("bytes_sent"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount")).alias("bytes_received"),
        F.floor("l_quantity").alias("packets_sent"),
        F.floor(F.col("l_quantity") / 2).alias("packets_received"),
        (F.greatest(F.lit(0), F.datediff("l_shipdate", "o_orderdate")) * 1000).cast("bigint").alias("duration_ms"),
        *more,
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def packets_of(events: DataFrame) -> DataFrame:
    """Also for a stream of events."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    tcp = F.col("event_type").isin("click", "view")
    return rows.select(
        F.col("event_id").alias("packet_id"),
        "ts",
        F.col("user_id").alias("device_id"),
        _octets("10", "user_id", 3).alias("source_ip"),
        F.concat(F.lit("192.0.2."), F.col("k").cast("string")).alias("destination_ip"),
        (1024 + (F.col("user_id") * 7919) % 60000).cast("int").alias("source_port"),
        _port("k").alias("destination_port"),
        F.when(tcp, "TCP").when(F.col("event_type").isin("purchase", "signup"), "UDP").otherwise("ICMP").alias("protocol"),
        F.floor(F.col("value") * 100).alias("payload_size"),
        F.when(tcp, F.when(F.col("k") % 3 == 0, F.array(F.lit("SYN"))).when(F.col("k") % 3 == 1, F.array(F.lit("ACK"))).otherwise(F.array(F.lit("ACK"), F.lit("FIN")))).alias("tcp_flags"),
        F.when(tcp, F.col("event_id") % 97).alias("tcp_sequence_number"),
        (F.col("value") > 250).alias("large"),
    )


_SQL_PORT = "CAST(list_extract([53, 80, 443, 22, 8080], CAST({} % 5 AS INT) + 1) AS INT)"
_SQL_IP = "concat_ws('.', '10', ({0} // 65536) % 256, ({0} // 256) % 256, {0} % 256)"

FLOWS_SQL = f"""flows AS (
  SELECT md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))) AS flow_id,
    o_orderdate + to_hours(l_linenumber) AS ts, o_custkey AS device_id, {_SQL_IP.format("o_custkey")} AS source_ip,
    CASE WHEN l_partkey % 7 = 0 THEN {_SQL_IP.format("l_suppkey")} ELSE '198.51.100.' || (l_suppkey % 256) END AS destination_ip,
    CAST(1024 + l_partkey % 60000 AS INT) AS source_port, {_SQL_PORT.format("l_partkey")} AS destination_port,
    CASE l_returnflag WHEN 'A' THEN 'TCP' WHEN 'N' THEN 'UDP' ELSE 'ICMP' END AS protocol,
    CAST(floor(l_extendedprice) AS BIGINT) AS bytes_sent, CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS bytes_received,
    CAST(floor(l_quantity) AS BIGINT) AS packets_sent, CAST(floor(l_quantity / 2) AS BIGINT) AS packets_received,
    CAST(greatest(0, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) * 1000 AS BIGINT) AS duration_ms
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

PACKETS_SQL = f"""packets AS (
  SELECT event_id AS packet_id, ts, user_id AS device_id, {_SQL_IP.format("user_id")} AS source_ip, '192.0.2.' || k AS destination_ip,
    CAST(1024 + (user_id * 7919) % 60000 AS INT) AS source_port, {_SQL_PORT.format("k")} AS destination_port,
    CASE WHEN event_type IN ('click', 'view') THEN 'TCP' WHEN event_type IN ('purchase', 'signup') THEN 'UDP' ELSE 'ICMP' END AS protocol,
    CAST(floor(value * 100) AS BIGINT) AS payload_size,
    CASE WHEN event_type IN ('click', 'view') THEN CASE k % 3 WHEN 0 THEN ['SYN'] WHEN 1 THEN ['ACK'] ELSE ['ACK', 'FIN'] END END AS tcp_flags,
    CASE WHEN event_type IN ('click', 'view') THEN event_id % 97 END AS tcp_sequence_number, value > 250 AS large
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)"""
