"""Protocol logs to records: tab-separated analyser logs, EVE JSON lines, the
labelled CSV, and raw packets (OP-02 to OP-17). Times are UTC."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow.operators.quantiles import exact_quantiles

EVE = (
    "timestamp string, event_type string, src_ip string, dest_ip string, src_port int, dest_port int, proto string, "
    "flow struct<bytes_toserver:bigint,bytes_toclient:bigint>, tcp struct<syn:boolean,ack:boolean,fin:boolean,rst:boolean,psh:boolean,urg:boolean>, "
    "http struct<http_method:string,url:string,http_user_agent:string,status:int,length:bigint>, "
    "dns struct<rrname:string,rrtype:string,rcode:string,answers:array<struct<rdata:string>>>, "
    "tls struct<version:string,sni:string,ja3:struct<hash:string>,ja3s:struct<hash:string>>, "
    "alert struct<gid:int,signature_id:int,signature:string,severity:string,category:string>"
)
FLAGS = ("syn", "ack", "fin", "rst", "psh", "urg")

#: Columns of the labelled CSV by kind.
CSV_INTEGERS = "src_port dst_port src_bytes dst_bytes missed_bytes src_pkts src_ip_bytes dst_pkts dst_ip_bytes dns_qclass dns_qtype dns_rcode http_trans_depth http_request_body_len http_response_body_len http_status_code label".split()
CSV_BOOLEANS = "dns_AA dns_RD dns_RA dns_rejected ssl_resumed ssl_established weird_notice".split()


def _fields(spark: SparkSession, path: str | list[str], least: int) -> DataFrame:
    """``f``: the tab-separated fields of data lines, '-' as null."""
    lines = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
    split = F.split("value", "\t")
    return lines.select(F.transform(split, lambda x: F.when(x != "-", x)).alias("f"), F.col("_metadata.file_name").alias("file")).where(F.size("f") >= least)


def _at(k: int) -> Column:
    return F.get("f", k)


def _time() -> Column:
    return F.timestamp_micros(F.round(_at(0).try_cast("double") * 1e6).cast("bigint")).cast("timestamp_ntz").alias("ts")


def _ends() -> list[Column]:
    port = lambda k: F.coalesce(_at(k).try_cast("int"), F.lit(0))
    return [_time(), _at(2).alias("source_ip"), port(3).alias("source_port"), _at(4).alias("destination_ip"), port(5).alias("destination_port")]


def conn_log(spark: SparkSession, path: str | list[str], enabled: tuple[str, ...] = ("TCP", "UDP", "ICMP")) -> DataFrame:
    """OP-04: connections; protocols that are not enabled are dropped."""
    size = lambda k: F.coalesce(_at(k).try_cast("bigint"), F.lit(0))
    rows = _fields(spark, path, 10).select(*_ends(), F.upper(_at(6)).alias("protocol"), F.coalesce(_at(8).try_cast("double"), F.lit(0.0)).alias("duration_s"), (size(9) + size(10)).alias("payload_size"))
    return rows.where(F.col("protocol").isin(*enabled))


def http_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """OP-05."""
    uri = F.coalesce(F.concat(_at(8), _at(9)), _at(9))
    return _fields(spark, path, 10).select(*_ends(), F.lit("HTTP").alias("protocol"), _at(7).alias("http_method"), uri.alias("http_uri"), _at(12).alias("http_user_agent"), _at(15).try_cast("int").alias("http_status_code"))


def dns_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """OP-06."""
    return _fields(spark, path, 10).select(*_ends(), F.lit("DNS").alias("protocol"), _at(9).alias("dns_query"), _at(11).alias("dns_query_type"), _at(15).alias("dns_response_code"), F.split(_at(21), ",").alias("dns_answers"))


def ssl_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """OP-07."""
    return _fields(spark, path, 10).select(*_ends(), F.lit("TLS").alias("protocol"), _at(6).alias("tls_version"), _at(9).alias("tls_sni"), _at(16).alias("tls_ja3_fingerprint"), _at(17).alias("tls_ja3s_fingerprint"))


def notice_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """OP-08: alerts, as an output of their own (G8)."""
    return _fields(spark, path, 10).select(*_ends(), _at(8).alias("rule_id"), _at(9).alias("rule_name"), F.lit("medium").alias("severity"))


PARSERS = {"conn": conn_log, "http": http_log, "dns": dns_log, "ssl": ssl_log}


def log_folder(spark: SparkSession, files: list[str]) -> DataFrame:
    """OP-09: each file by the parser of its name, one table; columns that a log
    does not have are null."""
    by: dict[str, list[str]] = {}
    for f in files:
        kind = f.rsplit("/", 1)[-1].split(".")[0]
        if kind in PARSERS:
            by.setdefault(kind, []).append(f)
    parts = [PARSERS[kind](spark, paths) for kind, paths in sorted(by.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def eve_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """OP-10: JSON lines; malformed ones are dropped."""
    rows = spark.read.schema(EVE).option("mode", "DROPMALFORMED").json(path)
    # +0000 and Z are both read as an offset.
    stamp = F.regexp_replace("timestamp", r"([+-]\d\d)(\d\d)$", "$1:$2")
    return rows.withColumn("ts", F.try_to_timestamp(stamp).cast("timestamp_ntz")).where("event_type is not null")


def eve_records(events: DataFrame) -> DataFrame:
    """OP-11 to OP-13: http, dns, tls and flow events as records. DNS events
    keep their transport protocol (G14)."""
    kind = F.col("event_type")
    flags = F.array_compact(F.array(*(F.when(F.col(f"tcp.{f}"), F.lit(f.upper())) for f in FLAGS)))
    answers = F.transform(F.filter("dns.answers", lambda a: a["rdata"].isNotNull()), lambda a: a["rdata"])
    flow_bytes = F.coalesce("flow.bytes_toserver", F.lit(0)) + F.coalesce("flow.bytes_toclient", F.lit(0))
    only = lambda k, c: F.when(kind == k, c)
    return events.where(kind.isin("http", "dns", "tls", "flow")).select(
        F.when(kind == "http", "HTTP").when(kind == "tls", "TLS").otherwise(F.upper("proto")).alias("protocol"),
        "ts",
        F.col("src_ip").alias("source_ip"),
        F.col("dest_ip").alias("destination_ip"),
        F.coalesce("src_port", F.lit(0)).alias("source_port"),
        F.coalesce("dest_port", F.lit(0)).alias("destination_port"),
        only("http", F.col("http.http_method")).alias("http_method"),
        only("http", F.col("http.url")).alias("http_uri"),
        only("http", F.col("http.http_user_agent")).alias("http_user_agent"),
        only("http", F.col("http.status")).alias("http_status_code"),
        only("dns", F.col("dns.rrname")).alias("dns_query"),
        only("dns", F.col("dns.rrtype")).alias("dns_query_type"),
        only("dns", F.col("dns.rcode")).alias("dns_response_code"),
        only("dns", F.coalesce(answers, F.array().cast("array<string>"))).alias("dns_answers"),
        only("tls", F.col("tls.sni")).alias("tls_sni"),
        only("tls", F.col("tls.version")).alias("tls_version"),
        only("tls", F.col("tls.ja3.hash")).alias("tls_ja3_fingerprint"),
        only("tls", F.col("tls.ja3s.hash")).alias("tls_ja3s_fingerprint"),
        F.when((kind == "flow") & (F.size(flags) > 0), flags).alias("tcp_flags"),
        F.when(kind == "flow", flow_bytes).when(kind == "http", F.coalesce("http.length", F.lit(0))).otherwise(0).alias("payload_size"),
    )


def eve_alerts(events: DataFrame) -> DataFrame:
    """OP-14: id ``gid:sid``; the original only logs them."""
    part = lambda c: F.coalesce(F.col(f"alert.{c}"), F.lit(0)).cast("string")
    return events.where("event_type = 'alert'").select(
        "ts",
        F.concat_ws(":", part("gid"), part("signature_id")).alias("rule_id"),
        F.coalesce("alert.signature", F.lit("Unknown")).alias("rule_name"),
        F.coalesce("alert.severity", F.lit("medium")).alias("severity"),
        F.coalesce("alert.category", F.lit("unknown")).alias("category"),
        F.col("src_ip").alias("source_ip"),
        F.col("dest_ip").alias("destination_ip"),
        F.coalesce("src_port", F.lit(0)).alias("source_port"),
        F.coalesce("dest_port", F.lit(0)).alias("destination_port"),
        F.col("proto").alias("protocol"),
    )


def labelled_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """OP-16: '-' and empty are null; numbers and truth values are cast where
    they can be; adds threat_label and is_threat."""
    rows = spark.read.option("header", True).option("nullValue", "-").option("emptyValue", None).csv(path)
    return typed_rows(rows)


def typed_rows(rows: DataFrame) -> DataFrame:
    made = {c: F.when(~F.col(c).isin("-", ""), F.col(c)) for c in rows.columns}
    made |= {c: made[c].try_cast("double").try_cast("bigint") for c in CSV_INTEGERS if c in made}
    made |= {c: F.when(made[c].isNotNull(), F.upper(made[c]).isin("T", "TRUE", "1")) for c in CSV_BOOLEANS if c in made}
    if "duration" in made:
        made["duration"] = made["duration"].try_cast("double")
    out = rows.select(*(c.alias(n) for n, c in made.items()))
    threat = F.coalesce(F.col("label") == 1, F.lit(False))
    return out.withColumns({"threat_label": F.when(threat, F.coalesce("type", F.lit("normal"))).otherwise("normal"), "is_threat": threat})


def filled(df: DataFrame, columns: list[str], median: bool = False) -> DataFrame:
    """OP-17: what is no number becomes 0, or the column's median."""
    numbers = df.withColumns({c: F.col(c).try_cast("double") for c in columns})
    if not median:
        return numbers.fillna(0.0, columns)
    middle = exact_quantiles(numbers, columns, [0.5])
    return numbers.withColumns({c: F.coalesce(F.col(c), F.lit(middle[c][0.5])) for c in columns})


def _number(data: Column, start: int, n: int) -> Column:
    """Big-endian number of n bytes, from ``start`` (0 is the first)."""
    return F.conv(F.hex(F.substring(data, start + 1, n)), 16, 10).cast("int")


def parsed_packets(packets: DataFrame) -> DataFrame:
    """OP-02, OP-03: Ethernet frames (``data``) to protocol, addresses, ports.
    Other IPv4 protocols are ``IP``, other IPv6 ones ``IPv6``; what is neither
    is dropped. Only fixed headers are read, in SQL."""
    data = F.col("data")
    ether = _number(data, 12, 2)
    v4, v6 = ether == 0x0800, ether == 0x86DD
    head = F.when(v4, 14 + (_number(data, 14, 1) % 16) * 4).otherwise(54)
    protocol = F.when(v4, _number(data, 23, 1)).otherwise(_number(data, 20, 1))
    name = F.when(protocol == 6, "TCP").when(protocol == 17, "UDP").when(v4 & (protocol == 1), "ICMP").when(v6 & (protocol == 58), "ICMPv6").when(v4, "IP").otherwise("IPv6")
    dotted = lambda at: F.concat_ws(".", *(_number(data, at + k, 1).cast("string") for k in range(4)))
    colons = lambda at: F.concat_ws(":", *(F.lower(F.hex(F.substring(data, at + 1 + 2 * k, 2))) for k in range(8)))
    port = lambda at: F.when(name.isin("TCP", "UDP"), F.conv(F.hex(F.substring(data, head + at + 1, F.lit(2))), 16, 10).cast("int"))
    return packets.where(v4 | v6).withColumns(
        {
            "length": F.length(data),
            "protocol": name,
            "source_ip": F.when(v4, dotted(26)).otherwise(colons(22)),
            "destination_ip": F.when(v4, dotted(30)).otherwise(colons(38)),
            "source_port": port(0),
            "destination_port": port(2),
        }
    )


def plain_records(packets: DataFrame) -> DataFrame:
    """OP-15: parsed packets as records, fields straight through."""
    return packets.select("protocol", "ts", "source_ip", "destination_ip", "source_port", "destination_port", F.length("data").alias("payload_size"))


def with_fallback(first: Callable[[], DataFrame] | None, second: Callable[[], DataFrame]) -> DataFrame:
    """OP-212: the first decoder's records, or, if there is none or it fails
    when it is set up, the second's. What a first decoder finds is taken even if
    it is nothing."""
    if first is not None:
        try:
            found = first()
            found.schema  # noqa: B018 - analysed here, so that a missing file or column fails here
            return found
        except Exception:  # noqa: BLE001 - the fallback is for any failure
            pass
    return second()
