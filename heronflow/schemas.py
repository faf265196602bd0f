"""Record types, and their validation as arrays of violated rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NETWORK_FLOW = (
    "flow_id string, ts timestamp_ntz, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, "
    "bytes_sent bigint, bytes_received bigint, packets_sent bigint, packets_received bigint, duration_ms bigint, inter_arrival_mean_ms double, "
    "inter_arrival_std_ms double, jitter_ms double, tcp_flags array<string>, retransmissions bigint, syn_fin_ratio double"
)
PROTOCOL_METADATA = (
    "protocol string, ts timestamp_ntz, source_ip string, destination_ip string, source_port int, destination_port int, "
    "http_method string, http_uri string, http_user_agent string, http_status_code int, "
    "dns_query string, dns_query_type string, dns_response_code string, dns_answers array<string>, "
    "tls_sni string, tls_ja3_fingerprint string, tls_ja3s_fingerprint string, tls_version string, "
    "tcp_flags array<string>, tcp_window_size int, tcp_sequence_number bigint, payload_size bigint"
)
SIGNATURE_ALERT = (
    "ts timestamp_ntz, rule_id string, rule_name string, severity string, category string, source_ip string, destination_ip string, source_port int, destination_port int, protocol string"
)
RAW_PACKET = "ts timestamp_ntz, length int, data binary, interface string, protocol string, source_ip string, destination_ip string, source_port int, destination_port int"
SIGNATURE_RULE = "id string, name string, weight double, enabled boolean, conditions array<struct<field:string,operator:string,value:string>>"

#: Fixed values.
FLOW_PROTOCOLS = ("TCP", "UDP", "ICMP", "ICMPv6")
TCP_FLAGS = ("SYN", "ACK", "FIN", "RST", "PSH", "URG")
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(\.{OCTET}){{3}}$"
MITRE = r"^T[0-9]{4}(\.[0-9]{3})?$"
MAC = r"^([0-9a-f]{2}:){5}[0-9a-f]{2}$"


def is_ipv6(column: Column) -> Column:
    """IPv6 texts: eight groups of hex digits, or fewer around one ``::``."""
    groups = F.size(F.filter(F.split(column, ":"), lambda g: g != ""))
    well_formed = column.rlike(r"^[0-9A-Fa-f:]+$") & ~column.rlike(r"[0-9A-Fa-f]{5,}|:::") & ~column.rlike(r"(^:[^:])|([^:]:$)")
    short = column.contains("::") & ~column.rlike(r"::.*::") & (groups <= 7)
    return well_formed & (short | (~column.contains("::") & (groups == 8)))


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules (conditions that must hold) that do not."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))


def flow_rules() -> dict[str, Column]:
    address = lambda c: F.col(c).rlike(IPV4) | is_ipv6(F.col(c))
    counters = ("bytes_sent", "bytes_received", "packets_sent", "packets_received", "duration_ms")
    # Upper-cased ICMPV6 is not in the vocabulary, which has ICMPv6.
    return {
        "source_ip": address("source_ip"),
        "destination_ip": address("destination_ip"),
        "protocol": F.upper("protocol").isin(*FLOW_PROTOCOLS),
        "source_port": F.col("source_port").between(0, 65535),
        "destination_port": F.col("destination_port").between(0, 65535),
        "counters": reduce(lambda a, b: a & b, (F.col(c) >= 0 for c in counters)),
    }


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with their violations."""
    checked = df.withColumn("violations", violations(rules))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
