"""Queries of log and packet sources and of sinks: what is written from the
driver tables in each format is read back and must be the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronflow import enrich
from heronflow.plans.catalog import query
from heronflow.sources import logs, sinks, transport
from heronflow.sources.checkpoints import new_folder
from heronflow.sources.fixtures import PACKETS_SQL, packets


def _ends() -> list[Column]:
    """The fields that every log begins with."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.format_string("%d.%06d", (micros / 1_000_000).cast("bigint"), micros % 1_000_000)
    return [seconds, F.lit("uid"), F.col("source_ip"), F.col("source_port").cast("string"), F.col("destination_ip"), F.col("destination_port").cast("string")]


def _lines(rows: DataFrame, columns: list[Column], path: str) -> str:
    """Tab-separated lines behind a comment; null as a dash."""
    line = F.concat_ws("\t", *(F.coalesce(c, F.lit("-")) for c in columns))
    rows.select(line.alias("value")).union(rows.sparkSession.createDataFrame([("#fields\tts\tuid",), ("too\tshort",), ("",)], "value string")).write.text(path)
    return path


def _dash(n: int) -> list[Column]:
    return [F.lit(None).cast("string")] * n


@query(
    f"""WITH {PACKETS_SQL} SELECT ts, source_ip, destination_ip, destination_port, protocol, CASE WHEN payload_size % 3 = 0 THEN 0 ELSE (payload_size % 1000) / 8 END AS duration_s, payload_size + payload_size // 2 AS payload_size
    FROM packets WHERE protocol IN ('TCP', 'UDP')"""
)
def conn_log_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-04: connections, of enabled protocols."""
    rows = packets(spark, sf_dir)
    size = F.col("payload_size")
    columns = [*_ends(), F.lower("protocol"), F.lit("-"), F.when(size % 3 != 0, ((size % 1000) / 8).cast("string")), size.cast("string"), F.floor(size / 2).cast("string")]
    path = _lines(rows, columns, f"{new_folder(spark, 'logs')}/conn.log")
    return logs.conn_log(spark, path, ("TCP", "UDP")).select("ts", "source_ip", "destination_ip", "destination_port", "protocol", "duration_s", "payload_size")


_KINDS = """SELECT 'HTTP' AS protocol, ts, source_ip, 'GET' AS method_or_type, CASE WHEN packet_id % 2 = 0 THEN 'host' || device_id || '/p' ELSE '/p' END AS name, CASE WHEN packet_id % 5 <> 0 THEN '200' END AS code, '' AS answers FROM packets
    UNION ALL SELECT 'DNS', ts, source_ip, 'A', 'n' || device_id || '.example', 'NOERROR', CASE WHEN packet_id % 3 = 0 THEN '1.1.1.1;' || destination_ip ELSE destination_ip END FROM packets
    UNION ALL SELECT 'TLS', ts, source_ip, 'TLSv12', 's' || device_id || '.example', 'ja3' || (packet_id % 7), '' FROM packets"""


@query(f"WITH {PACKETS_SQL}, k AS ({_KINDS}) SELECT protocol, source_ip, method_or_type, name, code, answers, count(*) AS n, min(ts) AS first_seen FROM k GROUP BY ALL")
def log_folder_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-05, OP-06, OP-07, OP-09: logs of three kinds, each by its parser."""
    rows, folder = packets(spark, sf_dir), new_folder(spark, "logs")
    k = F.col("packet_id")
    http = [*_ends(), F.lit("1"), F.lit("GET"), F.when(k % 2 == 0, F.concat(F.lit("host"), "device_id")), F.lit("/p"), *_dash(2), F.lit("agent"), *_dash(2), F.when(k % 5 != 0, "200")]
    answers = F.when(k % 3 == 0, F.concat(F.lit("1.1.1.1,"), "destination_ip")).otherwise(F.col("destination_ip"))
    dns = [*_ends(), F.lit("udp"), *_dash(2), F.concat(F.lit("n"), "device_id", F.lit(".example")), F.lit("1"), F.lit("A"), *_dash(3), F.lit("NOERROR"), *_dash(5), answers]
    ssl = [*_ends(), F.lit("TLSv12"), *_dash(2), F.concat(F.lit("s"), "device_id", F.lit(".example")), *_dash(6), F.concat(F.lit("ja3"), (k % 7).cast("string")), F.lit("ja3s")]
    files = [_lines(rows, c, f"{folder}/{name}.log") for name, c in (("http", http), ("dns", dns), ("ssl", ssl))]
    found = logs.log_folder(spark, [*files, f"{folder}/weird.log"])
    out = found.select(
        "protocol",
        "source_ip",
        F.coalesce("http_method", "dns_query_type", "tls_version").alias("method_or_type"),
        F.coalesce("http_uri", "dns_query", "tls_sni").alias("name"),
        F.coalesce(F.col("http_status_code").cast("string"), "dns_response_code", "tls_ja3_fingerprint").alias("code"),
        F.coalesce(F.array_join("dns_answers", ";"), F.lit("")).alias("answers"),
        "ts",
    )
    return out.groupBy("protocol", "source_ip", "method_or_type", "name", "code", "answers").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))


@query(f"WITH {PACKETS_SQL} SELECT 'Scan::' || protocol AS rule_id, 'medium' AS severity, count(*) AS n FROM packets GROUP BY protocol")
def notice_log_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-08."""
    columns = [*_ends(), *_dash(2), F.concat(F.lit("Scan::"), "protocol"), F.lit("a scan")]
    path = _lines(packets(spark, sf_dir), columns, f"{new_folder(spark, 'logs')}/notice.log")
    return logs.notice_log(spark, path).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


def _eve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of five kinds as JSON lines, read back; some lines are broken."""
    k = F.col("packet_id")
    some = lambda kind, *c: F.when(F.col("event_type") == kind, F.struct(*c))
    rows = packets(spark, sf_dir).withColumn("event_type", F.element_at(F.array(*map(F.lit, ("flow", "dns", "http", "tls", "alert"))), (k % 5 + 1).cast("int")))
    line = F.to_json(
        F.struct(
            F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+0000")).alias("timestamp"),
            "event_type",
            F.col("source_ip").alias("src_ip"),
            F.col("destination_ip").alias("dest_ip"),
            F.col("source_port").alias("src_port"),
            F.col("destination_port").alias("dest_port"),
            F.lower("protocol").alias("proto"),
            some("flow", F.col("payload_size").alias("bytes_toserver"), F.lit(7).alias("bytes_toclient")).alias("flow"),
            some("flow", F.array_contains("tcp_flags", "SYN").alias("syn"), F.array_contains("tcp_flags", "ACK").alias("ack")).alias("tcp"),
            some("dns", F.lit("q.example").alias("rrname"), F.lit("A").alias("rrtype"), F.array(F.struct(F.col("destination_ip").alias("rdata"))).alias("answers")).alias("dns"),
            some("http", F.lit("GET").alias("http_method"), F.lit("/x").alias("url"), F.col("payload_size").alias("length")).alias("http"),
            some("tls", F.lit("TLS 1.2").alias("version"), F.lit("s.example").alias("sni")).alias("tls"),
            some("alert", F.lit(1).alias("gid"), (k % 9).cast("int").alias("signature_id"), F.lit("odd").alias("signature"), F.lit("high").alias("severity")).alias("alert"),
        )
    )
    path = f"{new_folder(spark, 'logs')}/eve.json"
    rows.select(F.explode(F.array(line, F.lit("{broken"))).alias("value")).write.text(path)
    return logs.eve_events(spark, path)


@query(
    f"""WITH {PACKETS_SQL} SELECT ts, CASE packet_id % 5 WHEN 2 THEN 'HTTP' WHEN 3 THEN 'TLS' ELSE protocol END AS protocol, source_ip, source_port, CASE packet_id % 5 WHEN 0 THEN payload_size + 7 WHEN 2 THEN payload_size ELSE 0 END AS payload_size,
    CASE packet_id % 5 WHEN 1 THEN 'q.example' WHEN 2 THEN '/x' WHEN 3 THEN 's.example' END AS name, CASE WHEN packet_id % 5 = 1 THEN destination_ip ELSE '' END AS answers,
    coalesce(CASE WHEN packet_id % 5 = 0 THEN array_to_string([f FOR f IN ['SYN', 'ACK'] IF list_contains(tcp_flags, f)], '+') END, '') AS flags FROM packets WHERE packet_id % 5 < 4"""
)
def eve_records_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-10 to OP-13."""
    found = logs.eve_records(_eve(spark, sf_dir))
    name, answers, flags = F.coalesce("dns_query", "http_uri", "tls_sni"), F.coalesce(F.array_join("dns_answers", "+"), F.lit("")), F.coalesce(F.array_join("tcp_flags", "+"), F.lit(""))
    return found.select("ts", "protocol", "source_ip", "source_port", "payload_size", name.alias("name"), answers.alias("answers"), flags.alias("flags"))


@query(f"WITH {PACKETS_SQL} SELECT '1:' || (packet_id % 9) AS rule_id, 'odd' AS rule_name, 'high' AS severity, 'unknown' AS category, count(*) AS n, min(ts) AS first_seen FROM packets WHERE packet_id % 5 = 4 GROUP BY packet_id % 9")
def eve_alerts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-14."""
    found = logs.eve_alerts(_eve(spark, sf_dir))
    return found.groupBy("rule_id", "rule_name", "severity", "category").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))


@query(
    f"""WITH {PACKETS_SQL} SELECT ts, CASE protocol WHEN 'ICMP' THEN CASE WHEN packet_id % 2 = 0 THEN 'ICMP' ELSE 'IP' END ELSE protocol END AS protocol, source_ip, destination_ip,
    CASE WHEN protocol <> 'ICMP' THEN source_port END AS source_port, CASE WHEN protocol <> 'ICMP' THEN destination_port END AS destination_port, 46 AS payload_size FROM packets WHERE packet_id % 7 <> 0"""
)
def packet_headers_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-02, OP-03, OP-15: frames made of packets and parsed again; what is
    neither IPv4 nor IPv6 is dropped."""
    rows = packets(spark, sf_dir)
    hexes = lambda c, n: F.lpad(F.hex(c), n, "0")
    ip = lambda c: F.concat(*(hexes(F.split(c, r"\.")[k].cast("int"), 2) for k in range(4)))
    number = F.when(F.col("protocol") == "TCP", "06").when(F.col("protocol") == "UDP", "11").when(F.col("packet_id") % 2 == 0, "01").otherwise("2F")
    ether = F.when(F.col("packet_id") % 7 == 0, "0806").otherwise("0800")
    frame = F.unhex(F.concat(F.lit("00" * 12), ether, F.lit("45" + "00" * 8), number, F.lit("0000"), ip("source_ip"), ip("destination_ip"), hexes("source_port", 4), hexes("destination_port", 4), F.lit("00" * 8)))
    return logs.plain_records(logs.parsed_packets(rows.select("ts", frame.alias("data"))))


@query(f"WITH {PACKETS_SQL} SELECT CAST(destination_port % 2 AS VARCHAR) AS decoder, protocol, count(*) AS n FROM packets WHERE destination_port % 2 = 0 OR source_port % 2 = 0 GROUP BY ALL")
def decoder_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-212: of two pairs of decoders the first of one works, that of the
    other does not."""
    rows = packets(spark, sf_dir).withColumn("decoder", (F.col("destination_port") % 2).cast("string"))
    works = logs.with_fallback(lambda: rows.where("decoder = '0'"), lambda: rows)
    fails = logs.with_fallback(lambda: rows.where("no_such_column = 1"), lambda: rows.where("decoder = '1' and source_port % 2 = 0"))
    picked = works.unionByName(fails)
    return picked.groupBy("decoder", "protocol").agg(F.count("*").alias("n"))


# --- sinks ------------------------------------------------------------------------


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS n, count(*) FILTER (value > 400) AS alerts FROM events GROUP BY ALL")
def routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-33, OP-34: events by type and day; those of high severity twice."""
    folder = new_folder(spark, "routed")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("severity", F.when(F.col("value") > 450, "critical").when(F.col("value") > 400, "high").otherwise("low"))
    for batch in (0, 1, 1):  # the second one comes again
        enrich.write_routed(rows.where(F.col("event_id") % 2 == batch), folder, batch=batch)
    of = lambda route: F.count_if(F.col("route") == route)
    return spark.read.parquet(folder).groupBy("event_type", F.col("event_date").cast("string").alias("event_date")).agg(of("events").alias("n"), of("alerts").alias("alerts"))


@query("SELECT count(*) AS written, count(*) AS stored, count(DISTINCT event_id) AS ids FROM events")
def bulk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-30, OP-31: documents that were written, as counted while writing."""
    folder = new_folder(spark, "index")
    n = sinks.bulk_index(spark.read.parquet(f"{sf_dir}/events.parquet"), folder, "event_id")
    return spark.read.parquet(folder).agg(F.lit(n).cast("bigint").alias("written"), F.count("*").alias("stored"), F.count_distinct("_id").alias("ids"))


@query("SELECT event_id, value, user_id FROM events")
def ndjson_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-32: JSON lines of at most 500 documents a file."""
    folder = new_folder(spark, "ndjson")
    sinks.ndjson(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", "user_id"), folder)
    return spark.read.schema("event_id bigint, value double, user_id bigint").json(folder)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS value FROM events UNION ALL SELECT -event_id - 1, 0 FROM events WHERE event_id % 3 = 0")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-252: rows of the same key are replaced, others are added."""
    folder = new_folder(spark, "upsert")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    rows.write.parquet(folder)
    changed = rows.where("event_id % 3 = 0")
    new = changed.withColumn("value", F.col("value") + 1).union(changed.select(-F.col("event_id") - 1, F.lit(0.0)))
    return sinks.upsert(spark, folder, new, ["event_id"])


@query("""SELECT '{"event_type":"network_flow","event_id":' || event_id || ',"user_id":' || user_id || '}' AS line FROM events""")
def json_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-40."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(sinks.json_event("network_flow", "event_id", "user_id").alias("line"))


@query("SELECT CAST(event_id AS VARCHAR) AS message_id, event_type AS priority, value, ts, 'messages.' || event_type AS subject FROM events")
def nats_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-19: headers inside the payload."""
    sent = transport.to_nats(_messages(spark, sf_dir))
    back = transport.from_nats(sent, "struct<value:double>")
    return back.select("message_id", "priority", "payload.value", "ts", F.concat(F.lit("messages."), "priority").alias("subject"))


@query("SELECT CAST(event_id AS VARCHAR) AS message_id, event_type AS priority, value, ts FROM events")
def mqtt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-20: delivered at least once, some twice, and read once."""
    sent = transport.to_mqtt(_messages(spark, sf_dir))
    back = transport.from_mqtt(sent.union(sent.where("payload like '%7%'")), "struct<value:double>")
    return back.select("message_id", "priority", "payload.value", "ts")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("message_id"), F.col("event_type").alias("priority"), F.struct("value").alias("payload"), "ts")


@query("SELECT event_type AS priority, count(*) FILTER (value <= 300) AS delivered, count(*) FILTER (value > 300) AS buffered, sum(greatest(0, event_id % 3 - 1))::BIGINT AS retries FROM events GROUP BY event_type")
def sent_with_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-251: receipts, and what failed goes to the buffer."""
    rows = _messages(spark, sf_dir)
    k = F.col("message_id").cast("bigint")
    receipts, buffered = transport.sent(rows, F.col("payload.value") <= 300, k % 3)
    by = rows.select("message_id", "priority")
    good = receipts.join(by, "message_id").groupBy("priority").agg(F.count_if("delivered").alias("delivered"), F.sum("retries").alias("retries"))
    return good.join(buffered.groupBy("priority").agg(F.count("*").alias("buffered")), "priority", "left").select("priority", "delivered", F.coalesce("buffered", F.lit(0)).alias("buffered"), "retries")


@query("SELECT codec, count(*) AS n, true AS same FROM events, (SELECT unnest(['bz2', 'gzip', 'zlib']) AS codec) GROUP BY codec")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-249: values that come back whole from each codec."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("props").cast("binary").alias("data"))
    parts = [rows.select(F.lit(c).alias("codec"), (sinks.decompressed(sinks.compressed(F.col("data"), c), c) == F.col("data")).alias("same")) for c in sorted(sinks.CODECS)]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("codec").agg(F.count("*").alias("n"), F.every("same").alias("same"))


@query("SELECT event_id, value FROM events WHERE ('0x' || substr(md5(CAST(event_id AS VARCHAR) || '#0'), 1, 8))::BIGINT / 4294967296.0 < 0.25")
def compressed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-197."""
    made = sinks.compress_and_sample(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value"), "event_id", 0.25, "zlib")
    return made.select(F.from_json(sinks.decompressed(F.col("data"), "zlib").cast("string"), "event_id bigint, value double").alias("r")).select("r.*")


@query("SELECT CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey::BIGINT END AS src_port, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS duration, CASE WHEN c_nationkey % 2 = 1 THEN c_mktsegment ELSE 'normal' END AS threat_label, c_custkey % 2 = 0 AS dns_AA, count(*) AS n FROM customer GROUP BY ALL")
def csv_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-16: a CSV file with a header and dashes for nulls."""
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.when(k % 4 == 0, "-").otherwise(F.col("c_nationkey").cast("string")).alias("src_port"),
        F.when(k % 3 == 0, "-").otherwise(F.col("c_acctbal").cast("string")).alias("duration"),
        F.when(k % 2 == 0, "T").otherwise("F").alias("dns_AA"),
        (F.col("c_nationkey") % 2).cast("string").alias("label"),
        F.col("c_mktsegment").alias("type"),
    )
    folder = new_folder(spark, "csv")
    rows.write.option("header", True).csv(folder)
    return logs.labelled_csv(spark, folder).groupBy("src_port", "duration", "threat_label", "dns_AA").agg(F.count("*").alias("n"))
