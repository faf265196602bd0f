"""Device profiles: vendor lookup, learned baselines, anomalies (OP-60 to OP-70,
OP-87, OP-88, OP-145, OP-237, OP-238)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronflow.features import entropy
from heronflow.flows import micros

#: Prefixes of hardware addresses and their vendors.
OUI = {
    "00:40:8c": "Axis Communications",
    "00:0f:7c": "Hikvision",
    "00:12:01": "Dahua Technology",
    "00:0c:e5": "Sony Corporation",
    "00:80:f0": "Panasonic",
    "00:02:d1": "Vivotek Inc.",
    "00:50:56": "VMware",
    "08:00:27": "Oracle VirtualBox",
    "00:1b:21": "Intel Corporate",
    "00:15:5d": "Microsoft Corporation",
    "50:c7:bf": "TP-Link Technologies",
    "ec:fa:bc": "Belkin International",
    "44:61:32": "Amazon Technologies",
    "2c:aa:8e": "Wyze Labs",
    "b8:27:eb": "Raspberry Pi Foundation",
    "dc:a6:32": "Raspberry Pi Foundation",
    "e4:5f:01": "Raspberry Pi Foundation",
    "00:1e:c0": "Arduino",
    "98:84:e3": "Espressif Inc.",
    "24:0a:c4": "Espressif Inc.",
    "30:ae:a4": "Espressif Inc.",
    "00:16:6c": "Samsung Electronics",
    "28:6d:cd": "Samsung Electronics",
    "d8:50:e6": "Samsung Electronics",
    "00:03:93": "Apple Inc.",
    "00:17:f2": "Apple Inc.",
    "28:cf:e9": "Apple Inc.",
    "18:b4:30": "Google Inc.",
    "64:16:66": "Google Inc.",
    "f4:f5:d8": "Google Inc.",
}
#: Vendors of each device type, in the order in which they are tried.
VENDORS = {
    "camera": ["axis", "hikvision", "dahua", "bosch", "sony", "panasonic", "vivotek", "geovision", "avigilon", "hanwha", "flir", "mobotix", "acti", "arecont", "pelco"],
    "plug": ["tp-link", "belkin", "wemo", "kasa", "amazon", "wyze", "gosund", "treatlife", "meross", "teckin", "smart life"],
    "thermostat": ["nest", "ecobee", "honeywell", "emerson", "johnson controls", "carrier", "trane", "lennox", "white-rodgers", "lux"],
    "sensor": ["texas instruments", "nordic semiconductor", "silicon labs", "espressif", "particle", "arduino", "raspberry pi foundation", "adafruit", "sparkfun", "seeed", "mikroe", "digi"],
    "hub": ["samsung", "philips", "hubitat", "smartthings", "wink", "vera", "fibaro", "aeotec", "z-wave", "zigbee"],
}
#: Words in a vendor's name that tell its type, tried after the vendors.
KEYWORDS = {
    "camera": ["camera", "vision", "video", "surveillance", "security"],
    "sensor": ["sensor", "instruments", "semiconductor", "arduino", "raspberry"],
    "hub": ["smart", "home", "automation", "iot"],
    "thermostat": ["thermostat", "climate", "hvac", "temperature"],
}
#: Protocols, bandwidth (bits/s) and activity by hour and weekday of each type.
DEFAULTS = {
    "camera": (["TCP", "UDP", "HTTP", "HTTPS", "RTSP", "ONVIF"], 2_000_000, [0.9] * 24, [0.9] * 7),
    "sensor": (["UDP", "TCP", "MQTT", "COAP", "HTTP", "HTTPS"], 10_000, [0.3] * 6 + [0.7] * 12 + [0.4] * 6, [0.8] * 5 + [0.5] * 2),
    "plug": (["TCP", "UDP", "HTTP", "HTTPS", "MQTT"], 50_000, [0.2] * 6 + [0.8] * 4 + [0.6] * 8 + [0.9] * 4 + [0.4] * 2, [0.8] * 5 + [0.6] * 2),
    "thermostat": (["TCP", "UDP", "HTTP", "HTTPS", "MQTT", "ZIGBEE"], 20_000, [0.4] * 6 + [0.8] * 2 + [0.5] * 8 + [0.8] * 4 + [0.6] * 4, [0.8] * 5 + [0.7] * 2),
    "hub": (["TCP", "UDP", "HTTP", "HTTPS", "MQTT", "ZIGBEE", "Z-WAVE"], 500_000, [0.6] * 24, [0.7] * 7),
    "unknown": (["TCP", "UDP", "HTTP", "HTTPS"], 100_000, [0.3] * 6 + [0.6] * 12 + [0.4] * 6, [0.5] * 7),
}


def oui_table(spark: SparkSession, custom: list[tuple[str, str]] | None = None) -> DataFrame:
    """prefix, vendor; custom entries replace those of the same prefix."""
    rows = OUI | dict(custom or [])
    return spark.createDataFrame(sorted(rows.items()), "oui string, vendor string")


def oui_prefix(mac: Column) -> Column:
    """aa:bb:cc of an address in any notation, null if it is not one."""
    hexes = F.lower(F.regexp_replace(mac, r"[:\-.]", ""))
    return F.when(hexes.rlike("^[0-9a-f]{12}$"), F.concat_ws(":", *(F.substring(hexes, i, 2) for i in (1, 3, 5))))


def vendor_lookup(devices: DataFrame, oui: DataFrame, mac: str = "mac") -> DataFrame:
    """OP-87: left join on the prefix; the dimension has a few dozen rows."""
    return devices.withColumn("oui", oui_prefix(F.col(mac))).join(oui, "oui", "left")


def device_type(vendor: Column) -> Column:
    """OP-88: the first known vendor that equals, is in, or holds the name,
    then key words; as one expression, so no join is needed."""
    name = F.lower(vendor)
    exact = [(name == v, kind) for kind, vendors in VENDORS.items() for v in vendors]
    partial = [(name.contains(v) | F.lit(v).contains(name), kind) for kind, vendors in VENDORS.items() for v in vendors]
    words = [(name.contains(w), kind) for kind, found in KEYWORDS.items() for w in found]
    out = F.when(vendor.isNull(), "unknown")
    for test, kind in exact + partial + words:
        out = out.when(test, kind)
    return out.otherwise("unknown")


def defaults_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in DEFAULTS.items()], "device_type string, protocols array<string>, bandwidth_bps bigint, hour_of_day array<double>, day_of_week array<double>")


def created_profiles(devices: DataFrame, spark: SparkSession) -> DataFrame:
    """OP-237: devices (mac) to new profiles with the defaults of their type."""
    typed = vendor_lookup(devices, oui_table(spark)).withColumn("device_type", device_type(F.col("vendor")))
    return typed.join(F.broadcast(defaults_table(spark)), "device_type").withColumns({"confidence_score": F.lit(0.1), "observation_count": F.lit(0).cast("bigint")})


def protocol_baseline(observed: DataFrame, defaults: list[str] | None = None) -> DataFrame:
    """OP-61: protocols of over 5 % of a device's observations. From ten on they
    replace the defaults, or, if there are none, the most common one does (ties:
    alphabetical); below ten they are added to the defaults."""
    base = F.array(*map(F.lit, defaults or []))
    counts = observed.groupBy("device_id", F.upper("protocol").alias("p")).agg(F.count("*").alias("n"))
    total = Window.partitionBy("device_id")
    marked = counts.withColumns({"total": F.sum("n").over(total), "rank": F.row_number().over(total.orderBy(F.desc("n"), "p"))})
    out = marked.groupBy("device_id").agg(
        F.max("total").alias("observations"),
        F.collect_set(F.when(F.col("n") / F.col("total") > 0.05, F.col("p"))).alias("often"),
        F.collect_set(F.when(F.col("rank") == 1, F.col("p"))).alias("top"),
    )
    learned = F.when(F.size("often") > 0, F.col("often")).otherwise(F.col("top"))
    return out.select("device_id", "observations", F.array_sort(F.when(F.col("observations") >= 10, learned).otherwise(F.array_union(base.cast("array<string>"), "often"))).alias("normal_protocols"))


def destinations(observed: DataFrame, most: int = 100) -> DataFrame:
    """OP-62, OP-110: a device's destinations, the most frequent if there are
    over ``most`` (ties: by address). Counts are ranked, not observations."""
    counts = observed.groupBy("device_id", "destination_ip").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("device_id").orderBy(F.desc("n"), "destination_ip")))
    return ranked.where(F.col("rank") <= most).groupBy("device_id").agg(F.array_sort(F.collect_set("destination_ip")).alias("allowed_destinations"))


def latest(observed: DataFrame, n: int) -> DataFrame:
    """OP-104: the last n observations of a device by (ts, flow_id)."""
    w = Window.partitionBy("device_id").orderBy(F.desc("ts"), F.desc("flow_id"))
    return observed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def bandwidth_baseline(observed: DataFrame, current: Column) -> DataFrame:
    """OP-63: median bits/s of the last 100 observations (at least ten), blended
    into ``current``: 30/70 if it differs by over half, else 70/30."""
    total = F.col("bytes_sent") + F.col("bytes_received")
    bps = F.when(F.col("duration_ms") > 0, total * 8 / (F.col("duration_ms") / 1000))
    out = latest(observed, 100).groupBy("device_id").agg(F.count("*").alias("n"), F.floor(F.percentile(bps, 0.5)).alias("median_bps"))
    change = F.abs(F.col("median_bps") - current) / F.greatest(current, F.lit(1))
    blended = F.when(current <= 0, F.col("median_bps")).when(change > 0.5, F.floor(0.3 * current + 0.7 * F.col("median_bps"))).otherwise(F.floor(0.7 * current + 0.3 * F.col("median_bps")))
    return out.select("device_id", "median_bps", F.when((F.col("n") >= 10) & F.col("median_bps").isNotNull(), blended).otherwise(current).cast("bigint").alias("typical_bandwidth_bps"))


def baselines(observed: DataFrame, most: int = 100, last: int = 100) -> DataFrame:
    """OP-61 to OP-63 for devices without defaults, in one pass: observations,
    normal_protocols, allowed_destinations, median_bps, typical_bandwidth_bps, as
    :func:`protocol_baseline`, :func:`destinations` and
    :func:`bandwidth_baseline` (of 0) give them one by one, for devices with at
    least one destination.

    Each of these would join, shuffle and rank the observations anew. Here rows
    go once to their device's task; what counts of a row is told by windows of
    the device, which are sorted there.
    """
    device = Window.partitionBy("device_id")
    total = F.col("bytes_sent") + F.col("bytes_received")
    bps = F.when(F.col("duration_ms") > 0, total * 8 / (F.col("duration_ms") / 1000))
    rows = observed.select("device_id", "ts", "flow_id", F.upper("protocol").alias("p"), "destination_ip", bps.alias("bps"))
    late = F.row_number().over(device.orderBy(F.desc("ts"), F.desc("flow_id"))) <= last
    rows = rows.select("device_id", "p", "destination_ip", late.alias("late"), F.when(late, F.col("bps")).alias("bps"))
    rows = rows.withColumn("to", F.count("*").over(Window.partitionBy("device_id", "destination_ip")))
    rows = rows.withColumn("place", F.dense_rank().over(device.orderBy(F.desc("to"), "destination_ip")))
    # One row a protocol, then one a device.
    kinds = rows.groupBy("device_id", "p").agg(
        F.count("*").alias("n"),
        F.count_if("late").alias("late"),
        F.collect_set(F.when(F.col("place") <= most, F.col("destination_ip"))).alias("to"),
        F.collect_list("bps").alias("bps"),
    )
    out = kinds.groupBy("device_id").agg(
        F.sum("n").alias("observations"),
        F.sum("late").alias("late"),
        F.collect_list(F.struct("n", "p")).alias("kinds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("to")))).alias("allowed_destinations"),
        F.sort_array(F.flatten(F.collect_list("bps"))).alias("bps"),
    )
    known = F.filter("kinds", lambda k: k["p"].isNotNull())
    often = F.transform(F.filter(known, lambda k: k["n"] / F.col("observations") > 0.05), lambda k: k["p"])
    first = F.array_sort(F.transform("kinds", lambda k: F.struct((-k["n"]).alias("n"), k["p"].alias("p"))))[0]["p"]
    top = F.array_compact(F.array(first))
    learned = F.when((F.col("observations") >= 10) & (F.size(often) == 0), top).otherwise(often)
    n = F.size("bps")
    low, high = F.get("bps", F.floor((n - 1) / 2).cast("int")), F.get("bps", F.floor(n / 2).cast("int"))
    median = F.when(n > 0, F.floor(F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)))
    typical = F.when(F.col("late") >= 10, F.coalesce(median, F.lit(0))).otherwise(0).cast("bigint")
    return out.select("device_id", "observations", F.array_sort(learned).alias("normal_protocols"), "allowed_destinations", median.alias("median_bps"), typical.alias("typical_bandwidth_bps"))


def activity_schedule(observed: DataFrame, hours: list[float], days: list[float]) -> DataFrame:
    """OP-64: observations by hour and weekday over their greatest count, 40 %
    of it mixed into the old schedule; devices of under 24 observations keep
    the old one."""

    def histogram(part: Column, size: int, old: list[float], name: str) -> DataFrame:
        counts = observed.groupBy("device_id", part.alias("k")).agg(F.count("*").alias("n"))
        by = counts.groupBy("device_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"), F.max("n").alias("top"), F.sum("n").alias("total"))
        fresh = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0)) / F.col("top"))
        before = F.array(*map(F.lit, old))
        return by.select("device_id", F.when(F.col("total") >= 24, F.zip_with(before, fresh, lambda a, b: 0.6 * a + 0.4 * b)).otherwise(before).alias(name))

    return histogram(F.hour("ts"), 24, hours, "hour_of_day").join(histogram(F.weekday("ts"), 7, days, "day_of_week"), "device_id")


def confidence(observed: DataFrame) -> DataFrame:
    """OP-65: half by count, 0.3 by how few protocols, 0.2 by how regular the
    last 24 observations are."""
    kinds = observed.groupBy("device_id", "protocol").agg(F.count("*").alias("n")).groupBy("device_id").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    spread = entropy(observed, ["device_id"], "protocol", "h")
    w = Window.partitionBy("device_id").orderBy("ts", "flow_id")
    gaps = latest(observed, 24).withColumn("gap", (micros() - F.lag(micros()).over(w)) / 1e6)
    cv = F.when(F.avg("gap") > 0, F.coalesce(F.stddev_samp("gap"), F.lit(0.0)) / F.avg("gap")).otherwise(1.0)
    regular = gaps.groupBy("device_id").agg((1 / (1 + cv)).alias("regular"))
    by_count = F.least(F.lit(0.9), F.log1p("n") / 10)
    even = F.when(F.col("kinds") > 1, 1 - F.col("h") / F.log2("kinds")).otherwise(1 - F.col("h"))
    score = by_count * 0.5 + even * 0.3 + F.when(F.col("n") > 24, F.col("regular")).otherwise(0.5) * 0.2
    return kinds.join(spread, "device_id").join(regular, "device_id").select("device_id", F.col("n").alias("observation_count"), score.alias("confidence_score"))


def simple_confidence(n: Column) -> Column:
    """OP-66."""
    return F.least(F.lit(0.95), 1 - F.exp(-n / 1000))


def is_mature(count: Column, score: Column) -> Column:
    """OP-51c."""
    return (count >= 100) & (score >= 0.7)


def pattern_strength(observed: DataFrame, part: Column, slots: int, least: int) -> DataFrame:
    """OP-68: 1 - entropy of a device's histogram over its most; 0 below
    ``least`` observations."""
    rows = observed.select("device_id", part.alias("slot"))
    n = rows.groupBy("device_id").agg(F.count("*").alias("n"))
    strength = 1 - F.col("h") / F.log2(F.lit(float(slots)))
    return n.join(entropy(rows, ["device_id"], "slot", "h"), "device_id").select("device_id", F.when(F.col("n") >= least, strength).otherwise(0.0).alias("strength"))


def anomalies(flows: DataFrame, profiles: DataFrame) -> DataFrame:
    """OP-91, OP-145: up to four anomalies a flow, against the profile of its
    device. A profile has normal_protocols, allowed_destinations (exact texts;
    none: not checked), typical_bandwidth_bps, hour_of_day."""
    rows = flows.join(profiles, "device_id")
    total = F.col("bytes_sent") + F.col("bytes_received")
    bps = F.when(F.col("duration_ms") > 0, total * 8 / (F.col("duration_ms") / 1000)).otherwise(0.0)
    found = F.array(
        F.when(~F.array_contains("normal_protocols", F.upper("protocol")), F.struct(F.lit("protocol_anomaly").alias("type"), F.lit("medium").alias("severity"))),
        F.when((F.size("allowed_destinations") > 0) & ~F.array_contains("allowed_destinations", F.col("destination_ip")), F.struct(F.lit("destination_anomaly").alias("type"), F.lit("high").alias("severity"))),
        F.when((F.col("typical_bandwidth_bps") > 0) & (bps / F.col("typical_bandwidth_bps") > 5), F.struct(F.lit("bandwidth_anomaly").alias("type"), F.lit("medium").alias("severity"))),
        F.when(F.element_at("hour_of_day", F.hour("ts") + 1) < 0.2, F.struct(F.lit("temporal_anomaly").alias("type"), F.lit("low").alias("severity"))),
    )
    return rows.select("device_id", "flow_id", "ts", F.explode(F.array_compact(found)).alias("a")).select("device_id", "flow_id", "ts", "a.*")


def port_scans(flows: DataFrame, most: int = 20, window: str = "1 hour") -> DataFrame:
    """OP-146: sources with over ``most`` flows in a window, once each."""
    busy = flows.groupBy("source_ip", F.window("ts", window)).agg(F.count("*").alias("active")).where(F.col("active") > most)
    return busy.groupBy("source_ip").agg(F.min("window.start").alias("first_window"), F.max("active").alias("active"))
