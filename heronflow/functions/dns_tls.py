"""Features of DNS queries and TLS handshakes as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SUSPICIOUS_TLDS = ("tk", "ml", "ga", "cf", "bit", "onion")
SUSPICIOUS_OCTETS = (0, 127, 169, 224, 240)
TLS_SCORES = {"TLSv1.3": 1.0, "TLSv1.2": 0.8, "TLSv1.1": 0.4, "TLSv1.0": 0.2, "SSLv3": 0.0, "SSLv2": 0.0}


def char_entropy(text: Column) -> Column:
    """Shannon entropy (bits) of the characters of a text, within the row."""
    n = F.char_length(text)
    chars = F.array_distinct(F.split(text, ""))
    count = lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.transform(chars, lambda c: -count(c) * F.log2(count(c))), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def share_of(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{characters}]", ""))) / F.char_length(text)


def dns_features(query: Column) -> dict[str, Column]:
    n = F.char_length(query)
    return {
        "dns_query_length": n.cast("double"),
        "dns_subdomain_count": (F.size(F.split(query, r"\.")) - 1).cast("double"),
        "dns_query_entropy": char_entropy(query),
        "dns_digit_ratio": share_of(query, "0-9"),
        "dns_vowel_ratio": share_of(query, "aeiouAEIOU"),
        "dns_has_numbers": query.rlike("[0-9]").cast("double"),
        "dns_has_hyphens": query.contains("-").cast("double"),
        "dns_length_suspicious": ((n > 50) | (n < 3)).cast("double"),
    }


def dns_answer_features(answers: Column, code: Column) -> dict[str, Column]:
    n = F.coalesce(F.size(answers), F.lit(0))
    odd = F.size(F.filter(answers, lambda a: suspicious_ip(a)))
    return {
        "dns_nxdomain": (code == "NXDOMAIN").cast("double"),
        "dns_response_success": (code == "NOERROR").cast("double"),
        "dns_answer_count": F.greatest(n, F.lit(0)).cast("double"),
        "dns_suspicious_ip_ratio": F.when(n > 0, odd / n).otherwise(0.0),
    }


def suspicious_ip(address: Column) -> Column:
    first = F.split_part(address, F.lit("."), F.lit(1)).try_cast("int")
    return F.coalesce(first.isin(*SUSPICIOUS_OCTETS), F.lit(False))


def looks_like_ip(text: Column) -> Column:
    """Four groups of digits, of any size."""
    return text.rlike(r"^[0-9]+(\.[0-9]+){3}$")


def bucket(text: Column) -> Column:
    """A stable number below a million; the original's hash changes with each process (G11)."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(1_000_000)).cast("double")


def tls_features(sni: Column, version: Column, ja3: Column, ja3s: Column) -> dict[str, Column]:
    scores = F.create_map(*[F.lit(x) for kv in TLS_SCORES.items() for x in kv])
    present = lambda c: (c.isNotNull() & (c != "")).cast("double")
    return {
        "tls_sni_length": F.char_length(sni).cast("double"),
        "tls_sni_entropy": char_entropy(sni),
        "tls_sni_subdomain_count": (F.size(F.split(sni, r"\.")) - 1).cast("double"),
        "tls_sni_has_ip": looks_like_ip(sni).cast("double"),
        "tls_sni_suspicious_tld": sni.rlike(rf"\.({'|'.join(SUSPICIOUS_TLDS)})$").cast("double"),
        "tls_ja3_present": F.coalesce(present(ja3), F.lit(0.0)),
        "tls_ja3_hash": F.coalesce(bucket(ja3), F.lit(0.0)),
        "tls_ja3s_present": F.coalesce(present(ja3s), F.lit(0.0)),
        "tls_ja3s_hash": F.coalesce(bucket(ja3s), F.lit(0.0)),
        "tls_version_score": F.when(version.isNull(), 0.0).otherwise(F.coalesce(scores[version], F.lit(0.5))),
    }
