"""Scores, severities, evidence and identifiers as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decision thresholds and score types per detector.
DETECTORS = {
    "ddos": (0.13920332491397858, "model_score"),
    "c2_beaconing": (0.20, "probability"),
    "dga": (0.68, "probability"),
    "dns_tunnelling": (0.50, "probability"),
    "malware_tls": (0.6235448718070984, "probability"),
    "portscan": (0.50166595, "model_score"),
    "exfiltration": (0.85, "probability"),
}

# Threat family by substring of the lower-cased class; the first match wins.
THREAT_FAMILIES = (
    ("ddos", "threat_ddos"),
    ("c2", "threat_c2"),
    ("dga", "threat_dga_dns"),
    ("dns", "threat_dga_dns"),
    ("tls", "threat_tls"),
    ("quic", "threat_tls"),
    ("malware in encrypted sessions", "threat_tls"),
    ("recon", "threat_recon"),
    ("port scan", "threat_recon"),
    ("exfil", "threat_exfil"),
)
DEFAULT_FAMILY = "threat_ddos"

# Context keys that must never be stored.
REDACTED_KEYS = ("payload", "pcap_excerpt", "tls_keys", "authorization")

# Fixed value: addresses that no session of interest has.
NON_ROUTABLE = r"^(255\.255\.255\.255|.*\.255|169\.254\..*|224\..*|239\..*|127\..*|0\.0\.0\.0)$"


def severity_from_score(score: Column) -> Column:
    return (
        F.when(score >= 0.95, "CRITICAL").when(score >= 0.85, "HIGH").when(score >= 0.70, "MEDIUM").otherwise("LOW")
    )


def threat_family(threat_class: Column) -> Column:
    lowered = F.lower(F.coalesce(threat_class, F.lit("")))
    chain = reduce(
        lambda acc, pair: acc.when(lowered.contains(pair[0]), pair[1]),
        THREAT_FAMILIES[1:],
        F.when(lowered.contains(THREAT_FAMILIES[0][0]), THREAT_FAMILIES[0][1]),
    )
    return chain.otherwise(DEFAULT_FAMILY)


def is_non_routable(ip: Column) -> Column:
    return F.coalesce(ip.rlike(NON_ROUTABLE), F.lit(False))


def _feature(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def tls_rule_score(columns: Sequence[str]) -> Column:
    """Largest of the session rules; a feature that is not among ``columns`` counts as 0."""
    get = lambda n: _feature(n) if n in columns else F.lit(0.0)
    cv, regular = get("iat_cv"), get("iat_regularity_score")
    rules = [
        F.when(cv > 0, F.abs(cv - 0.3) / 0.5),
        F.when(regular > 0.7, regular * 3.0),
        F.when(get("has_deprecated_cipher") != 0, F.lit(3.0)),
        F.when(get("tls_sslv3") != 0, F.lit(4.0)),
        F.when((get("tls_1_0") != 0) | (get("tls_1_1") != 0), F.lit(2.0)),
        F.when(get("has_sni") == 0, F.lit(1.5)),
        F.when(get("cert_self_signed") != 0, F.lit(2.5)),
    ]
    return F.coalesce(F.greatest(*rules), F.lit(0.0))


# What an alert's evidence says where the session does not tell.
EVIDENCE_CONTEXT = {"src_ip": "unknown", "dst_ip": "unknown", "src_port": "0", "dst_port": "0", "protocol": "unknown"}


def tls_evidence(
    columns: Sequence[str], probability: Column, threshold: float, detector: str | None = None, version: str | None = None,
    context: Mapping[str, Column] | None = None, top: int = 5,
) -> Column:
    """Evidence map: rounded values, present only where they are notable.

    With a ``detector`` also its name and version, the endpoints of the session (``context``, by the names of
    EVIDENCE_CONTEXT) and, as JSON, the ``top`` features.
    """
    get = lambda n: _feature(n) if n in columns else F.lit(0.0)
    text = lambda c: c.cast("string")
    flag = lambda n: F.when(get(n) != 0, F.lit("true"))
    known = {k: F.coalesce(text(context[k]) if context and k in context else F.lit(None).cast("string"), F.lit(v)) for k, v in EVIDENCE_CONTEXT.items()}
    named = [("detector", F.lit(detector)), ("model_version", F.lit(version)), *known.items(), ("top_features", F.to_json(top_features(columns, top)))] if detector else []
    entries = [
        *named,
        ("malware_probability", text(F.round(probability, 4))),
        ("decision_threshold", F.lit(str(threshold))),
        ("deprecated_cipher_detected", flag("has_deprecated_cipher")),
        ("self_signed_certificate", flag("cert_self_signed")),
        ("expired_certificate", flag("cert_expired")),
        ("iat_coefficient_of_variation", F.when(get("iat_cv") > 0, text(F.round(get("iat_cv"), 4)))),
        (
            "beaconing_regularity_score",
            F.when(get("iat_regularity_score") > 0.5, text(F.round(get("iat_regularity_score"), 4))),
        ),
        ("dominant_frequency_hz", F.when(get("dominant_freq_hz") > 0, text(F.round(get("dominant_freq_hz"), 6)))),
        (
            "consecutive_periodic_intervals",
            F.when(get("consecutive_similar_iat_count") > 3, text(get("consecutive_similar_iat_count").cast("long"))),
        ),
        ("total_packets", text(get("total_pkt_count").cast("long"))),
        ("total_bytes", text(get("total_byte_count").cast("long"))),
        ("flow_duration_sec", text(F.round(get("flow_duration_sec"), 3))),
    ]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def top_features(columns: Sequence[str], n: int = 5) -> Column:
    """The ``n`` non-zero features of largest magnitude, as name/value structs; ties by contract order."""
    pairs = F.array(
        *[
            F.struct(
                (-F.abs(_feature(c))).alias("rank"), F.lit(i).alias("pos"),
                F.lit(c).alias("name"), F.round(_feature(c), 4).alias("value"),
            )
            for i, c in enumerate(columns)
        ]
    )
    ordered = F.array_sort(F.filter(pairs, lambda p: p["rank"] != 0))
    return F.transform(F.slice(ordered, 1, n), lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")))


def alert_confidence(score: Column, score_type: Column) -> Column:
    return F.when((score_type == "probability") & score.between(0.0, 1.0), score)


def raw_model_score(score: Column, score_type: Column) -> Column:
    return F.when(score_type == "model_score", score)


def alert_id(*parts: Column) -> Column:
    """``ALT-`` and the first 16 hex digits of the SHA-256 of the parts joined by bars."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit("ALT-"), F.substring(F.sha2(joined, 256), 1, 16))


def redact(context: Column) -> Column:
    return F.map_filter(context, lambda k, _: ~F.lower(k).isin(*REDACTED_KEYS))


def is_botnet(label: Column) -> Column:
    return F.coalesce(F.lower(label).contains("botnet"), F.lit(False)).cast("int")


def is_not_benign(label: Column) -> Column:
    return (F.lower(F.trim(label)) != "benign").cast("int")


def ratio(numerator: Column, denominator: Column, eps: float = 1e-9) -> Column:
    return numerator / (denominator + F.lit(eps))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Zero where the denominator is zero or missing."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))
