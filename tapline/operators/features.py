"""Feature vectors of single flows and DNS records."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.scoring import ratio
from ..functions.text import entropy
from ..session import stage
from .packet_flows import DDOS_INPUTS, PORTSCAN_INPUTS

EPS = 1e-9


def _kept(df: DataFrame, keep: Sequence[str]) -> list[str]:
    """Columns to keep; a detector's verdict on the inputs always stays."""
    return [*keep, *(["_unfit"] if "_unfit" in df.columns and "_unfit" not in keep else [])]

# Order of the volumetric-attack vector.
DDOS_FEATURES = (
    "Flow Packets/s", "Flow Bytes/s", "Flow Duration", "fwd_byte_ratio", "packet_asymmetry", "byte_asymmetry",
    "syn_ratio", "ack_ratio", "rst_ratio", "Packet Length Mean", "packet_size_variability", "is_udp",
)


def ddos_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 12 volumetric-attack features of flow rows; non-finite values become 0."""
    c = lambda n: F.col(n).cast("double")
    packets = c("Total Fwd Packets") + c("Total Backward Packets")
    size = c("Fwd Packets Length Total") + c("Bwd Packets Length Total")
    derived = {
        "fwd_byte_ratio": ratio(c("Fwd Packets Length Total"), size, EPS),
        "packet_asymmetry": ratio(F.abs(c("Total Fwd Packets") - c("Total Backward Packets")), packets, EPS),
        "byte_asymmetry": ratio(F.abs(c("Fwd Packets Length Total") - c("Bwd Packets Length Total")), size, EPS),
        "syn_ratio": ratio(c("SYN Flag Count"), packets, EPS),
        "ack_ratio": ratio(c("ACK Flag Count"), packets, EPS),
        "rst_ratio": ratio(c("RST Flag Count"), packets, EPS),
        "packet_size_variability": ratio(c("Packet Length Std"), c("Packet Length Mean"), EPS),
        "is_udp": (c("Protocol") == 17).cast("double"),
    }
    return df.select(*_kept(df, keep), *[P.clean_numeric(derived.get(n, F.col(n))).alias(n) for n in DDOS_FEATURES])


def portscan_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 8 scan features, cleaned."""
    return df.select(*_kept(df, keep), *[P.clean_numeric(n).alias(n) for n in PORTSCAN_INPUTS])


def dns_base_features(df: DataFrame, lenient: bool = True) -> DataFrame:
    """Per-record features of stateful DNS rows: collection counts, TTLs, type flags, ratios.

    ``lenient`` is the research form (unparsed collections count 1, TTL text falls back to its
    numbers); the scoring form counts 0 and takes list literals only.
    """
    number = lambda n: P.to_number_or_zero(n)
    at_least_one = lambda c: F.greatest(c, F.lit(1.0))
    counts = {
        "country_count": "unique_country", "asn_count": "unique_asn", "domain_count": "distinct_domains",
        "ip_count": "distinct_ip", "ns_count": "distinct_ns",
    }
    counted = {n: P.literal_count(F.col(c), 1 if lenient else 0) for n, c in counts.items() if c in df.columns}
    ttl = P.ttl_features(F.col("unique_ttl"), lenient)
    flags = P.rr_flags(F.col("rr_type"))
    ratios = {
        "reverse_dns_known": (F.coalesce(F.lower("reverse_dns"), F.lit("nan")) != "unknown").cast("int"),
        "ptr_per_rr": number("PTR_frequency") / at_least_one(number("rr_count")),
        "rr_entropy_per_length": number("rr_name_entropy") / at_least_one(number("rr_name_length")),
        "ttl_variance_ratio": number("ttl_variance") / at_least_one(number("ttl_mean")),
    }
    return df.select("*", *[v.alias(n) for n, v in {**counted, **ttl, **flags, **ratios}.items()])


def ptr_rr_ratio(ptr, rr, stable: bool = True):
    """PTR share of recent records: ``ptr / (rr + 1)``, or with the denominator clipped at 1e-6."""
    return ptr / (rr + 1.0) if stable else ptr / F.greatest(rr, F.lit(1e-6))


# Order of the encrypted-session vector.
TLS_FEATURES = (
    "dst_port", "fwd_pkt_count", "bwd_pkt_count", "total_pkt_count", "fwd_byte_count", "bwd_byte_count",
    "total_byte_count", "fwd_ttl_mean", "bwd_ttl_mean", "fwd_iat_mean", "fwd_iat_std", "fwd_iat_max", "fwd_iat_min",
    "bwd_iat_mean", "bwd_iat_std", "overall_iat_mean", "overall_iat_std", "fwd_pkt_size_max", "bwd_pkt_size_max",
    "syn_count", "ack_count", "fin_count", "psh_count", "tls_1_0", "tls_1_2", "tls_1_3", "tls_quic", "has_sni",
    "sni_length", "sni_entropy", "cert_expired", "cert_valid_days_remaining", "alpn_h2", "alpn_http1_1",
    "dominant_freq_hz", "dominant_freq_power", "proto_quic",
)


def tls_flow_features(
    packets: DataFrame, sessions: DataFrame, bins: int = 256, rows: int | None = None
) -> DataFrame:
    """The 37 encrypted-session features per flow; times are seconds.

    ``packets``: uid, seq (unique arrival), ts, forward, size, ttl, flags. ``sessions``: uid,
    dst_port, proto, version, server_name, alpn, cert_days. Packets are read once and summed per flow
    and time; all else comes from these sums. Gaps come from running times in chunks: the mean gap is
    known from a flow's first and last time, so the deviations from it add up. The dominant frequency is
    this library's own definition: packets are counted in ``bins`` equal time slots of the flow and the
    strongest non-zero term of the real spectrum is taken, so a flow of any size is reduced to at most
    ``bins`` rows before its transform.
    """
    from .chunks import CHUNK_ROWS, join_on

    forward = F.col("forward")
    sides = {"fwd": forward, "bwd": ~forward}
    marks = {"syn": 2, "ack": 16, "fin": 1, "psh": 8}
    own = lambda make, c: {d: make(F.when(side, F.col(c))) for d, side in sides.items()}
    ttl = lambda c: F.sum(c.cast("double"))
    moments = stage(
        packets.groupBy("uid", F.unix_micros(F.col("ts").cast("timestamp")).alias("_t")).agg(
            F.count(F.lit(1)).alias("total_pkt_count"),
            *[F.count_if(side).alias(f"{d}_pkt_count") for d, side in sides.items()],
            F.sum("size").alias("total_byte_count"),
            *[v.alias(f"{d}_byte_count") for d, v in own(F.sum, "size").items()],
            *[v.alias(f"{d}_pkt_size_max") for d, v in own(F.max, "size").items()],
            *[v.alias(f"_{d}_ttl") for d, v in own(ttl, "ttl").items()],
            *[v.alias(f"_{d}_ttls") for d, v in own(F.count, "ttl").items()],
            *[F.count_if(F.col("flags").bitwiseAND(F.lit(mask)) != 0).alias(f"{n}_count") for n, mask in marks.items()],
        )
    )
    added = [f"{d}_pkt_count" for d in ("total", *sides)] + ["total_byte_count"] + [f"{n}_count" for n in marks]
    seen = {"overall": F.lit(True), "fwd": F.col("fwd_pkt_count") > 0, "bwd": F.col("bwd_pkt_count") > 0}
    flows = stage(
        moments.groupBy("uid").agg(
            *[F.sum(n).alias(n) for n in added],
            *[F.coalesce(F.sum(f"{d}_byte_count"), F.lit(0)).alias(f"{d}_byte_count") for d in sides],
            *[F.max(f"{d}_pkt_size_max").alias(f"{d}_pkt_size_max") for d in sides],
            *[(F.sum(f"_{d}_ttl") / F.nullif(F.sum(f"_{d}_ttls"), F.lit(0))).alias(f"{d}_ttl_mean") for d in sides],
            F.min("_t").alias("_t0"), F.max("_t").alias("_t1"), F.count(F.lit(1)).alias("_moments"),
            *[((F.max(F.when(at, F.col("_t"))) - F.min(F.when(at, F.col("_t")))) / F.lit(1e6)).alias(f"_{d}_span") for d, at in seen.items()],
        )
    )
    for d, count in (("overall", "total"), ("fwd", "fwd"), ("bwd", "bwd")):
        gaps = F.col(f"{count}_pkt_count") - 1
        flows = flows.withColumn(f"_{d}_gaps", gaps).withColumn(f"_{d}_mean", F.when(gaps > 0, F.coalesce(f"_{d}_span", F.lit(0.0)) / gaps))
    placed = _gaps_and_slots(moments, flows, seen, bins, rows or CHUNK_ROWS)
    measured = _dominant_frequency(placed, seen, bins)
    out = join_on(join_on(flows, measured, ["uid"], null_safe=False), _session_features(sessions), ["uid"], null_safe=False)
    for d in seen:
        n, mean, known = F.col(f"_{d}_gaps"), F.col(f"_{d}_mean"), F.col(f"_{d}_pos")
        m2 = F.coalesce(f"_{d}_m2", F.lit(0.0)) + (n - known) * mean * mean
        out = out.withColumns({
            f"{d}_iat_mean": F.when(known.isNotNull(), mean), f"{d}_iat_std": F.when(n > 1, F.sqrt(m2 / (n - 1))),
            f"{d}_iat_max": F.when(n > 0, F.coalesce(f"_{d}_max", F.lit(0.0))),
            f"{d}_iat_min": F.when(n > 0, F.when(n > known, F.lit(0.0)).otherwise(F.col(f"_{d}_min"))),
        })
    return out.select("uid", *[P.clean_numeric(n).alias(n) for n in TLS_FEATURES])


def _session_features(sessions: DataFrame) -> DataFrame:
    """What the session alone tells, each feature computed once per session."""
    version, alpn = F.lower(F.coalesce("version", F.lit(""))), F.lower(F.coalesce("alpn", F.lit("")))
    name = F.coalesce(F.col("server_name"), F.lit(""))
    quic = F.lower(F.coalesce("proto", F.lit(""))) == "quic"
    features = {
        "tls_1_0": version == "tlsv10", "tls_1_2": version == "tlsv12", "tls_1_3": version == "tlsv13",
        "tls_quic": version.contains("quic") | quic, "has_sni": name != "", "sni_length": F.length(name),
        "sni_entropy": entropy(name), "cert_expired": F.col("cert_days") < 0,
        "cert_valid_days_remaining": F.col("cert_days"), "alpn_h2": alpn == "h2",
        "alpn_http1_1": alpn == "http/1.1", "proto_quic": quic, "dst_port": F.col("dst_port"),
    }
    return P.evaluated(sessions, ["uid"], features)


def _gaps_and_slots(moments: DataFrame, flows: DataFrame, seen: dict, bins: int, rows: int) -> DataFrame:
    """Per flow and time slot: packets, and sums over the gaps of both ways together and of each."""
    from .chunks import join_on, running

    known = flows.select("uid", "_t0", "_t1", *[f"_{d}_mean" for d in seen])
    counted = moments.select("uid", "_t", "total_pkt_count", "fwd_pkt_count", "bwd_pkt_count")
    largest = flows.agg(F.max("_moments")).first()[0] or 0
    before = {f"_{d}_before": ("max", F.when(at, F.col("_t")), False) for d, at in seen.items()}
    timed = running(join_on(counted, known, ["uid"], null_safe=False), ["uid"], "_t", before, rows=rows, largest=largest)
    width = F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1))
    slot = F.least(F.floor((F.col("_t") - F.col("_t0")) * bins / width), F.lit(bins - 1)).cast("int")
    gap = {d: F.when(at, (F.col("_t") - F.col(f"_{d}_before")) / F.lit(1e6)) for d, at in seen.items()}
    timed = timed.select("*", *[v.alias(f"_{d}_gap") for d, v in gap.items()])
    off = lambda d: F.col(f"_{d}_gap") - F.col(f"_{d}_mean")
    sums = lambda d: {
        f"_{d}_pos": F.count(f"_{d}_gap"), f"_{d}_m2": F.sum(off(d) * off(d)),
        f"_{d}_max": F.max(f"_{d}_gap"), f"_{d}_min": F.min(f"_{d}_gap"),
    }
    return timed.groupBy("uid", slot.alias("slot")).agg(
        F.sum("total_pkt_count").alias("n"), ((F.first("_t1") - F.first("_t0")) / F.lit(1e6)).alias("seconds"),
        *[v.alias(n) for d in seen for n, v in sums(d).items()],
    )


def _dominant_frequency(slots: DataFrame, seen: dict, bins: int) -> DataFrame:
    """Strongest frequency of each flow's packet counts, and the gap sums of its slots added up.

    A flow is at most ``bins`` counts by now; they are packed into one short array per flow, and a
    vectorised function transforms a whole Arrow batch of flows as one matrix.
    """
    whole = {"pos": F.sum, "m2": F.sum, "max": F.max, "min": F.min}
    sums = {f"_{d}_{n}": make for d in seen for n, make in whole.items()}
    packed = slots.groupBy("uid").agg(
        F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "n"))).alias("_at"),
        F.first("seconds", ignorenulls=True).alias("seconds"), *[make(n).alias(n) for n, make in sums.items()],
    )
    packed = packed.select("*", F.col("_at.slot").alias("at"), F.col("_at.n").alias("counts"))

    @F.pandas_udf("dominant_freq_hz double, dominant_freq_power double")
    def strongest(at: pd.Series, counts: pd.Series, seconds: pd.Series) -> pd.DataFrame:
        series = np.zeros((len(at), bins))
        row = np.repeat(np.arange(len(at)), at.str.len())
        series[row, np.concatenate(at.to_list())] = np.concatenate(counts.to_list())
        power = np.abs(np.fft.rfft(series - series.mean(axis=1, keepdims=True), axis=1))[:, 1:] ** 2
        whole, long = power.sum(axis=1), seconds.to_numpy() > 0
        alive = long & (whole > 1e-9)
        share = np.where(alive, power.max(axis=1) / np.where(alive, whole, 1.0), 0.0)
        hertz = np.where(alive, (power.argmax(axis=1) + 1) / np.where(long, seconds, 1.0), 0.0)
        return pd.DataFrame({"dominant_freq_hz": hertz, "dominant_freq_power": share})

    return packed.select("uid", *sums, strongest("at", "counts", "seconds").alias("_f")).select("uid", *sums, "_f.*")
