"""Windowed per-threat aggregates: flooding, scanning, DNS tunnelling, exfiltration, lexical domains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import safe_divide
from ..functions.text import char_ngrams, entropy, lexical_features
from ..session import stage
from .beacon import gaps_by_time, micros
from .chunks import CHUNK_ROWS, join_on, running


def time_bucket(ts: str | Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket, in seconds."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (F.floor(F.unix_seconds(c.cast("timestamp")) / seconds) * seconds).cast("long")


def distinct_and_entropy(df: DataFrame, by: Sequence[str], value: str, prefix: str) -> DataFrame:
    """Exact distinct count and Shannon entropy of a column per key, from counts per value.

    Two levels of counting: a hot key's values are first counted by (key, value), which spreads over
    the cluster, and only those counts are summed per key, on the map side first.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    n, total = F.col("_n").cast("double"), F.sum("_n").cast("double")
    return counts.groupBy(*by).agg(
        F.count(F.col(value)).alias(f"unique_{prefix}"),
        (F.log2(total) - F.sum(n * F.log2(n)) / total).alias(f"{prefix}_entropy"),
    )


# Bits of TCP flags in a count column's name.
FLAG_COUNTS = ("syn", "ack", "rst", "fin")


def _traffic_sums(packets: str, size: str, protocol: str, reply: str | None, flags: Mapping[str, str], inbound: Column | None) -> dict[str, Column]:
    """Sums of the traffic onto a destination; they add up over any cut of the rows."""
    of = lambda p: F.sum(F.when(F.lower(F.col(protocol).cast("string")).isin(*p), F.col(packets)).otherwise(0))
    sums = {
        "flows_per_destination": F.count(F.lit(1)), "packets_per_destination": F.sum(packets), "bytes_per_destination": F.sum(size),
        "tcp_packets": of(("6", "tcp")), "udp_packets": of(("17", "udp")), "icmp_packets": of(("1", "icmp")),
        "_back": F.sum(reply) if reply else F.sum(F.lit(0)),
    }
    sums |= {f"{n}_count": F.sum(F.coalesce(F.col(c), F.lit(0))) for n, c in flags.items()}
    if inbound is not None:
        sums["inbound_packets"] = F.sum(F.when(inbound, F.col(packets)).otherwise(0))
    return sums


def _traffic_features(df: DataFrame, seconds: int, flags: Mapping[str, str], inbound: Column | None) -> DataFrame:
    """Rates, ratios and the flood subtype from the sums.

    Subtype rules are this library's own: the protocol that carries at least 80 % of the packets names the
    flood; TCP with SYN on at least 80 % of its packets and ACK on at most 20 % is a SYN flood.
    """
    share = lambda c: safe_divide(F.col(c), F.col("packets_per_destination"))
    out = df.withColumn("packets_per_second", F.col("packets_per_destination") / seconds)
    out = out.withColumn("bidirectional_ratio", safe_divide(F.col("_back"), F.col("bytes_per_destination"))).drop("_back")
    if flags:
        out = out.withColumns({f"{n}_ratio": share(f"{n}_count") for n in flags})
    if inbound is not None:
        out = out.withColumn("outbound_packets", F.col("packets_per_destination") - F.col("inbound_packets")).withColumn("inbound_share", share("inbound_packets"))
    of_tcp = lambda c: safe_divide(F.col(c), F.col("tcp_packets"))
    syn = (of_tcp("syn_count") >= 0.8) & (of_tcp("ack_count") <= 0.2) if {"syn", "ack"} <= set(flags) else F.lit(False)
    return out.withColumn(
        "subtype",
        F.when(share("udp_packets") >= 0.8, "UDP_FLOOD").when(share("icmp_packets") >= 0.8, "ICMP_FLOOD")
        .when((share("tcp_packets") >= 0.8) & syn, "SYN_FLOOD").when(share("tcp_packets") >= 0.8, "TCP_FLOOD").otherwise("MIXED"),
    )


def ddos_window(
    df: DataFrame, ts: str = "ts", src: str = "src", dst: str = "dst", seconds: int = 60, protocol: str = "protocol",
    packets: str = "pkts", size: str = "bytes", reply: str | None = None, flags: Mapping[str, str] | None = None, inbound: Column | None = None,
) -> DataFrame:
    """Traffic onto each destination per window, with source diversity and a subtype label.

    ``reply`` names the bytes sent back, for the bidirectional ratio; ``flags`` the columns that count packets by TCP flag
    (names of ``FLAG_COUNTS``), for ratios and SYN floods; ``inbound`` tells which flows come from outside.
    """
    bucketed = df.withColumn("window_start", time_bucket(ts, seconds))
    key, flags = [dst, "window_start"], flags or {}
    base = bucketed.groupBy(*key).agg(*[v.alias(k) for k, v in _traffic_sums(packets, size, protocol, reply, flags, inbound).items()])
    spread = distinct_and_entropy(bucketed, key, src, "source_ips").withColumnRenamed("source_ips_entropy", "source_ip_entropy")
    return _traffic_features(join_on(base, spread, key), seconds, flags, inbound)


def _rolling(df: DataFrame, by: str, ts: str, seconds: int, step: int, sums: dict[str, Column], distinct: Mapping[str, str], exact: bool) -> DataFrame:
    """Windows of ``seconds`` that start at every multiple of ``step``, from buckets of one step.

    Rows are read once, into buckets; a window adds up its buckets. Distinct values are HyperLogLog sketches
    of the buckets, united per window; or, if ``exact``, the distinct values of each bucket, counted per window.
    """
    if seconds % step:
        raise ValueError("the window must be a multiple of the step")
    bucketed = df.withColumn("_bucket", time_bucket(ts, step))
    starts = F.explode(F.sequence(F.col("_bucket") - (seconds - step), F.col("_bucket"), F.lit(step).cast("long")))
    sketches = {} if exact else {f"_h_{n}": F.hll_sketch_agg(F.col(c).cast("string")) for n, c in distinct.items()}
    buckets = stage(bucketed.groupBy(by, "_bucket").agg(*[v.alias(k) for k, v in (sums | sketches).items()]))
    spread = buckets.withColumn("window_start", starts)
    united = [F.hll_sketch_estimate(F.hll_union_agg(f"_h_{n}")).alias(f"unique_{n}") for n in distinct] if not exact else []
    out = spread.groupBy(by, "window_start").agg(*[F.sum(k).alias(k) for k in sums], *united)
    for name, column in distinct.items() if exact else ():
        values = bucketed.groupBy(by, "_bucket", F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        per_window = values.withColumn("window_start", starts).groupBy(by, "window_start", "_v").agg(F.sum("_n").alias("_n"))
        out = join_on(out, per_window.groupBy(by, "window_start").agg(F.count("_v").alias(f"unique_{name}")), [by, "window_start"])
    return out


def rolling_ddos(
    df: DataFrame, ts: str = "ts", src: str = "src", dst: str = "dst", seconds: int = 60, step: int = 5, protocol: str = "protocol", packets: str = "pkts",
    size: str = "bytes", reply: str | None = None, flags: Mapping[str, str] | None = None, inbound: Column | None = None, exact: bool = False,
) -> DataFrame:
    """``ddos_window`` over windows that start every ``step`` seconds, without the entropy.

    Work follows rows plus windows, not rows times overlap. ``unique_source_ips`` is estimated from
    mergeable sketches (standard error about 1.6 %), or counted with ``exact``.
    """
    flags = flags or {}
    sums = _traffic_sums(packets, size, protocol, reply, flags, inbound)
    return _traffic_features(_rolling(df, dst, ts, seconds, step, sums, {"source_ips": src}, exact), seconds, flags, inbound)


def _scan_sums(failed: str, unanswered: Column | None, syn_only: Column | None, duration: str | None) -> dict[str, Column]:
    sums = {"connection_count": F.count(F.lit(1)), "failed_connections": F.count_if(F.col(failed))}
    sums |= {n: F.count_if(c) for n, c in (("unanswered_connections", unanswered), ("syn_only_connections", syn_only)) if c is not None}
    if duration:
        x = F.col(duration).cast("double")
        sums |= {"_d0": F.count(x), "_d1": F.coalesce(F.sum(x), F.lit(0.0)), "_d2": F.coalesce(F.sum(x * x), F.lit(0.0))}
    return sums


def _scan_features(df: DataFrame, seconds: int, full_score_at: int, unanswered: Column | None, syn_only: Column | None, duration: str | None) -> DataFrame:
    fan = F.greatest("unique_ports", "unique_hosts")
    of_all = lambda c: F.col(c) / F.col("connection_count")
    out = df.withColumn("fanout_rate", (F.col("unique_ports") + F.col("unique_hosts")) / seconds).withColumn("failed_ratio", of_all("failed_connections"))
    if unanswered is not None:
        out = out.withColumn("unanswered_ratio", of_all("unanswered_connections"))
    if syn_only is not None:
        out = out.withColumn("syn_only_ratio", of_all("syn_only_connections"))
    if duration:
        mean = F.when(F.col("_d0") > 0, F.col("_d1") / F.col("_d0"))
        spread = F.when(F.col("_d0") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("_d2") / F.col("_d0") - mean * mean)))
        out = out.withColumn("duration_mean", mean).withColumn("duration_std", spread).drop("_d0", "_d1", "_d2")
    return out.withColumn("scan_shape", F.when(F.col("unique_ports") >= F.col("unique_hosts"), "vertical").otherwise("horizontal")).withColumn(
        "heuristic_score", F.least(F.lit(1.0), fan / F.lit(float(full_score_at)))
    )


def scan_fanout(
    df: DataFrame, ts: str = "ts", src: str = "src", dst: str = "dst", port: str = "dst_port", failed: str = "failed", seconds: int = 60,
    full_score_at: int = 50, unanswered: Column | None = None, syn_only: Column | None = None, duration: str | None = None,
) -> DataFrame:
    """Fan-out of each source per window: hosts, ports, rate, failures and port entropy.

    ``unanswered`` and ``syn_only`` tell connections without an answer, and with nothing but SYN packets; ``duration`` names
    their seconds. ``heuristic_score`` grows with the larger fan-out up to 1; it is no probability.
    """
    bucketed = df.withColumn("window_start", time_bucket(ts, seconds))
    key = [src, "window_start"]
    base = bucketed.groupBy(*key).agg(*[v.alias(k) for k, v in _scan_sums(failed, unanswered, syn_only, duration).items()])
    ports = distinct_and_entropy(bucketed, key, port, "ports")
    hosts = distinct_and_entropy(bucketed, key, dst, "hosts").drop("hosts_entropy")
    return _scan_features(join_on(join_on(base, ports, key), hosts, key), seconds, full_score_at, unanswered, syn_only, duration)


def rolling_scan(
    df: DataFrame, ts: str = "ts", src: str = "src", dst: str = "dst", port: str = "dst_port", failed: str = "failed", seconds: int = 60, step: int = 5,
    full_score_at: int = 50, unanswered: Column | None = None, syn_only: Column | None = None, duration: str | None = None, exact: bool = False,
) -> DataFrame:
    """``scan_fanout`` over windows that start every ``step`` seconds, without the entropy; see ``rolling_ddos``."""
    sums = _scan_sums(failed, unanswered, syn_only, duration)
    rolled = _rolling(df, src, ts, seconds, step, sums, {"ports": port, "hosts": dst}, exact)
    return _scan_features(rolled, seconds, full_score_at, unanswered, syn_only, duration)


def dns_tunnel_features(
    df: DataFrame, by: Sequence[str], ts: str = "ts", query: str = "query", qtype: str = "qtype", rcode: str = "rcode",
    request: str = "request_bytes", response: str = "response_bytes", seconds: int = 3600, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """DNS tunnelling aggregates per key and window."""
    bucketed = df.withColumn("window_start", time_bucket(ts, seconds))
    key = [*by, "window_start"]
    upper = lambda c: F.upper(F.col(c))
    base = bucketed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("queries_per_window"),
        F.avg(F.length(query)).alias("query_length"),
        F.avg(entropy(F.col(query))).alias("query_entropy"),
        F.avg((upper(qtype) == "TXT").cast("double")).alias("txt_ratio"),
        F.avg((upper(rcode) == "NXDOMAIN").cast("double")).alias("nxdomain_ratio"),
        F.sum(request).alias("request_bytes"),
        F.sum(response).alias("response_bytes"),
    )
    distinct = bucketed.groupBy(*key, query).agg(F.lit(1).alias("_one")).groupBy(*key).agg(
        F.count(query).alias("unique_queries")
    )
    gaps = gaps_by_time(bucketed, key, ts, rows).select(*key, "iat_mean", "iat_std")
    joined = join_on(join_on(base, distinct, key), gaps, key)
    mean, std = F.col("iat_mean"), F.col("iat_std")
    return (
        joined.withColumn("unique_subdomain_ratio", F.col("unique_queries") / F.col("queries_per_window"))
        .withColumn("query_frequency", F.col("queries_per_window") / seconds)
        .withColumn("request_response_ratio", safe_divide(F.col("request_bytes"), F.col("response_bytes")))
        .withColumn("iat_cv", F.when(mean > 0, std / mean))
        .withColumn("burstiness", F.when(std + mean > 0, (std - mean) / (std + mean)))
    )


def exfil_volume(
    df: DataFrame, ts: str = "ts", src: str = "src", dst: str = "dst", out_bytes: str = "out_bytes",
    in_bytes: str = "in_bytes", out_pkts: str = "out_pkts", in_pkts: str = "in_pkts", seconds: int = 86_400,
) -> DataFrame:
    """Outbound volume of each source per window, with destination novelty and persistence.

    A destination is new to a source in the window that holds their first flow; persistence is the
    share of the windows from the source's first one up to this one in which it was active; repetition is the
    number of flows per destination; burstiness compares deviation and mean of the gaps between flows.
    """
    bucketed = df.withColumn("window_start", time_bucket(ts, seconds))
    pairs = bucketed.groupBy(src, dst, "window_start").agg(
        F.sum(out_bytes).alias("_ob"), F.sum(in_bytes).alias("_ib"), F.sum(out_pkts).alias("_op"),
        F.sum(in_pkts).alias("_ip"), F.count(F.lit(1)).alias("_n"),
        F.min(micros(ts)).alias("_from"), F.max(micros(ts)).alias("_to"),
    )
    first = pairs.groupBy(src, dst).agg(F.min("window_start").alias("_first"))
    seen = join_on(pairs, first, [src, dst])
    base = seen.groupBy(src, "window_start").agg(
        F.sum("_ob").alias("outbound_bytes"), F.sum("_ib").alias("inbound_bytes"),
        F.sum("_op").alias("outbound_packets"), F.sum("_ip").alias("inbound_packets"),
        F.sum("_n").alias("connection_count"), F.count(F.lit(1)).alias("destination_count"),
        F.count_if(F.col("_first") == F.col("window_start")).alias("new_destinations"),
        ((F.max("_to") - F.min("_from")) / F.lit(1e6)).alias("active_seconds"),
    )
    # one row per (source, window): at most the windows of the observed time
    so_far = {"_w0": ("min", F.col("window_start"), True), "_active": ("sum", F.lit(1), True)}
    spans = running(stage(base.select(src, "window_start")), [src], "window_start", so_far)
    gaps = gaps_by_time(bucketed, [src, "window_start"], ts).select(src, "window_start", "iat_mean", "iat_std")
    joined = join_on(join_on(base, spans, [src, "window_start"]), gaps, [src, "window_start"])
    windows = (F.col("window_start") - F.col("_w0")) / seconds + 1
    mean, std = F.col("iat_mean"), F.col("iat_std")
    rate = lambda c: safe_divide(F.col(c), F.col("active_seconds"))
    return (
        joined.withColumn("outbound_inbound_ratio", safe_divide(F.col("outbound_bytes"), F.col("inbound_bytes")))
        .withColumn("packet_ratio", safe_divide(F.col("outbound_packets"), F.col("inbound_packets")))
        .withColumn("outbound_bytes_per_second", rate("outbound_bytes"))
        .withColumn("inbound_bytes_per_second", rate("inbound_bytes"))
        .withColumn("destination_novelty", F.col("new_destinations") / F.col("destination_count"))
        .withColumn("temporal_persistence", F.col("_active") / windows)
        .withColumn("repetition", F.col("connection_count") / F.col("destination_count"))
        .withColumn("burstiness", F.when(std + mean > 0, (std - mean) / (std + mean)))
        .drop("_w0", "_active", "iat_mean", "iat_std")
    )


def domain_lexical(df: DataFrame, domain: str, words: DataFrame | None = None, word: str = "word") -> DataFrame:
    """Lexical features per row; with a word table also the share of labels found in it."""
    out = df.select("*", *[v.alias(k) for k, v in lexical_features(F.col(domain)).items()])
    if words is None:
        return out
    labels = df.select(domain).distinct().select(
        domain, F.explode(F.split(domain, r"[.\-_0-9]+")).alias("_label")
    ).filter("_label <> ''")
    known = words.select(F.col(word).alias("_label")).distinct().withColumn("_known", F.lit(1))
    matched = join_on(labels, known, ["_label"]).groupBy(domain).agg(
        F.avg(F.coalesce("_known", F.lit(0)).cast("double")).alias("dictionary_match_ratio")
    )
    return join_on(out, matched, [domain])


def domain_ngrams(df: DataFrame, domain: str, n: int = 2) -> DataFrame:
    """Character n-gram counts with document frequency and smoothed inverse document frequency."""
    names = df.select(domain).distinct()
    grams = names.select(domain, F.explode(char_ngrams(F.col(domain), n)).alias("gram"))
    counts = grams.groupBy(domain, "gram").agg(F.count(F.lit(1)).alias("_tf"))
    per_gram = counts.groupBy("gram").agg(F.sum("_tf").alias("occurrences"), F.count(F.lit(1)).alias("documents"))
    total = names.agg(F.count(F.lit(1))).scalar()
    return per_gram.withColumn("idf", F.log((total + 1) / (F.col("documents") + 1)))


def domain_tfidf(df: DataFrame, domain: str, ns: Sequence[int] = (2, 3), features: int = 1 << 16):
    """TF-IDF vectors of character n-grams: the frame and the fitted model, savable with it."""
    from pyspark.ml.feature import IDF, HashingTF

    grams = F.concat(*[char_ngrams(F.col(domain), n) for n in ns])
    hashed = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=features).transform(df.withColumn("_grams", grams))
    model = IDF(inputCol="_tf", outputCol="tfidf").fit(hashed)
    return model.transform(hashed).drop("_grams", "_tf"), model
