"""Raw sensor records to normalised events, with a reason for every refused record."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import evaluated, field, parse_ts, present_int, strict_int, ts_reject

# Supported event types and the fields each must carry.
SUPPORTED_TYPES = ("conn", "dns", "ssl", "tls", "packet")
ENDPOINT_TYPES = ("conn", "dns", "ssl", "tls")
ENDPOINT_FIELDS = ("id.orig_h", "id.resp_h")

# Record aliases of each event column.
ALIASES = {
    "source_ip": ("id.orig_h", "src", "source_ip"),
    "destination_ip": ("id.resp_h", "dst", "destination_ip"),
    "source_port": ("id.orig_p", "src_port", "source_port"),
    "destination_port": ("id.resp_p", "dst_port", "destination_port"),
    "protocol": ("proto", "protocol"),
    "flow_id": ("uid", "flow_id", "connection_id"),
    "direction": ("direction", "conn_state_direction"),
}

# Model features a connection record carries under another name.
CONN_FEATURES = {
    "Destination Port": "id.resp_p",
    "Total Fwd Packets": "orig_pkts",
    "Total Backward Packets": "resp_pkts",
    "Protocol": "ip_proto",
}


_COUNTERS = {"bytes": ("bytes", "orig_bytes", "resp_bytes"), "packets": ("packets", "orig_pkts", "resp_pkts")}


def normalize(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the normalised columns and ``reject_reason``; other columns stay.

    Three projections: look fields up, parse them, judge them. Each value is computed once, which
    keeps the generated code small.
    """
    kept = [c for c in df.columns if c not in ("event_type", "reject_reason")]
    given = evaluated(df, kept, {"_given": F.map_filter(raw, lambda _, v: (v != "") & (v != "-"))})
    first = lambda *names: F.coalesce(*[field("_given", n) for n in names])
    looked_up = {"event_type": F.lower(F.trim(first("event_type", "type", "log_type")))}
    looked_up |= {f"_f{i}": field(raw, n) for i, n in enumerate(("ts", *ENDPOINT_FIELDS))}
    looked_up |= {f"_t_{n}": first(*names) for n, names in ALIASES.items()}
    looked_up |= {f"_c_{n}": first(n) for names in _COUNTERS.values() for n in names}
    found = evaluated(given, kept, looked_up)
    # one expression over an array instead of eight copies keeps the generated method small
    texts = {n: f"_t_{n}" for n in ("source_port", "destination_port")}
    texts |= {f"_i_{n}": f"_c_{n}" for names in _COUNTERS.values() for n in names}
    numbers = {
        "observed_at": parse_ts(F.col("_f0")),
        "_numbers": F.transform(F.array(*[F.col(c) for c in texts.values()]), strict_int),
    }
    numbered = evaluated(found, found.columns, numbers)
    parsed = numbered.select(
        *[c for c in numbered.columns if c != "_numbers"],
        *[F.col("_numbers")[i].alias(n) for i, n in enumerate(texts)],
    )
    bad = lambda text, number: F.when(F.col(number).isNull(), F.col(text))
    counts, faults = {}, [bad("_t_source_port", "source_port"), bad("_t_destination_port", "destination_port")]
    for name, (direct, first, second) in _COUNTERS.items():
        given = F.col(f"_c_{direct}").isNotNull()
        either = F.col(f"_i_{first}").isNotNull() | F.col(f"_i_{second}").isNotNull()
        added = F.coalesce(f"_i_{first}", F.lit(0)) + F.coalesce(f"_i_{second}", F.lit(0))
        counts[name] = F.when(given, F.col(f"_i_{direct}")).otherwise(F.when(either, added))
        of = lambda n: bad(f"_c_{n}", f"_i_{n}")
        faults.append(F.when(given, of(direct)).otherwise(F.coalesce(of(first), of(second))))
    totals = parsed.select("*", *[v.alias(k) for k, v in counts.items()], F.coalesce(*faults).alias("_fault"))
    text = ("source_ip", "destination_ip", "protocol", "flow_id", "direction")
    named = totals.select(
        "*", *[F.col(f"_t_{n}").alias(n) for n in text]
    )
    out = evaluated(named, named.columns, {"reject_reason": _reject_reason()})
    return out.select(
        *kept, "observed_at", "event_type", *text[:2],
        *[F.col(n).cast("int").alias(n) for n in ("source_port", "destination_port")],
        *text[2:3], "bytes", "packets", *text[3:], "reject_reason",
    )


def _missing(column: str, name: str) -> Column:
    return F.when(
        F.col(column).isNull() | (F.col(column) == ""),
        F.concat("event_type", F.lit(f" event is missing required field: {name}")),
    )


def _reject_reason() -> Column:
    """First rule a record breaks, in the order the fields are read; null for a good record."""
    kind = F.col("event_type")
    endpoints = F.coalesce(*[_missing(f"_f{i}", n) for i, n in enumerate(ENDPOINT_FIELDS, start=1)])
    negative = [F.when(F.col(n) < 0, F.lit(f"{n} must not be negative")) for n in _COUNTERS]
    return F.coalesce(
        F.when(kind.isNull(), F.lit("Zeek record is missing event type")),
        F.when(~kind.isin(*SUPPORTED_TYPES), F.concat(F.lit("Unsupported Zeek event type: '"), kind, F.lit("'"))),
        _missing("_f0", "ts"),
        F.when(kind.isin(*ENDPOINT_TYPES), endpoints),
        F.when(F.col("observed_at").isNull(), ts_reject(F.col("_f0"))),
        F.concat(F.lit("Expected integer value, got '"), F.col("_fault"), F.lit("'")),
        *negative,
    )


def zeek_conn_features(raw: str = "raw") -> Column:
    """Raw map with model feature names added for connection records.

    Directional features are withheld when the history shows that the sensor flipped the
    direction. A feature that is there already stays; a value that is no integer is skipped.
    """
    flipped = F.coalesce(field(raw, "history"), F.lit("")).contains("^")
    entries = []
    for target, source in CONN_FEATURES.items():
        value = present_int(raw, source).cast("string")
        if target != "Protocol":
            value = F.when(~flipped, value)
        value = F.when(~F.map_contains_key(raw, F.lit(target)), value)
        entries.append(F.struct(F.lit(target).alias("key"), value.alias("value")))
    added = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    is_conn = F.coalesce(F.lower(F.trim(field(raw, "event_type"))) == "conn", F.lit(False))
    return F.when(is_conn, F.map_concat(F.col(raw), added)).otherwise(F.col(raw))


def missing_fields(contract: Sequence[str]) -> Column:
    """Names of contract columns that are null in a row."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in contract]))


def select_contract(df: DataFrame, contract: Sequence[str], name: str = "vector") -> DataFrame:
    """Add the exact contract columns as one struct, or null, and the missing names."""
    known = [c for c in contract if c in df.columns]
    absent = [c for c in contract if c not in df.columns]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in known], F.lit(not absent))
    vector = F.struct(*[F.col(c) if c in known else F.lit(None).cast("double").alias(c) for c in contract])
    lost = F.concat(missing_fields(known), F.array(*[F.lit(c) for c in absent]).cast("array<string>"))
    return df.withColumn(name, F.when(complete, vector)).withColumn("missing_inputs", lost)


def validate_contract(df: DataFrame, contract: Sequence[str]) -> DataFrame:
    """One row: missing and unexpected columns, and how many rows hold a null or non-finite value."""
    missing = [c for c in contract if c not in df.columns]
    unexpected = [c for c in df.columns if c not in contract]
    known = [F.col(c).cast("double") for c in contract if c in df.columns]
    finite = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in known], F.lit(True))
    names = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("non_finite_rows")
    ).select(
        "*",
        names(missing).alias("missing"),
        names(unexpected).alias("unexpected"),
        F.lit([c for c in df.columns if c in contract] == list(contract)).alias("ordered"),
    )


def check_contract_metadata(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """Add ``reject_reason`` to predictions whose metadata conflicts with the detector contract."""
    conflicts = [
        F.when(F.col(c).isNotNull() & (F.col(c) != F.lit(v)), F.lit(f"output {c} conflicts with contract"))
        for c, v in contract.items()
    ]
    return df.withColumn("reject_reason", F.coalesce(*conflicts))


def five_tuple(df: DataFrame, name: str = "grouping_key") -> DataFrame:
    return df.withColumn(
        name, F.struct("source_ip", "destination_ip", "source_port", "destination_port", "protocol")
    )


def drop_non_routable(df: DataFrame, src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    from ..functions.scoring import is_non_routable

    return df.filter(~(is_non_routable(F.col(src)) | is_non_routable(F.col(dst))))


# Sensor field aliases of session transport metadata.
_QUIC_FLAGS = {
    "zero_rtt_observed": ("quic_0rtt", "zero_rtt", "early_data"),
    "handshake_confirmed": ("quic_handshake_confirmed", "handshake_confirmed"),
    "connection_migration_observed": (
        "quic_migration", "connection_migration", "migrated", "quic_peer_address_changed",
    ),
}
_QUIC_COUNTS = {
    "observed_stream_count": ("quic_stream_count", "stream_count", "streams_observed"),
    "active_stream_count": ("quic_active_streams", "active_stream_count"),
}
_QUIC_IDS = ("quic_connection_id", "quic_dcid", "dcid", "connection_id")


def quic_metadata(raw: str = "raw") -> Column:
    """Struct of transport metadata; records that are not QUIC get the default struct."""
    from ..functions.parsing import truthy

    lower = lambda n: F.lower(F.coalesce(field(raw, n), F.lit("")))
    named = F.exists(
        F.map_values(raw), lambda v: F.coalesce(F.lower(v).rlike("quic|http3|h3"), F.lit(False))
    )
    is_quic = (lower("proto") == "udp") & (lower("service").contains("quic") | named)
    first = lambda names: F.coalesce(*[field(raw, n) for n in names])
    flags = {k: reduce(lambda a, b: a | b, [truthy(field(raw, n)) for n in v]) for k, v in _QUIC_FLAGS.items()}
    counts = {k: F.greatest(F.lit(0).cast("long"), strict_int(first(v))) for k, v in _QUIC_COUNTS.items()}
    counts = {k: F.when(strict_int(first(_QUIC_COUNTS[k])).isNotNull(), v) for k, v in counts.items()}
    return F.struct(
        is_quic.alias("is_quic"),
        *[(is_quic & v).alias(k) for k, v in flags.items()],
        *[F.when(is_quic, v).alias(k) for k, v in counts.items()],
        F.when(is_quic, first(_QUIC_IDS)).alias("connection_id"),
        F.when(is_quic, F.lit("sensor_transport_metadata")).otherwise("not_quic").alias("evidence_source"),
    )
