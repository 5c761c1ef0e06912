"""Causal context of ordered records: rolling statistics, deltas and deviations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_ROWS, over_previous
from .features import dns_base_features

# DNS record features that get rolling context, and those that get deltas.
CONTEXT_FEATURES = (
    "rr", "PTR_frequency", "rr_count", "rr_name_entropy", "rr_name_length", "distinct_ns", "ttl_mean", "ttl_variance",
    "country_count", "asn_count", "domain_count", "ttl_unique_count", "ttl_range", "reverse_dns_known", "is_A_record",
    "is_PTR_record", "rr_entropy_per_length", "ttl_variance_ratio",
)
DELTA_FEATURES = ("rr", "PTR_frequency", "rr_name_entropy", "rr_name_length", "ttl_mean", "ttl_variance")
# Order of the exfiltration vector.
EXFIL_FEATURES = (
    "rr_count_prev20_mean", "ttl_range_prev20_mean", "ttl_variance_prev20_std", "ttl_mean_prev20_mean",
    "rr_name_length_prev20_mean", "PTR_frequency_prev20_mean", "is_PTR_record_prev20_mean",
    "reverse_dns_known_prev20_mean", "ttl_unique_count_prev20_mean", "rr_entropy_per_length_prev20_mean",
)
HISTORY = 20


def _mean(column: str, n: int):
    return lambda w: F.avg(F.col(column).cast("double")).over(w.rowsBetween(-n, -1))


def _std(column: str, n: int):
    return lambda w: F.stddev_samp(F.col(column).cast("double")).over(w.rowsBetween(-n, -1))


def _zero(make):
    return lambda w: F.coalesce(make(w), F.lit(0.0))


def rolling_context(
    df: DataFrame, by: Sequence[str], seq: str, columns: Sequence[str], spans: Sequence[int] = (5, 20),
    fill_zero: bool = True, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Mean and sample deviation of the previous records of the key, the current one excluded.

    All columns and spans share one chunked ordering. A mean needs one record before, a deviation
    two; without them the value is 0.
    """
    wrap = _zero if fill_zero else (lambda make: make)
    added = {}
    for column in columns:
        for n in spans:
            added[f"{column}_prev{n}_mean"] = wrap(_mean(column, n))
            added[f"{column}_prev{n}_std"] = wrap(_std(column, n))
    return over_previous(df, by, seq, max(spans), added, rows)


def delta_prev(df: DataFrame, by: Sequence[str], seq: str, columns: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Difference to the previous record; null for the first."""
    step = lambda c: lambda w: F.col(c) - F.lag(c).over(w)
    return over_previous(df, by, seq, 1, {f"{c}_delta_prev": step(c) for c in columns}, rows)


def vs_prev(
    df: DataFrame, by: Sequence[str], seq: str, columns: Sequence[str], n: int = HISTORY, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Difference to the mean of the previous ``n`` records; null for the first."""
    off = lambda c: lambda w: F.col(c) - _mean(c, n)(w)
    return over_previous(df, by, seq, n, {f"{c}_vs_prev{n}": off(c) for c in columns}, rows)


def exfil_context(df: DataFrame, by: Sequence[str], seq: str, rows: int = CHUNK_ROWS, derive: bool = True) -> DataFrame:
    """The ten previous-20 features of a DNS stream and how many records they rest on."""
    base = dns_base_features(df, lenient=False) if derive else df
    added = {}
    for name in EXFIL_FEATURES:
        column, _, stat = name.rsplit("_", 2)
        added[name] = _zero((_mean if stat == "mean" else _std)(column, HISTORY))
    added["history_records_used"] = lambda w: F.count(F.lit(1)).over(w.rowsBetween(-HISTORY, -1))
    return over_previous(base, by, seq, HISTORY, added, rows)
