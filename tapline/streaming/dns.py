"""DNS queries and responses matched across two streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_dns_stream(
    queries: DataFrame, responses: DataFrame, on: Sequence[str], max_delay: float, query_ts: str = "query_ts", response_ts: str = "response_ts",
    query_id: str = "query_id", late_seconds: float = 5.0,
) -> DataFrame:
    """Each query with its first response on the same tuple and transaction within the delay: ``match_dns`` of two streams.

    An interval join with watermarks on both sides: a query waits ``max_delay`` and ``late_seconds`` of event time for responses,
    responses wait for late queries, and both are dropped from state after that. The first response of
    a query is an aggregate over the joined rows, so a query comes out once, when its time is over, without a response
    too. ``query_id`` with the query's columns names a query; rows without a time or with a null among ``on`` match nothing.
    """
    on, kept = list(on), list(queries.columns)
    micros = max(int(max_delay * 1_000_000), 1)
    asked = queries.withWatermark(query_ts, f"{late_seconds} seconds").alias("q")
    answers = responses.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(response_ts).alias("_response")).withWatermark("_response", f"{late_seconds} seconds")
    within = (F.col("_response") >= F.col(query_ts)) & (F.col("_response") <= F.col(query_ts) + F.expr(f"INTERVAL {micros} MICROSECONDS"))
    same = within
    for c in on:
        same = same & (F.col(f"q.{c}") == F.col(f"_{c}"))
    joined = asked.join(answers, same, "left_outer")
    first = joined.groupBy(*[F.col(f"q.{c}") for c in kept]).agg(F.min("_response").alias(response_ts))
    return first.select(*kept, response_ts)
