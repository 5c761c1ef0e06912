"""Result writers."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import evaluated
from pyspark.sql import types as T

from ..operators.chunks import join_on

_NUMERIC = (T.DoubleType, T.FloatType)


def write_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """Scored rows as csv, json or parquet. Collections become JSON text in csv files."""
    if fmt == "csv":
        nested = (T.ArrayType, T.MapType, T.StructType)
        df = df.select(
            *[
                F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
                for f in df.schema.fields
            ]
        )
    writer = df.write.mode(mode)
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    """A report as JSON with sorted keys; a NaN or infinity anywhere fails the job."""
    checked = []
    for name in sorted(report.columns):
        kind = report.schema[name].dataType
        column = F.col(name)
        if isinstance(kind, _NUMERIC):
            broken = F.isnan(column) | (F.abs(column) == float("inf"))
            column = F.when(broken, F.raise_error(F.lit(f"{name} is not finite")).cast(kind)).otherwise(column)
        checked.append(column.alias(name))
    report.select(*checked).write.mode(mode).option("ignoreNullFields", "false").json(path)


def save_features(df: DataFrame, path: str, helpers: Sequence[str] = (), by: str = "source", mode: str = "error") -> None:
    """Feature table without helper columns, partitioned by capture."""
    df.drop(*helpers).write.mode(mode).partitionBy(by).parquet(path)


def score_csv_to_jsonl(
    spark: SparkSession, path: str | Sequence[str], out: str, score: Callable[[DataFrame], DataFrame], mode: str = "error"
) -> None:
    """Score CSV records to JSON lines.

    ``score`` receives ``source`` (the whole path), ``source_file`` and ``seq`` (the line), so stateful
    features start afresh in every file. Every file is read by its own header: files are grouped by their
    header line, of which there are few, and a column that a file lacks is null in its rows.
    """
    from .zeek import numbered_lines, path_of_metadata

    lines = numbered_lines(spark, path).withColumn("source", path_of_metadata(F.col("source_path")))
    heads = lines.filter("line_number = 1").select("source", F.col("line").alias("header"))
    headers = sorted(r.header for r in heads.select("header").distinct().collect())
    body = join_on(lines.filter("line_number > 1 AND trim(line) <> ''"), heads, ["source"], "inner")
    if not headers:  # no line at all: nothing to score
        spark.createDataFrame([], "source string").write.mode(mode).json(out)
        return
    names = {h: [n.strip() for n in next(csv.reader([h]))] for h in headers}
    kept = {"source": F.col("source"), "source_file": F.col("source_file"), "seq": F.col("line_number")}
    # One pass: every line is parsed by its own header, and a column is taken from the headers that have it.
    parsed = {f"_r{i}": F.when(F.col("header") == h, F.from_csv("line", ", ".join(f"`{n}` string" for n in names[h]))) for i, h in enumerate(headers)}
    rows = evaluated(body.select(*[v.alias(k) for k, v in kept.items()], "line", "header"), list(kept), parsed)
    columns = dict.fromkeys(n for h in headers for n in names[h])
    of = lambda n: F.coalesce(*[F.col(f"_r{i}")[n] for i, h in enumerate(headers) if n in names[h]])
    score(rows.select(*kept, *[of(n).alias(n) for n in columns])).write.mode(mode).json(out)
