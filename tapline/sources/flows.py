"""Flow-record readers and capture inventories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import to_number_or_zero
from ..functions.scoring import is_botnet

# Alternative column names of flow exports, first present wins.
NETFLOW_NAMES = {
    "bytes": ("Bytes", "TotBytes", "bytes"),
    "pkts": ("Pkts", "TotPkts", "pkts"),
    "protocol": ("Proto", "Protocol", "proto", "protocol"),
    "flow_dir_reverse": ("FlowDir_Reverse", "flow_dir_reverse"),
}


def trimmed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def first_column(df: DataFrame, names: Sequence[str], default: Column) -> Column:
    """The first of the named columns that exists."""
    return next((F.col(n) for n in names if n in df.columns), default)


def netflow_columns(df: DataFrame) -> DataFrame:
    """Typed flow columns from any of the known exports.

    ``StartTime`` counts whole seconds, ``StartTimeUnix`` keeps fractions. Epochs stay doubles, as
    their differences go below a microsecond.
    """
    if "StartTime" in df.columns:
        stamp = F.unix_seconds(F.regexp_replace("StartTime", "/", "-").try_cast("timestamp")).cast("double")
    elif "StartTimeUnix" in df.columns:
        stamp = F.col("StartTimeUnix").try_cast("double")
    else:
        raise ValueError("a flow file needs StartTime or StartTimeUnix")
    zero, empty = F.lit("0"), F.lit("")
    return df.select(
        stamp.alias("timestamp_unix"),
        F.col("SrcAddr").alias("src"),
        F.col("DstAddr").alias("dst"),
        to_number_or_zero(first_column(df, NETFLOW_NAMES["bytes"], zero)).alias("bytes"),
        to_number_or_zero(first_column(df, NETFLOW_NAMES["pkts"], zero)).alias("pkts"),
        F.coalesce(first_column(df, NETFLOW_NAMES["protocol"], empty), empty).alias("protocol"),
        (to_number_or_zero(first_column(df, NETFLOW_NAMES["flow_dir_reverse"], zero)) != 0).alias("flow_dir_reverse"),
        is_botnet(F.col("Label")).alias("target"),
    )


def read_netflow_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return netflow_columns(trimmed(spark.read.csv(path, header=True)))


def load_captures(spark: SparkSession, captures: Sequence[tuple[str, int]]) -> DataFrame:
    """Union of labelled capture files with ``label``, ``source`` (the whole path) and ``source_file`` (its name)."""
    from .zeek import path_of_metadata

    frames = [
        trimmed(
            spark.read.csv(path, header=True).select(
                "*",
                path_of_metadata(F.col("_metadata.file_path")).alias("source"),
                F.col("_metadata.file_name").alias("source_file"),
            )
        ).withColumn("label", F.lit(label))
        for path, label in captures
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def capture_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per capture file below a folder: size, digest, rows, header, copies and schema peers.

    The digest combines the MD5 of every numbered line by addition, so a file of any size is read in
    splits. Files of equal size and digest hold the same lines.
    """
    from .zeek import numbered_lines

    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    sizes = read.format("binaryFile").load(path).select(
        F.regexp_replace("path", "^file:/+", "/").alias("source_path"), F.col("length").alias("bytes")
    )
    lines = numbered_lines(read, path).withColumn("source_path", F.regexp_replace("source_path", "^file:/+", "/"))
    digest = F.md5(F.concat_ws(":", F.col("line_number").cast("string"), "line"))
    part = lambda start: F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    shape = lines.groupBy("source_path").agg(
        (F.count_if(F.trim("line") != "") - 1).alias("rows"),
        F.min_by("line", "line_number").alias("_header"),
        part(1).alias("_a"),
        part(17).alias("_b"),
    )
    names = F.transform(F.split("_header", ","), lambda c: F.trim(c))
    described = sizes.join(shape, "source_path", "left").select(
        "source_path",
        "bytes",
        "rows",
        F.size(names).alias("columns"),
        F.array_join(names, ",").alias("schema"),
        F.md5(F.concat_ws(":", F.col("bytes").cast("string"), "_a", "_b")).alias("digest"),
    )
    copies = described.groupBy("digest").agg(F.count(F.lit(1)).alias("identical_files"))
    peers = described.groupBy("schema").agg(F.count(F.lit(1)).alias("schema_files"))
    return described.join(copies, "digest").join(peers, "schema")
