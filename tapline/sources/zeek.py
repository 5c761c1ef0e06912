"""Sensor log readers: tab-separated logs with a field header and JSON lines.

A reader never raises on a bad line. It returns the line with ``reject_reason`` set, and
``split_rejects`` parts good rows from bad ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import evaluated
from ..operators.chunks import if_small, join_on
from ..session import stage

# Log names that give an event type.
EVENT_TYPES = ("conn", "dns", "ssl", "tls", "packet")

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("uid", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("src_port", T.LongType()),
        T.StructField("dst_port", T.LongType()),
        T.StructField("proto", T.LongType()),
        T.StructField("payload_len", T.LongType()),
        T.StructField("tcp_flags", T.LongType()),
        T.StructField("flow_complete", T.BooleanType()),
        T.StructField("flow_start_ts", T.TimestampType()),
    ]
)


def text_lines(reader) -> DataFrame:
    """Lines of a text scan, batch or streaming, with where they come from."""
    return reader.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def plain_path(path: Column) -> Column:
    """A path without scheme, authority and repeated slashes, to match a configured file with a scanned one."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/+", "/")


def path_of_metadata(path: Column) -> Column:
    """``plain_path`` of a scan's file path, which is written as an encoded URI."""
    return plain_path(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def number_lines(lines: DataFrame) -> DataFrame:
    """Add an exact ``line_number``.

    The rows of one file split are consecutive within a scan partition, so a line's place in its
    split is a difference of row ids, and the splits before it add a sum of counts. Nothing is
    sorted and no file passes through one task.
    """
    lines = lines.withColumn("_row", F.monotonically_increasing_id())
    blocks = lines.groupBy("source_path", "_block").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy("source_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    joined = join_on(lines, if_small(stage(blocks.drop("_n"))), ["source_path", "_block"], "inner")
    number = F.col("_offset") + F.col("_row") - F.col("_first") + 1
    return joined.withColumn("line_number", number).drop("_block", "_row", "_first", "_offset")


def numbered_lines(spark: SparkSession | DataFrameReader, path: str | Sequence[str]) -> DataFrame:
    reader = spark.read if isinstance(spark, SparkSession) else spark
    return number_lines(text_lines(reader.text(path)))


def event_type_of(file_name: Column) -> Column:
    stem = F.regexp_extract(file_name, r"^(.*?)(\.[^.]*)?$", 1)
    return F.when(stem.isin(*EVENT_TYPES), stem)


def split_tsv(line: Column) -> Column:
    """Tab-separated values; a value that opens with a quote may hold tabs and doubled quotes."""
    quoted = F.regexp_extract_all(
        F.concat(line, F.lit("\t")), F.lit(r"((?:\"(?:[^\"]|\"\")*\"[^\t]*)|[^\t]*)\t"), F.lit(1)
    )
    unquote = lambda v: F.when(
        v.startswith('"'),
        F.regexp_replace(F.regexp_replace(v, r'^"((?:[^"]|"")*)"', "$1"), '""', '"'),
    ).otherwise(v)
    return F.when(F.instr(line, '"') > 0, F.transform(quoted, unquote)).otherwise(F.split(line, "\t"))


def parse_fields(line: Column) -> Column:
    """Column names of a ``#fields`` header line."""
    return F.split(F.regexp_replace(line, r"^#fields[\t ]*", ""), "\t")


def decode_lines(lines: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Lines with ``fields`` (null outside tab-separated files) to raw maps and reject reasons.

    Header, comment and blank lines are dropped. Unparsable lines keep their text. Lines over ``max_chars``
    are refused; by default a line may have any length.
    """
    body = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    values = split_tsv(F.col("line"))
    named = F.map_from_arrays(
        F.col("fields"), F.transform(F.col("_values"), lambda v: F.when(v != "-", v))
    )
    kind = event_type_of(F.col("source_file"))
    too_long = F.lit(False) if max_chars is None else F.length("line") > max_chars
    undecodable = ~F.is_valid_utf8("line")
    width = F.size("_values") != F.size("fields")
    where = F.col("line_number").cast("string")
    reason = (
        F.when(too_long, F.concat(F.lit("Oversized line "), where))
        .when(undecodable, F.concat(F.lit("Undecodable text on line "), where))
        .when(
            F.col("fields").isNotNull() & width,
            F.concat(
                F.lit("Zeek TSV line "), where, F.lit(" has "), F.size("_values").cast("string"),
                F.lit(" values; expected "), F.size("fields").cast("string"),
            ),
        )
        .when(
            F.col("fields").isNull() & F.col("_json").isNull(),
            F.when(
                F.col("line").rlike(r"^\s*(\[.*\]|\".*\"|-?[0-9.eE+-]+|true|false|null)\s*$"),
                F.concat(F.lit("Zeek record on line "), where, F.lit(" is not an object")),
            ).otherwise(F.concat(F.lit("Invalid JSON on line "), where)),
        )
    )
    with_type = lambda raw, overwrite: F.when(kind.isNull(), raw).otherwise(
        F.map_concat(F.map_filter(raw, lambda k, _: k != "event_type"), F.create_map(F.lit("event_type"), kind))
        if overwrite
        else F.when(F.map_contains_key(raw, F.lit("event_type")), raw).otherwise(
            F.map_concat(raw, F.create_map(F.lit("event_type"), kind))
        )
    )
    in_table = F.col("fields").isNotNull()
    decoded = {
        "_values": F.when(in_table, values),
        "_json": F.when(~in_table, F.from_json("line", "map<string,string>")),
    }
    parsed = evaluated(body, body.columns, decoded)
    flagged = evaluated(parsed, parsed.columns, {"reject_reason": reason})
    raw = F.when(
        F.col("reject_reason").isNull(),
        F.when(F.col("fields").isNotNull(), with_type(named, True)).otherwise(with_type(F.col("_json"), False)),
    )
    kept = [c for c in flagged.columns if c not in ("_values", "_json", "fields")]
    return evaluated(flagged, kept, {"raw": raw})


def attach_headers(lines: DataFrame) -> DataFrame:
    """Add ``fields``: the names of the last header above each line of its file, null without one."""
    headers = lines.filter(F.col("line").startswith("#fields")).select(
        "source_path", F.col("line_number").alias("_at"), parse_fields(F.col("line")).alias("_names")
    )
    # One small row per file: its headers in line order.
    per_file = headers.groupBy("source_path").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_names"))).alias("_headers")
    )
    joined = join_on(lines, if_small(stage(per_file)), ["source_path"])
    above = F.filter("_headers", lambda h: h["_at"] < F.col("line_number"))
    return joined.withColumn("fields", F.try_element_at(above, F.lit(-1))["_names"]).drop("_headers")


def read_zeek(spark: SparkSession, path: str | Sequence[str], max_chars: int | None = None) -> DataFrame:
    """Raw records of sensor logs in either form, with file, line number and reject reason.

    A header names the columns of the lines below it up to the next header of the same file. Lines
    above any header are JSON.
    """
    return decode_lines(attach_headers(numbered_lines(spark, path)), max_chars)


def read_zeek_tsv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return read_zeek(spark, path)


def read_zeek_json(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """JSON-lines logs only, so no header lookup is planned."""
    lines = numbered_lines(spark, path)
    return decode_lines(lines.withColumn("fields", F.lit(None).cast("array<string>")))


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = df.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = df.filter(F.col("reject_reason").isNotNull())
    return good, bad


def replay_scan(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Decoded records in configured file order with a global ``arrival_seq`` and ``event_id``.

    The index counts every decoded record from 0, also those that normalisation refuses later. It is
    a file offset plus the record's rank in its file; files are told apart by their whole path: records before a line are those lines less the
    ones dropped, counted per block of lines, so no single task orders the whole replay.
    """
    from ..operators.chunks import running

    rank = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "file_rank int, source_path string")
    rank = rank.withColumn("source_path", plain_path(F.col("source_path")))
    decoded = read_zeek(spark, list(files)).withColumn("source_path", path_of_metadata(F.col("source_path")))
    good, _ = split_rejects(decoded)
    ranked = good.join(F.broadcast(rank), "source_path")  # one row per configured file
    placed = running(
        ranked.withColumn("_one", F.lit(1)), ["file_rank"], "line_number",
        {"_in_file": ("sum", F.col("_one"), False)},
    ).drop("_one")
    counts = ranked.groupBy("file_rank").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("file_rank").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = counts.select("file_rank", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    indexed = join_on(placed, offsets, ["file_rank"])
    return (
        indexed.withColumn("arrival_seq", F.col("_offset") + F.col("_in_file"))
        .withColumn("event_id", F.concat_ws(":", "source_file", F.col("arrival_seq").cast("string")))
        .drop("_in_file", "_offset")
    )


def packet_rows(raw: DataFrame) -> DataFrame:
    """Packet records of a raw frame in their fixed types; the raw map stays for parse reasons."""
    from ..functions.parsing import field, flag_marker, parse_ts, present, present_int

    packets = raw.filter(field("raw", "event_type") == "packet")
    return packets.select(
        "*",
        parse_ts(field("raw", "ts")).alias("ts"),
        present(F.coalesce(field("raw", "uid"), field("raw", "flow_id"))).alias("uid"),
        present(field("raw", "src")).alias("src"),
        present(field("raw", "dst")).alias("dst"),
        *[present_int("raw", n).alias(n) for n in ("src_port", "dst_port", "proto", "payload_len", "tcp_flags")],
        flag_marker(field("raw", "flow_complete")).alias("flow_complete"),
        parse_ts(present(field("raw", "flow_start_ts"))).alias("flow_start_ts"),
    )
