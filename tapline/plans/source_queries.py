"""Readers and writers over files that Spark writes from the given tables to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import flows as FL
from ..sources import sinks, zeek
from . import views as V
from .registry import Tables, query, rounded


def _folder(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/files-{uuid.uuid4().hex}"


def _files(t: Tables, folder: str) -> list[str]:
    """Data files below a folder, by path."""
    hadoop = t.spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(folder)
    found, out = place.getFileSystem(t.spark._jsc.hadoopConfiguration()).listFiles(place, True), []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().startswith("part-"):
            out.append(path.toString())
    return sorted(out)


def _sides(t: Tables, line) -> str:
    """Lines in two folders whose files have the same names."""
    folder = _folder(t)
    V.events(t).select((F.col("event_id") % 2).alias("side"), line.alias("value")).write.partitionBy("side").text(folder)
    return folder


@query(
    "replay_index",
    """SELECT count(*) AS records, count(*) AS places, count(*) AS ids, 0::bigint AS first_place, count(*)-1 AS last_place, 2::bigint AS folders,
  sum(event_id)::bigint AS id_sum FROM events""",
)
def replay_index(t: Tables):
    folder = _sides(t, F.to_json(F.struct("event_id", "user_id")))
    out = zeek.replay_scan(t.spark, _files(t, folder))
    side = F.regexp_extract("source_path", "/side=([0-9])/", 1)
    return out.agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("arrival_seq").alias("places"), F.count_distinct("event_id").alias("ids"),
        F.min("arrival_seq").alias("first_place"), F.max("arrival_seq").alias("last_place"), F.count_distinct(side).alias("folders"),
        F.sum(F.col("raw")["event_id"].cast("long")).alias("id_sum"),
    )


@query(
    "labelled_captures",
    """SELECT CASE WHEN event_id%2=1 THEN 1 ELSE 0 END::bigint AS label, count(*) AS rows, true AS sources_apart, sum(user_id)::bigint AS users FROM events GROUP BY 1""",
)
def labelled_captures(t: Tables):
    """Two captures whose files have the same names stay two sources."""
    folder = _folder(t)
    V.events(t).withColumn("side", F.col("event_id") % 2).select("side", "event_id", "user_id").write.partitionBy("side").csv(folder, header=True)
    out = FL.load_captures(t.spark, [(f"{folder}/side=0", 0), (f"{folder}/side=1", 1)])
    per_source = out.groupBy("source").agg(F.count_distinct("label").alias("labels"))
    joined = out.join(per_source, "source").groupBy("label")
    return rounded(joined.agg(F.count(F.lit(1)).alias("rows"), (F.max("labels") == 1).alias("sources_apart"), F.sum(F.col("user_id").cast("long")).alias("users")))


@query("csv_scoring", "SELECT event_id, round(value,6) AS value, user_id FROM (SELECT event_id, value, user_id FROM events)")
def csv_scoring(t: Tables):
    """Two captures with the same columns in another order, each read by its own header."""
    folder, out = _folder(t), _folder(t)
    rows = V.events(t).select(F.col("event_id").cast("string").alias("e"), F.col("value").cast("string").alias("v"), F.col("user_id").cast("string").alias("u"))
    rows.filter("e % 2 = 0").select("e", "v", "u").write.csv(f"{folder}/a", header=True)
    rows.filter("e % 2 = 1").select("u", "v", "e").write.csv(f"{folder}/b", header=True)
    typed = lambda df: df.select(F.col("e").cast("long").alias("event_id"), F.col("v").cast("double").alias("value"), F.col("u").cast("long").alias("user_id"))
    sinks.score_csv_to_jsonl(t.spark, [f"{folder}/a", f"{folder}/b"], out, typed)
    return rounded(t.spark.read.schema("event_id long, value double, user_id long").json(out))


@query("result_csv", "SELECT event_id, event_type, '[\"'||event_type||'\",\"'||user_id||'\"]' AS tags FROM events")
def result_csv(t: Tables):
    folder = _folder(t)
    rows = V.events(t).select("event_id", "event_type", F.array("event_type", F.col("user_id").cast("string")).alias("tags"))
    sinks.write_results(rows, folder)
    return t.spark.read.schema("event_id long, event_type string, tags string").option("escape", "\\").csv(folder, header=True)


@query(
    "capture_inventory",
    """SELECT count(*) AS rows, 2::bigint AS columns, 'o_orderkey,o_custkey' AS schema, true AS copies_found FROM orders""",
)
def capture_inventory(t: Tables):
    """A capture and its copy: every file has a peer of the same digest."""
    folder = _folder(t)
    rows = t.orders.select("o_orderkey", "o_custkey").repartition(4, "o_orderkey").sortWithinPartitions("o_orderkey", "o_custkey")
    for name in ("a", "b"):
        rows.write.csv(f"{folder}/{name}", header=True)
    found: DataFrame = FL.capture_inventory(t.spark, folder).filter("rows > 0")
    return rounded(
        found.groupBy("columns", "schema").agg((F.sum("rows") / 2).cast("long").alias("rows"), (F.min("identical_files") >= 2).alias("copies_found"))
    )
