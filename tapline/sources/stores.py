"""Stored tables that grow: alerts merged by key into buckets, and tables kept by day."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
MOST_DELTAS = 8


def _children(spark: SparkSession, path: str, prefix: str) -> dict[str, str]:
    """Value and path of the partition folders ``prefix=value`` below a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return {}
    names = [s.getPath() for s in files.listStatus(place)]
    return {p.getName().split("=", 1)[1]: p.toString() for p in names if p.getName().startswith(prefix + "=")}


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _overwrite_parts(df: DataFrame, path: str, parts: list[str]) -> None:
    """Replace the partitions that ``df`` has rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


class BucketStore:
    """One row for each key, the newest by ``order``, in a folder of buckets by the key's hash.

    A batch adds one delta to each bucket that it has keys of, under its own number, so running it again replaces what it
    wrote. A bucket with more than ``most_deltas`` of them is folded into one: the fold is written under the
    number of its last delta before the older ones are deleted, and as the newest row of a key wins, a fold that
    was cut short changes no result. What a batch writes follows the batch and, over ``most_deltas`` batches, one fold.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "alert_id", order: str = "observed_at", buckets: int = BUCKETS, most_deltas: int = MOST_DELTAS):
        self.spark, self.path, self.key, self.order, self.buckets, self.most_deltas = spark, path, key, order, buckets, most_deltas

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The newest row of each key; of equally new ones, the one of the later batch, then by hash."""
        kept = [c for c in rows.columns if c not in ("bucket", "batch")]
        rank = F.struct(F.col(self.order), *([F.col("batch")] if "batch" in rows.columns else []), F.xxhash64(*kept))
        grouped = rows.groupBy(self.key).agg(F.max_by(F.struct(*kept), rank).alias("_r"))
        return grouped.select("_r.*")

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Add a batch. Batches count upwards; the same number again replaces the earlier run."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        for stale in (p for b in _children(self.spark, self.path, "bucket").values() for n, p in _children(self.spark, b, "batch").items() if int(n) == 2 * batch):
            _delete(self.spark, stale)
        placed = self._newest(rows).withColumn("bucket", bucket).withColumn("batch", F.lit(2 * batch).cast("long"))
        _overwrite_parts(placed.repartition("bucket"), self.path, ["bucket", "batch"])
        self.fold()

    def fold(self) -> None:
        """Fold the buckets with too many deltas. Folds have odd numbers: that of their last delta, and one."""
        full = {}
        for bucket, folder in _children(self.spark, self.path, "bucket").items():
            batches = sorted(int(n) for n in _children(self.spark, folder, "batch"))
            if len(batches) > self.most_deltas:
                full[int(bucket)] = batches
        if not full:
            return
        last = F.create_map(*[F.lit(x) for b, batches in full.items() for x in (b, batches[-1] | 1)])
        rows = self._rows().filter(F.col("bucket").isin(list(full)))
        kept = [c for c in rows.columns if c not in ("bucket", "batch")]
        rank = F.struct(F.col(self.order), F.col("batch"), F.xxhash64(*kept))
        newest = rows.groupBy("bucket", self.key).agg(F.max_by(F.struct(*kept), rank).alias("_r"))
        folded = newest.select("_r.*", "bucket", last[F.col("bucket")].cast("long").alias("batch"))
        _overwrite_parts(folded.repartition("bucket"), self.path, ["bucket", "batch"])
        for bucket, batches in full.items():
            for n in batches:
                if n != batches[-1] | 1:
                    _delete(self.spark, f"{self.path}/bucket={bucket}/batch={n}")

    def _rows(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def read(self) -> DataFrame:
        """The newest row of every key."""
        return self._newest(self._rows())

    def writer(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return self.merge


def write_days(df: DataFrame, path: str, ts: str = "ts", day: str = "day") -> None:
    """Store rows by the day of ``ts``; days that ``df`` has rows of are replaced, the others stay. Rows without a time go to no day and are refused."""
    dated = df.withColumn(day, F.to_date(F.col(ts).cast("timestamp")))
    if not dated.filter(F.col(day).isNull()).isEmpty():
        raise ValueError(f"rows without {ts} belong to no day")
    _overwrite_parts(dated, path, [day])


def read_days(spark: SparkSession, path: str, newest: date, days: int, ts: str = "ts", day: str = "day") -> DataFrame:
    """Rows of the last ``days`` days up to ``newest``; only their folders are read."""
    return spark.read.parquet(path).filter(F.col(day).between(F.lit(newest - timedelta(days=days - 1)), F.lit(newest)))


def drop_days(spark: SparkSession, path: str, newest: date, days: int, day: str = "day") -> list[str]:
    """Delete the folders of days before the last ``days`` ones; no row is read. Returns the days that went."""
    first = (newest - timedelta(days=days - 1)).isoformat()
    old = {d: p for d, p in _children(spark, path, day).items() if d < first}
    for p in old.values():
        _delete(spark, p)
    return sorted(old)
