"""Tables that grow: merged alerts in buckets, rows by day."""

import glob
import os
import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tapline.sources import stores
from tapline.sources.stores import BucketStore, drop_days, read_days, write_days

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCHEMA = "alert_id string, observed_at long, status string"


def size(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def test_merge_keeps_the_newest(spark, tmp_path):
    rng = random.Random(3)
    store = BucketStore(spark, str(tmp_path / "alerts"), buckets=3, most_deltas=2)
    want = {}
    for batch in range(6):
        rows = [(f"a{rng.randrange(12)}", rng.randrange(20), f"s{batch}-{i}") for i in range(8)] + [(None, batch, "null")]
        for run in range(2 if batch == 3 else 1):  # a batch that is run again changes nothing
            store.merge(spark.createDataFrame(rows, SCHEMA), batch)
        for key, at, _ in rows:
            want[key] = max(want.get(key, -1), at)
        assert {r.alert_id: r.observed_at for r in store.read().collect()} == want
    folders = [os.path.basename(p) for p in glob.glob(str(tmp_path / "alerts/bucket=*/batch=*"))]
    assert len(folders) <= 3 * 3 and any(int(f.split("=")[1]) % 2 for f in folders)


def test_bytes_follow_the_batch(spark, tmp_path):
    path = str(tmp_path / "alerts")
    store = BucketStore(spark, path, buckets=4, most_deltas=8)
    wide = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("alert_id"), F.col("id").alias("observed_at"), F.lit("NEW").alias("status"))
    store.merge(wide, 0)
    first = size(path)
    store.merge(wide.limit(1).withColumn("observed_at", F.lit(10**6).cast("long")), 1)
    assert size(path) - first < first / 50
    assert store.read().count() == 20_000 and store.read().filter("observed_at = 1000000").count() == 1


def test_a_fold_that_was_cut_short(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "alerts")
    store = BucketStore(spark, path, buckets=1, most_deltas=1)
    rows = lambda at, s: spark.createDataFrame([("a", at, s), ("b", at, s)], SCHEMA)
    store.most_deltas = 9
    store.merge(rows(1, "old"), 0)
    store.merge(rows(2, "new"), 1)
    left = []
    store.most_deltas = 1
    with monkeypatch.context() as patch:
        patch.setattr(stores, "_delete", lambda s, p: left.append(p))
        store.fold()
    assert left and {r.status for r in store.read().collect()} == {"new"} and store.read().count() == 2
    store.fold()
    assert len(glob.glob(f"{path}/bucket=0/batch=*")) == 1 and store.read().count() == 2


def test_days(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = [(i, T0 + timedelta(hours=7 * i), "x") for i in range(20)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, note string")
    write_days(frame, path)
    write_days(frame.filter("event_id = 0").withColumn("note", F.lit("again")), path)  # replaces its day only
    newest = date(2026, 1, 6)
    kept = read_days(spark, path, newest, 3)
    plan = kept._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert {r.event_id for r in kept.collect()} == {i for i, t, _ in rows if t.date() >= date(2026, 1, 4)}
    assert drop_days(spark, path, newest, 3) == ["2026-01-01", "2026-01-02", "2026-01-03"]
    assert sorted(os.path.basename(p) for p in glob.glob(path + "/day=*")) == ["day=2026-01-04", "day=2026-01-05", "day=2026-01-06"]
    assert drop_days(spark, str(tmp_path / "none"), newest, 3) == []
    with pytest.raises(ValueError):
        write_days(spark.createDataFrame([(1, None, "x")], frame.schema), path)
