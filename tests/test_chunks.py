"""Chunked ordering must give what one big window gives, also for keys that are cut."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapline.operators import chunks as C


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with two thirds of the rows, sparse and bursty sequence numbers, many small keys."""
    rng = random.Random(3)
    data, seq = [], 0
    for i in range(900):
        seq += rng.choice([1, 1, 1, 40])
        data.append(("hot" if i % 3 else f"k{i % 17}", seq, rng.randint(-50, 50)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "key string, seq long, v long").repartition(7).cache()


@pytest.mark.parametrize("size", [5, 37, 10_000])
def test_over_previous(skewed, size):
    make = {
        "mean": lambda w: F.avg("v").over(w.rowsBetween(-20, -1)),
        "std": lambda w: F.stddev_samp("v").over(w.rowsBetween(-5, -1)),
        "before": lambda w: F.lag("seq").over(w),
    }
    got = C.over_previous(skewed, ["key"], "seq", 20, make, size)
    plain = Window.partitionBy("key").orderBy("seq")
    want = skewed.select("*", *[m(plain).alias(n) for n, m in make.items()])
    shaped = lambda df: sorted((r.key, r.seq, round(r.mean or 0, 9), round(r.std or 0, 9), r.before) for r in df.collect())
    assert [str(x) for x in shaped(got)] == [str(x) for x in shaped(want)]


def test_chunks_are_bounded(skewed):
    sizes = C.assign_chunks(skewed, ["key"], "seq", 25).groupBy("key", C.CHUNK).count().collect()
    assert max(r["count"] for r in sizes) < 50
    assert len([r for r in sizes if r["key"] == "hot"]) > 12
    assert C.assign_chunks(skewed, ["key"], "seq", 10_000) is None


def test_sparse_and_null_keys_are_cut(spark):
    """Steps of the sequence far wider than a chunk, in a named and in a null key: every partition is bounded."""
    sparse = spark.range(0, 20_000).select(F.when(F.col("id") % 2 == 0, "hot").alias("key"), (F.col("id") * 1_500_000).alias("seq"), F.lit(1).alias("v"))
    cut = C.assign_chunks(sparse, ["key"], "seq", 1000)
    sizes = cut.groupBy("key", C.CHUNK).count().collect()
    assert max(r["count"] for r in sizes) < 2000 and len(sizes) > 12
    got = C.running(sparse, ["key"], "seq", {"n": ("sum", F.col("v"), True)}, rows=1000)
    assert got.filter(F.col("n") != F.floor(F.col("seq") / 3_000_000) + 1).count() == 0 and got.count() == 20_000


@pytest.mark.parametrize("size", [11, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running(skewed, size, descending):
    spec = {
        "s": ("sum", F.col("v"), False), "si": ("sum", F.col("v"), True),
        "m": ("max", F.col("v"), False), "mi": ("min", F.col("v"), True),
    }
    got = C.running(skewed, ["key"], "seq", spec, descending, size).toPandas()
    frame = skewed.toPandas().sort_values("seq", ascending=not descending)
    groups = frame.groupby("key")["v"]
    frame["si"], frame["mi"] = groups.cumsum(), groups.cummin()
    frame["s"] = frame["si"] - frame["v"]
    frame["m"] = groups.cummax().groupby(frame["key"]).shift(1)
    merged = got.merge(frame, on=["key", "seq"], suffixes=("", "_w"))
    assert len(merged) == len(frame)
    for c in spec:
        assert (merged[c].fillna(-999) == merged[f"{c}_w"].fillna(-999)).all(), c


@pytest.mark.parametrize("size", [13, 10_000])
def test_row_numbers(skewed, size):
    tied = skewed.withColumn("t", F.floor(F.col("v") / 20))
    got = C.row_numbers(tied, ["key"], ["t", "seq"], "n", size).toPandas()
    want = got.sort_values(["key", "t", "seq"]).groupby("key").cumcount() + 1
    assert (got.sort_values(["key", "t", "seq"])["n"] == want).all()


@pytest.mark.parametrize("size", [20, 10_000])
def test_exact_percentiles(skewed, size):
    marks = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = C.exact_percentiles(skewed, ["key"], "v", marks, size).toPandas().set_index("key")
    frame = skewed.toPandas()
    for name, f in marks.items():
        want = frame.groupby("key")["v"].quantile(f)
        assert (got[name] - want).abs().max() < 1e-9
    whole = C.exact_percentiles(skewed, [], "v", marks, size).first()
    assert abs(whole["p99"] - frame["v"].quantile(0.99)) < 1e-9


def test_null_keys_stay_one_group(spark):
    frame = spark.createDataFrame([(None, i, 1) for i in range(30)] + [("a", i, 1) for i in range(30)], "key string, seq long, v long")
    got = C.running(frame, ["key"], "seq", {"s": ("sum", F.col("v"), True)}, rows=7)
    assert got.groupBy("key").agg(F.max("s").alias("m")).select("m").distinct().collect()[0].m == 30
    assert pd.isna(got.toPandas()["key"]).sum() == 30
