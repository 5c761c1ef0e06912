"""Registry of queries over the given tables and the SQL each is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one scale folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of the tables under a name, with its check SQL where SQL can say it."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0. ``special`` gives a column other digits."""

    def one(field) -> Column:
        if field.dataType.typeName() in ("double", "float"):
            value = F.col(f"`{field.name}`").cast("double")
            # rounding goes through decimals; whole numbers, most of the features, are spared it
            value = F.when(value == F.rint(value), value).otherwise(F.round(value, special.get(field.name, digits)))
            return (value + F.lit(0.0)).alias(field.name)
        if field.dataType.typeName() in ("integer", "short", "byte", "decimal"):
            return F.col(f"`{field.name}`").cast("long").alias(field.name)
        return F.col(f"`{field.name}`")

    return df.select(*[one(f) for f in df.schema.fields])


def micros(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as epoch microseconds, so no time zone enters a comparison."""
    for c in columns:
        df = df.withColumn(c, F.unix_micros(F.col(c).cast("timestamp")))
    return df
