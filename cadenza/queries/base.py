"""Tables and fixtures of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds of a timestamp without a zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def fixture(spark: SparkSession, sql: str) -> DataFrame:
    """A literal table; the same text goes into the oracle."""
    return spark.sql(f"SELECT * FROM {sql}")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ranges: (event_id, user_id, us, us_end, event_type, value); a range lasts value seconds."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", micros("ts").alias("us"), (micros("ts") + F.floor(F.col("value") * 1_000_000)).alias("us_end"), "event_type", "value")


TIMED = "e as (select event_id, user_id, epoch_us(ts) as us, epoch_us(ts) + floor(value * 1000000)::bigint as us_end, event_type, value from events)"
