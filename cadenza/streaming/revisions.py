"""Ranges that are gone over again, as they come: a table by revision that replays don't change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.coverage import newest

#: What a refined range has; further columns, its text for one, go along.
KEY = ("session", "start", "end")


def revision_log(refined: DataFrame, path: str) -> DataStreamWriter:
    """A writer of a stream of refined ranges (session, start, end, revision, ...) to a table with a folder for each micro-batch.

    A batch replaces its own folder and no other, so one that runs again after a failure leaves
    the table as it was. In a batch only the greatest revision of each range is kept; between
    batches that is decided when the table is read, so no batch waits for another, and one that
    comes late is as good as one in time.
    """

    def write(batch: DataFrame, number: int) -> None:
        top = _greatest(batch)
        top.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return refined.writeStream.foreachBatch(write)


def _greatest(rows: DataFrame) -> DataFrame:
    """Of each range the row with the greatest revision, of equal ones the greatest row: whatever their order, the same."""
    rest = [c for c in rows.columns if c not in KEY]
    best = F.max(F.struct("revision", *[c for c in rest if c != "revision"])).alias("_best")
    return rows.groupBy(*KEY).agg(best).select(*KEY, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*rows.columns)


def refined_ranges(spark: SparkSession, path: str, spans: DataFrame, slack: float = 0.02) -> DataFrame:
    """The ranges of the table that count now, over the spans (session, start, end, revision) as they are now."""
    return newest(_greatest(spark.read.parquet(path).drop("batch")), spans, slack=slack)


def compacted(spark: SparkSession, path: str, into: str) -> None:
    """The same table with one folder, written elsewhere; the stream goes on there under batches from 1 on."""
    rows = _greatest(spark.read.parquet(path).drop("batch"))
    rows.withColumn("batch", F.lit(-1)).write.mode("overwrite").partitionBy("batch").parquet(into)
