"""Features of signals: sample arrays and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import FRAME, RATE, Recovery

#: Fixed values of the adaptive floor: fall, rise, ratio to the noise, least floor.
NOISE_FALL, NOISE_RISE, NOISE_RATIO, LEAST_FLOOR = 0.05, 0.003, 3.0, 0.0008


def rms(samples: Column) -> Column:
    """Root mean square of an array, in doubles; 0 of an empty one."""
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(square / F.size(samples))).otherwise(0.0)


def fixed_floor(threshold: float) -> float:
    """A threshold of 0 to 1 as an absolute level."""
    return 0.006 + 0.02 * threshold


def is_active(level: Column, threshold: float = 0.5) -> Column:
    return level >= fixed_floor(threshold)


def is_active_by_model(prob: Column, level: Column, threshold: float = 0.5) -> Column:
    """A model's probability where there is one, else the energy rule."""
    return F.coalesce(prob >= threshold, is_active(level, threshold))


def frames(samples: DataFrame, key: str = "session", pos: str = "pos", value: str = "x", size: int = FRAME) -> DataFrame:
    """(key, frame_no, n, sum_sq, peak) of a table of samples."""
    x = F.col(value).cast("double")
    return samples.groupBy(key, F.floor(F.col(pos) / size).alias("frame_no")).agg(F.count("*").alias("n"), F.sum(x * x).alias("sum_sq"), F.max(F.abs(x)).alias("peak"))


def evidence(framed: DataFrame, key: str = "session", size: int = FRAME, rate: int = RATE, frame_rms: float = 0.003) -> DataFrame:
    """(key, duration, rms, peak, active_ratio) of frames(): an incomplete last frame counts for the ratio only where it is alone."""
    full = F.col("n") == size
    level = F.sqrt(F.col("sum_sq") / F.col("n"))
    of_full = F.avg(F.when(full, (level >= frame_rms).cast("double")))
    return framed.groupBy(key).agg(
        (F.sum("n") / rate).alias("duration"),
        F.sqrt(F.sum("sum_sq") / F.sum("n")).alias("rms"),
        F.max("peak").alias("peak"),
        F.coalesce(of_full, F.max((level >= frame_rms).cast("double"))).alias("active_ratio"),
    )


def supports_retry(level: Column, active_ratio: Column, p: Recovery = Recovery()) -> Column:
    return (level >= p.rms) & (active_ratio >= p.active)


def downsampled(samples: Column, rate_in: int, rate_out: int) -> Column:
    """Linear interpolation to a lower rate; the samples themselves if the rate isn't lower."""
    if rate_out >= rate_in:
        return samples
    ratio = rate_in / rate_out

    def at(i: Column) -> Column:
        pos = i * F.lit(ratio)
        a = F.get(samples, F.floor(pos).cast("int"))
        b = F.coalesce(F.get(samples, F.floor(pos).cast("int") + 1), a)
        return a + (b - a) * (pos - F.floor(pos))

    count = F.floor(F.size(samples) / F.lit(ratio)).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.slice(samples, 1, 0))


def stalls(blocks: DataFrame, key: str, at_ms: str, longest: int = 3000) -> DataFrame:
    """Blocks before which no input came for more than `longest` ms, with the gap's length."""
    from pyspark.sql import Window

    gap = F.col(at_ms) - F.lag(at_ms).over(Window.partitionBy(key).orderBy(at_ms))
    return blocks.withColumn("gap_ms", gap).where(F.col("gap_ms") > longest)
