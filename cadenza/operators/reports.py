"""Counts, top lists and comparisons for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import drop_reason
from ..params import SCORING


def kinds(hunks: DataFrame) -> DataFrame:
    return hunks.groupBy("kind").agg(F.count("*").alias("n"))


def run_stats(rows: DataFrame, key: str = "session") -> DataFrame:
    """(key, chunks, blocked, blocked_s, empty, gaps, gap_s, recovered, recovered_s) of rows (status, start, end, gap, recovery)."""
    seconds = F.col("end") - F.col("start")
    total = lambda cond, value: F.round(F.sum(F.when(cond, value).otherwise(0.0)), 3)
    s = F.col("status")
    return rows.groupBy(key).agg(
        F.count_if(s == "kept").alias("chunks"),
        F.count_if(s == "blocked").alias("blocked"),
        total(s == "blocked", seconds).alias("blocked_s"),
        F.count_if(s == "empty").alias("empty"),
        F.count_if(F.col("gap") >= 0.35).alias("gaps"),
        total(F.col("gap") >= 0.35, F.col("gap")).alias("gap_s"),
        F.count_if(F.col("recovery").isNotNull()).alias("recovered"),
        total(F.col("recovery").isNotNull(), F.col("gap")).alias("recovered_s"),
    )


def lengths(rows: DataFrame, key: str, seconds: Column, short: float = 4.0) -> DataFrame:
    """(key, n, median_s, short_share)"""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.median(seconds).alias("median_s"), F.avg((seconds < short).cast("double")).alias("short_share"))


def terms(texts: DataFrame, text: str = "text", order: str = "ord", katakana: str = "[ァ-ヴー]{3,}", latin: str = "[A-Za-z][A-Za-z0-9._-]{2,}") -> DataFrame:
    """(term, n, first): how often each katakana or alphanumeric term occurs, and where first (katakana before the others)."""
    found = [F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for p in (katakana, latin)]
    own = [texts.select(F.lit(k).alias("kind"), order, F.posexplode(f).alias("pos", "term")) for k, f in enumerate(found)]
    return own[0].union(own[1]).groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("kind", order, "pos")).alias("first"))


def most_frequent(found: DataFrame, top: int = 40) -> DataFrame:
    return found.orderBy(F.desc("n"), "first").limit(top).select("term", "n")


def paragraph_stats(bodies: DataFrame, key: str = "session", text: str = "text") -> DataFrame:
    """(key, chars, paragraphs, mean_chars): mean as a whole number; null without paragraphs."""
    parts = F.filter(F.split(F.col(text), "\n\n"), lambda p: F.length(F.regexp_replace(p, r"(?U)\s", "")) > 0)
    size = F.aggregate(F.transform(parts, F.length), F.lit(0), lambda a, x: a + x)
    return bodies.select(key, F.length(text).alias("chars"), F.size(parts).alias("paragraphs"), F.when(F.size(parts) > 0, F.floor(size / F.size(parts))).alias("mean_chars"))


def model_report(runs: DataFrame, warmup: int = 3) -> DataFrame:
    """(model, n, median_ms, mean_ms, rtf, wer) of runs (model, i, ms, seconds, ref, wer); the first ones don't count, nor do blank references for wer."""
    own = runs.where(F.col("i") >= warmup)
    return own.groupBy("model").agg(
        F.count("*").alias("n"), F.median("ms").alias("median_ms"), F.avg("ms").alias("mean_ms"),
        (F.sum("ms") / 1000 / F.sum("seconds")).alias("rtf"), F.avg(F.when(F.trim("ref") != "", F.col("wer"))).alias("wer"),
    )


def keyword_matrix(runs: DataFrame, words: list[str], models: list[str], warmup: int = 3) -> DataFrame:
    """(word, in_ref, one column a model): of the rows whose reference has the word, how many of each model have it."""
    own = runs.where(F.col("i") >= warmup).withColumn("word", F.explode(F.array(*[F.lit(w.strip().lower()) for w in words if w.strip()])))
    own = own.where(F.contains(F.lower("ref"), F.col("word"))).withColumn("hit", F.contains(F.lower("text"), F.col("word")).cast("int"))
    counts = own.groupBy("word").pivot("model", models).agg(F.sum("hit"))
    return own.groupBy("word").agg(F.count_distinct("i").alias("in_ref")).join(counts, "word")


def what_if(segments: DataFrame, profiles: tuple[str, ...] = tuple(SCORING)) -> DataFrame:
    """(profile, no_speech, logprob, kept): how many segments each profile would drop, and why."""
    made = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.coalesce(drop_reason(F.col("no_speech"), F.col("logprob"), p), F.lit("kept")).alias("reason")) for p in profiles])).alias("x")
    return segments.select(made).groupBy("x.profile").agg(*[F.count_if(F.col("x.reason") == r).alias(r) for r in ("no_speech", "logprob", "kept")])


def worst(segments: DataFrame, n: int, score: str = "logprob", order: str = "ord") -> DataFrame:
    return segments.orderBy(score, order).limit(n)


def shown(rows: DataFrame, order: list, most: int, key: str = "kind") -> DataFrame:
    """rows with more: each kind's first rows, and on the last of them how many more there are."""
    by = Window.partitionBy(key)
    own = rows.withColumns({"_rank": F.row_number().over(by.orderBy(*order)), "_n": F.count("*").over(by)}).where(F.col("_rank") <= most)
    return own.withColumn("more", F.when((F.col("_rank") == most) & (F.col("_n") > most), F.col("_n") - most)).drop("_rank", "_n")


def by_difference(runs: DataFrame) -> DataFrame:
    """(i, worst): rows by the greatest error rate among the models, the greatest first."""
    return runs.groupBy("i").agg(F.max("wer").alias("worst")).orderBy(F.desc("worst"), "i")


def text_offsets(segs: DataFrame, key: str = "session", order: str = "ord", text: str = "text") -> DataFrame:
    """segs with raw_start and raw_end: where each text lies in all texts of its session joined."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length(text)).over(by)
    return segs.withColumns({"raw_start": end - F.length(text), "raw_end": end})


def first_of_each(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def last_rows(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """Each key's last rows: a history that drops its oldest."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= most).drop("_rank")


def without(rows: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(known, key, "left_anti")
