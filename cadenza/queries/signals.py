"""Signals, gaps and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import coverage, segments
from .base import TIMED, fixture, table, timed

HOUR = 3_600_000_000


def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.gap_segments(timed(spark, sf_dir), "user_id", "us", "event_id", 6 * HOUR)


_GAPS = f"""with {TIMED},
f as (select *, case when us - lag(us) over (partition by user_id order by us, event_id) >= {6 * HOUR} then 1 else 0 end as new from e),
g as (select *, sum(new) over (partition by user_id order by us, event_id rows unbounded preceding)::bigint as seg from f),
s as (select user_id, seg, min(us) as start, max(us) as "end", count(*) as n from g group by all)"""


def pause_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.pauses(gap_segments(spark, sf_dir), "user_id").select("user_id", "seg", "pause")


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = coverage.gaps(timed(spark, sf_dir), "user_id", "us", "us_end", HOUR, 12 * HOUR, ("us", "event_id"))
    return own.select("event_id", "covered", "gap", "retry")


def missing_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir).select("user_id", "event_id", (F.col("us") % (1000 * HOUR) / 1_000_000).alias("start"))
    own = own.withColumn("end", F.col("start") + 60)
    return coverage.missing(own, "user_id", least=3600.0).select("event_id", "marker")


def delivered_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir).withColumn("rec", F.col("event_type") == "click")
    return coverage.delivered(own, "user_id", "us", "us_end", "rec").select("event_id", "delivered_end")


def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.recent(timed(spark, sf_dir), "user_id", "us", 48 * HOUR).select("event_id", "user_id", "us")


def idle_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir).select("user_id", "event_id", "us", "value")
    return coverage.idle(own, "user_id", "us", "value", 24 * HOUR, 50.0, warn=12 * HOUR).select("event_id", "remaining", "expired", "warned")


def resume_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "disconnect").otherwise("resume")
    return coverage.resumed(timed(spark, sf_dir).withColumn("event", kind), "user_id", "us", 6 * HOUR).select("event_id", "event", "status")


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir)
    return coverage.carried(own, "user_id", "us", "event_type", F.col("value") >= 50, "none").select("event_id", "carried")


def input_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.stalls(timed(spark, sf_dir), "user_id", "us", 24 * HOUR).select("event_id", F.col("gap_ms").alias("gap"))


def frame_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("session"), F.posexplode("embedding").alias("pos", "x"))
    found = signal.evidence(signal.frames(own, size=8), size=8, rate=16, frame_rms=0.1)
    return found.select("session", F.round("duration", 6).alias("duration"), F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"), F.round("active_ratio", 6).alias("active_ratio"), ((F.col("rms") >= 0.1) & (F.col("active_ratio") >= 0.5)).alias("retry"))


def array_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select("vec_id", signal.rms(F.col("embedding")).alias("rms"))
    return own.select("vec_id", F.round("rms", 6).alias("rms"), signal.is_active(F.col("rms")).alias("active"))


def quiet_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    framed = own.groupBy("vec_id", F.floor(F.col("pos") / 8).alias("frame_no")).agg(F.round(F.sqrt(F.avg(F.col("x").cast("double") * F.col("x").cast("double"))), 3).alias("rms"))
    return segments.quietest(framed, "vec_id", "frame_no", "rms", 4)


def linear_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.downsampled(F.col("embedding").cast("array<double>"), 48, 16)).alias("i", "x"))
    return own.select("vec_id", "i", F.round("x", 6).alias("x"))


_HANDOVER = "(VALUES (1, 1, 'それでは中山さんお願いいたします。'), (1, 2, 'おやすみなさい。'), (1, 3, '皆様こんにちは中山でございます。'), (2, 1, 'じゃあね'), (2, 2, 'おやすみなさい'), (2, 3, 'また明日'), (3, 1, 'では佐藤さんお願いします'), (3, 2, 'おやすみなさい'), (4, 1, 'それではお願いします'), (4, 2, 'おやすみなさい'), (4, 3, '')) AS t(session, ord, text)"


def between_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.judged(fixture(spark, _HANDOVER)).select("session", "ord", "removed")


QUERIES = {f.__name__: f for f in (gap_segments, pause_lag, coverage_gaps, missing_markers, delivered_end, recent_history, idle_sources, resume_sessions, carry_forward, input_stalls, frame_evidence, array_levels, quiet_frame, linear_downsample, between_neighbours)}
_BY = "partition by user_id order by us"
ORACLE_SQL = {
    "gap_segments": f'{_GAPS} select user_id, seg, start, "end", n from s',
    "pause_lag": f'{_GAPS} select user_id, seg, case when b is not null then greatest(0, start - b) end as pause from (select *, lag("end") over (partition by user_id order by start, "end") as b from s)',
    "coverage_gaps": f"with {TIMED}, c as (select *, max(us_end) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding) as covered from e) select event_id, covered, us - covered as gap, coalesce(covered > 0 and us - covered between {HOUR} and {12 * HOUR}, false) as retry from c",
    "missing_markers": f"""with {TIMED}, s as (select user_id, event_id, (us % {1000 * HOUR}) / 1000000 as start, (us % {1000 * HOUR}) / 1000000 + 60 as z from e),
      c as (select *, max(z) over (partition by user_id order by start, z rows between unbounded preceding and 1 preceding) as cov from s)
      select event_id, case when cov > 0 and start - cov >= 3600 then '⟨未認識 ' || printf('%d:%04.1f', floor(cov / 60)::bigint, cov - floor(cov / 60) * 60) || '–' || printf('%d:%04.1f', floor(start / 60)::bigint, start - floor(start / 60) * 60) || '⟩' end as marker from c""",
    "delivered_end": f"with {TIMED} select event_id, coalesce(max(case when event_type <> 'click' then us_end end) over ({_BY} rows unbounded preceding), 0) as delivered_end from e",
    "recent_history": f"with {TIMED} select event_id, user_id, us from (select *, max(us) over (partition by user_id) as m from e) where us > m - {48 * HOUR}",
    "idle_sources": f"""with {TIMED}, a as (select *, first(us) over ({_BY} rows unbounded preceding) as s, max(case when value >= 50 then us end) over ({_BY} rows unbounded preceding) as h from e),
      b as (select *, h is null and us - s >= {12 * HOUR} as mute from a)
      select event_id, {24 * HOUR} - (us - coalesce(h, s)) as remaining, {24 * HOUR} - (us - coalesce(h, s)) <= 0 as expired, mute and sum(mute::int) over ({_BY} rows unbounded preceding) = 1 as warned from b""",
    "resume_sessions": f"""with {TIMED}, k as (select *, case when event_id % 2 = 0 then 'disconnect' else 'resume' end as event from e),
      n as (select *, lag(event) over ({_BY}) as p, us - lag(us) over ({_BY}) as dp, lead(event) over ({_BY}) as q, lead(us) over ({_BY}) - us as dq from k)
      select event_id, event, case when event = 'resume' then case when p = 'disconnect' and dp < {6 * HOUR} then 'continued' else 'rejected' end else case when q = 'resume' and dq < {6 * HOUR} then 'held' else 'closed' end end as status from n""",
    "carry_forward": f"with {TIMED} select event_id, coalesce(last_value(case when value >= 50 then event_type end ignore nulls) over ({_BY} rows unbounded preceding), 'none') as carried from e",
    "input_stalls": f"with {TIMED} select event_id, gap from (select event_id, us - lag(us) over ({_BY}) as gap from e) where gap > {24 * HOUR}",
    "frame_evidence": """with s as (select vec_id as session, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
      f as (select session, pos // 8 as k, count(*) as n, sum(x * x) as sq, max(abs(x)) as peak from s group by all),
      a as (select session, sum(n) / 16 as duration, sqrt(sum(sq) / sum(n)) as rms, max(peak) as peak, avg((sqrt(sq / n) >= 0.1)::int::double) as active_ratio from f group by session)
      select session, round(duration, 6) as duration, round(rms, 6) as rms, round(peak, 6) as peak, round(active_ratio, 6) as active_ratio, rms >= 0.1 and active_ratio >= 0.5 as retry from a""",
    "array_levels": "select vec_id, round(r, 6) as rms, r >= 0.016 as active from (select vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)) as r from embeddings)",
    "quiet_frame": """with s as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
      f as (select vec_id, pos // 8 as frame_no, round(sqrt(avg(x * x)), 3) as rms from s group by all),
      r as (select *, row_number() over (partition by vec_id order by frame_no desc) as b from f)
      select vec_id, arg_min(frame_no, (rms, frame_no)) as at from r where b <= 4 group by vec_id""",
    "linear_downsample": "select vec_id, i, round(embedding[i * 3 + 1]::double, 6) as x from embeddings, range(0, 21) as r(i) where i < floor(len(embedding) / 3)",
    "between_neighbours": f"select session, ord, text in ('おやすみなさい', 'おやすみなさい。') and session = 1 as removed from {_HANDOVER}",
}
