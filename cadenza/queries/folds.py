"""Ordered folds over events as frames, segments and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import commands, segments
from ..params import Joining, Paragraphs, Segmenting
from .base import TIMED, fixture, table, timed
from .signals import HOUR


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding components as frame levels: 16 vectors are a session of 1024 frames."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return own.select(F.floor(F.col("vec_id") / 16).cast("string").alias("session"), (F.col("vec_id") % 16 * 64 + F.col("pos")).alias("frame_no"), F.round(F.abs("x").cast("double") / 8, 6).alias("rms"))


def forced_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segments(_frames(spark, sf_dir), Segmenting(silence=0.16, longest=3.0, shortest=0.3, pad=0.06))


def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.noise_floor(_frames(spark, sf_dir)).groupBy("session").agg(F.count_if("active").alias("active"))


def joined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = segments.segments(_frames(spark, sf_dir), Segmenting(silence=0.16, longest=3.0, shortest=0.3, pad=0.06))
    return segments.joined(segs, Joining(4.0, 6.0, 2.0)).drop("pause")


def replayed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.replayed(_frames(spark, sf_dir), Segmenting(silence=0.16, longest=3.0, shortest=0.1, pad=0.06), Joining(4.0, 6.0, 2.0)).drop("pause")


def paragraph_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("ord"), F.concat("text", F.when(F.col("turn") % 3 > 0, "。").otherwise("")).alias("text"), (F.col("turn") % 4 / 2.0).alias("pause"))
    return segments.paragraphs(own, Paragraphs(120, 0.7, 300)).select("session", "ord", "breaks")


def refine_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir)
    base = F.min("us").over(Window.partitionBy("user_id"))
    ends = own.select(F.col("user_id").alias("session"), F.struct("us", "event_id").alias("o"), (F.col("us") - base).alias("delivered_end")).select("session", F.col("o.event_id").alias("event_id"), F.col("o.us").alias("ord"), "delivered_end")
    return segments.refinements(ends, 48 * HOUR, 8 * HOUR)


def throttled_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir).select("user_id", "event_id", (F.col("us") / 1e6).alias("at"))
    return segments.throttled(own, "user_id", "at", 24 * 3600.0).select("event_id")


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, "(VALUES ('s', 1, 'insert', 'abc', ''), ('s', 2, 'insert', 'def', ''), ('s', 3, 'cancel', '', ''), ('s', 4, 'insert', 'abcx', ''), ('s', 5, 'replace', 'abc', 'Z'), ('s', 6, 'insert', '!  ', ''), ('s', 7, 'trim', '', ''), ('t', 1, 'insert', 'x', ''), ('t', 2, 'cancel', '', ''), ('t', 3, 'restore', '', ''), ('t', 4, 'cancel', '', ''), ('t', 5, 'cancel', '', '')) AS t(session, ord, op, text, into)")
    return commands.edited(log)


def cursor_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, "(VALUES (1, '業績に起用しました', 5), (2, '業績に起用しました', 2), (3, '業績に起用しました', 3), (4, 'スライドを見る', 2), (5, '。', 1), (6, '', 0), (7, 'abc def', 4)) AS t(id, text, pos)")
    return own.select("id", commands.word_at("text", "pos").alias("w")).select("id", "w.start", "w.end")


QUERIES = {f.__name__: f for f in (forced_cut, noise_floor, joined_chunks, replayed_chunks, paragraph_fold, refine_ranges, throttled_levels, edit_log, cursor_words)}
_PARA = """with recursive c as (select conv_id::varchar as session, turn as ord, text || case when turn % 3 > 0 then '。' else '' end as text, turn % 4 / 2 as pause, row_number() over (partition by conv_id order by turn) as k from conversations),
w(session, k, ord, breaks, size, fin) as (
  select session, k, ord, false, length(text), right(rtrim(text), 1) in ('。', '！', '？', '!', '?', '」', '』', '）') from c where k = 1
  union all
  select session, k, ord, go, case when go then 0 else size end + length(text), right(rtrim(text), 1) in ('。', '！', '？', '!', '?', '」', '』', '）')
  from (select c.session, c.k, c.ord, c.text, w.size, (((w.size >= 120 and c.pause >= 0.7) or w.size >= 300) and w.fin) or w.size >= 600 as go from w join c on c.session = w.session and c.k = w.k + 1))
select session, ord, breaks from w"""
_REFINE = f"""with recursive {TIMED}, d as (select user_id::varchar as session, us - min(us) over (partition by user_id) as z, row_number() over (partition by user_id order by us, event_id) as k, count(*) over (partition by user_id) as n from e),
w(session, k, z, low, rev, s, f, n) as (
  select session, k, z, 0::bigint, 0, null::bigint, null::bigint, n from d where k = 1
  union all
  select d.session, d.k, d.z, case when d.z - w.low >= {48 * HOUR} then d.z else w.low end, case when d.z - w.low >= {48 * HOUR} then w.rev + 1 else w.rev end, case when d.z - w.low >= {48 * HOUR} then w.low end, case when d.z - w.low >= {48 * HOUR} then d.z end, d.n
  from w join d on d.session = w.session and d.k = w.k + 1)
select session, s as start, f as "end", rev as revision from w where s is not null
union all select session, low, z, rev + 1 from w where k = n and z - low >= {8 * HOUR}"""
_THROTTLE = f"""with recursive {TIMED}, d as (select event_id, user_id, us, row_number() over (partition by user_id order by us, event_id) as k from e),
w(user_id, k, event_id, last, keep) as (select user_id, k, event_id, us, true from d where k = 1 union all
  select d.user_id, d.k, d.event_id, case when d.us - w.last >= {24 * HOUR} then d.us else w.last end, d.us - w.last >= {24 * HOUR} from w join d on d.user_id = w.user_id and d.k = w.k + 1)
select event_id from w where keep"""
_FRAMES = "fr as (select (vec_id // 16)::varchar as session, vec_id % 16 * 64 + p - 1 as k, round(abs(embedding[p])::double / 8, 6) as rms from embeddings, range(1, 65) r(p))"
_NOISE = f"""with recursive {_FRAMES}, w(session, k, noise, active) as (
  select session, k, rms, rms >= least(0.016, greatest(0.0008, 3 * rms)) from fr where k = 0
  union all
  select session, k, nz, rms >= least(0.016, greatest(0.0008, 3 * nz)) from (select fr.session, fr.k, fr.rms, w.noise + (fr.rms - w.noise) * case when fr.rms < w.noise then 0.05 else 0.003 end as nz from w join fr on fr.session = w.session and fr.k = w.k + 1))
select session, count(*) filter (where active) as active from w group by session"""
ORACLE_SQL = {
    "paragraph_fold": _PARA,
    "refine_ranges": _REFINE,
    "throttled_levels": _THROTTLE,
    "noise_floor": _NOISE,
    "edit_log": "select 's' as session, 'abcZx!' as body union all select 't', ''",
    "cursor_words": "select * from (values (1, 3, 9), (2, 0, 3), (3, 0, 3), (4, 0, 4), (5, null, null), (6, null, null), (7, 4, 7)) t(id, start, \"end\")",
}
