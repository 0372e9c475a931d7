"""Join-like operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, joins, reports
from .base import TIMED, fixture, table, timed
from .signals import HOUR


def asof_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir)
    left, right = own.where("event_id % 2 = 0").select("event_id", "user_id", "us"), own.where("event_id % 2 = 1").select("user_id", F.col("us").alias("at"), F.col("event_id").alias("segment"))
    return joins.as_of(left, right, "user_id", "us", "at", "segment").select("event_id", "segment")


def overlap_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir)
    left = own.where("event_id % 2 = 0").select("user_id", F.col("event_id").alias("a"), (F.col("us") / 1e6).alias("start"), (F.col("us") / 1e6 + 20000).alias("end"))
    right = own.where("event_id % 2 = 1").select("user_id", F.col("event_id").alias("b"), (F.col("us") / 1e6).alias("r_start"), (F.col("us") / 1e6 + 5000).alias("r_end"))
    return joins.overlaps(left, right, "user_id", cell=7200.0, slack=0.02).select("a", "b")


def contains_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), "text")
    needles = conv.where("start = 1").select("session", F.substring("text", 5, 12).alias("needle"))
    return joins.spans_of(conv, needles)


def rounded_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir)
    left = own.select("event_id", "user_id", (F.col("us") / 1e10).alias("a"))
    right = own.where("event_id % 5 = 0").select("user_id", F.col("event_id").alias("hit"), (F.col("us") / 1e10).alias("b"))
    return joins.on_rounded(left, right, "user_id", "a", "b", "hit", 10).select("event_id", "hit")


def probe_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "us")
    consumed = own.where("seq % 3 = 0").select("session", "seq", F.col("us").alias("consumed_at"))
    return joins.unconsumed(own, consumed).select("session", "seq")


def zipped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations")
    ask, answer = (own.where(F.col("turn") % 2 == k).select("conv_id", "turn", F.length("text").alias(n)) for k, n in ((0, "ask"), (1, "answer")))
    return joins.zipped(ask, answer, "conv_id", "turn")


def keyword_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = fixture(spark, "(VALUES ('Password'), ('akia'), ('tion the')) AS t(word)")
    return joins.with_keyword(table(spark, sf_dir, "documents"), words).select("doc_id")


def nearest_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = fixture(spark, "(VALUES (1, 'green'), (2, 'blue'), (3, 'red'), (4, 'blush')) AS t(ord, reading)")
    own = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ")[0].alias("word"))
    return joins.nearest(own, F.col("word"), phrases, lambda n: F.when(n <= 4, 1).otherwise(2)).select("p_partkey", F.col("match.e.reading").alias("phrase"), F.col("match.distance").alias("distance"))


def known_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir).select("user_id", "event_type").distinct()
    return reports.without(own, own.where("user_id % 3 = 0"), ["user_id", "event_type"])


def recovered_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = coverage.gaps(timed(spark, sf_dir), "user_id", "us", "us_end", HOUR, 12 * HOUR, ("us", "event_id")).select(F.col("user_id").alias("session"), "event_id", F.col("us").alias("start"), "retry")
    found = own.where("retry").select("session", "start", F.when(F.col("event_id") % 4 == 0, "").otherwise("text").alias("text"), (-(F.col("event_id") % 3) / 1.0).alias("logprob"))
    return coverage.recovered(own, found).select("event_id", "recovery")


def newest_refinements(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = spark.sql("SELECT session, CAST(a AS DOUBLE) AS start, CAST(z AS DOUBLE) AS end, revision FROM (VALUES ('s', 0.0, 3.0, 0), ('s', 3.0, 6.0, 2), ('s', 6.0, 9.0, 0)) AS t(session, a, z, revision)")
    refined = spark.sql("SELECT session, CAST(a AS DOUBLE) AS start, CAST(z AS DOUBLE) AS end, revision FROM (VALUES ('s', 0.01, 3.0, 1), ('s', 0.01, 3.0, 2), ('s', 3.0, 6.0, 1), ('s', 6.0, 8.5, 3), ('s', 0.0, 9.0, 4), ('x', 0.0, 3.0, 1)) AS t(session, a, z, revision)")
    return coverage.newest(refined, spans)


QUERIES = {f.__name__: f for f in (asof_segment, overlap_spans, contains_span, rounded_key, probe_anti, zipped_turns, keyword_semi, nearest_phrase, known_except, recovered_gaps, newest_refinements)}
ORACLE_SQL = {
    "asof_segment": f"with {TIMED}, r as (select user_id, us as t, event_id as segment from e where event_id % 2 = 1), f as (select user_id, arg_min(segment, t) as first from r group by user_id), l as (select * from e where event_id % 2 = 0) select l.event_id, coalesce(r.segment, f.first) as segment from l asof left join r on l.user_id = r.user_id and l.us >= r.t left join f on f.user_id = l.user_id",
    "overlap_spans": f"with {TIMED}, s as (select event_id, user_id, us / 1e6 as t from e) select a.event_id as a, b.event_id as b from s a join s b on a.user_id = b.user_id and a.event_id % 2 = 0 and b.event_id % 2 = 1 and least(a.t + 20000, b.t + 5000) - greatest(a.t, b.t) > 0.02",
    "contains_span": "with n as (select conv_id, substring(text, 5, 12) as needle from conversations where turn = 1) select c.conv_id as session, needle, min(turn)::double as start, max(turn + 1)::double as \"end\" from conversations c join n on n.conv_id = c.conv_id where trim(needle) <> '' and trim(text) <> '' and (contains(trim(text), trim(needle)) or contains(trim(needle), trim(text))) group by 1, 2",
    "rounded_key": f"with {TIMED}, k as (select *, round_even(us / 1e10 * 10, 0)::bigint as u from e), r as (select user_id, u, max(event_id) as hit from k where event_id % 5 = 0 group by all) select event_id, hit from k join r using (user_id, u)",
    "probe_anti": f"with {TIMED}, c as (select user_id, event_id from e where event_id % 3 = 0 qualify row_number() over (partition by user_id order by us desc, event_id desc) <= 20) select user_id as session, event_id as seq from e where (user_id, event_id) not in (select user_id, event_id from c)",
    "zipped_turns": "with p as (select conv_id, turn % 2 as k, length(text) as n, row_number() over (partition by conv_id, turn % 2 order by turn) as place from conversations) select a.conv_id, a.place, a.n as ask, b.n as answer from p a join p b on a.conv_id = b.conv_id and a.place = b.place and a.k = 0 and b.k = 1",
    "keyword_semi": "select doc_id from documents where contains(lower(text), 'password') or contains(lower(text), 'akia') or contains(lower(text), 'tion the')",
    "nearest_phrase": "with w as (select p_partkey, string_split(p_name, ' ')[1] as word from part), d as (select p_partkey, reading, levenshtein(word, reading) as d, o, case when length(reading) <= 4 then 1 else 2 end as t from w, (values (1, 'green'), (2, 'blue'), (3, 'red'), (4, 'blush')) p(o, reading)), b as (select p_partkey, arg_min(reading, (d, o)) as phrase, min(d) as distance from d where d <= t group by 1) select w.p_partkey, phrase, distance from w left join b using (p_partkey)",
    "known_except": "select distinct user_id, event_type from events where user_id % 3 <> 0",
    "recovered_gaps": f"with {TIMED}, c as (select *, max(us_end) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding) as cov from e) select event_id, case when coalesce(cov > 0 and us - cov between {HOUR} and {12 * HOUR}, false) and event_id % 4 <> 0 and event_id % 3 <= 1 then '⟨復旧 text⟩' end as recovery from c",
    "newest_refinements": "select 's' as session, 0.01::double as start, 3.0::double as \"end\", 2 as revision union all select 's', 0.0, 9.0, 4",
}
