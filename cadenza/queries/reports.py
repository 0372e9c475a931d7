"""Language choice, scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards, language
from ..operators import reports
from ..params import SCORING
from .base import TIMED, table, timed


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored segments: probabilities and scores are made from ids and values."""
    c = F.col
    return timed(spark, sf_dir).select(
        "event_id", "user_id", "us", "event_type",
        ((c("event_id") * 7919 % 1000) / 1000).alias("no_speech"), (-(c("event_id") * 104729 % 6000) / 1000).alias("logprob"),
        ((c("event_id") * 31 % 100) / 100).alias("p_ja"), ((c("event_id") * 17 % 100) / 100).alias("p_en"),
        (c("event_id") % 120 / 10).alias("dur"), F.concat(c("event_type"), F.lit(" ")).alias("text"),
    )


_SCORED = f"""{TIMED}, x as (select event_id, user_id, us, event_type, (event_id * 7919 % 1000) / 1000 as no_speech, -(event_id * 104729 % 6000) / 1000 as logprob,
  (event_id * 31 % 100) / 100 as p_ja, (event_id * 17 % 100) / 100 as p_en, event_id % 120 / 10 as dur, event_type || ' ' as text from e)"""


def confidence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("event_id", guards.drop_reason(F.col("no_speech"), F.col("logprob")).alias("reason"))


def kept_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = guards.kept_result(_scored(spark, sf_dir), "user_id", "us", guards.drop_reason(F.col("no_speech"), F.col("logprob"), "transcription"))
    return own.select("user_id", F.md5("text").alias("md5"), F.round("avg_logprob", 6).alias("avg_logprob"), "max_no_speech", "dropped")


def threshold_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.what_if(_scored(spark, sf_dir))


def result_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("event_id")
    own = _scored(spark, sf_dir).select(guards.result_status(F.when(c % 3 == 0, "").otherwise("x"), c % 2, c % 5).alias("status"))
    return own.groupBy("status").agg(F.count("*").alias("n"))


def worst_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.worst(_scored(spark, sf_dir), 20, "logprob", "event_id").select("event_id", "logprob")


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = reports.lengths(_scored(spark, sf_dir), "event_type", F.col("dur"))
    return own.select("event_type", "n", "median_s", F.round("short_share", 6).alias("short_share"))


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kinds(_scored(spark, sf_dir).withColumnRenamed("event_type", "kind"))


def language_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    own = _scored(spark, sf_dir)
    return own.select("event_id", language.louder(c("p_ja"), c("p_en")).alias("louder"), language.by_identification(c("p_ja"), c("p_en"), F.when(c("event_id") % 2 == 0, "abc").otherwise("日本語"), 0.1).alias("lid"), language.by_logprob(c("logprob"), F.when(c("event_id") % 3 > 0, c("no_speech") - 3)).alias("logprob"))


def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    own = _scored(spark, sf_dir).select("p_ja", "p_en", "dur", c("logprob").alias("ja_logprob"), (c("no_speech") - 3).alias("en_logprob"), F.repeat(F.lit("abc "), (c("event_id") % 9).cast("int")).alias("ja_text"), F.lit("short").alias("en_text"))
    return language.rule_report(own).drop("ja_broken", "en_broken", "en_broken_but_sure", "both_en", "both_en_seconds")


def body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    own = _scored(spark, sf_dir).select(c("event_id").alias("n"), (c("event_id") * 3).alias("start"), F.when(c("event_id") % 4 > 0, "日本").otherwise("").alias("ja_text"), F.lit(" an  English text ").alias("en_text"), "p_ja", "p_en")
    return language.body_lines(own, language.by_identification(c("p_ja"), c("p_en"), c("ja_text")))


def body_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    own = _scored(spark, sf_dir).select(F.when(c("event_id") % 4 > 0, "日本").otherwise("").alias("ja_text"), F.lit(" an  English text ").alias("en_text"), "p_ja", "p_en")
    return language.body_counts(own, language.by_identification(c("p_ja"), c("p_en"), c("ja_text")))


def vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.most_frequent(reports.terms(table(spark, sf_dir, "documents"), order="doc_id"), 40)


def first_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir)
    return reports.first_of_each(own, ["user_id", "event_type"], [F.col("us"), F.col("event_id")]).select("user_id", "event_type", "event_id")


def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.last_rows(timed(spark, sf_dir), "user_id", [F.desc("us"), F.desc("event_id")], 20).select("event_id", "user_id")


def top_with_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir).select(F.col("user_id").alias("kind"), "us", "event_id")
    return reports.shown(own, [F.col("us"), F.col("event_id")], 5).select("kind", "event_id", "more")


def text_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), "text")
    return reports.text_offsets(own).select("session", "ord", "raw_start", "raw_end")


def paragraph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return reports.paragraph_stats(own, "doc_id")


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("event_id")
    own = timed(spark, sf_dir).select("user_id", F.element_at(F.array(F.lit("kept"), F.lit("blocked"), F.lit("empty")), (c % 3 + 1).cast("int")).alias("status"), (c * 2).cast("double").alias("start"), (c * 2 + 1).cast("double").alias("end"), (c % 10 / 10).alias("gap"), F.when(c % 7 == 0, "x").alias("recovery"))
    return reports.run_stats(own, "user_id")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    own = table(spark, sf_dir, "conversations").select((c("conv_id") * 100 + c("turn")).alias("i"), F.lower("text").alias("ref"))
    m = F.explode(F.array(*map(F.lit, ("a", "b")))).alias("model")
    return own.select("*", m).withColumns({"ms": (c("i") * 37 % 500 + F.when(c("model") == "a", 100).otherwise(50)).cast("double"), "seconds": (c("i") % 7 + 1).cast("double"), "text": F.when(c("model") == "b", F.replace("ref", F.lit("the"), F.lit(""))).otherwise(c("ref")), "wer": (c("i") % 10 / 10)})


def model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = reports.model_report(_runs(spark, sf_dir))
    return own.select("model", "n", "median_ms", *[F.round(k, 6).alias(k) for k in ("mean_ms", "rtf", "wer")])


def keyword_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.keyword_matrix(_runs(spark, sf_dir), ["the", "and", "der", "Zebra"], ["a", "b"])


def by_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_difference(_runs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (confidence_split, kept_results, threshold_what_if, result_statuses, worst_scores, length_stats, kind_counts, language_decision, rule_report, body_lines, body_counts, vocab_topk, first_distinct, bounded_history, top_with_remainder, text_offsets, paragraph_stats, run_stats, model_report, keyword_matrix, by_difference)}
_WHY = "case when no_speech > {0} then 'no_speech' when logprob < {1} then 'logprob' end"
_RUNS = "r as (select i, ref, model, (i * 37 % 500 + case model when 'a' then 100 else 50 end)::double as ms, (i % 7 + 1)::double as seconds, case model when 'b' then replace(ref, 'the', '') else ref end as text, i % 10 / 10 as wer from (select conv_id * 100 + turn as i, lower(text) as ref from conversations), (values ('a'), ('b')) m(model))"
_LID = "case when least(p_ja, p_en) >= 0.15 then 'mix' when p_en > p_ja then 'en' else 'ja' end"
_LINE = "'- `' || printf('%02d:%02d:%02d', start // 3600, start % 3600 // 60, start % 60) || '` '"
ORACLE_SQL = {
    "confidence_split": f"with {_SCORED} select event_id, {_WHY.format(0.6, -1.0)} as reason from x",
    "kept_results": f"with {_SCORED}, y as (select *, {_WHY.format(0.95, -3.0)} as why from x) select user_id, md5(trim(coalesce(string_agg(text, '' order by us, text) filter (where why is null), ''))) as md5, round(avg(logprob) filter (where why is null), 6) as avg_logprob, max(no_speech) filter (where why is null) as max_no_speech, count(why) as dropped from y group by user_id",
    "threshold_what_if": f"with {_SCORED}, p(profile, a, b) as (values {', '.join(str((k, v.no_speech, v.logprob)) for k, v in SCORING.items())}) select profile, count(*) filter (where no_speech > a) as no_speech, count(*) filter (where no_speech <= a and logprob < b) as logprob, count(*) filter (where no_speech <= a and logprob >= b) as kept from x, p group by profile",
    "result_statuses": f"with {TIMED} select case when event_id % 3 <> 0 then 'kept' when event_id % 2 > 0 then 'blocked' when event_id % 5 > 0 then 'dropped' else 'empty' end as status, count(*) as n from e group by 1",
    "worst_scores": f"with {_SCORED} select event_id, logprob from x order by logprob, event_id limit 20",
    "length_stats": f"with {_SCORED} select event_type, count(*) as n, median(dur) as median_s, round(avg((dur < 4)::int::double), 6) as short_share from x group by event_type",
    "kind_counts": "select event_type as kind, count(*) as n from events group by 1",
    "language_decision": f"with {_SCORED} select event_id, case when p_en > p_ja then 'en' else 'ja' end as louder, case when least(p_ja, p_en) >= 0.15 then case when event_id % 2 = 0 then 'en' else 'mix' end when p_en > p_ja + 0.1 then 'en' else 'ja' end as lid, case when (case when event_id % 3 > 0 then no_speech - 3 else -9 end) > logprob then 'en' else 'ja' end as logprob from x",
    "rule_report": f"""with {_SCORED}, y as (select *, no_speech - 3 as en_lp, p_en > p_ja as lid, no_speech - 3 > logprob as lp, event_id % 9 > 5 as leak from x)
      select count(*) as n, round(sum(dur), 3) as seconds, count(*) filter (where lid) as lid_en, round(coalesce(sum(dur) filter (where lid), 0), 3) as lid_en_seconds, count(*) filter (where lp) as logprob_en, round(coalesce(sum(dur) filter (where lp), 0), 3) as logprob_en_seconds,
      count(*) filter (where lid <> lp) as differ, count(*) filter (where least(p_ja, p_en) >= 0.15) as mixed, count(*) filter (where leak) as leaked, count(*) filter (where leak and lid) as leaked_found from y""",
    "body_lines": f"""with {_SCORED}, y as (select event_id as n, event_id * 3 as start, {_LID} as lang, case when event_id % 4 > 0 then '日本' else '' end as ja from x)
      select n, 0 as part, start, lang, {_LINE} || case lang when 'mix' then '⚠MIX JA ' || ja when 'en' then '**EN** an English text' else 'JA ' || ja end as line from y where lang <> 'ja' or ja <> ''
      union all select n, 1, start, lang, {_LINE} || '⚠MIX **EN** an English text' from y where lang = 'mix'""",
    "body_counts": f"with {_SCORED} select kind, count(*) as n from (select case when {_LID} = 'ja' and event_id % 4 = 0 then 'empty' else {_LID} end as kind from x) group by kind",
    "vocab_topk": "with t as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9._-]{2,}', 0)) as term, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9._-]{2,}', 0), 1) as pos from documents) select term, n from (select term, count(*) as n, min((doc_id, pos)) as first from t group by term) order by n desc, first limit 40",
    "first_distinct": f"with {TIMED} select user_id, event_type, event_id from e qualify row_number() over (partition by user_id, event_type order by us, event_id) = 1",
    "bounded_history": f"with {TIMED} select event_id, user_id from e qualify row_number() over (partition by user_id order by us desc, event_id desc) <= 20",
    "top_with_remainder": f"with {TIMED}, r as (select user_id as kind, event_id, row_number() over (partition by user_id order by us, event_id) as k, count(*) over (partition by user_id) as n from e) select kind, event_id, case when k = 5 and n > 5 then n - 5 end as more from r where k <= 5",
    "text_offsets": "select conv_id as session, turn as ord, sum(length(text)) over w - length(text) as raw_start, sum(length(text)) over w as raw_end from conversations window w as (partition by conv_id order by turn rows unbounded preceding)",
    "paragraph_stats": r"with p as (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as t from documents), q as (select doc_id, length(t) as chars, list_filter(string_split(t, chr(10) || chr(10)), lambda x: length(regexp_replace(x, '\s', '', 'g')) > 0) as ps from p) select doc_id, chars, len(ps) as paragraphs, case when len(ps) > 0 then list_sum(list_transform(ps, lambda x: length(x))) // len(ps) end as mean_chars from q",
    "run_stats": """with r as (select user_id, ['kept', 'blocked', 'empty'][event_id % 3 + 1] as status, event_id % 10 / 10 as gap, event_id % 7 = 0 as rec from events)
      select user_id, count(*) filter (where status = 'kept') as chunks, count(*) filter (where status = 'blocked') as blocked, count(*) filter (where status = 'blocked')::double as blocked_s, count(*) filter (where status = 'empty') as empty,
      count(*) filter (where gap >= 0.35) as gaps, round(coalesce(sum(gap) filter (where gap >= 0.35), 0), 3) as gap_s, count(*) filter (where rec) as recovered, round(coalesce(sum(gap) filter (where rec), 0), 3) as recovered_s from r group by user_id""",
    "model_report": f"with {_RUNS} select model, count(*) as n, median(ms) as median_ms, round(avg(ms), 6) as mean_ms, round(sum(ms) / 1000 / sum(seconds), 6) as rtf, round(avg(wer) filter (where trim(ref) <> ''), 6) as wer from r where i >= 3 group by model",
    "keyword_matrix": f"with {_RUNS} select word, count(distinct i) as in_ref, sum(contains(text, word)::int) filter (where model = 'a') as a, sum(contains(text, word)::int) filter (where model = 'b') as b from r, (values ('the'), ('and'), ('der'), ('zebra')) w(word) where i >= 3 and contains(ref, word) group by word",
    "by_difference": f"with {_RUNS} select i, max(wer) as worst from r group by i",
}
