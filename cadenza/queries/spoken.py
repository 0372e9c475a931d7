"""Utterances, handovers and revisions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards, signal, text
from ..operators import commands, coverage
from .base import TIMED, table, timed

_KATA, _HIRA = "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097)))
_quoted = lambda s: "'" + s.replace("'", "''") + "'"

#: What is said about a part, in SQL of both engines: commands with a part's name in them, commands alone, forms of an open list, and plain text.
_SAID = """case p_partkey % 13 when 0 then p_name || 'を再変換' when 1 then p_name || 'を言い直して。' when 2 then p_name || 'を' || p_type || 'に修正' when 3 then '確定' when 4 then '候補' || (p_partkey % 9 + 1) || '番'
  when 5 then 'ここを言い直' when 6 then ' 入力キャンセル。' when 7 then p_name when 8 then 'カク テイ' when 9 then '訂正' when 10 then 'これを再変換' when 11 then 'サンバー' else 'ヤメル' end"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each utterance is as a command, in an open list and loosely, and where it goes."""
    c = F.col
    own = table(spark, sf_dir, "part").select("p_partkey", F.expr(_SAID).alias("text"), F.lit("").alias("reading"), (c("p_size") % 7 == 0).alias("consumed"), (c("p_size") % 3 == 0).alias("in_dialog"), (c("p_size") % 2 == 0).alias("has_selection"), (c("p_size") % 5 == 0).alias("awaiting"))
    own = commands.routed(own).withColumns({"c": commands.classified(c("text")), "m": commands.classified_in_dialog(c("text")), "loose": commands.loosely_respeak(c("text"))})
    return own.select("p_partkey", "c.kind", c("c.index").alias("n"), "c.target", c("c.into").alias("put"), c("m.kind").alias("dialog"), c("m.index").alias("dialog_n"), "loose", "route")


#: A turn as what may stand around a good night: a handover, the phrase, an introduction, the turn itself, nothing.
_HANDED = "case (conv_id + turn * 3) % 7 when 0 then text || 'お願いします。' when 1 then 'おやすみなさい。' when 2 then 'おやすみなさい' when 3 then '皆様こんにちは' || text when 4 then '本日は' || text when 5 then '' else text end"


def handovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_HANDED).alias("text"))
    return coverage.judged(own, "conv_id", "turn").select("conv_id", "turn", "removed")


def newest_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of three seconds for each event, and ranges gone over again whose edges lie on them or beside them."""
    own = timed(spark, sf_dir).select(F.col("user_id").alias("session"), (F.col("event_id") % 400).cast("double").alias("k"), "event_id")
    spans = own.select("session", (F.col("k") * 3).alias("start"), (F.col("k") * 3 + 3).alias("end"), (F.col("event_id") % 3).alias("revision"))
    again = own.select("session", (F.col("k") * 3 + F.col("event_id") % 4 / 100).alias("start"), (F.col("k") * 3 + 3 * (1 + F.col("event_id") % 2) - F.col("event_id") % 3 / 100).alias("end"), (F.col("event_id") % 5).alias("revision"))
    found = coverage.newest(again, spans)
    return found.groupBy("session", "start", "end", "revision").agg(F.count(F.lit(1)).alias("n"))


def one_language_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = timed(spark, sf_dir).select("event_id", (F.col("value") % 1).alias("p_ja"), (1 - F.col("value") % 1).alias("p_en"))
    return coverage.one_language(own, 0.15).select("event_id")


def model_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a model's probability, or without one, and a level."""
    own = timed(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("value") % 1).alias("prob"), (F.col("value") / 5000).alias("level"))
    return own.select("event_id", signal.is_active_by_model(F.col("prob"), F.col("level")).alias("active"))


def kana_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names, spelt in kana of both kinds, turned into one kind and the other."""
    own = table(spark, sf_dir, "part").select("p_partkey", F.translate(F.col("p_name"), "abcdefghijklm", "アいウえオかキくケこサしス").alias("t"))
    return own.select("p_partkey", text.katakana_to_hiragana(F.col("t")).alias("hira"), text.hiragana_to_katakana(F.col("t")).alias("kata"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a part's name as morphemes, some without a reading."""
    words = F.transform(F.split("p_name", " "), lambda w, i: F.struct(w.alias("surface"), F.when((F.col("p_partkey") + i) % 3 == 0, F.lit("")).when((F.col("p_partkey") + i) % 3 == 1, F.upper(w)).alias("reading")))
    return table(spark, sf_dir, "part").select("p_partkey", text.reading(words).alias("reading"))


QUERIES = {f.__name__: f for f in (utterances, handovers, newest_ranges, one_language_events, model_activity, kana_names, readings)}

_map = lambda d: "map {" + ", ".join(f"{_quoted(k)}: {_quoted(str(v))}" for k, v in d.items()) + "}"
_number = lambda t, names: f"try_cast(case when regexp_full_match(translate({t}, '０１２３４５６７８９', '0123456789'), '[0-9]{{1,9}}') then translate({t}, '０１２３４５６７８９', '0123456789') else {_map(names)}[{t}] end as int)"
_select = ", ".join(map(_quoted, commands.SELECTION))
_strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
ORACLE_SQL = {
    "utterances": f"""with s as (select p_partkey, p_size, {_SAID} as t from part),
      o as (select *, regexp_replace({_strip("t")}, '[。、．，\\s]+$', '') as own from s),
      b as (select *, regexp_replace(own, '[\\s・]+', '', 'g') as flat, {_map({w: k for k, w, _ in commands.PHRASES})}[own] as phrase, {_number(f"regexp_extract(own, {_quoted(commands.PICK)}, 1)", text.KANJI_NUMBERS)} as pick,
        {_strip(f"regexp_extract(own, {_quoted(commands.RECONVERT_TARGET)}, 1)")} as again, {_strip(f"regexp_extract(own, {_quoted(commands.RESPEAK_TARGET)}, 1)")} as say, {_strip(f"regexp_extract(own, {_quoted(commands.REPLACE)}, 1)")} as a, {_strip(f"regexp_extract(own, {_quoted(commands.REPLACE)}, 2)")} as z from o),
      h as (select *, translate(flat, '{_KATA}', '{_HIRA}') as hira from b),
      d as (select *, regexp_replace(regexp_replace(replace(hira, 'ー', ''), '^(候補|こうほ)', ''), '(番目|ばんめ|番|ばん|ば)$', '') as body from h),
      k as (select *, case when phrase is not null then phrase when pick is not null then 'pick' when again in ({_select}) then 'reconvertSelection' when again <> '' then 'reconvertTarget' when say in ({_select}) then 'respeakExplicit' when say <> '' then 'respeakTarget' when a <> '' and z <> '' then 'replace' end as kind,
        {_number("body", text.KANJI_NUMBERS | text.KANA_NUMBERS)} as dn, regexp_matches(flat, {_quoted(commands.MODAL_CONFIRM)}) or regexp_matches(hira, {_quoted(commands.MODAL_CONFIRM)}) as yes, regexp_matches(flat, {_quoted(commands.MODAL_CANCEL)}) or regexp_matches(hira, {_quoted(commands.MODAL_CANCEL)}) as no from d),
      r as (select *, case when yes then 'confirm' when no then 'cancel' when dn is not null then 'pick' end as dialog, length(own) <= 15 and regexp_matches(own, {_quoted(commands.LOOSE_RESPEAK)}) as loose from k)
      select p_partkey, kind, case when kind = 'pick' then pick end as n, case kind when 'reconvertTarget' then again when 'respeakTarget' then say when 'replace' then a end as target, case kind when 'replace' then z end as put, dialog, case dialog when 'pick' then dn end as dialog_n, loose,
        case when p_size % 7 = 0 then 'consumed' when p_size % 3 = 0 and dialog is not null then 'dialog' when kind is not null and (kind <> 'respeak' or p_size % 2 = 0) then 'exact' when p_size % 2 = 0 and loose then 'loose' when p_size % 5 = 0 then 'respeak' else 'insert' end as route from r""",
    "handovers": f"""with t as (select conv_id, turn, {_HANDED} as t from conversations), n as (select *, lag(t) over w as b, lead(t) over w as a from t window w as (partition by conv_id order by turn))
      select conv_id, turn, coalesce(t in ('おやすみなさい', 'おやすみなさい。') and trim(b) <> '' and trim(a) <> '' and regexp_matches(trim(b, chr(10) || ' '), {_quoted(guards.HANDOVER)}) and regexp_matches(trim(a, chr(10) || ' '), {_quoted(guards.INTRODUCTION)}), false) as removed from n""",
    "newest_ranges": f"""with {TIMED}, o as (select user_id as session, (event_id % 400)::double as k, event_id from e), s as (select session, k * 3 as a, k * 3 + 3 as z, event_id % 3 as r from o),
      g as (select session, k * 3 + event_id % 4 / 100 as a, k * 3 + 3 * (1 + event_id % 2) - event_id % 3 / 100 as z, event_id % 5 as r from o), m as (select session, a, z, max(r) as r from g group by all),
      f as (select m.*, (select max(s.r) from s where s.session = m.session and abs(s.a - m.a) <= 0.02) as have, exists (select 1 from s where s.session = m.session and abs(s.z - m.z) <= 0.02) as edge from m)
      select session, a as start, z as "end", r as revision, 1 as n from f where r > have and edge""",
    "one_language_events": f"with {TIMED} select event_id from e where least(value % 1, 1 - value % 1) < 0.15",
    "model_activity": f"with {TIMED} select event_id, case when event_id % 3 > 0 then value % 1 >= 0.5 else value / 5000 >= {signal.fixed_floor(0.5)} end as active from e",
    "kana_names": f"select p_partkey, translate(t, '{_KATA}', '{_HIRA}') as hira, translate(t, '{_HIRA}', '{_KATA}') as kata from (select p_partkey, translate(p_name, 'abcdefghijklm', 'アいウえオかキくケこサしス') as t from part)",
    "readings": "with w as (select p_partkey, string_split(p_name, ' ') as w from part) select p_partkey, array_to_string(list_transform(range(1, len(w) + 1), lambda i: case when (p_partkey + i - 1) % 3 = 1 then upper(w[i]) else w[i] end), '') as reading from w",
}
