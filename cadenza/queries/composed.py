"""Functions over texts that are put together from parts by each row's number, and over whole tables, with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards, morphemes, text
from ..operators import commands, dictionary, reconvert
from ..plans import flows
from .base import table


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick(options: list[str], by: int, of: str = "event_id") -> str:
    """SQL of either dialect: one of the options by a digit of the row's number in a mixed base, so that all combinations come."""
    cases = " ".join(f"WHEN {k} THEN {_quoted(o)}" for k, o in enumerate(options))
    return f"(CASE CAST(FLOOR({of} / {by}) AS INT) % {len(options)} {cases} END)"


_WORDS = [w for words, _ in text.SYMBOL_WORDS for w in words if "\n" not in w]
_DICTATED = f"{pick(['', '困った', 'これは ', '要点を'], 1)} || {pick([*_WORDS, 'かっこいい', '当点', 'まるい', ''], 4)} || {pick(['', '。', '、 ', 'だ'], 4 * (len(_WORDS) + 4))}"
_NUMBER = pick(["３", "12", "七", "さん", "x", "", "１２３４５６７８９", "1234567890", "十", "きゅう", "１a", "-1", "一二"], 1)
_ORIGINAL, _SPOKEN = pick(["寄与", "ですます", "天気", "", "カタカナ", "kana"], 1), pick(["キヨ", "です", "きょうはいいてんきですね", "寄与", "", "ー", "あ1"], 6)
_LINE = f"{pick(['', 'では、', 'それでは 。', 'ええ', 'です'], 1)} || {pick(['ご視聴ありがとうございました', '最後までご視聴いただき誠にありがとうございます', 'チャンネル登録よろしくお願いします', 'チャンネル登録をお願いいたします', '次回もお楽しみに', 'お楽しみに', 'はい', 'おやすみなさい', ''], 5)} || {pick(['', '。', '！ ', '、次回予告', '高評価高評価'], 45)}"
_GLUED = f"{pick(['ここに', '', '以上です。', 'ありがとう'], 1)} || {pick(['ございます', 'ございました', ''], 4)} || {pick(['ありがとうございます', 'ご視聴ありがとうございました', 'ありがとうございました', ''], 12)} || {pick(['', '。', '、', '。。'], 48)}"
_SHORT, _SEGMENTS = pick(["悪", "てん", " まる ", "。", "ながいことば", "とてもながいことば", ""], 1), "CAST(FLOOR(event_id / 7) AS INT) % 3"
_KANA = f"{pick(['カタカナ', 'ひらがな', 'ヴァイオリン', 'abc', '東京ト'], 1)} || {pick(['、', ' ー', 'ッャ', ''], 5)} || {pick(['キョウ', 'ゐゑ', '12', ''], 20)}"
_CLIENT = f"{pick(['a b', '「あ」', '東京。', ''], 1)} || {pick([' ', '、', '…', '!?'], 4)} || {pick(['x.y', '(z)', '[w]', '・'], 16)}"
_ECHO = f"{pick(['これ', '', '候補を'], 1)} || {pick(['を再変換', 'を修正', 'を言い直し', 'を見る', 'は'], 3)}"
_SESSION = f"{pick(['20260101', '2026010', 'x0260101', '20261231'], 1)} || {pick(['-', '_', ''], 4)} || {pick(['120000', '12000', '235959-2', '235959-', '120000-12'], 12)}"
_MIXED = f"{pick(['今日は Python を', 'Ａトック　', 'a  b', ' '], 1)} || {pick([' 書く', '、、x', '。。', 'New York に', ''], 4)} || {pick([' まる', '', ' てん', 'てんき'], 20)}"
_KIND, _LEFT, _RIGHT = pick(["reconverted", "added", "symbol", "other"], 1), "repeat('a', CAST(event_id % 140 AS INT))", "repeat('b', CAST(event_id * 7 % 270 AS INT))"


def _made(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *(F.expr(sql).alias(name) for name, sql in columns.items()))


def _sql(**columns: str) -> str:
    return f"m as (select event_id, {', '.join(f'{sql} as {name}' for name, sql in columns.items())} from events)"


def dictated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, t=_DICTATED).select("event_id", text.dictated_symbols(F.col("t"), {"当点": "、"}).alias("text"))


def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, t=_NUMBER).select("event_id", text.number(F.col("t")).alias("n"), text.number(F.col("t"), kana=True).alias("kana"))


def spoken_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, a=_ORIGINAL, b=_SPOKEN).select("event_id", text.needs_conversion(F.col("a"), F.col("b")).alias("needed"))


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, t=_LINE).select("event_id", guards.is_boilerplate(F.col("t")).alias("boilerplate"), guards.is_blocked(F.col("t")).alias("blocked"), guards.marker_count(F.col("t")).alias("markers"))


def glued_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, t=_GLUED).select("event_id", guards.without_glued_ending(F.col("t")).alias("text"))


def symbol_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, t=_SHORT, n=_SEGMENTS).select("event_id", F.array_join(reconvert.symbol_choices(F.col("t"), F.col("n"), F.array(F.lit("、"), F.lit("x"))), " ").alias("offers"))


def reading_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, t=_KANA).select("event_id", text.reading_key(F.col("t")).alias("key"))


def client_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, t=_CLIENT).select("event_id", text.comparable_by_client(F.col("t")).alias("key"))


def command_echoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, t=_ECHO, p="CAST(event_id % 5 AS INT)").select("event_id", commands.is_echo(F.col("t"), F.col("p")).alias("echo"))


def valid_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, t=_SESSION).select("event_id", guards.valid_session(F.col("t")).alias("valid"))


def registrable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, k=_KIND, a=_LEFT, b=_RIGHT).select("event_id", commands.registrable(F.col("k"), F.col("a"), F.col("b")).alias("ok"))


def turn_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(f"{pick(['', '。', '、', '（', 'x'], 1, 'turn')} || text || {pick(['', '。', '「', ' ', '）'], 2, 'turn')}").alias("t"), (F.col("turn") % 7 * 0.5).alias("pause"))
    before = F.coalesce(F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return own.select("conv_id", "turn", F.md5(text.pause_comma(F.col("t"), F.col("pause"), before)).alias("md5"))


def edit_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.element_at(F.array(*map(F.lit, ("insert", "insert", "cancel", "restore", "insert", "replace", "trim"))), (F.col("turn") % 7 + 1).cast("int"))
    log = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("ord"), op.alias("op"), F.when(op == "replace", "the").otherwise(F.concat("text", F.lit("  "))).alias("text"), F.lit("<X>").alias("into"))
    return commands.edited(log).select("session", F.md5("body").alias("md5"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations")
    return own.select("conv_id", "turn", F.array_join(commands.occurrences_backwards(F.col("text"), F.when(F.col("turn") % 2 == 0, "the").otherwise("a.")), ",").alias("places"))


def replaced_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 50).cast("int").alias("p")).withColumn("expected", F.col("text").substr(F.when(F.col("doc_id") % 2 == 0, F.col("p") + 1).otherwise(F.lit(7)), F.lit(4)))
    return own.select("doc_id", F.md5(commands.replaced_at(F.col("text"), F.col("p"), F.col("expected"), F.lit("<X>"))).alias("md5"))


_OPTIONS = ["the", "and", " of", "zq", "e"]


def last_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", reconvert.last_surface(F.col("text"), F.array(*map(F.lit, _OPTIONS[:4])), 200).alias("r"))
    return own.select("doc_id", "r.at", "r.surface")


def surface_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("p_name", " ")
    segments = F.array(F.array(w[0], F.upper(w[0]), F.concat(w[0], F.lit("x"))), F.array(w[1], F.concat(w[1], F.lit("y"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(reconvert.surfaces(F.col("p_name"), segments, 2, 3), "|").alias("surfaces"))


def preselected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("p_name", " ")
    third = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("zz"))).otherwise(F.array(F.concat(w[1], F.lit("?")), w[1]))
    segments = F.array(F.array(F.concat(w[0], F.lit("!")), w[0]), F.array(F.lit(" ")), third)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(reconvert.preselected(F.col("p_name"), segments), "|").alias("chosen"))


def reconverted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    known = own.where("p_partkey % 10 = 0").select(F.col("w")[1].alias("reading"), F.col("p_partkey").alias("ord"), F.col("w")[0].alias("candidate"))
    return reconvert.reconverted(own.select(F.col("p_partkey").alias("id"), F.col("w")[0].alias("reading")), known).select("id", F.array_join("candidates", "|").alias("candidates"))


_PROBE = pick(["入力キャンセル", "今日は晴れ", "確定", "", "改行", "参加を惨禍に修正"], 1)


def _cascade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_id") % 9).cast("double").alias("seconds"), (F.col("event_id") % 5 > 0).alias("dictated"), (F.col("event_id") % 7 == 0).alias("recovery"), F.expr(_PROBE).alias("text"))
    return commands.cascaded(own.drop("text"), own.select("session", "seq", "text", F.lit("").alias("reading")), own.select("session", "seq", "text"))


def probe_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir)[0]


def probe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir)[1].select("session", "seq")


def finish_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("ord"), "event_type")
    steps = {name: own.where(F.col("ord") % 5 == k).withColumn("payload", F.concat(F.lit(name[0]), "ord")) for k, name in enumerate(("tail", "held", "context", "refined"))}
    return flows.finished(own.where("ord % 5 = 4 and session % 3 > 0").select("session", F.col("ord").alias("at"), F.col("event_type").alias("reason")), steps)


def language_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.when(F.col("event_id") % 3 == 0, "en").when(F.col("event_id") % 3 == 1, "ja")
    return _made(spark, sf_dir, t=_MIXED).select("event_id", flows.clean_by_language(F.col("t"), language, {"Python": "パイソン"}, symbols=True).alias("text"))


#: Morphemes that rows are put together from: surface, reading, the pos's first fields.
UNITS = [("鍵", "カギ", "名詞"), ("かっこ", "カッコ", "名詞"), ("括弧", "カッコ", "名詞"), ("と", "ト", "助詞"), ("じ", "ジ", "名詞"), ("バージョンカッコトジ", "バージョンカッコトジ", "名詞"), ("カギカッコー", "カギカッコー", "名詞"), ("です", "デス", "助動詞"), ("ね", "ネ", "助詞 終助詞"), ("から", "カラ", "助詞 接続助詞"), ("しかし", "シカシ", "接続詞"), ("つまり", "ツマリ", "副詞"), ("。", "。", "補助記号"), ("晴れる", "ハレル", "動詞 一般 - - - 終止形")]


def unit(row, k: int):
    """Which unit is the k-th of a row: of a column or of a number."""
    return (row * (7 + 2 * k) + 3 * k * k + (row - row % 10**k) / 10**k) % len(UNITS)


def _morphemes(spark: SparkSession, sf_dir: str, length: int = 6) -> DataFrame:
    every = F.array(*[F.struct(F.lit(s).alias("surface"), F.lit(r).alias("reading"), F.split(F.lit(pos + " -" * (5 - pos.count(" "))), " ").alias("pos")) for s, r, pos in UNITS])
    own = table(spark, sf_dir, "events").select("event_id", F.array(*[F.get(every, unit(F.col("event_id"), k).cast("int")) for k in range(length)]).alias("m"))
    return own.withColumn("t", F.array_join(F.transform("m", lambda x: x["surface"]), ""))


def symbols_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _morphemes(spark, sf_dir).select("event_id", morphemes.with_inline_symbols(F.col("t"), F.col("m")).alias("text"))


def punctuated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _morphemes(spark, sf_dir).select("event_id", morphemes.punctuated(F.col("t"), F.col("m")).alias("text"))


def cycle_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("k")).distinct().select(F.concat(F.lit("u"), "k").alias("observed"), F.concat(F.lit("u"), (F.col("k") * F.col("k") + 3) % 12).alias("output"))
    return dictionary.cycle_members(links)


def hallucination_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey") % 4).alias("profile"), F.when(F.col("p_partkey") % 3 == 0, "hotword").otherwise("hallucination").alias("kind"), F.col("p_partkey").cast("int").alias("ord"), F.split("p_name", " ")[0].alias("word"))
    sets = spark.range(3).select(F.lit("s").alias("set_id"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("p"), "id").alias("profile"))
    return dictionary.hallucinations(words, sets, "s")


_OWN = (dictated_words, number_tokens, spoken_conversions, boilerplate_lines, glued_lines, symbol_offers, reading_keys, client_keys, command_echoes, valid_sessions, registrable_pairs, turn_commas, edit_folds, occurrences, replaced_places, last_surfaces, surface_lists, preselected_parts, reconverted_words, cycle_walks, hallucination_words, probe_commands, probe_texts, finish_order, language_texts, symbols_within, punctuated_texts)
QUERIES = {f.__name__: f for f in _OWN}

_SYMBOL = "map {" + ", ".join(f"{_quoted(w)}: {_quoted(s)}" for words, s in text.SYMBOL_WORDS for w in words) + "}"
_TAIL, _END = "[。、 　\t]+$", f"({'|'.join(text.ENDERS)})$"
_NUMBERS = lambda kana: "map {" + ", ".join(f"{_quoted(w)}: {n}" for w, n in (text.KANJI_NUMBERS | (text.KANA_NUMBERS if kana else {})).items()) + "}"
_ALL_KANA = "^[ぁ-ゖァ-ヶー]+$"
_KATA, _HIRA = "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097)))
_BLOCKED = ", ".join(map(_quoted, guards.BLOCKLIST))
_MARKERS = " + ".join(f"len(regexp_extract_all(t, {_quoted(m)}))" for m in guards.MARKERS)
_last = lambda t, s: f"case when instr(reverse({t}), reverse({s})) > 0 then length({t}) - instr(reverse({t}), reverse({s})) + 1 - length({s}) else -1 end"
_near = "greatest(" + ", ".join(_last("n", _quoted(s)) for s in _OPTIONS[:4]) + ")"
_far = "greatest(" + ", ".join(_last("text", _quoted(s)) for s in _OPTIONS[:4]) + ")"
_which = lambda t, at: "case " + " ".join(f"when {_last(t, _quoted(s))} = {at} then {_quoted(s)}" for s in _OPTIONS[:4]) + " end"
_PROBED = f"p as (select user_id as session, event_id as seq, map {{'入力キャンセル': 'cancelInput', '確定': 'confirm', '改行': 'newline'}}[{_PROBE}] as kind from events where event_id % 9 <= 4 and event_id % 5 > 0 and event_id % 7 > 0)"
_J, _AN = r"[\x{3000}-\x{303F}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}]", "[A-Za-z0-9]"
_once = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '({_J}) +({_AN})', '\\1\\2', 'g'), '({_AN}) +({_J})', '\\1\\2', 'g'), '({_J}) +({_J})', '\\1\\2', 'g')"
_FULL, _HALF = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　", ("".join(map(chr, range(0x21, 0x7F))) + " ").replace("'", "''")
_fold = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '、{{2,}}', '、', 'g'), '。{{2,}}', '。', 'g'), '[ \\t]{{2,}}', ' ', 'g')"
ORACLE_SQL = {
    "probe_commands": f"with {_PROBED} select * from p where kind is not null",
    "probe_texts": f"with {_PROBED}, c as (select session, seq from p where kind is not null qualify row_number() over (partition by session order by seq desc) <= 20) select user_id as session, event_id as seq from events where (user_id, event_id) not in (select session, seq from c)",
    "finish_order": "with s as (select user_id, arg_min(event_type, event_id) as reason from events where event_id % 5 = 4 and user_id % 3 > 0 group by 1), r as (select user_id, event_id % 5 as step, event_id as ord, ['tail', 'held', 'context', 'refined'][event_id % 5 + 1] as event, ['t', 'h', 'c', 'r'][event_id % 5 + 1] || event_id as payload from events where event_id % 5 < 4 and user_id in (select user_id from s) union all select user_id, 4, 0, 'stopped', reason from s) select user_id as session, row_number() over (partition by user_id order by step, ord, payload)::int as n, event, payload from r",
    "language_texts": f"with {_sql(t=_MIXED)}, h as (select event_id, t as raw, translate(regexp_replace(t, '^[\\s　]+|[\\s　]+$', '', 'g'), '{_FULL}', '{_HALF}') as t from m), s as (select *, trim(t) as u, regexp_replace(trim(t), '{_TAIL}', '') as bare, regexp_extract(trim(t), '{_END}', 1) as w from h), d as (select *, case when u = '' then u else coalesce({_SYMBOL}[bare], case when w <> '' then regexp_replace(left(u, length(u) - length(w)), '{_TAIL}', '') || {_SYMBOL}[w] end, u) end as x from s), r as (select *, replace(x, 'Python', 'パイソン') as x2 from d) select event_id, case when event_id % 3 = 0 then {_fold('t')} else {_fold(_once(_once('x2')))} end as text from r",
    "dictated_words": f"with {_sql(t=_DICTATED)}, s as (select event_id, regexp_replace(t, '^[\\s　]+|[\\s　]+$', '', 'g') as t from m), b as (select *, regexp_replace(t, '{_TAIL}', '') as bare, regexp_extract(t, '{_END}', 1) as w from s) select event_id, case when t = '' then t else coalesce(case when bare = '当点' then '、' end, {_SYMBOL}[bare], case when w <> '' then regexp_replace(left(t, length(t) - length(w)), '{_TAIL}', '') || {_SYMBOL}[w] end, t) end as text from b",
    "number_tokens": f"with {_sql(t=_NUMBER)}, d as (select *, translate(t, '０１２３４５６７８９', '0123456789') as d from m) select event_id, coalesce(case when regexp_matches(d, '^[0-9]{{1,9}}$') then d::int end, {_NUMBERS(False)}[t]) as n, coalesce(case when regexp_matches(d, '^[0-9]{{1,9}}$') then d::int end, {_NUMBERS(True)}[t]) as kana from d",
    "spoken_conversions": f"with {_sql(a=_ORIGINAL, b=_SPOKEN)} select event_id, length(b) between 1 and 8 and not regexp_matches(a, '{_ALL_KANA}') and regexp_matches(b, '{_ALL_KANA}') as needed from m",
    "boilerplate_lines": f"with {_sql(t=_LINE)} select event_id, regexp_matches(regexp_replace(t, '^[\\s　]+|[\\s　]+$', '', 'g'), {_quoted(guards.BOILERPLATE)}) as boilerplate, t in ({_BLOCKED}) as blocked, ({_MARKERS})::int as markers from m",
    "glued_lines": f"with {_sql(t=_GLUED)} select event_id, regexp_replace(regexp_replace(t, '(ございます)ありがとうございます[。、]?$', '\\1'), '(ございます)ご視聴ありがとうございました[。、]?$', '\\1') as text from m",
    "symbol_offers": f"with {_sql(t=_SHORT, n=_SEGMENTS)} select event_id, case when n = 1 and length(trim(t)) between 1 and 6 and trim(t) not in ({', '.join(map(_quoted, reconvert.SYMBOLS))}) then array_to_string(list_filter([{', '.join(map(_quoted, reconvert.SYMBOLS))}], lambda x: x not in ('、', 'x')), ' ') else '' end as offers from m",
    "reading_keys": f"with {_sql(t=_KANA)} select event_id, regexp_replace(translate(t, '{_KATA}', '{_HIRA}'), '[^ぁ-ゖ]', '', 'g') as key from m",
    "client_keys": f"with {_sql(t=_CLIENT)} select event_id, regexp_replace(replace(t, '…', '...'), '[\\s、。！？!?・：:；;,.「」『』（）()\\[\\]…]', '', 'g') as key from m",
    "command_echoes": f"with {_sql(t=_ECHO, p='CAST(event_id % 5 AS INT)')} select event_id, regexp_matches(substr(t, p + 1, 5), '^(?:{"|".join(commands.COMMAND_RESTS)})') as echo from m",
    "valid_sessions": f"with {_sql(t=_SESSION)} select event_id, regexp_full_match(t, '[0-9]{{8}}-[0-9]{{6}}(-[0-9]+)?') as valid from m",
    "registrable_pairs": f"with {_sql(k=_KIND, a=_LEFT, b=_RIGHT)} select event_id, case k when 'reconverted' then length(a) between 2 and 64 and length(b) <= 128 when 'added' then length(a) between 2 and 128 and length(b) <= 256 when 'symbol' then length(a) between 1 and 16 else false end as ok from m",
    "turn_commas": f"with c as (select conv_id, turn, {pick(['', '。', '、', '（', 'x'], 1, 'turn')} || text || {pick(['', '。', '「', ' ', '）'], 2, 'turn')} as t, turn % 7 * 0.5 as pause from conversations), p as (select *, coalesce(lag(t) over (partition by conv_id order by turn), '') as before from c) select conv_id, turn, md5(case when pause > 0 and pause <= 2 and t <> '' and not regexp_matches(t, '^[、。！？!?…・：\\n）」』]') and before <> '' and not regexp_matches(before, '[、。！？!?…・：\\s　「『（(]$') then '、' || t else t end) as md5 from p",
    "edit_folds": """with recursive c as (select conv_id::varchar as session, row_number() over (partition by conv_id order by turn) as k, count(*) over (partition by conv_id) as n, ['insert', 'insert', 'cancel', 'restore', 'insert', 'replace', 'trim'][turn % 7 + 1] as op, text || '  ' as text from conversations),
z as (select distinct session, 0::bigint as k, n from c),
w(session, k, n, body, done, undone) as (select session, k, n, '', []::varchar[], []::varchar[] from z
  union all
  select c.session, c.k, c.n,
    case when op = 'insert' then body || text when back then left(body, length(body) - length(done[-1])) when again then body || undone[-1]
      when op = 'replace' and contains(body, 'the') then left(body, length(body) - instr(reverse(body), 'eht') - 2) || '<X>' || right(body, instr(reverse(body), 'eht') - 1) when op = 'trim' then regexp_replace(body, '\\s+$', '') else body end,
    case when op = 'insert' then list_append(done, text) when back then done[1:len(done) - 1] when again then list_append(done, undone[-1]) else done end,
    case when op = 'insert' then [] when back then list_append(undone, done[-1]) when again then undone[1:len(undone) - 1] else undone end
  from (select c.*, w.body, w.done, w.undone, coalesce(c.op = 'cancel' and len(w.done) > 0 and suffix(w.body, w.done[-1]), false) as back, c.op = 'restore' and len(w.undone) > 0 as again from w join c on c.session = w.session and c.k = w.k + 1) c)
select session, md5(body) as md5 from w where k = n""",
    "occurrences": "with g as (select conv_id, turn, string_split(text, p) as g, length(p) as n from (select *, case when turn % 2 = 0 then 'the' else 'a.' end as p from conversations)) select conv_id, turn, coalesce(array_to_string(list_reverse(list_transform(range(1, len(g)), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + (i - 1) * n)), ','), '') as places from g",
    "replaced_places": f"with m as (select doc_id, text, (doc_id % 50)::int as p, substr(text, case when doc_id % 2 = 0 then (doc_id % 50)::int + 1 else 7 end, 4) as x from documents), a as (select *, case when substr(text, p + 1, length(x)) = x then p else {_last('text', 'x')} end as place from m) select doc_id, md5(case when length(x) > 0 and place >= 0 then left(text, place::int) || '<X>' || substr(text, place::int + length(x)::int + 1) else text end) as md5 from a",
    "last_surfaces": f"with m as (select doc_id, text, right(text, 200) as n, greatest(length(text) - 200, 0) as skipped from documents), a as (select *, {_near} as near, {_far} as far from m) select doc_id, case when near >= 0 then near + skipped when far >= 0 then far end::int as at, case when near >= 0 then {_which('n', 'near')} when far >= 0 then {_which('text', 'far')} end as surface from a",
    "surface_lists": "with m as (select p_partkey, p_name, string_split(p_name, ' ')[1] as a, string_split(p_name, ' ')[2] as b from part) select p_partkey, array_to_string([p_name, a || b, a || b || 'y', upper(a) || b], '|') as surfaces from m",
    "preselected_parts": "with m as (select p_partkey, string_split(p_name, ' ') as w from part) select p_partkey, case when p_partkey % 3 = 0 then w[1] || '| ' else w[1] || '| |' || w[2] end as chosen from m",
    "reconverted_words": "with m as (select p_partkey, string_split(p_name, ' ') as w from part), k as (select w[2] as reading, string_agg(w[1], '|' order by p_partkey, w[1]) as c from m where p_partkey % 10 = 0 group by 1) select p_partkey as id, coalesce(c, w[1]) as candidates from m left join k on k.reading = m.w[1]",
    "cycle_walks": "with recursive l as (select distinct user_id % 12 as a, (user_id % 12 * (user_id % 12) + 3) % 12 as b from events), w(origin, here, n) as (select a, b, 1 from l union all select w.origin, l.b, n + 1 from w join l on l.a = w.here where w.here <> w.origin and n < 13) select distinct 'u' || origin as observed from w where here = origin",
    "hallucination_words": "select distinct string_split(p_name, ' ')[1] as word from part where p_partkey % 3 <> 0 and p_partkey % 4 < 3",
}
