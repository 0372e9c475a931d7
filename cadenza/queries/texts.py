"""String functions and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import align, dictionary, guards, text
from ..operators import commands, reconvert
from .base import fixture, table

_JA = """(VALUES (1, '今日は Python を 書く'), (2, 'New York に 行く'), (3, 'Ａトック　２０'), (4, '、、あ。。い'), (5, 'これは  テスト'), (6, ''), (7, 'ＡＢＣ ＤＥＦ'), (8, 'カタカナとひらがな'), (9, 'abc def')) AS t(id, text)"""
_ALONE = """(VALUES (1, '丸。'), (2, '会場'), (3, '会場は広い'), (4, 'これはテストです まる'), (5, 'かっこ'), (6, '当点'), (7, ''), (8, '要点をまとめる'), (9, 'まるてん')) AS t(id, text)"""
_BOILER = """(VALUES (1, 'では、ご視聴ありがとうございました。'), (2, 'ですご視聴ありがとうございました'), (3, 'ご視聴ありがとうございました'), (4, 'チャンネル登録よろしくお願いします！'), (5, '次回もお楽しみに'), (6, 'はい'), (7, 'おやすみなさい'), (8, '')) AS t(id, text)"""
_ARTIFACT = """(VALUES (1, 'こちらも省略します。次回予告次のスライドをご覧ください。', 0.05, 0.9), (2, '以上で終わります。', 0.0005, 0.01), (3, '以上で終わります。', 0.05, 0.9), (4, 'おやすみなさい', 0.05, 0.9), (5, 'おやすみなさい', 0.0005, 0.0), (6, '体験価値を提供します。ご視聴ありがとうございました。昨年は新施設を開設しました。', 0.05, 0.9), (7, '本日はご視聴ありがとうございました。', 0.05, 0.9)) AS t(id, text, rms, active)"""
_GLUED = """(VALUES (1, 'ここにございますありがとうございます'), (2, '以上です。ありがとうございました。'), (3, 'ございますご視聴ありがとうございました。'), (4, 'ありがとうございます')) AS t(id, text)"""
_NUMBERS = """(VALUES (1, '３'), (2, '12'), (3, '七'), (4, 'さん'), (5, 'x'), (6, '')) AS t(id, token)"""
_COMMANDS = """(VALUES (1, '入力キャンセル'), (2, '参加を惨禍に修正'), (3, '修行'), (4, '3番'), (5, '候補七'), (6, 'スミシンを再変'), (7, 'ここを再変換'), (8, 'これを言い直し'), (9, '寄与をいいなおし'), (10, '確定。'), (11, '改行'), (12, '今日は晴れ'), (13, '')) AS t(id, text)"""
_READINGS = """(VALUES (1, '乳酸キャンセル', 'ニュウサンキャンセル'), (2, '修行', 'シュギョウ'), (3, 'にゅりょくキャンセル', 'ニュリョクキャンセル'), (4, 'さいへんかん', 'サイヘンカン'), (5, '今日はいい天気ですね', 'キョウハイイテンキデスネ'), (6, 'x', '')) AS t(id, text, reading)"""
_PAUSES = """(VALUES (1, 1, '今日は', CAST(NULL AS DOUBLE)), (1, 2, '晴れです', 0.5), (1, 3, '。明日は', 0.7), (1, 4, '雨', 2.5), (1, 5, '（注）', 0.4), (1, 6, 'です。', 0.0), (1, 7, '終わり', 1.0)) AS t(session, ord, text, pause)"""


def fullwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, _JA).select("id", text.half_width(F.col("text")).alias("text"))


def japanese_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, _JA).select("id", text.without_japanese_spaces(F.col("text")).alias("text"))


def kana_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, _JA).select("id", text.katakana_to_hiragana(F.col("text")).alias("hira"), text.hiragana_to_katakana(F.col("text")).alias("kata"))


def symbols_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    return docs.unionByName(fixture(spark, _JA).select(F.col("id").cast("long"), "text")).select("id", F.md5(text.collapsed(F.col("text"))).alias("md5"))


def latin_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.latin_ratio(F.col("text")), 6).alias("share"))


def dictated_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, _ALONE).select("id", text.dictated_symbols(F.col("text"), {"当点": "、"}).alias("text"))


def replace_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(dictionary.replaced(F.col("text"), {"th": "T", "the": "<the>", "there": "<there>", "e.": "E!", "in": "th"})).alias("md5"))


def replace_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(dictionary.replaced_in_turn(F.col("text"), [("th", "T"), ("The", "A"), ("in", "th"), ("th", "x")])).alias("md5"))


def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("# "), "text", F.lit(" **bold** [link](http://x) ![i](y) [[target|alias]] [[page]] `code` <!-- no -->"))
    return table(spark, sf_dir, "documents").select("doc_id", text.note_text(made).alias("text")).select("doc_id", F.md5("text").alias("md5"))


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.word_list(F.regexp_replace("text", "[^A-Za-z' ]", " "))).alias("n"))


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 - 5).alias("s"))
    return own.select("event_id", text.clock(F.col("s")).alias("clock"), text.minute_clock(F.greatest(F.col("s"), F.lit(0)) / F.lit(4.0) * F.lit(4.0)).alias("minutes"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, _NUMBERS).select("id", text.number(F.col("token")).alias("n"), text.number(F.col("token"), kana=True).alias("kana"))


def key_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.split_keys(F.col("text")), "|").alias("keys"))


def conversion_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, "(VALUES (1, '寄与', 'キヨ'), (2, 'ですます', 'です'), (3, '天気', 'きょうはいいてんきですね'), (4, '寄与', '寄与'), (5, '寄与', '')) AS t(id, original, spoken)")
    return own.select("id", text.needs_conversion(F.col("original"), F.col("spoken")).alias("needed"))


def english_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.english_final(F.col("text"))).alias("md5"))


def line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.without_line_breaks(F.col("text"))).alias("md5"))


def pause_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.coalesce(F.lag("text").over(Window.partitionBy("session").orderBy("ord")), F.lit(""))
    return fixture(spark, _PAUSES).select("ord", text.pause_comma(F.col("text"), F.col("pause"), before).alias("text"))


def tsv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_id", F.round("value", 3).alias("value"), "props")
    return own.select("event_id", text.tsv_cell(F.col("value"), "double").alias("value"), text.tsv_cell(F.col("props"), "string").alias("props"))


def boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, _BOILER).select("id", guards.is_boilerplate(F.col("text")).alias("boilerplate"), guards.is_blocked(F.col("text")).alias("blocked"), guards.marker_count(F.col("text")).alias("markers"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, _ARTIFACT).select("id", guards.without_artifacts(F.col("text"), F.col("rms").cast("double"), F.col("active").cast("double")).alias("r"))
    return own.select("id", "r.text", F.array_join("r.removed", ",").alias("removed"))


def glued_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, _GLUED).select("id", guards.without_glued_ending(F.col("text")).alias("text"))


def parsed_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, _COMMANDS).select("id", commands.classified(F.col("text")).alias("c")).select("id", "c.kind", "c.index", "c.target", "c.into")


def fuzzy_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, _READINGS).select("id", commands.by_reading(F.col("text"), F.col("reading")).alias("m"), commands.probed(F.col("text"), F.col("reading")).alias("probe"))
    return own.select("id", "m.kind", "m.distance", "m.confident", "probe")


def reading_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, "(VALUES ('ては'), ('へんかん'), ('かこ'), ('へんか')) AS t(reading)")
    return reconvert.variants(own, 6)


def symbol_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixture(spark, "(VALUES (1, '悪', 1, 'x'), (2, '悪', 3, 'x'), (3, 'てん', 1, '、'), (4, '。', 1, 'x'), (5, 'ながいことば', 1, 'x'), (6, 'とてもながいことば', 1, 'x')) AS t(id, text, n, have)")
    return own.select("id", F.size(reconvert.symbol_choices(F.col("text"), F.col("n"), F.array("have"))).alias("n"))


def compressed_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.repetition(F.col("text")).alias("ratio"))


def adjacent_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(align.repeats_in()(F.col("text"))).alias("r")).select("doc_id", "r.pos", "r.unit")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("ref"))
    return docs.withColumn("live", F.regexp_replace(F.regexp_replace("ref", "the ", ""), "ing", "ign"))


def text_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("conv_id", "turn", F.explode(align.differences(F.col("live"), F.col("ref"))).alias("h")).select("conv_id", "turn", "h.*")


def text_match_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("conv_id", "turn", align.match_ratio("live", "ref").alias("ratio"))


def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("conv_id", "turn", align.word_error_rate(text.word_list(F.col("ref")), text.word_list(F.col("live"))).alias("wer"))


def safe_refinements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("conv_id", "turn", align.refinement_safety(F.col("ref"), F.col("live")).alias("s")).select("conv_id", "turn", "s.safe", "s.reason")


def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    return own.select("p_partkey", align.edit_distance(F.col("a"), F.col("b")).alias("distance"))


QUERIES = {f.__name__: f for f in (fullwidth, japanese_spacing, kana_swap, symbols_collapse, latin_share, dictated_symbols, replace_longest, replace_in_turn, markdown_strip, word_lists, clocks, numbers, key_lists, conversion_needed, english_spaces, line_breaks, pause_commas, tsv_cells, boilerplate, artifacts, glued_endings, parsed_commands, fuzzy_commands, reading_variants, symbol_choices, compressed_repetition, adjacent_repeats, text_differences, text_match_ratio, word_errors, safe_refinements, edit_distances)}

_FULL, _HALF = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　", ("".join(map(chr, range(0x21, 0x7F))) + " ").replace("'", "''")
_KATA, _HIRA = "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097)))
_J = r"[\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}]"
_PASS = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '({_J}) +([A-Za-z0-9])', '\\1\\2', 'g'), '([A-Za-z0-9]) +({_J})', '\\1\\2', 'g'), '({_J}) +({_J})', '\\1\\2', 'g')"
_KEYS = ["there", "the", "th", "e\\.", "in"]
_MAP = "map {'there': '<there>', 'the': '<the>', 'th': 'T', 'e.': 'E!', 'in': 'th'}"
_DOC_MD = "'# ' || text || ' **bold** [link](http://x) ![i](y) [[target|alias]] [[page]] `code` <!-- no -->'"
_expected = lambda name, cols, rows: f"select * from (values {', '.join(str(r).replace('None', 'null') for r in rows)}) t({cols})"
ORACLE_SQL = {
    "fullwidth": f"select id, translate(text, '{_FULL}', '{_HALF}') as text from {_JA}",
    "japanese_spacing": f"select id, {_PASS(_PASS(_PASS('text')))} as text from {_JA}",
    "kana_swap": f"select id, translate(text, '{_KATA}', '{_HIRA}') as hira, translate(text, '{_HIRA}', '{_KATA}') as kata from {_JA}",
    "symbols_collapse": f"select id, md5(regexp_replace(regexp_replace(regexp_replace(text, '、{{2,}}', '、', 'g'), '。{{2,}}', '。', 'g'), '[ \\t]{{2,}}', ' ', 'g')) as md5 from (select doc_id as id, text from documents union all select id, text from {_JA})",
    "latin_share": "select doc_id, round(case when length(s) > 0 then length(regexp_replace(s, '[^A-Za-z]', '', 'g')) / length(s) else 0 end, 6) as share from (select doc_id, regexp_replace(text, '\\s', '', 'g') as s from documents)",
    "dictated_symbols": _expected("dictated", "id, text", [(1, "。"), (2, "\n"), (3, "会場は広い"), (4, "これはテストです。"), (5, "（"), (6, "、"), (7, ""), (8, "要点をまとめる"), (9, "まる、")]).replace("'\\n'", "chr(10)"),
    "replace_longest": f"select doc_id, md5(list_aggregate(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce({_MAP}[h[i]], '')), 'string_agg', '')) as md5 from (select doc_id, string_split_regex(text, '{'|'.join(_KEYS)}') as g, regexp_extract_all(text, '{'|'.join(_KEYS)}', 0) as h from documents)",
    "replace_in_turn": "select doc_id, md5(replace(replace(replace(replace(text, 'th', 'T'), 'The', 'A'), 'in', 'th'), 'th', 'x')) as md5 from documents",
    "markdown_strip": f"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_DOC_MD}, '<!--.*?-->', '', 'gs'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '\\[\\[[^\\]|]*\\|([^\\]]+)\\]\\]', '\\1', 'g'), '\\[\\[([^\\]|]*)\\|?\\]\\]', '\\1', 'g'), '(?m)^\\s{{0,3}}(?:[#>]+|[-*+]|\\d+\\.)\\s+', '', 'g'), '\\*\\*|~~|==|`', '', 'g')) as md5 from documents",
    "word_lists": "select conv_id, turn, len(list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z'' ]', ' ', 'g')), ' +'), lambda w: w <> '')) as n from conversations",
    "clocks": "select event_id, case when s < 0 then '--:--:--' else printf('%02d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) end as clock, printf('%d:%04.1f', greatest(s, 0) // 60, (greatest(s, 0) % 60)::double) as minutes from (select event_id, event_id * 37 - 5 as s from events)",
    "numbers": _expected("numbers", "id, n, kana", [(1, 3, 3), (2, 12, 12), (3, 7, 7), (4, None, 3), (5, None, None), (6, None, None)]),
    "key_lists": "select doc_id, coalesce(list_aggregate(list_filter(list_transform(string_split_regex(text, '[、,，／/\\n]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), 'string_agg', '|'), '') as keys from documents",
    "conversion_needed": _expected("needed", "id, needed", [(1, True), (2, False), (3, False), (4, False), (5, False)]),
    "english_spaces": "select doc_id, md5(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')) as md5 from documents",
    "line_breaks": "select doc_id, md5(replace(replace(text, chr(10), ''), chr(13), '')) as md5 from documents",
    "pause_commas": _expected("commas", "ord, text", [(1, "今日は"), (2, "、晴れです"), (3, "。明日は"), (4, "雨"), (5, "、（注）"), (6, "です。"), (7, "終わり")]),
    "tsv_cells": "select event_id, coalesce(printf('%.3f', round(value, 3)), '') as value, coalesce(translate(props, chr(9) || chr(10), '  '), '') as props from events",
    "boilerplate": _expected("boilerplate", "id, boilerplate, blocked, markers", [(1, True, False, 1), (2, False, False, 1), (3, True, True, 1), (4, True, False, 1), (5, True, False, 1), (6, False, True, 0), (7, False, True, 1), (8, False, False, 0)]),
    "artifacts": _expected("artifacts", "id, text, removed", [(1, "こちらも省略します。次のスライドをご覧ください。", "次回予告"), (2, "", "以上で終わります"), (3, "以上で終わります。", ""), (4, "おやすみなさい", ""), (5, "", "おやすみなさい"), (6, "体験価値を提供します。昨年は新施設を開設しました。", "ご視聴ありがとうございました"), (7, "本日はご視聴ありがとうございました。", "")]),
    "glued_endings": _expected("glued", "id, text", [(1, "ここにございます"), (2, "以上です。ありがとうございました。"), (3, "ございます"), (4, "ありがとうございます")]),
    "parsed_commands": _expected("commands", "id, kind, index, target, into", [(1, "cancelInput", None, None, None), (2, "replace", None, "参加", "惨禍"), (3, None, None, None, None), (4, "pick", 3, None, None), (5, "pick", 7, None, None), (6, "reconvertTarget", None, "スミシン", None), (7, "reconvertSelection", None, None, None), (8, "respeakExplicit", None, None, None), (9, "respeakTarget", None, "寄与", None), (10, "confirm", None, None, None), (11, "newline", None, None, None), (12, None, None, None, None), (13, None, None, None, None)]).replace("t(id, kind, index, target, into)", 't(id, kind, "index", target, "into")'),
    "fuzzy_commands": _expected("fuzzy", "id, kind, distance, confident, probe", [(1, "cancelInput", 3, True, "cancelInput"), (2, None, None, None, None), (3, "cancelInput", 1, True, "cancelInput"), (4, "reconvert", 0, True, "reconvert"), (5, None, None, None, None), (6, None, None, None, None)]),
    "symbol_choices": _expected("choices", "id, n", [(1, 13), (2, 0), (3, 12), (4, 0), (5, 13), (6, 0)]),
    "edit_distances": "select p_partkey, levenshtein(p_name, p_type) as distance from part",
}
