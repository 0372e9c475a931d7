"""Spoken commands: classification by exact phrases, patterns and readings, and what they do to a text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import bound
from ..functions.text import katakana_to_hiragana, number, reading_key, stripped
from ..functions.udf import arrow
from .folding import folded
from .joins import unconsumed

#: Phrases, their readings and what they mean, in the order that breaks ties.
PHRASES = (
    ("stop", "入力終了", "にゅうりょくしゅうりょう"), ("stop", "音声入力終了", "おんせいにゅうりょくしゅうりょう"), ("stop", "終了", "しゅうりょう"), ("stop", "ストップ", "すとっぷ"),
    ("cancelInput", "入力キャンセル", "にゅうりょくきゃんせる"), ("cancelInput", "直前入力をキャンセル", "ちょくぜんにゅうりょくをきゃんせる"), ("cancelInput", "今の入力をキャンセル", "いまのにゅうりょくをきゃんせる"),
    ("restoreInput", "入力復元", "にゅうりょくふくげん"), ("restoreInput", "入力を復元", "にゅうりょくをふくげん"), ("restoreInput", "キャンセルを戻す", "きゃんせるをもどす"),
    ("newline", "改行", "かいぎょう"), ("newline", "次の行", "つぎのぎょう"),
    ("reconvert", "変換戻し", "へんかんもどし"), ("reconvert", "変換し直し", "へんかんしなおし"), ("reconvert", "変換やり直し", "へんかんやりなおし"), ("reconvert", "再変換", "さいへんかん"),
    ("respeakExplicit", "言い直し", "いいなおし"), ("respeakExplicit", "言い直して", "いいなおして"), ("respeakExplicit", "言い直す", "いいなおす"),
    ("respeakExplicit", "ここを言い直し", "ここをいいなおし"), ("respeakExplicit", "ここを言い直して", "ここをいいなおして"), ("respeakExplicit", "これを言い直し", "これをいいなおし"), ("respeakExplicit", "これを言い直して", "これをいいなおして"),
    ("respeakExplicit", "ここを訂正", "ここをていせい"), ("respeakExplicit", "これを訂正", "これをていせい"), ("respeakExplicit", "ここを言い換え", "ここをいいかえ"), ("respeakExplicit", "ここを差し替え", "ここをさしかえ"),
    ("respeak", "訂正", "ていせい"), ("respeak", "訂正して", "ていせいして"), ("respeak", "言い換え", "いいかえ"), ("respeak", "差し替え", "さしかえ"),
    ("confirm", "確定", "かくてい"), ("confirm", "決定", "けってい"),
    ("cancel", "キャンセル", "きゃんせる"), ("cancel", "やめる", "やめる"),
)
#: Patterns of commands with an argument.
_WO = "[をオヲお]"
PICK = r"^(?:候補)?([0-9０-９一二三四五六七八九十]+)\s*番?$"
RECONVERT_TARGET = rf"^(.+?){_WO}(?:再変換?|変換し直し|変換しなおし|もう一度変換)(?:て|して)?$"
RESPEAK_TARGET = rf"^(.+?){_WO}(?:言い直し|言い直す|いいなおし|訂正|ていせい|言い換え|いいかえ|差し替え|さしかえ)(?:て|して)?$"
REPLACE = rf"^(.+?){_WO}(.+?)に(?:修正|変換|直して|してください|変えて)$"
LOOSE_RESPEAK = r"^(?:ここ|これ|この)を?(?:言い|いい|訂正|ていせい|差し替|言い換)"
MODAL_CONFIRM = r"(?i)^(?:確定|決定|かくてい|けってい|これでいい|おーけー|ok)$"
MODAL_CANCEL = r"^(?:きゃんせる|やめる|止める|とめる|閉じる|とじる|戻る|もどる|中止|ちゅうし)$"
SELECTION = ("これ", "ここ", "選択範囲", "選択部分")
#: Commands without an argument, which a quick first pass may carry out.
ARGUMENT_FREE = ("stop", "cancelInput", "restoreInput", "newline", "reconvert", "reconvertSelection", "respeak", "respeakExplicit", "confirm", "cancel", "pick")


def spoken(text: Column) -> Column:
    """Without white space at the ends and marks at the end."""
    return F.regexp_replace(stripped(text), r"(?U)[。、．，\s]+$", "")


def _command(kind: Column | str, index: Column | None = None, target: Column | None = None, into: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (index if index is not None else none).cast("int").alias("index"), (target if target is not None else none).cast("string").alias("target"), (into if into is not None else none).cast("string").alias("into"))


def classified(text: Column, prefix: str = "") -> Column:
    """struct(kind, index, target, into) of a whole utterance that is a command, else null: phrases first, then a pick, a target to reconvert, one to say again, a replacement."""
    own = spoken(text)
    ok = F.lit(True)
    if prefix:
        ok = own.startswith(prefix)
        own = spoken(F.regexp_replace(own.substr(F.lit(len(prefix) + 1), F.length(own)), r"(?U)^[、,\s]+", ""))
    kinds = dict.fromkeys(k for k, _, _ in PHRASES)
    out = F.when(~ok, None)
    for kind in kinds:
        out = out.when(own.isin(*[w for k, w, _ in PHRASES if k == kind]), _command(kind))
    part = lambda pattern, i: stripped(F.regexp_extract(own, pattern, i))
    pick = number(F.regexp_extract(own, PICK, 1))
    out = out.when(pick.isNotNull(), _command("pick", pick))
    again, say = part(RECONVERT_TARGET, 1), part(RESPEAK_TARGET, 1)
    out = out.when(again.isin(*SELECTION), _command("reconvertSelection")).when(again != "", _command("reconvertTarget", target=again))
    out = out.when(say.isin(*SELECTION), _command("respeakExplicit")).when(say != "", _command("respeakTarget", target=say))
    a, b = part(REPLACE, 1), part(REPLACE, 2)
    return out.when((a != "") & (b != ""), _command("replace", target=a, into=b))


def classified_in_dialog(text: Column) -> Column:
    """The lenient form for an open list of candidates: confirm, cancel or pick, by kana too."""
    own = F.regexp_replace(spoken(text), r"(?U)[\s・]+", "")
    hira = katakana_to_hiragana(own)
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(hira, "ー", ""), "^(?:候補|こうほ)", ""), "(?:番目|ばんめ|番|ばん|ば)$", "")
    n = number(body, kana=True)
    yes = lambda p: own.rlike(p) | hira.rlike(p)
    return F.when(yes(MODAL_CONFIRM), _command("confirm")).when(yes(MODAL_CANCEL), _command("cancel")).when(n.isNotNull(), _command("pick", n))


def loosely_respeak(text: Column) -> Column:
    own = spoken(text)
    return (F.length(own) <= 15) & own.rlike(LOOSE_RESPEAK)


def tolerance(length: int) -> int:
    """Edits that a phrase's reading may differ by; half up."""
    return 1 if length <= 7 else int(length * 0.25 + 0.5)


def near_tolerance(length: int) -> int:
    return tolerance(length) + (length >= 8)


def by_reading(text: Column, reading: Column) -> Column:
    """struct(distance, ord, kind, phrase, confident) of the phrase whose reading is nearest, the first of equally near ones; null if none is near or the utterance is long.

    The phrases are a fixed list and become one literal array.
    """
    fixed = []
    for i, (kind, phrase, own) in enumerate(PHRASES):
        key_of = re.sub("[^ぁ-ゖ]", "", own)
        fixed.append(F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), F.lit(phrase).alias("phrase"), F.lit(key_of).alias("key"), F.lit(tolerance(len(key_of))).alias("sure"), F.lit(near_tolerance(len(key_of))).alias("near")))

    def found(key: Column) -> Column:
        scored = F.transform(F.array(*fixed), lambda e: F.struct(F.levenshtein(key, e["key"]).alias("distance"), e["ord"].alias("ord"), e["kind"].alias("kind"), e["phrase"].alias("phrase"), e["sure"].alias("sure"), e["near"].alias("near")))
        best = F.array_min(F.filter(scored, lambda e: e["distance"] <= e["near"]))
        return F.when(F.length(key).between(1, 24), best)

    key = F.coalesce(F.nullif(reading_key(reading), F.lit("")), reading_key(text))
    best = bound(key, found)
    return F.when((F.length(reading) > 0) & best.isNotNull(), bound(best, lambda e: F.struct(e["distance"].alias("distance"), e["kind"].alias("kind"), e["phrase"].alias("phrase"), (e["distance"] <= e["sure"]).alias("confident"))))


def probed(text: Column, reading: Column) -> Column:
    """The kind that a quick first pass may act on: an exact command without argument, or a confident one by reading."""
    exact, near = classified(text)["kind"], by_reading(text, reading)
    by = F.when(near["confident"] & near["kind"].isin(*ARGUMENT_FREE), near["kind"])
    return F.when(exact.isNotNull(), F.when(exact.isin(*ARGUMENT_FREE), exact)).otherwise(by)


def cascaded(chunks: DataFrame, probes: DataFrame, mains: DataFrame, longest: float = 4.0, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(commands, texts) of a cheap first pass and a main one over the same chunks.

    chunks: (session, seq, seconds, dictated, recovery); probes: (session, seq, text, reading);
    mains: (session, seq, text). Only dictated chunks of at most `longest` seconds are probed,
    no recovered ones. A probe that reads as a command is acted on, (session, seq, kind), and
    its chunk's main result is dropped while it is among the session's last `most` consumed
    numbers; all other main results are the texts.
    """
    own = chunks.where((F.col("seconds") <= longest) & F.col("dictated") & ~F.col("recovery")).select("session", "seq")
    read = own.join(probes.where("text <> ''"), ["session", "seq"]).select("session", "seq", probed(F.col("text"), F.coalesce("reading", F.lit(""))).alias("kind")).where("kind is not null")
    return read, unconsumed(mains, read.withColumn("consumed_at", F.col("seq")), most=most)


def routed(rows: DataFrame) -> DataFrame:
    """rows (text, reading, consumed, in_dialog, has_selection, awaiting) with route: consumed, dialog, exact, loose, fuzzy, respeak or insert, the first that applies."""
    c = F.col
    exact = classified(c("text"))["kind"]
    plain = exact.isNotNull() & ((exact != "respeak") | c("has_selection"))
    near = by_reading(c("text"), c("reading"))
    return rows.withColumn(
        "route",
        F.when(c("consumed"), "consumed").when(c("in_dialog") & classified_in_dialog(c("text")).isNotNull(), "dialog").when(plain, "exact").when(c("has_selection") & loosely_respeak(c("text")), "loose").when(F.coalesce(near["confident"], F.lit(False)), "fuzzy").when(c("awaiting"), "respeak").otherwise("insert"),
    )


def edited(log: DataFrame, key: str = "session", order: str = "ord", most: int = 50) -> DataFrame:
    """(session, body) after a log of edits (op, text, into): insert, cancel, restore, replace (the last occurrence of text, or none), trim (white space at the end).

    cancel takes back the last insert that stands, restore puts it back; `most` inserts are
    remembered. The log of one session is folded in its order.
    """

    own = log.select(F.col(key).cast("string").alias("session"), F.col(order).alias("_at"), "op", "text", "into")
    return folded(own, "session", ["_at"], lambda session: _Body(session, most), "session string, body string")


class _Body:
    """The text so far, and the inserts that can be taken back or put back."""

    def __init__(self, session: str | None, most: int):
        self.session, self.most, self.body, self.done, self.undone = session, most, "", [], []

    def push(self, pdf: pd.DataFrame) -> None:
        for op, text, into in pdf[["op", "text", "into"]].itertuples(index=False):
            if op == "insert":
                self.done, self.undone, self.body = [*self.done, text][-self.most :], [], self.body + text
            elif op == "cancel" and self.done and self.body.endswith(self.done[-1]):
                self.body, self.undone = self.body[: len(self.body) - len(self.done[-1])], [*self.undone, self.done[-1]]
                self.done = self.done[:-1]
            elif op == "restore" and self.undone:
                self.body, self.done, self.undone = self.body + self.undone[-1], [*self.done, self.undone[-1]], self.undone[:-1]
            elif op == "replace" and text and text in self.body:
                at = self.body.rindex(text)
                self.body = self.body[:at] + (into or "") + self.body[at + len(text) :]
            elif op == "trim":
                self.body = self.body.rstrip()

    def close(self) -> pd.DataFrame:
        return pd.DataFrame({"session": [self.session], "body": [self.body]})


def replaced_at(text: Column, start: Column, expected: Column, new: Column) -> Column:
    """text with `new` where `expected` is remembered (start from 0), else at its last occurrence, else unchanged."""
    n = F.length(expected)
    there = text.substr(start + 1, n) == expected
    at = F.when(there, start).otherwise(_last_place(text, expected))
    return F.when((n > 0) & (at >= 0), F.concat(text.substr(F.lit(1), at), new, text.substr(at + n + 1, F.length(text)))).otherwise(text)


def _last_place(text: Column, part: Column) -> Column:
    """Where part begins last, from 0; -1 if nowhere."""
    back = F.instr(F.reverse(text), F.reverse(part))
    return F.when(back > 0, F.length(text) - back + 1 - F.length(part)).otherwise(-1)


def occurrences_backwards(text: Column, part: Column) -> Column:
    """Places (from 0) where part occurs, overlaps left out, the last first."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(1))), lambda i: F.aggregate(F.slice(gaps, 1, i), F.lit(0), lambda a, g: a + F.length(g)) + (i - 1) * F.length(part))
    return F.when((F.size(gaps) > 1) & (F.length(part) > 0), F.reverse(at)).otherwise(F.array().cast("array<int>"))


def registrable(kind: Column, observed: Column, output: Column) -> Column:
    """Whether a pair may be registered, by its kind: reconverted, added, symbol."""
    a, b = F.length(observed), F.length(output)
    return F.when(kind == "reconverted", a.between(2, 64) & (b <= 128)).when(kind == "added", a.between(2, 128) & (b <= 256)).when(kind == "symbol", a.between(1, 16)).otherwise(False)


#: Characters of words, by class.
CLASSES = ("一-鿿㐀-䶿々〇", "ぁ-ゖゝゞ", "ァ-ヺーヽヾｦ-ﾟ", "0-9A-Za-z０-９Ａ-Ｚａ-ｚ")
_HAN, _HIRA = CLASSES[:2]


@arrow("start int, end int")
def word_at(text: pd.Series, pos: pd.Series) -> pd.DataFrame:
    """The word at a cursor: the run of one class before it, else after it; kanji with up to 4 kana that follow, kana with the kanji before; none over 24."""
    any_run = re.compile("|".join(f"[{c}]+" for c in CLASSES))

    def one(t: str, p: int) -> tuple[int | None, int | None]:
        p = max(0, min(p, len(t)))
        runs = [m.span() for m in any_run.finditer(t)]
        hit = next((r for r in runs if r[0] < p <= r[1]), None) or next((r for r in runs if r[0] <= p < r[1]), None)
        if hit is None:
            return None, None
        a, z = hit
        if re.match(f"[{_HAN}]", t[a]):
            kana = re.match(f"[{_HIRA}]*", t[z:]).end()
            z += kana if kana <= 4 else 0
        elif re.match(f"[{_HIRA}]", t[a]) and z - a <= 4:
            a = re.search(f"[{_HAN}]*$", t[:a]).start()
        return (a, z) if z - a <= 24 else (None, None)

    return pd.DataFrame([one(t or "", int(p)) for t, p in zip(text, pos, strict=True)], columns=["start", "end"]).astype("Int32")


#: How the rest of a command that was cut off begins.
COMMAND_RESTS = ("を再変", "を修正", "を変換", "を言い直", "を訂正")


def is_echo(text: Column, at: Column) -> Column:
    """Whether the rest of a command stands in text from `at` (from 0) on."""
    return text.substr(at + 1, F.lit(5)).rlike(f"^(?:{'|'.join(COMMAND_RESTS)})")
