"""Filters of scored model outputs and of artifacts in their text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import SCORING
from .text import stripped

#: Whole outputs that are dropped.
BLOCKLIST = (
    "はい", "はいはい", "はい。", "ん", "んー", "うん", "ありがとうございました", "ありがとうございました。", "ありがとうございます", "ありがとうございます。",
    "ご視聴ありがとうございました", "ご視聴ありがとうございました。", "おやすみなさい", "バイバイ", "はい、", "です。", "チャンネル登録お願いします", "最後までご視聴いただきありがとうございます",
)
#: A whole output that is boilerplate, perhaps after a short lead-in.
BOILERPLATE = (
    r"\A(?:では|それでは|はい|ええ|えー|あの)?[、。]?[\s　]*"
    r"(?:(?:最後まで)?ご視聴(?:いただき)?(?:誠に)?ありがとうございま(?:した|す)|チャンネル登録(?:を)?(?:よろしく)?お願い(?:いたし|し)ます|(?:次回[もは])?お楽しみに)"
    r"[。、！\s　]*\z"
)
#: Phrases that are artifacts inside another text or on weak audio, in the middle only, on weak audio only.
OBVIOUS = ("次回予告", "次の動画でお会いしましょう")
CONTEXTUAL = ("おやすみなさい",)
MIDSTREAM = ("ご視聴ありがとうございました",)
POSSIBLE_ENDINGS = ("以上で終わります",)
#: A formal handover before, a formal introduction after.
HANDOVER = r"(?:それでは|では).{0,40}(?:お願い(?:いた)?します|お願いいたします)|(?:お願い(?:いた)?します|お願いいたします)[。！？!?]*\z"
INTRODUCTION = r"\A.{0,12}(?:皆様|みなさま).{0,8}(?:こんにちは|おはようございます|こんばんは)|\A.{0,30}(?:でございます|と申します|本日(?:の|は))"
#: Phrases counted as left-over boilerplate.
MARKERS = (
    "ご視聴ありがとうございました", "ご覧いただきありがとうございました", "次の動画でお会いしましょう", "お会いしましょう", "今までの動画をご覧ください", "この動画をご覧ください",
    "次回予告", "チャンネル登録", "高評価", "お楽しみに", "お待ちしております", "お疲れ様でした", "おめでとうございます", "おやすみなさい", "おはようございます", "ブーブー",
)
_EDGE = "[ 、。！？!?　]"


def drop_reason(no_speech: Column, logprob: Column, profile: str | None = None, no_speech_over: float = 0.6, logprob_under: float = -1.0) -> Column:
    """'no_speech' or 'logprob', whichever threshold fails first; null for what is kept. Missing values count as 0."""
    if profile:
        no_speech_over, logprob_under = SCORING[profile].no_speech, SCORING[profile].logprob
    return F.when(F.coalesce(no_speech, F.lit(0.0)) > no_speech_over, "no_speech").when(F.coalesce(logprob, F.lit(0.0)) < logprob_under, "logprob")


def kept_result(segments: DataFrame, key: str, order: str, reason: Column) -> DataFrame:
    """(key, text, avg_logprob, max_no_speech, dropped): of the kept rows the joined text, mean and maximum (null if none), of the others the count."""
    kept = reason.isNull()
    parts = F.array_sort(F.collect_list(F.when(kept, F.struct(order, "text"))))
    return segments.groupBy(key).agg(
        F.trim(F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("text"),
        F.avg(F.when(kept, F.coalesce("logprob", F.lit(0.0)))).alias("avg_logprob"),
        F.max(F.when(kept, F.coalesce("no_speech", F.lit(0.0)))).alias("max_no_speech"),
        F.count(F.when(~kept, 1)).alias("dropped"),
    )


def is_boilerplate(text: Column) -> Column:
    return stripped(text).rlike(BOILERPLATE)


def is_blocked(text: Column, own: tuple[str, ...] = ()) -> Column:
    return text.isin(*BLOCKLIST, *own)


def bare(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_EDGE}+|{_EDGE}+$", "")


def alone_artifact(text: Column) -> Column:
    """The ambiguous phrase that a text is, but for marks and blanks; else null."""
    return F.when(bare(text).isin(*CONTEXTUAL), bare(text))


def between_context(phrase: Column, previous: Column, following: Column) -> Column:
    """Whether an ambiguous phrase stands between a formal handover and a formal introduction."""
    before, after = stripped(F.coalesce(previous, F.lit(""))), stripped(F.coalesce(following, F.lit("")))
    return phrase.isin(*CONTEXTUAL) & (before != "") & (after != "") & before.rlike(HANDOVER) & after.rlike(INTRODUCTION)


def bound(value: Column, expression: Callable[[Column], Column]) -> Column:
    """expression of value, which is written once in the plan however often the expression uses it."""
    return F.get(F.transform(F.array(value), expression), F.lit(0))


def _of(step: Callable[[Column, str], Column], phrase: str) -> Callable[[Column], Column]:
    return lambda s: step(s, phrase)


def without_artifacts(text: Column, rms: Column, active_ratio: Column, weak_rms: float = 0.0015, weak_active: float = 0.03) -> Column:
    """struct(text, removed): a text without the phrases that neither audio nor context supports."""
    weak = (rms < weak_rms) | (active_ratio < weak_active)
    state = F.struct(stripped(text).alias("t"), F.array().cast("array<string>").alias("removed"))

    def taken(state: Column, phrase: str, go: Column, rest: Column) -> Column:
        return F.when(go, F.struct(rest.alias("t"), F.concat(state["removed"], F.array(F.lit(phrase))).alias("removed"))).otherwise(state)

    def obvious(s: Column, phrase: str) -> Column:
        rest = F.replace(s["t"], F.lit(phrase), F.lit(""))
        return taken(s, phrase, F.contains(s["t"], F.lit(phrase)) & ((bare(rest) != "") | weak), rest)

    def midstream(s: Column, phrase: str) -> Column:
        at = F.instr(s["t"], phrase)
        after = s["t"].substr(at + len(phrase), F.length(s["t"]))
        return taken(s, phrase, (at > 0) & (F.length(bare(after)) >= 12), F.concat(s["t"].substr(F.lit(1), at - 1), after))

    def ending(s: Column, phrase: str) -> Column:
        return taken(s, phrase, (bare(s["t"]) == phrase) & weak, F.lit(""))

    for step, phrases in ((obvious, OBVIOUS + CONTEXTUAL), (midstream, MIDSTREAM), (ending, POSSIBLE_ENDINGS)):
        for phrase in phrases:
            state = bound(state, _of(step, phrase))
    tidy = F.regexp_replace(F.regexp_replace(state["t"], r"([。！？!?])\1+", "$1"), "^[ 、　]+|[ 、　]+$", "")
    return F.struct(tidy.alias("text"), state["removed"].alias("removed"))


def without_glued_ending(text: Column) -> Column:
    """Without a thanks that is glued to a polite ending."""
    for phrase in ("ありがとうございます", "ご視聴ありがとうございました"):
        text = F.regexp_replace(text, rf"(?<=ございます){phrase}[。、]?\n?\z", "")
    return stripped(text)


def marker_count(text: Column) -> Column:
    """How often each marker occurs, overlaps within one marker not counted, summed."""
    return sum((F.regexp_count(text, F.lit(m)) for m in MARKERS), F.lit(0))


def result_status(text: Column, blocked: Column, dropped: Column) -> Column:
    """'kept', 'blocked' (its range is still sent), 'dropped' or 'empty'."""
    return F.when(text != "", "kept").when(blocked > 0, "blocked").when(dropped > 0, "dropped").otherwise("empty")


def plausible_reading(hiragana: Column) -> Column:
    """Whether a kana reading can be a Japanese word's."""
    bad = "^[んっー]|っ$|[っん][っん]|っ[^かきくけこさしすせそたちつてとぱぴぷぺぽ]"
    return (F.length(hiragana) > 0) & ~hiragana.rlike(bad)


def valid_session(session: Column) -> Column:
    return session.rlike(r"^[0-9]{8}-[0-9]{6}(?:-[0-9]+)?$")


def valid_profile(profile: Column) -> Column:
    return profile.rlike(r"^[a-z0-9][a-z0-9._-]{0,63}$")
