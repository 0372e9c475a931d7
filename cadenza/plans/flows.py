"""Flows: cleaning a text, transcribing again, and comparing a note with a whole pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import align, guards, morphemes, text
from ..functions.dictionary import replaced
from ..operators import coverage, joins, reports, segments
from ..params import JOINING, Paragraphs, Recovery, Segmenting


def clean_text(column: Column, values: dict[str, str] | None = None, symbols: bool = False, own_symbols: dict[str, str] | None = None, strip_space: bool = True, analyse: Callable[[Column], Column] | None = None, inline: bool = False, punctuate: bool = False) -> Column:
    """A recognised text made ready: ends, glued endings, half width, symbols, symbols within, dictionary, spaces, punctuation, repeated marks, in this order. Half width comes before symbols, whose full-width marks stay.

    analyse gives a text's morphemes (see functions.morphemes); without it symbols within a text
    and punctuation are left alone.
    """
    t = guards.without_glued_ending(text.stripped(column))
    t = text.half_width(t)
    if symbols:
        t = text.dictated_symbols(t, own_symbols)
    if inline and analyse:
        t = guards.bound(F.struct(t.alias("text"), analyse(t).alias("of")), lambda x: morphemes.with_inline_symbols(x["text"], x["of"]))
    t = replaced(t, values or {})
    if strip_space:
        t = text.without_japanese_spaces(t)
    if punctuate and analyse:
        t = guards.bound(F.struct(t.alias("text"), analyse(t).alias("of")), lambda x: morphemes.punctuated(x["text"], x["of"]))
    return F.when(column == "", column).otherwise(text.collapsed(t))


def clean_by_language(column: Column, language: Column, values: dict[str, str] | None = None, **options) -> Column:
    """clean_text() of a text; of an English one only what no language's text loses by: nothing that is made for Japanese."""
    return F.when(F.coalesce(language == "en", F.lit(False)), clean_text(column, strip_space=False)).otherwise(clean_text(column, values, **options))


def retranscribed(frames: DataFrame, outputs: DataFrame, low_latency: bool = False, values: dict[str, str] | None = None, p: Segmenting = Segmenting(), paragraphs: Paragraphs = Paragraphs()) -> tuple[DataFrame, DataFrame]:
    """(body lines, statistics) of a recording.

    frames: (session, frame_no, rms); outputs, the model's: (session, start, text, logprob, dropped,
    recovered_text, recovered_logprob[, language]) by segment start; rows in English are not
    cleaned as Japanese. Every step is a join or a window by session; only the paragraph rule is
    folded.
    """
    segs = segments.replayed(frames, p.for_microphone(), JOINING["microphone", low_latency])
    rows = segs.join(outputs, ["session", "start"], "left").na.fill("", ["text"])
    language = F.col("language") if "language" in outputs.columns else F.lit("ja")
    seconds = {c: (F.col(c) / p.rate).alias(c) for c in ("start", "end")}
    rows = rows.select("session", seconds["start"], seconds["end"], "pause", F.when(guards.is_boilerplate(F.col("text")), "").otherwise(clean_by_language(F.col("text"), language, values)).alias("text"), guards.is_boilerplate(F.col("text")).cast("int").alias("blocked"), F.coalesce("dropped", F.lit(0)).alias("dropped"), "recovered_text", "recovered_logprob")
    rows = coverage.gaps(rows, "session", "start", "end", Recovery().shortest, Recovery().longest)
    good = F.col("retry") & coverage.accepted(F.col("recovered_text"), F.col("recovered_logprob"))
    rows = rows.withColumn("recovery", F.when(good, F.concat(F.lit("⟨復旧 "), "recovered_text", F.lit("⟩"))))
    rows = coverage.missing(rows).withColumn("status", guards.result_status(F.col("text"), F.col("blocked"), F.col("dropped")))
    marked = rows.withColumn("marker", F.when(F.col("recovery").isNull() & (F.col("status") == "kept"), F.col("marker")))
    body = segments.paragraphs(marked.select("session", "start", "text", "pause", "marker", "recovery"), paragraphs, order="start")
    lines = body.select("session", "start", F.concat(F.coalesce("marker", "recovery", F.lit("")), F.when(F.col("breaks"), "\n\n").otherwise(""), F.col("text")).alias("line")).where("line <> ''")
    return lines, reports.run_stats(marked)


def bodies(lines: DataFrame) -> DataFrame:
    """(session, text): each session's lines in order."""
    return lines.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "line"))), lambda x: x["line"]), "").alias("text"))


def finished(stops: DataFrame, steps: dict[str, DataFrame]) -> DataFrame:
    """(session, n, event, payload): what a session still gives once it is stopped, in the order of the steps, then `stopped` with the reason.

    stops: (session, at, reason), of which the first counts, however often a session is stopped;
    steps, in their order: name to (session, ord, payload), such as the last segment, the held
    one, its text, a text that waited for its context and the rest that is gone over again. All
    of a step comes before the next one; sessions that aren't stopped give nothing.
    """
    first = stops.groupBy("session").agg(F.min_by("reason", F.struct("at", "reason")).alias("payload"))
    rows = first.select("session", F.lit(len(steps)).alias("step"), F.lit(0).cast("long").alias("ord"), F.lit("stopped").alias("event"), "payload")
    for k, (name, step) in enumerate(steps.items()):
        own = step.join(first.select("session"), "session", "left_semi")
        rows = rows.union(own.select("session", F.lit(k), F.col("ord").cast("long"), F.lit(name), F.col("payload").cast("string")))
    n = F.row_number().over(Window.partitionBy("session").orderBy("step", "ord", "payload"))
    return rows.withColumn("n", n).select("session", "n", "event", "payload")


def compared(notes: DataFrame, segs: DataFrame, top: int = 40, merge: int = 8, context: int = 24, least: int = 2) -> dict[str, DataFrame]:
    """What a note and a whole pass over its recording tell about each other.

    notes: (session, text); segs: (session, ord, start, text, logprob, no_speech). Gives hunks with
    their times, counts by kind, match ratios, repeats, frequent terms, the least sure segments
    and what each scoring profile would drop.
    """
    placed = reports.text_offsets(segs)
    refs = placed.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("ref"))
    both = notes.select("session", text.note_text(F.col("text")).alias("note")).join(refs, "session")
    cut = both.withColumn("a", align.aligned_prefix(F.col("note"), F.col("ref"))).select("session", F.col("a.text").alias("live"), "ref", F.col("a.status").alias("status"))
    found = cut.select("session", F.posexplode(align.differences(F.col("live"), F.col("ref"), merge, context, least)).alias("n", "h")).select("session", "n", "h.*")
    hunks = joins.as_of(found, placed.select("session", "raw_start", "start"), "session", "ref_pos", "raw_start", "start").withColumnRenamed("start", "at_sec")
    again = refs.select("session", F.explode(align.repeats_in()("ref")).alias("r")).select("session", "r.*")
    return {
        "hunks": hunks,
        "kinds": reports.kinds(hunks),
        "ratios": cut.select("session", "status", align.match_ratio("live", "ref").alias("ratio")),
        "repeats": joins.as_of(again, placed.select("session", "raw_start", "start"), "session", "pos", "raw_start", "start"),
        "terms": reports.most_frequent(reports.terms(placed), top),
        "unsure": reports.worst(segs, top),
        "what_if": reports.what_if(segs),
    }
