"""Gaps in what was delivered, idle sources, and rows that wait for their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import alone_artifact, between_context
from ..functions.text import minute_clock
from ..params import Recovery


def _before(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def gaps(segs: DataFrame, key: str, start: str, end: str, shortest, longest, order: tuple[str, ...] = ()) -> DataFrame:
    """segs with covered (the furthest end before), gap, and retry: whether the gap is between the two bounds, both included, and not at the very start."""
    covered = F.max(end).over(_before(key, *(order or (start, end))))
    gap = F.col(start) - covered
    return segs.withColumns({"covered": covered, "gap": gap, "retry": F.coalesce((covered > 0) & gap.between(shortest, longest), F.lit(False))})


def missing(segs: DataFrame, key: str = "session", start: str = "start", end: str = "end", least: float = 0.35, sent: Column | None = None) -> DataFrame:
    """segs with marker: the range before a row that no text covers, if it is `least` seconds or more. sent: rows that move the covered end; all do by default."""
    own = F.when(sent, F.col(end)) if sent is not None else F.col(end)
    covered = F.max(own).over(_before(key, start, end))
    marker = F.when((covered > 0) & (F.col(start) - covered >= least), F.concat(F.lit("⟨未認識 "), minute_clock(covered), F.lit("–"), minute_clock(F.col(start)), F.lit("⟩")))
    return segs.withColumn("marker", marker)


def recovered(segs: DataFrame, found: DataFrame, key: str = "session", p: Recovery = Recovery()) -> DataFrame:
    """segs with recovery: the text that was found for the gap before each, if it is accepted. found: (key, start, text, logprob) by the start of the segment after the gap."""
    good = found.where((F.col("text") != "") & (F.col("logprob") >= p.logprob)).select(key, "start", F.concat(F.lit("⟨復旧 "), "text", F.lit("⟩")).alias("recovery"))
    return segs.join(good, [key, "start"], "left")


def accepted(text: Column, logprob: Column, p: Recovery = Recovery()) -> Column:
    """A recovery needs a text and a known score of at least the limit."""
    return F.coalesce((text != "") & (logprob >= p.logprob), F.lit(False))


def delivered(segs: DataFrame, key: str = "session", order: str = "ord", end: str = "end", recovery: str = "is_recovery") -> DataFrame:
    """segs with delivered_end: the furthest end so far, recoveries left out."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return segs.withColumn("delivered_end", F.coalesce(F.max(F.when(~F.col(recovery), F.col(end))).over(upto), F.lit(0)))


def recent(rows: DataFrame, key: str, pos: str, most: int) -> DataFrame:
    """The rows within `most` of each key's last position: a bounded history."""
    return rows.withColumn("_last", F.max(pos).over(Window.partitionBy(key))).where(F.col(pos) > F.col("_last") - most).drop("_last")


def slice_of_recent(rows: DataFrame, key: str, pos: str, most: int, start: int, end: int) -> DataFrame:
    """Rows start .. end - 1 of each key whose history still holds all of them; none otherwise."""
    whole = recent(rows, key, pos, most).where(F.col(pos).between(start, end - 1))
    return whole.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where(F.col("_n") == end - start).drop("_n")


def idle(levels: DataFrame, key: str, at: str, level: str, timeout: float, audible: float = 0.0001, started: str | None = None, warn: float = 0.0) -> DataFrame:
    """levels with remaining, expired, and warned: on the first row at `warn` seconds or more after the start without any sound."""
    by = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    start = F.first(F.col(started or at)).over(by)
    heard = F.max(F.when(F.col(level) >= audible, F.col(at))).over(by)
    left = timeout - (F.col(at) - F.coalesce(heard, start))
    out = levels.withColumns({"remaining": left, "expired": (left <= 0) if timeout > 0 else F.lit(False), "_mute": heard.isNull() & (F.col(at) - start >= warn) if warn > 0 else F.lit(False)})
    first = F.count_if("_mute").over(by)
    return out.withColumn("warned", F.col("_mute") & (first == 1)).drop("_mute")


def judged(rows: DataFrame, key: str = "session", order: str = "ord") -> DataFrame:
    """rows with removed: an ambiguous phrase that stands alone waits for the next row and goes if it is between a formal handover and a formal introduction. At the end, or before an empty text, it stays."""
    by = Window.partitionBy(key).orderBy(order)
    gone = between_context(alone_artifact(F.col("text")), F.lag("text").over(by), F.lead("text").over(by))
    return rows.withColumn("removed", F.coalesce(gone, F.lit(False)))


def resumed(events: DataFrame, key: str, at: str, hold) -> DataFrame:
    """Events 'disconnect' and 'resume' with status: a resume within `hold` of the disconnect before it continues, any other is rejected; a disconnect without one is closed."""
    by = Window.partitionBy(key).orderBy(at)
    held = (F.lag("event").over(by) == "disconnect") & (F.col(at) - F.lag(at).over(by) < hold)
    back = (F.lead("event").over(by) == "resume") & (F.lead(at).over(by) - F.col(at) < hold)
    status = F.when(F.col("event") == "resume", F.when(F.coalesce(held, F.lit(False)), "continued").otherwise("rejected")).when(F.col("event") == "disconnect", F.when(F.coalesce(back, F.lit(False)), "held").otherwise("closed"))
    return events.withColumn("status", status)


def carried(rows: DataFrame, key: str, order: str, value: str, known: Column, default: str) -> DataFrame:
    """rows with carried: their value where it is known, else the last known one before, else the default."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("carried", F.coalesce(F.last(F.when(known, F.col(value)), ignorenulls=True).over(by), F.lit(default)))


def newest(refined: DataFrame, spans: DataFrame, key: str = "session", slack: float = 0.02) -> DataFrame:
    """Refined ranges that still count: of each range the greatest revision, above the one that its spans have, and with edges on spans' edges."""
    by = Window.partitionBy(key, "start", "end").orderBy(F.desc("revision"))
    own = refined.withColumn("_rank", F.row_number().over(by)).where("_rank = 1").drop("_rank")
    edges = spans.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("revision").alias("_r"))
    cell = lambda c: F.floor(c / 0.5)  # noqa: E731  edges meet only in the same or the next cell
    left = own.withColumn("_cell", F.explode(F.array(cell(F.col("start")) - 1, cell(F.col("start")), cell(F.col("start")) + 1)))
    first = left.join(edges.withColumn("_cell", cell(F.col("_s"))), [key, "_cell"]).where(F.abs(F.col("start") - F.col("_s")) <= slack).groupBy(key, "start", "end", "revision").agg(F.max("_r").alias("_have"))
    right = own.withColumn("_cell", F.explode(F.array(cell(F.col("end")) - 1, cell(F.col("end")), cell(F.col("end")) + 1)))
    last = right.join(edges.withColumn("_cell", cell(F.col("_e"))), [key, "_cell"]).where(F.abs(F.col("end") - F.col("_e")) <= slack).select(key, "start", "end", "revision").distinct()
    return own.join(first, [key, "start", "end", "revision"]).join(last, [key, "start", "end", "revision"]).where("revision > _have").drop("_have")


def one_language(rows: DataFrame, most: float = 0.15) -> DataFrame:
    """Rows whose less likely language is unlikely enough to refine them."""
    return rows.where(F.least("p_ja", "p_en") < most)
