"""Segments of a frame stream: the batch forms of the ordered steps.

The steps are small state machines over one session; streaming/ runs the same ones. A session's
frames are features (a level and a flag each), not samples, so an hour is about 112,000 rows.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signal import LEAST_FLOOR, NOISE_FALL, NOISE_RATIO, NOISE_RISE, fixed_floor
from ..params import FRAME, Joining, Paragraphs, Segmenting
from .folding import folded

#: Frames that are pushed at once: what stays open is copied at each close, so it is kept short.
_PUSH = 4096
SEGMENT = "session string, start long, end long, reason string, pause double"


@dataclass
class Noise:
    """The adaptive floor: it follows quiet frames fast and loud ones slowly, and is never stricter than the fixed one."""

    level: float | None = None

    def active(self, rms: np.ndarray, threshold: float) -> np.ndarray:
        fixed, out = fixed_floor(threshold), np.empty(len(rms), bool)
        for i, r in enumerate(rms.tolist()):
            if self.level is None:
                self.level = r
            else:
                self.level += (r - self.level) * (NOISE_FALL if r < self.level else NOISE_RISE)
            out[i] = r >= min(fixed, max(LEAST_FLOOR, NOISE_RATIO * self.level))
        return out


@dataclass
class Segmenter:
    """Open frames of a session, from `base` on; frames before `seen` were carried over and don't count as sound again."""

    p: Segmenting
    base: int = 0
    seen: int = 0
    last_end: int | None = None
    level: list[float] = field(default_factory=list)
    sound: list[bool] = field(default_factory=list)

    def state(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "p"}

    def push(self, level: np.ndarray, sound: np.ndarray) -> list[tuple[int, int, str, float | None]]:
        """Take frames; give what closes: (start, end, reason, pause), in samples and seconds."""
        self.level += level.tolist()
        self.sound += sound.tolist()
        out = []
        while (event := self._next()) is not None:
            at, reason, first, last = event
            out += self._close(at + 1, reason, first, last, 0)
        return out

    def flush(self, tail: int = 0) -> list[tuple[int, int, str, float | None]]:
        """The end of the stream; tail: samples of an incomplete last frame."""
        end = self.base + len(self.sound)
        hits = [i for i in range(self.seen, end) if self.sound[i - self.base]]
        return self._close(end, "silence", hits[0], hits[-1], tail) if hits else []

    def _next(self) -> tuple[int, str, int, int] | None:
        """The first frame at which something closes, why, and the first and last frames of sound up to it."""
        end, n = self.base + len(self.sound), self.p.frames(self.p.silence)
        forced = self.base + ceil(self.p.longest * self.p.rate / FRAME) - 1
        upto = min(end, forced + 1)
        hits = np.flatnonzero(np.asarray(self.sound[self.seen - self.base : upto - self.base], bool)) + self.seen
        quiet = np.flatnonzero(np.append(hits[1:], upto + n) - hits > n) if len(hits) else []
        closing = hits[quiet[0]] + n if len(quiet) else end
        if closing <= forced and closing < end:
            return int(closing), "silence", int(hits[0]), int(hits[quiet[0]])
        if forced < end:
            own = hits[hits <= forced]
            return (int(forced), "max_len", int(own[0]), int(own[-1])) if len(own) else (int(forced), "nothing", -1, -1)
        return None

    def _close(self, end: int, reason: str, first: int, last: int, tail: int) -> list[tuple[int, int, str, float | None]]:
        own = (end - self.seen) * FRAME + tail
        if reason == "nothing" or own < int(self.p.shortest * self.p.rate):
            self._keep_from(end, end)
            return []
        cut = self._quietest(end) if reason == "max_len" else min(end, last + 1 + self.p.frames(self.p.pad))
        if reason == "silence" and tail and last + 1 + self.p.frames(self.p.pad) > end:
            stop = end * FRAME + tail
        else:
            stop = cut * FRAME
        pause = None if self.last_end is None else max(0.0, (first * FRAME - self.last_end) / self.p.rate)
        self.last_end = (last + 1) * FRAME
        out = [(self.base * FRAME, stop, reason, pause)]
        self._keep_from(cut, end)
        return out

    def _quietest(self, end: int) -> int:
        """After the quietest of the last frames, the first of equally quiet ones."""
        window = min(self.p.frames(self.p.search), end - self.base - 1)
        if window <= 0:
            return end
        own = self.level[end - window - self.base : end - self.base]
        return end - window + int(np.argmin(own)) + 1

    def _keep_from(self, cut: int, seen: int) -> None:
        self.level, self.sound = self.level[cut - self.base :], self.sound[cut - self.base :]
        self.base, self.seen = cut, seen


def segments(frames: DataFrame, p: Segmenting = Segmenting()) -> DataFrame:
    """(session, start, end, reason, pause) of frames (session, frame_no, rms[, active][, n]).

    A segment closes after `silence` of quiet, or at `longest`, then at its quietest late frame;
    what is cut off is carried into the next one. One with less than `shortest` of its own is
    dropped. active: a detector's verdict, used where given; else the level against the fixed or
    the adaptive floor. n: samples in the frame; an incomplete last one counts as a tail. Null
    levels are silence; a session without sound has no segment. Frames are taken in their order.
    """
    cols = ["session", "frame_no", F.coalesce("rms", F.lit(0.0)).alias("rms")]
    cols.append(F.col("active") if "active" in frames.columns else F.lit(None).cast("boolean").alias("active"))
    cols.append(F.coalesce("n", F.lit(FRAME)).alias("n") if "n" in frames.columns else F.lit(FRAME).alias("n"))

    return folded(frames.select(*cols), "session", ["frame_no"], lambda session: _Segments(session, p), SEGMENT)


def _table(session: str | None, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["start", "end", "reason", "pause"])
    out.insert(0, "session", session)
    return out


class _Frames:
    """Frames whose last one waits, as it may be incomplete."""

    def __init__(self, session: str | None, p: Segmenting):
        self.session, self.p, self.noise, self.seg, self.held = session, p, Noise(), Segmenter(p), None

    def ready(self, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf if self.held is None else pd.concat([self.held, pdf], ignore_index=True)
        self.held = pdf.iloc[-1:]
        return pdf.iloc[:-1]

    def sounds(self, level: np.ndarray) -> np.ndarray:
        return self.noise.active(level, self.p.threshold) if self.p.adaptive else level >= fixed_floor(self.p.threshold)


class _Segments(_Frames):
    def take(self, own: pd.DataFrame) -> list[tuple]:
        level, rows = own["rms"].to_numpy(float), []
        given = own["active"].to_numpy(object)
        sound = np.array([s if g is None or g is pd.NA or g != g else bool(g) for g, s in zip(given, self.sounds(level), strict=True)], bool)
        for i in range(0, len(level), _PUSH):
            rows += self.seg.push(level[i : i + _PUSH], sound[i : i + _PUSH])
        return rows

    def push(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return _table(self.session, self.take(self.ready(pdf)))

    def close(self) -> pd.DataFrame:
        tail = int(self.held["n"].iloc[0]) % FRAME
        rows = [] if tail else self.take(self.held)
        return _table(self.session, rows + self.seg.flush(tail))


@dataclass
class Joiner:
    """One held segment, and since when."""

    p: Joining
    held: tuple[int, int, str, float | None] | None = None
    since: float = 0.0

    def push(self, own: tuple[int, int, str, float | None], now: float) -> list[tuple[int, int, str, float | None]]:
        out, since = [], now
        if self.held is not None:
            if self.held[1] == own[0] and not (own[3] is not None and own[3] >= self.p.pause):
                own, since = (self.held[0], own[1], own[2], self.held[3]), self.since
            else:
                out.append(self.held)
        if own[1] - own[0] >= int(self.p.least * self.p.rate):
            self.held = None
            return [*out, own]
        self.held, self.since = own, since
        return out

    def tick(self, now: float) -> list[tuple[int, int, str, float | None]]:
        return self.flush() if self.held is not None and now - self.since >= self.p.hold else []

    def flush(self) -> list[tuple[int, int, str, float | None]]:
        held, self.held = self.held, None
        return [held] if held is not None else []


def joined(segs: DataFrame, p: Joining = Joining(), closed_at: str | None = None) -> DataFrame:
    """Short segments joined with the next; (session, start, end, reason, pause[, closed_at]).

    A held segment waits until `hold` after it came; time is the stream's own position (closed_at,
    or a segment's end), and the next segment's arrival is when it is looked at. A pause of
    `pause` or a gap before a segment sends the held one first. The result has the first one's
    start and pause and the last one's end and reason.
    """
    at = F.col(closed_at) if closed_at else F.col("end") / p.rate

    own = segs.select("session", "start", "end", "reason", "pause", at.alias("now"))
    return folded(own, "session", ["now", "start"], lambda session: _Joins(session, p), SEGMENT)


class _Joins:
    def __init__(self, session: str | None, p: Joining):
        self.session, self.join = session, Joiner(p)

    def push(self, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for start, end, reason, pause, now in pdf[["start", "end", "reason", "pause", "now"]].itertuples(index=False):
            rows += self.join.tick(now)
            rows += self.join.push((int(start), int(end), reason, None if pause is None or pause != pause else float(pause)), now)
        return _table(self.session, rows)

    def close(self) -> pd.DataFrame:
        return _table(self.session, self.join.flush())


def replayed(frames: DataFrame, p: Segmenting, j: Joining, block: float = 0.1) -> DataFrame:
    """Segments and joins as a live session would give them: frames come in blocks, and the held segment's clock is the position at each block's end."""

    cols = ["session", "frame_no", "rms", F.coalesce("n", F.lit(FRAME)).alias("n") if "n" in frames.columns else F.lit(FRAME).alias("n")]
    return folded(frames.select(*cols), "session", ["frame_no"], lambda session: _Replay(session, p, j, int(p.rate * block)), SEGMENT)


class _Replay(_Frames):
    """Levels that no block has taken yet, and samples: those that came, and where the next block begins."""

    def __init__(self, session: str | None, p: Segmenting, j: Joining, step: int):
        super().__init__(session, p)
        self.join, self.step, self.size, self.at, self.done = Joiner(j), step, 0, 0, 0
        self.level, self.sound = np.zeros(0), np.zeros(0, bool)

    def take(self, own: pd.DataFrame) -> None:
        level = own["rms"].to_numpy(float)
        self.level, self.sound = np.r_[self.level, level], np.r_[self.sound, self.sounds(level)]
        self.size += int(own["n"].sum())

    def blocks(self, last: bool) -> list[tuple]:
        rows, used = [], 0
        while self.at < self.size and (last or self.at + self.step <= self.size):
            now, upto = (self.at + self.step) / self.p.rate, min(self.at + self.step, self.size) // FRAME
            n = upto - self.done
            for own in self.seg.push(self.level[used : used + n], self.sound[used : used + n]):
                rows += self.join.push(own, now)
            rows += self.join.tick(now)
            used, self.done, self.at = used + n, upto, self.at + self.step
        self.level, self.sound = self.level[used:], self.sound[used:]
        return rows

    def push(self, pdf: pd.DataFrame) -> pd.DataFrame:
        self.take(self.ready(pdf))
        return _table(self.session, self.blocks(False))

    def close(self) -> pd.DataFrame:
        self.take(self.held)
        rows = self.blocks(True)
        for own in self.seg.flush(self.size % FRAME):
            rows += self.join.push(own, self.size / self.p.rate)
        return _table(self.session, rows + self.join.flush())


def paragraphs(texts: DataFrame, p: Paragraphs = Paragraphs(), key: str = "session", order: str = "ord") -> DataFrame:
    """texts with breaks: whether a paragraph begins before the row. Rows of one session are folded in order; empty texts change nothing.

    A paragraph ends after a finished sentence once it has `least` characters and a pause of
    `pause` comes, or once it has `most`; at `hardest` it ends anyway.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    return folded(texts, key, [order], lambda _: _Breaks(p), f"{fields}, breaks boolean")


class _Breaks:
    def __init__(self, p: Paragraphs):
        self.p, self.hardest, self.size, self.finished = p, p.hardest or 2 * p.most, 0, False

    def push(self, pdf: pd.DataFrame) -> pd.DataFrame:
        p, out = self.p, []
        for text, pause in zip(pdf["text"], pdf["pause"], strict=True):
            own = text or ""
            if not own:
                out.append(False)
                continue
            wait = 0.0 if pause is None or pause != pause else pause
            go = p.least > 0 and self.size > 0 and ((((self.size >= p.least and wait >= p.pause) or self.size >= p.most) and self.finished) or self.size >= self.hardest)
            self.size = (0 if go else self.size) + len(own)
            self.finished = own.rstrip()[-1:] in tuple("。！？!?」』）")
            out.append(go)
        return pdf.assign(breaks=out)

    def close(self) -> None:
        return None


def refinements(ends: DataFrame, window: int, least: int, key: str = "session", order: str = "ord") -> DataFrame:
    """(session, start, end, revision): ranges that are gone over again, each from the last one's end to the first delivered end at `window` or more; at the end of the stream a rest of `least` or more. ends: (session, ord, delivered_end)."""

    own = ends.select(F.col(key).cast("string").alias("session"), order, "delivered_end")
    return folded(own, "session", [order], lambda session: _Ranges(session, window, least), "session string, start long, end long, revision int")


class _Ranges:
    def __init__(self, session: str | None, window: int, least: int):
        self.session, self.window, self.least, self.at, self.last, self.n = session, window, least, 0, 0, 0

    def table(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["start", "end", "revision"])
        out.insert(0, "session", self.session)
        return out

    def took(self) -> tuple[int, int, int]:
        self.n, row = self.n + 1, (self.at, self.last, self.n + 1)
        self.at = self.last
        return row

    def push(self, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for end in pdf["delivered_end"]:
            self.last = max(self.last, int(end))
            if self.last - self.at >= self.window:
                rows.append(self.took())
        return self.table(rows)

    def close(self) -> pd.DataFrame:
        return self.table([self.took()] if self.last - self.at >= self.least else [])


def noise_floor(frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """frames (session, frame_no, rms) with the adaptive floor's verdict."""

    return folded(frames.select("session", "frame_no", "rms"), "session", ["frame_no"], lambda _: _Floor(threshold), "session string, frame_no long, rms double, active boolean")


class _Floor:
    def __init__(self, threshold: float):
        self.noise, self.threshold = Noise(), threshold

    def push(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(active=self.noise.active(pdf["rms"].to_numpy(float), self.threshold))

    def close(self) -> None:
        return None


def throttled(blocks: DataFrame, key: str, at: str, apart: float = 0.1) -> DataFrame:
    """The blocks that are shown: each at least `apart` seconds after the one shown before. Of blocks at one time any one is the first."""
    return folded(blocks, key, [at], lambda _: _Shown(at, apart), blocks.schema)


class _Shown:
    def __init__(self, at: str, apart: float):
        self.at, self.apart, self.last = at, apart, -np.inf

    def push(self, pdf: pd.DataFrame) -> pd.DataFrame:
        keep = []
        for t in pdf[self.at]:
            keep.append(t - self.last >= self.apart)
            self.last = t if keep[-1] else self.last
        return pdf[np.array(keep, bool)]

    def close(self) -> None:
        return None


def gap_segments(events: DataFrame, key: str, micros: str, order: str, idle: int) -> DataFrame:
    """(key, seg, start, end, n): runs of events less than `idle` microseconds apart; a gap of exactly `idle` closes one. Windows only: a hot key's rows are sorted once."""
    by = Window.partitionBy(key).orderBy(micros, order)
    new = F.coalesce((F.col(micros) - F.lag(micros).over(by) >= idle).cast("int"), F.lit(0))
    own = events.withColumn("new", new).withColumn("seg", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(key, "seg").agg(F.min(micros).alias("start"), F.max(micros).alias("end"), F.count("*").alias("n"))


def pauses(segs: DataFrame, key: str = "session", start: str = "start", end: str = "end") -> DataFrame:
    """segs with pause: from the end of the one before to the start, at least 0; null for the first."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(start, end))
    return segs.withColumn("pause", F.when(before.isNotNull(), F.greatest(F.lit(0), F.col(start) - before)))


def quietest(frames: DataFrame, key: str, order: str, level: str, last: int) -> DataFrame:
    """(key, at): the quietest of each key's last frames, the first of equally quiet ones."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return frames.withColumn("back", back).where(F.col("back") <= last).groupBy(key).agg(F.min_by(order, F.struct(level, order)).alias("at"))
