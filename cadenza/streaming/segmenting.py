"""Segments, joins and paragraphs of a live stream: the batch steps, with their state kept between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.signal import fixed_floor
from ..operators.segments import SEGMENT, Joiner, Noise, Segmenter
from ..params import Joining, Segmenting


def live_segments(frames: DataFrame, p: Segmenting = Segmenting(), j: Joining | None = None, resume: int = 90, event_time: bool = True) -> DataFrame:
    """(session, start, end, reason, pause) of a stream of frames (session, frame_no, rms[, stop][, silence]).

    A session's open frames (at most `longest` seconds) and its held segment are its state; a
    row with stop ends it. silence, where given, sets the pause that closes a segment from
    there on. A session that sends nothing for `resume` seconds is closed and forgotten; one
    that comes back before goes on. A held segment's clock is the stream's own position
    (event_time), so that live and batch give the same; else it also goes out when `hold`
    seconds pass without input.
    """
    cols = ["session", "frame_no", F.coalesce("rms", F.lit(0.0)).alias("rms")]
    cols.append(F.coalesce("stop", F.lit(False)).alias("stop") if "stop" in frames.columns else F.lit(False).alias("stop"))
    cols.append(F.col("silence").cast("double") if "silence" in frames.columns else F.lit(None).cast("double").alias("silence"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else None
        q = Segmenting(**(vars(p) | ({"silence": own["silence"]} if own else {})))
        seg = Segmenter(q, **own["seg"]) if own else Segmenter(q)
        noise = Noise(own["noise"] if own else None)
        join = Joiner(j, tuple(own["held"]) if own and own["held"] else None, own["since"] if own else 0.0) if j else None
        rows: list[tuple] = []

        def send(closed: list[tuple]) -> None:
            now = (seg.base + len(seg.sound)) * 512 / q.rate
            for own in closed:
                rows.extend((join.tick(own[1] / q.rate) + join.push(own, own[1] / q.rate)) if join and event_time else join.push(own, now) if join else [own])

        idle = state.hasTimedOut
        stop = idle and (join is None or event_time or not join.held)
        if idle and join and join.held and not event_time:
            rows += join.flush()
        for pdf in [] if idle else sorted((b for b in batches if len(b)), key=lambda b: b["frame_no"].iloc[0]):
            pdf = pdf.sort_values("frame_no", kind="stable")
            for silence, part in pdf.groupby(pdf["silence"].ffill().fillna(seg.p.silence), sort=False):
                seg.p = Segmenting(**(vars(seg.p) | {"silence": float(silence)}))
                sounds = part[~part["stop"]]
                level = sounds["rms"].to_numpy(float)
                send(seg.push(level, noise.active(level, p.threshold) if p.adaptive else level >= fixed_floor(p.threshold)))
            stop = stop or bool(pdf["stop"].any())
        if stop:
            send(seg.flush())
            rows += join.flush() if join else []
            state.remove()
        else:
            state.update((json.dumps({"seg": seg.state(), "noise": noise.level, "silence": seg.p.silence, "held": join.held if join else None, "since": join.since if join else 0.0}),))
            hold = j.hold if join and join.held and not event_time else resume
            state.setTimeoutDuration(int(1000 * hold))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["session", "start", "end", "reason", "pause"]).astype({"start": np.int64, "end": np.int64})

    return frames.select(*cols).groupBy("session").applyInPandasWithState(run, SEGMENT, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_idle(levels: DataFrame, timeout: int, audible: float = 0.0001) -> DataFrame:
    """(session, expired_at): a session whose source was silent for `timeout` seconds of its own time. levels: (session, at, rms)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, done = state.get if state.exists else (None, False)
        out = []
        for at, rms in pd.concat(batches).sort_values("at")[["at", "rms"]].itertuples(index=False):
            last = at if last is None or rms >= audible else last
            if not done and at - last >= timeout:
                out.append((key[0], at))
                done = True
        state.update((float(last), done))
        yield pd.DataFrame(out, columns=["session", "expired_at"])

    return levels.groupBy("session").applyInPandasWithState(run, "session string, expired_at double", "last double, done boolean", "append", GroupStateTimeout.NoTimeout)


def live_paragraphs(texts: DataFrame, least: int = 120, pause: float = 0.7, most: int = 400, hardest: int = 0) -> DataFrame:
    """(session, ord, text, breaks) of a stream of texts (session, ord, text, pause): the characters since the last break are the state."""
    top = hardest or 2 * most

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, finished = state.get if state.exists else (0, False)
        out = []
        for n, text, wait in pd.concat(batches).sort_values("ord")[["ord", "text", "pause"]].itertuples(index=False):
            own, wait = text or "", 0.0 if wait is None or wait != wait else wait
            go = bool(own) and least > 0 and size > 0 and ((((size >= least and wait >= pause) or size >= most) and finished) or size >= top)
            if own:
                size, finished = (0 if go else size) + len(own), own.rstrip()[-1:] in tuple("。！？!?」』）")
            out.append((key[0], n, text, go))
        state.update((int(size), bool(finished)))
        yield pd.DataFrame(out, columns=["session", "ord", "text", "breaks"])

    return texts.groupBy("session").applyInPandasWithState(run, "session string, ord long, text string, breaks boolean", "size long, finished boolean", "append", GroupStateTimeout.NoTimeout)


def append_sink(stream: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch to a table with a folder for each session, once whatever is run again."""
    return stream.writeStream.format("parquet").partitionBy("session").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
