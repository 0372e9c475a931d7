"""Golden cases of the ordered steps, and batch against stream."""

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.operators.segments import Joiner, Noise, Segmenter, joined, paragraphs, refinements, segments
from cadenza.params import FRAME, JOINING, RATE, Joining, Paragraphs, Segmenting
from cadenza.queries import signals
from cadenza.streaming.segmenting import live_paragraphs, live_segments


def run(levels, p, tail=0):
    level = np.array(levels, float)
    m = Segmenter(p)
    return m.push(level, level >= 0.016) + m.flush(tail)


def loop(levels, p, tail=0):
    """Frame by frame, as plainly as can be."""
    n, pad, search = p.frames(p.silence), p.frames(p.pad), p.frames(p.search)
    buf, out, last_end, pos = [], [], None, 0
    st = {"has": False, "run": 0, "last": 0, "len": 0, "carried": 0, "start": 0, "first": None}

    def close(reason):
        nonlocal buf, last_end
        kept = None
        if buf and st["has"] and st["len"] - st["carried"] >= int(p.shortest * p.rate):
            keep = len(buf)
            if reason == "silence":
                keep = min(len(buf), st["last"] + pad)
            else:
                w = min(search, len(buf) - 1)
                if w > 0:
                    own = [x for _, x in buf[-w:]]
                    keep = len(buf) - w + own.index(min(own)) + 1
            size = sum(s for s, _ in buf[:keep])
            pause = None if last_end is None else max(0.0, (st["first"] - last_end) / p.rate)
            last_end = st["start"] + st["last"] * FRAME
            out.append((st["start"], st["start"] + size, reason, pause))
            kept, end = buf[keep:], st["start"] + size
        buf = list(kept or [])
        carried = sum(s for s, _ in buf)
        st.update(has=False, run=0, last=0, len=carried, carried=carried, first=None)
        if kept:
            st["start"] = end

    for x in levels:
        if not buf:
            st["start"] = pos
        buf.append((FRAME, x))
        st["len"] += FRAME
        pos += FRAME
        if x >= 0.016:
            if not st["has"]:
                st["first"] = pos - FRAME
            st.update(has=True, run=0, last=len(buf))
        else:
            st["run"] += 1
        if st["has"] and st["run"] >= n:
            close("silence")
        elif st["len"] >= int(p.longest * p.rate):
            close("max_len")
    if tail:
        if not buf:
            st["start"] = pos
        buf.append((tail, 0.0))
        st["len"] += tail
    close("silence")
    return out


@pytest.mark.parametrize("seed", range(30))
def test_segments_equal_the_plain_loop(seed):
    rng = np.random.default_rng(seed)
    levels = np.repeat(rng.choice([0.001, 0.2, 0.03], 60), rng.integers(1, 25, 60)) * rng.uniform(0.9, 1.1)
    levels = (levels + rng.uniform(0, 0.0005, len(levels))).tolist()
    p = Segmenting(silence=rng.choice([0.1, 0.35, 0.5]), longest=rng.choice([1.0, 3.0]), shortest=rng.choice([0.1, 0.5]), pad=rng.choice([0.05, 0.2]))
    tail = int(rng.integers(0, FRAME))
    assert run(levels, p, tail) == loop(levels, p, tail)


def test_segments_never_overlap_and_cover_what_is_carried():
    rng = np.random.default_rng(1)
    out = run(rng.choice([0.001, 0.2], 2000).tolist(), Segmenting(longest=3.0))
    assert all(a[1] <= b[0] for a, b in zip(out, out[1:], strict=False))
    assert all(a[1] == b[0] for a, b in zip(out, out[1:], strict=False) if a[2] == "max_len")


def test_noise_floor():
    assert not Noise().active(np.array([0.002] * 201), 0.5)[-1]
    n = Noise()
    n.active(np.array([0.002] * 200), 0.5)
    assert n.active(np.array([0.0066]), 0.5)[0]
    n = Noise()
    n.active(np.zeros(500), 0.5)
    assert not n.active(np.array([0.0004]), 0.5)[0]
    n = Noise()
    n.active(np.array([0.001] * 200), 0.5)
    assert n.active(np.array([0.00716]), 0.5)[0]


def seg(a, z, pause=None):
    return (int(a * RATE), int(z * RATE), "silence", pause)


def test_joiner():
    p = Joining(4.0, 2.0, 2.0)
    m = Joiner(p)
    assert [x for i, s in enumerate([seg(0, 1), seg(1, 2), seg(2, 3), seg(3, 4.5)]) for x in m.push(s, i)] == [seg(0, 4.5)]
    m = Joiner(p)
    assert m.push(seg(0, 1), 0) == [] and m.push(seg(9, 10), 9) == [seg(0, 1)]
    m = Joiner(p)
    m.push(seg(0, 1), 100)
    assert m.tick(101) == [] and m.tick(102.5) == [seg(0, 1)]
    m = Joiner(p)
    m.push(seg(0, 1, 1.2), 0)
    assert m.push(seg(1, 2, 3.0), 1) == [seg(0, 1, 1.2)]
    m = Joiner(Joining(10.0, 2.0, 2.0))
    for t, a in ((100, 0), (101, 0.5), (101.9, 1.0)):
        assert m.push(seg(a, a + 0.5), t) == []
    assert m.tick(102.1) == [seg(0, 1.5)]
    assert JOINING["system", True] == JOINING["system", False]


def texts(spark, rows):
    return spark.createDataFrame([("s", i, t, p) for i, (t, p) in enumerate(rows)], "session string, ord long, text string, pause double")


@pytest.mark.parametrize(
    ("p", "rows", "want"),
    [
        (Paragraphs(), [("あ" * 200, 5.0)], [False]),
        (Paragraphs(), [("あ" * 129 + "。", None), ("い" * 50, 0.3), ("う" * 49 + "。", 1.0)], [False, False, False]),
        (Paragraphs(), [("あ" * 130, None), ("い" * 19 + "。", 1.0), ("う" * 20, 1.0)], [False, False, True]),
        (Paragraphs(), [("あ" * 409 + "。", None), ("い" * 10, 0.0)], [False, True]),
        (Paragraphs(hardest=800), [("あ" * 810, None), ("い" * 10, 0.0)], [False, True]),
        (Paragraphs(least=0), [("あ" * 500, None), ("", 9.0), ("い" * 500, 9.0)], [False, False, False]),
    ],
)
def test_paragraphs(spark, p, rows, want):
    assert [r.breaks for r in paragraphs(texts(spark, rows), p).orderBy("ord").collect()] == want


def test_refinements(spark):
    ends = spark.createDataFrame([("s", i, e * RATE) for i, e in enumerate((12, 33, 55, 66))] + [("t", 0, 31 * RATE), ("t", 1, 40 * RATE)], "session string, ord long, delivered_end long")
    got = {(r.session, r.start // RATE, r.end // RATE, r.revision) for r in refinements(ends, 30 * RATE, 8 * RATE).collect()}
    assert got == {("s", 0, 33, 1), ("s", 33, 66, 2), ("t", 0, 31, 1), ("t", 31, 40, 2)}


def frames(spark, seed=3, n=900):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(s, i, float(x), False) for s in ("a", "b") for i, x in enumerate(np.repeat(rng.choice([0.001, 0.2], n // 15), 15))], "session string, frame_no long, rms double, stop boolean")


def test_empty_and_null_frames(spark):
    df = frames(spark).where("false")
    assert segments(df).count() == 0
    assert segments(frames(spark).withColumn("rms", F.lit(None).cast("double"))).count() == 0


@pytest.mark.parametrize("join", [None, Joining(4.0, 6.0, 4.0)])
def test_stream_equals_batch(spark, tmp_path, join):
    p = Segmenting(silence=0.3, longest=3.0)
    df = frames(spark)
    want = segments(df, p) if join is None else joined(segments(df, p), join)
    end = spark.createDataFrame([(s, 10_000, 0.0, True) for s in ("a", "b")], df.schema)
    for k in range(5):
        part = df.where(f"frame_no >= {200 * k} and frame_no < {200 * (k + 1)}")
        (part.union(end) if k == 4 else part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live_segments(stream, p, join).writeStream.format("memory").queryName(f"segs{bool(join)}").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    key = lambda r: (r.session, r.start, r.end, r.reason)
    assert sorted(map(key, spark.table(f"segs{bool(join)}").collect())) == sorted(map(key, want.collect()))


def test_stream_paragraphs(spark, tmp_path):
    df = texts(spark, [("あ" * 100 + "。", 1.0)] * 9)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live_paragraphs(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("paras").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    want = paragraphs(df).select("ord", "breaks").collect()
    assert sorted((r.ord, r.breaks) for r in spark.table("paras").collect()) == sorted((r.ord, r.breaks) for r in want)


def test_markers_round_by_the_exact_value(spark, tmp_path):
    """Tenths whose shortest decimal form ends in 5 lie above or below the half, or on it."""
    places = [timedelta(minutes=m, milliseconds=50 + 100 * k) for m in (1, 400, 20_000) for k in range(600)]
    rows = [(i, i, datetime(2024, 1, 1) + at + timedelta(hours=3 * part), "click", 1.0) for i, at in enumerate(places) for part in (0, 1)]
    frame = pd.DataFrame([(n, *r[1:]) for n, r in enumerate(rows)], columns=["event_id", "user_id", "ts", "event_type", "value"])
    frame.astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/events.parquet", index=False)
    got = {tuple(r) for r in signals.missing_markers(spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert got == set(duck.execute(signals.ORACLE_SQL["missing_markers"]).fetchall())
    starts = [n / 20 for n in range(1, 1200, 2)] + [60 * m + n / 20 for m in (7, 59_999) for n in range(1, 1200, 2)] + [0.0, 59.96, 119.999999]
    told = spark.createDataFrame([(s,) for s in starts], "s double").select("s", text.minute_clock(F.col("s")).alias("m")).collect()
    assert {r.s: r.m for r in told} == {s: f"{int(s // 60)}:{s - s // 60 * 60:04.1f}" for s in starts}
