"""Audio columns: exact round trips and plain signal processing."""

import hashlib
import zlib

import numpy as np
import pytest
from cadenza.llm import audio
from samples import corpus, frame, unique_ids


def test_digests_are_those_of_the_padded_bytes(spark):
    rows = corpus(1) + [(None, "no id"), (400, "é" * 64)]
    got = audio.audio_digests(frame(spark, rows, extra=True)).collect()
    want = sorted(repr((d, len(raw := (t or "").encode()), len(p := raw + bytes(-len(raw) % 64 if raw else 64)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))) for d, t in rows)
    assert sorted(repr((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in got) == want
    media = {r.payload_sha256: (r.media_bytes, r.media_sha256, r.feature) for r in got}
    assert all(media[r.payload_sha256] == (r.media_bytes, r.media_sha256, r.feature) for r in got)
    assert all(r.media_bytes == r.payload_bytes + 44 for r in got)
    assert audio.audio_digests(frame(spark, [])).count() == 0


def test_stored_samples_come_back():
    for raw in (b"", b"\x00", bytes(range(256)) * 3, b"x" * 64):
        own = audio.padded(raw)
        assert len(own) % 64 == 0 and len(own) > 0 and own.startswith(raw) and not own[len(raw) :].strip(b"\0")
        assert audio.from_wav(audio.to_wav(own, 16_000)) == own


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 2), (2, 3), (1, 1)])
def test_the_polyphase_resampler_is_filtering_between_zeros(up, down):
    p = audio.AudioParams(up=up, down=down)
    f = audio.Features(p)
    x = np.random.default_rng(1).integers(0, 256, 300).astype(np.uint8)
    total = -(-len(x) * up // down)
    got = f.resampled(x, 0, total)
    half = p.taps * up // 2
    n = np.arange(-half, half)
    width = 1 / max(up, down)
    low = np.sinc(n * width) * width * up * np.hamming(len(n))
    wide = np.zeros(len(x) * up)
    wide[::up] = (x.astype(float) - 128) / 128
    full = np.convolve(wide, low)[: len(wide) + len(low)]
    want = np.array([full[m * down + half - up] if m * down + half - up >= 0 else 0 for m in range(total)])
    shifts = [np.abs(got[40:-40] - np.array([full[m * down + half + s] for m in range(40, total - 40)])).max() for s in range(-up - 1, up + 2)]
    assert min(shifts) < 1e-4, (shifts, want[:3])
    np.testing.assert_allclose(np.concatenate([f.resampled(x, 0, 50), f.resampled(x, 50, total)]), got, atol=1e-6)


def test_features_do_not_depend_on_the_block():
    x = np.random.default_rng(2).integers(0, 256, 20_000).astype(np.uint8)
    one, many = audio.Features(audio.AudioParams()), audio.Features(audio.AudioParams(block=7))
    a, b = ([np.concatenate(c) for c in list(zip(*f.blocks(x), strict=True))[1:]] for f in (one, many))
    for u, v in zip(a, b, strict=True):
        np.testing.assert_allclose(u, v, atol=1e-4)


def test_segments_open_high_and_close_low():
    f = audio.Features(audio.AudioParams(on=0.5, off=0.0))
    energy = np.array([0, 0, 5, 2.4, 2.4, 5, 0, 0, 2.4, 0, 5.0])
    mean, dev = energy.mean(), energy.std()
    state, want = False, []
    for e in energy:
        state = e >= mean + 0.5 * dev or (state and e >= mean)
        want.append(state)
    got = np.zeros(len(energy), bool)
    for a, z in f.segments(energy):
        got[a:z] = True
    assert got.tolist() == want


def test_tensors_have_one_shape_and_time_spans(spark, tmp_path):
    p = audio.AudioParams()
    rows = [r for r in unique_ids(corpus(2)) if r[0] in (1, 2, 90, 70)]
    audio.audio_tensors(audio.audio_column(frame(spark, rows)), p).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t").toArrow()
    tensors = audio.as_tensors(table.column("tensor"), p)
    assert tensors.type.shape == [p.span, p.mels] and len(tensors) == len(table)
    got = table.to_pandas().sort_values(["doc_id", "span"])
    for _, own in got.groupby("doc_id"):
        assert own["span"].tolist() == list(range(len(own)))
        assert (own["frames"].iloc[:-1] == p.span).all() and own["frames"].iloc[-1] > 0
        assert np.allclose(own["end_s"].iloc[:-1], own["start_s"].iloc[1:]) and own["start_s"].iloc[0] == 0
        assert own["sound"].between(0, 1).all()


def test_features_come_from_stored_tensors(spark, monkeypatch):
    """Documents of many spans, repeated ids: what is derived from the tensors is what the signal gives."""
    kept, p, put = [], audio.AudioParams(), audio.stored
    monkeypatch.setattr(audio, "stored", lambda *a: kept.append(put(*a)) or kept[-1])
    rows = [(1, "ab " * 9000 + "z" * 30_000), (1, "other " * 50), (2, None), (3, "é" * 40_000)]
    got = {r.payload_sha256: r.feature for r in audio.audio_digests(frame(spark, rows), p).collect()}
    assert len(kept) == 2 and kept[1].where("size(tensor) = 1280").count() == kept[1].count() > len(rows)
    f, seconds = audio.Features(p), p.hop * p.down / (p.rate * p.up)
    for _, t in rows:
        x = audio.padded((t or "").encode())
        mel, energy = (np.concatenate(c) for c in list(zip(*f.blocks(np.frombuffer(x, np.uint8)), strict=True))[1:])
        seg = f.segments(energy)
        ends = f"{seg[0, 0] * seconds:.3f}-{seg[-1, 1] * seconds:.3f}" if len(seg) else "-"
        own = got[hashlib.sha256(x).hexdigest()].split(";")
        assert own[:4] == [str(len(energy)), str(len(seg)), str((seg[:, 1] - seg[:, 0]).sum()), ends]
        assert own[5] == f"{zlib.crc32(np.rint(mel).astype(np.int8).tobytes()):08x}"
        np.testing.assert_allclose(np.array(own[4].split(","), int), mel.mean(axis=0) * 10, atol=0.51)


def test_signals_cut_by_batches_have_the_same_features(spark):
    rows = [(i, "ab " * (900 * i) + "z" * 3000) for i in range(1, 9)] + [(1, "ab " * 900 + "z" * 3000), (20, None)]
    get = lambda: sorted((r.doc_id, r.feature) for r in audio.audio_digests(frame(spark, rows)).collect())
    whole, key = get(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        assert get() == whole
    finally:
        spark.conf.set(key, before)
