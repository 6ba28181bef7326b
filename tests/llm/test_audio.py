import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from inkwell.llm import audio


def check(df):
    rows = audio.audio_features(df).collect()
    docs = df.collect()
    payload = lambda t: audio.padded((t or "").encode())
    want = sorted([(r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for r in docs for p in [payload(r.text)]], key=str)
    assert sorted([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows], key=str) == want
    alike = {}
    for r in rows:
        assert r.media_bytes == r.payload_bytes + 44 and len(r.tensor) == audio.STEPS * audio.MELS and np.isfinite(r.tensor).all()
        assert all(0 <= a < b <= r.duration + audio.FRAME / (audio.RATE * audio.UP / audio.DOWN) for a, b in r.segments)
        assert alike.setdefault(r.payload_sha256, (r.media_sha256, r.feature, tuple(r.tensor))) == (r.media_sha256, r.feature, tuple(r.tensor))


def test_documents(documents):
    check(documents)


def test_odd(odd, none):
    check(odd)
    assert audio.audio_features(none).count() == 0


@given(st.binary(max_size=3000))
@settings(max_examples=40, deadline=None)
def test_round_trip(data):
    p = audio.padded(data)
    assert len(p) % 576 == 0 and len(p) >= 576 and p.startswith(data) and set(p[len(data) :]) <= {255}
    assert audio.from_wav(audio.to_wav(p)) == (p, audio.RATE)


def test_resampler_is_filtering_and_picking():
    x = np.random.default_rng(0).normal(size=4000).astype(np.float32)
    up = np.zeros(2 * len(x), np.float32)
    up[::2] = x
    n = audio.UP * audio.TAPS
    k = (np.arange(n) - (n - 1) / 2) / audio.DOWN
    h = np.sinc(k) * np.kaiser(n, 6.0)
    whole = np.convolve(up, h * audio.UP / h.sum())
    lag = audio.UP * (audio.TAPS // 2 - 1)
    y = audio.resampled(x)
    assert np.allclose(y[:1500], whole[lag : lag + 5 * 1500 : 5], atol=1e-5)


def test_blocks_do_not_show(monkeypatch):
    x = np.random.default_rng(1).normal(size=50_000).astype(np.float32)
    a, (m, e) = audio.resampled(x), audio.log_mel(x, 6400)
    monkeypatch.setattr(audio, "BLOCK", 1 << 8)
    assert np.allclose(a, audio.resampled(x), atol=1e-5)
    assert all(np.allclose(p, q, atol=1e-4) for p, q in zip((m, e), audio.log_mel(x, 6400)))


def test_a_tone_is_in_its_band_and_silence_outside_segments():
    rate = 6400
    t = np.arange(rate) / rate
    low, high = (audio.log_mel(np.sin(2 * np.pi * f * t).astype(np.float32), rate)[0].mean(0).argmax() for f in (300, 2000))
    assert low < high
    loud = np.concatenate([np.zeros(rate), np.sin(2 * np.pi * 400 * t), np.zeros(rate)]).astype(np.float32)
    spans = audio.segments(audio.log_mel(loud, rate)[1], rate)
    assert len(spans) == 1 and spans[0][0] == pytest.approx(1, abs=0.05) and spans[0][1] == pytest.approx(2, abs=0.05)


def test_hysteresis_holds_between_the_thresholds():
    energy = np.array([0, 0, 10, 3, 3, 10, 0, 3, 0, 0], float)  # mean 2.6: 3 neither opens nor closes
    assert audio.segments(energy, 6400) == [(0.02, round((5 * audio.HOP + audio.FRAME) / 6400, 4))]


def test_arrow_tensors(documents):
    table = audio.as_tensors(audio.audio_features(documents.limit(5)).toArrow())
    kind = table.schema.field("tensor").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [audio.STEPS, audio.MELS] and table.num_rows == 5


def plain_features(samples, rate=audio.RATE):
    """Every step by its definition, a value at a time or in double precision, sharing the operator's constants only."""
    x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    up, down, taps = audio.UP, audio.DOWN, audio.TAPS
    n = up * taps
    h = np.sinc((np.arange(n) - (n - 1) / 2) / max(up, down)) * np.kaiser(n, 6.0)
    h = h * up / h.sum()
    stuffed = np.zeros((len(x) + 2 * taps) * up)
    stuffed[taps // 2 * up : (taps // 2 + len(x)) * up : up] = x
    y = []
    for k in range(max(1, len(x) * up // down)):
        at = k * down  # on the finer grid
        y.append(sum(h[up * (taps - 1 - j) + at % up] * stuffed[(at // up + j) * up] for j in range(taps)))
    y, to = np.array(y), rate * up / down
    y = np.append(y, np.zeros(max(0, audio.FRAME - len(y))))
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + to / 2 / 700), audio.MELS + 2) / 2595) - 1)
    mels, energy = [], []
    for at in range(0, len(y) - audio.FRAME + 1, audio.HOP):
        frame = y[at : at + audio.FRAME] * np.hanning(audio.FRAME)
        power = np.abs(np.fft.rfft(frame, audio.FFT)) ** 2
        row = []
        for m in range(audio.MELS):
            low, mid, high = edges[m : m + 3]
            f = np.arange(len(power)) * to / audio.FFT
            row.append(np.log((power * np.clip(np.minimum((f - low) / (mid - low), (high - f) / (high - mid)), 0, None)).sum() + 1e-6))
        mels.append(row)
        energy.append(10 * np.log10((frame**2).mean() + 1e-10))
    spans, begun = [], None
    for k, e in enumerate([*energy, -1e9]):
        if begun is None and e > np.mean(energy) + audio.OPEN:
            begun = k
        elif begun is not None and e < np.mean(energy) - audio.CLOSE:
            spans.append((begun * audio.HOP / to, ((k - 1) * audio.HOP + audio.FRAME) / to))
            begun = None
    cut = np.linspace(0, len(mels), audio.STEPS + 1).astype(int)
    tensor = [np.mean(mels[a:b], 0) if b > a else mels[min(a, len(mels) - 1)] for a, b in zip(cut, cut[1:])]
    return np.array(tensor), spans


def test_features_against_plain_steps(documents):
    for r in documents.orderBy("doc_id").limit(6).collect():
        samples = audio.padded(r.text.encode()[:6000])
        found = audio.features(samples)
        tensor, spans = plain_features(samples)
        assert np.allclose(found["tensor"].reshape(audio.STEPS, audio.MELS), tensor, atol=2e-3)
        assert np.allclose(np.array(found["segments"]).ravel(), np.array(spans).ravel(), atol=1e-4)


def test_stored_tensors(spark, odd, tmp_path):
    import pyarrow.parquet as pq

    out = audio.audio_features(odd)
    assert out.schema["tensor"].metadata["shape"] == [audio.STEPS, audio.MELS]
    out.write.parquet(str(tmp_path / "features"))
    assert spark.read.parquet(str(tmp_path / "features")).schema["tensor"].metadata == audio.SHAPE
    files = audio.write_tensors(out, f"file://{tmp_path}/t").collect()
    assert sum(f.rows for f in files) == odd.count() and not list((tmp_path / "t").glob("_task*"))
    table = pq.read_table(tmp_path / "t", schema=None)
    assert table.schema.field("tensor").type == audio.TENSOR and len(table) == odd.count()
    want = {r.doc_id: r.tensor for r in out.collect()}
    got = dict(zip(table["doc_id"].to_pylist(), table["tensor"].combine_chunks().to_numpy_ndarray()))
    assert all(np.allclose(got[i].ravel(), want[i]) for i in got)
