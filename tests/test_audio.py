import io
import wave

import numpy as np
import pytest

from gramweave.functions import kernels
from gramweave.sources import audio


def file_of(x, width, channels, rate):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels), f.setsampwidth(width), f.setframerate(rate)
        raw = b"".join(int(v + 128).to_bytes(1, "little") if width == 1 else int(v).to_bytes(width, "little", signed=True) for v in x)
        f.writeframes(raw)
    return out.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_integers_of_any_width(width):
    top = 1 << (8 * width - 1)
    rate, x = audio.samples_of(file_of([0, top // 2, -top, top - 1, -1, 1], width, 2, 8000))
    assert rate == 8000 and np.allclose(x, [0.25, -0.5 / top, 0.0])


def test_mel_scale_and_filters():
    assert np.allclose(audio.mel([0, 200 / 3, 1000, 6400]), [0, 1, 15, 42]) and np.allclose(audio.hertz(audio.mel([10.0, 500, 1000, 7000])), [10, 500, 1000, 7000])
    f = audio.mel_filters(16000, 1024, 20, 0.0, 8000.0)
    assert f.shape == (20, 513) and (f >= 0).all() and np.allclose(f[5:].sum(axis=1) * 16000 / 1024, 1, atol=0.05)
    assert (np.diff(f.argmax(axis=1)) > 0).all()


def test_spectrogram_by_definition():
    r = np.random.default_rng(1)
    x, n, hop, rate = r.normal(size=300), 64, 16, 8000
    got = audio.log_mel(x, rate, n, hop, 6)
    padded = np.concatenate([np.zeros(32), x, np.zeros(32)])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    want = []
    for at in range(0, len(padded) - n + 1, hop):
        part = padded[at : at + n] * window
        power = np.array([abs(sum(part * np.exp(-2j * np.pi * k * np.arange(n) / n))) ** 2 for k in range(33)])
        want.append(audio.mel_filters(rate, n, 6, 0.0, rate / 2) @ power)
    want = 10 * np.log10(np.array(want)) - 10 * np.log10(np.max(want))
    assert got.shape == want.shape and np.allclose(got, np.maximum(want, -80))


def test_recordings_and_their_matrices(spark, tmp_path):
    r = np.random.default_rng(2)
    for name, x in (("normal/id_03/a.wav", r.normal(size=9000) * 3000), ("abnormal/id_4/b.wav", r.normal(size=9000) * 3000), ("normal/id_03/short.wav", np.ones(10)), ("normal/flat.wav", np.zeros(9000))):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(audio.wav_bytes(x, 8000))
    rows = audio.recordings(spark, f"file://{tmp_path}")
    assert {(x.kind, x.machine, x.rate, len(x.samples)) for x in rows.collect()} == {("normal", "id_03", 8000, 9000), ("abnormal", "id_04", 8000, 9000), ("normal", "id_03", 8000, 10), ("normal", None, 8000, 9000)}
    got = {x.path.rpartition("/")[2]: x for x in audio.band_correlation(rows, n_fft=256, hop=64, bands=12).collect()}
    assert {k: v.reason for k, v in got.items()} == {"a.wav": None, "b.wav": None, "short.wav": "too short", "flat.wav": "constant band"}
    least, most, trace, rank = kernels.quality(np.array(got["a.wav"].a).reshape(12, 12))
    assert least > -1e-10 and np.isclose(trace, 12) and rank == 12 and most < 12
