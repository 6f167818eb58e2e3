import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import segments, signal
from tidemark.sources import audio

RATE, SIZE = 1000, 250


def riff(path, raw, channels, bits, rate=RATE, tag=1, extensible=False, length=None):
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        fmt += struct.pack("<HHIH", 22, bits, 0, tag) + b"\0" * 14
    body = b"LIST" + struct.pack("<I", 5) + b"odd..\0" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(raw) if length is None else length) + raw
    path.write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)


def test_sample_kinds(spark, tmp_path):
    x = np.sin(np.arange(1100) / 7) * 0.9
    whole = np.round(x * (1 << 23)).astype("<i4")
    riff(tmp_path / "a24.wav", b"".join(int(v).to_bytes(3, "little", signed=True) for v in whole), 1, 24)
    riff(tmp_path / "b16.WAV", np.repeat(np.round(x * 32767).astype("<i2"), 2).tobytes(), 2, 16, extensible=True)
    riff(tmp_path / "c32f.wav", x.astype("<f4").tobytes() + b"\1\2", 1, 32, tag=3, length=0)
    riff(tmp_path / "d8.wav", np.round(x * 127 + 128).astype("u1").tobytes(), 1, 8, length=10**6)
    riff(tmp_path / "e32.wav", np.round(x * (2**31 - 1)).astype("<i4").tobytes(), 1, 32)
    riff(tmp_path / "none.wav", b"", 1, 16)
    (tmp_path / "other.txt").write_text("x")
    got = audio.read_wav(spark, str(tmp_path), blockSeconds=0.25, rangeBytes=1000)
    rows = got.collect()
    assert got.rdd.getNumPartitions() >= 12  # ranges of a kilobyte
    by = {}
    for r in sorted(rows, key=lambda r: (r["source_path"], r["block_idx"])):
        by.setdefault(r["source_path"].split("/")[-1], []).append(r)
    assert sorted(by) == ["a24.wav", "b16.WAV", "c32f.wav", "d8.wav", "e32.wav"]
    for name, blocks in by.items():
        assert [b["block_idx"] for b in blocks] == list(range(5)) and blocks[0]["duration_seconds"] == 1.1
        assert np.concatenate([b["block"] for b in blocks]) == pytest.approx(x, abs=0.02 if name == "d8.wav" else 1e-4)
    one = np.concatenate([b["block"] for b in by["a24.wav"]])
    assert one == pytest.approx(whole / (1 << 23), abs=1e-7)


def test_what_is_no_wav_is_an_error(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(b"RIFFxxxxWAVE")
    with pytest.raises(Exception, match="without samples"):
        audio.read_wav(spark, str(tmp_path)).count()
    riff(tmp_path / "x.wav", b"1234", 1, 12)
    with pytest.raises(Exception, match="can't be read"):
        audio.read_wav(spark, str(tmp_path)).count()


def test_reads_are_tried_again():
    left = [2]

    def flaky():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("not fetched yet")
        return 7

    assert audio.again(flaky, 2, 0) == 7
    left[0] = 2
    with pytest.raises(OSError):
        audio.again(flaky, 1, 0)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(8)
    all_ = {("r", 1): rng.normal(0, 0.2, 23 * SIZE + 77), ("r", 2): rng.normal(0, 0.2, 4 * SIZE), (None, 3): rng.normal(0, 0.2, 90), ("s", 4): rng.normal(0, 0.2, 1)}
    rows = [(k[0], k[1], b, x[b * SIZE : (b + 1) * SIZE].tolist()) for k, x in all_.items() for b in range(-(-len(x) // SIZE))]
    df = spark.createDataFrame(rows, "recording_id string, sequence int, block_idx long, block array<float>").repartition(7)
    return df, {k: x.astype(np.float32).astype(float) for k, x in all_.items()}


KEYS = ["recording_id", "sequence"]


def collected(df, value="value"):
    out = {}
    for r in df.orderBy(*KEYS, "frame_idx").collect():
        out.setdefault((r["recording_id"], r["sequence"]), []).append((r["frame_idx"], r["at"], r[value]))
    return out


@pytest.mark.parametrize("window,hop,blocks", [(500, 100, 3), (50, 7, 2), (130, 130, 1), (64, 90, 4)])
def test_rms_over_blocks_equals_the_whole(series, window, hop, blocks):
    df, all_ = series
    got = collected(segments.rms_frames(df, KEYS, window, hop, SIZE, blocks))
    for key, x in all_.items():
        n = (len(x) - window) // hop + 1 if len(x) >= window else 0
        want = [20 * np.log10(np.sqrt((x[i * hop : i * hop + window] ** 2).mean() + signal.EPS) + signal.EPS) for i in range(n)]
        own = got.get(key, [])
        assert [f for f, _, _ in own] == list(range(n)) and [a for _, a, _ in own] == [i * hop for i in range(n)]
        assert [v for _, _, v in own] == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("window,hop,blocks", [(100, 20, 3), (51, 10, 1), (300, 90, 2), (64, 64, 5)])
def test_flux_over_blocks_equals_the_whole(series, window, hop, blocks):
    df, all_ = series
    got = collected(segments.flux_frames(df, KEYS, window, hop, SIZE, blocks))
    for key, x in all_.items():
        size = min(window, len(x))
        step = hop - (window - size)
        if size < 2 or step < 1:
            assert key not in got
            continue
        at, magnitude = signal.stft_magnitudes(x, size, step)
        want = np.maximum(np.diff(magnitude, axis=0, prepend=magnitude[:1]), 0).sum(1)
        assert [(f, a) for f, a, _ in got[key]] == list(enumerate(at.tolist()))
        assert [v for _, _, v in got[key]] == pytest.approx(want.tolist(), abs=1e-9)


@pytest.mark.parametrize("to", [500, 800, 1600, 1000])
def test_resampling_over_blocks_equals_direct_convolution(series, to):
    df, all_ = series
    got = segments.resample(df, KEYS, RATE, to, SIZE, 3).collect()
    for key, x in all_.items():
        own = sorted((r for r in got if (r["recording_id"], r["sequence"]) == key), key=lambda r: r["block_idx"])
        y = np.concatenate([r["block"] for r in own])
        up, down = to // np.gcd(to, RATE), RATE // np.gcd(to, RATE)
        if up == down:
            assert y == pytest.approx(x, abs=1e-7)
            continue
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        h = segments.low_pass(up, down)
        want = np.convolve(wide, h)[len(h) // 2 :][: len(wide)][::down]
        assert len(y) == -(-len(x) * to // RATE) and [r["block_idx"] for r in own] == list(range(len(own)))
        assert y[: len(want)] == pytest.approx(want, abs=1e-5)


def test_resampling_keeps_tones(spark):
    t = np.arange(4 * RATE) / RATE
    x = np.sin(2 * np.pi * 60 * t)
    rows = [("r", 1, b, x[b * SIZE : (b + 1) * SIZE].tolist()) for b in range(16)]
    df = spark.createDataFrame(rows, "recording_id string, sequence int, block_idx long, block array<float>")
    y = np.concatenate([r["block"] for r in segments.resample(df, KEYS, RATE, 400, SIZE, 2).orderBy("block_idx").collect()])
    want = np.sin(2 * np.pi * 60 * np.arange(len(y)) / 400)
    assert np.abs(y - want)[100:-100].max() < 2e-3
    with pytest.raises(ValueError):
        segments.resample(df, KEYS, RATE, 333, SIZE)


def test_wave_module_files(spark, tmp_path):
    x = (np.sin(np.arange(2500) / 9) * 9000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(1000)
        w.writeframes(x.tobytes())
    blocks = audio.read_wav(spark, f"file://{tmp_path}/a.wav").orderBy("block_idx").collect()
    assert np.concatenate([b["block"] for b in blocks]) == pytest.approx(x / 32768, abs=1e-7)
    assert audio.read_wav(spark, str(tmp_path)).where(F.col("block_idx") > 1).count() == 1
    assert audio.wav_durations(spark, f"{tmp_path}/*.wav").first()["duration_seconds"] == 2.5
    both = audio.at_rate(audio.read_wav(spark, str(tmp_path)), ["source_path"], 500)
    assert both.select(F.sum(F.size("block"))).first()[0] == 1250
