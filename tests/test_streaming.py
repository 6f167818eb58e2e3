import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import peaks, signal
from tidemark.streaming.signals import Trace, stream_peaks, write_peaks

SCHEMA = "rec string, frame_idx long, t double, value double"


def values(n, seed):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(0, 1, n) + 3 * (rng.random(n) < 0.15).cumsum() % 7, 1)


@pytest.mark.parametrize("n,size,step", [(1, 3, 1), (40, 11, 1), (200, 11, 7), (200, 31, 50), (9, 31, 4), (150, 5, 150)])
def test_any_cut_gives_the_same_peaks(n, size, step):
    v = values(n, n + size)
    mask = lambda x, threshold: x - threshold >= 0.2
    base = signal.rolling_median(v, size)
    threshold = base + 1.0 * signal.rolling_median(np.abs(v - base), size) * signal.MAD_SCALE
    inside, want, i = mask(v, threshold), [], 0
    while i < n:
        j = i
        while j < n and inside[j]:
            j += 1
        if j > i:
            best = i + int(np.argmax(v[i:j]))
            want.append((len(want) + 1, best, float(v[best]), j - i))
        i = max(j, i + 1)
    rng = np.random.default_rng(n)
    for order in (np.arange(n), rng.permutation(n), np.append(rng.permutation(n), [0, n - 1])):
        trace, got = Trace(size, 1.0, mask), []
        for lo in range(0, len(order), step):
            idx = order[lo : lo + step]
            trace.add(idx, idx / 10, v[idx])
            got += trace.peaks()
            assert len(trace.v) <= 4 * (size // 2) + step
        trace.total = n
        got += trace.peaks() + trace.peaks()
        assert [(r[0], r[1], r[3], r[6]) for r in got] == want


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, i, i / 10, float(x)) for k, seed, n in (("a", 1, 400), ("b", 2, 90), ("c", 3, 12)) for i, x in enumerate(values(n, seed))]
    ends = [("a", 400, None, None), ("b", 90, None, None), ("c", 12, None, None)]
    rng = np.random.default_rng(0)
    rows = [rows[i] for i in rng.permutation(len(rows))] + ends
    batch = signal.rolling_threshold(spark.createDataFrame(rows, SCHEMA).where("value is not null"), ["rec"], ["frame_idx"], "value", 21, 1.0, index="frame_idx")
    want = peaks.run_apexes(batch, ["rec"], ["frame_idx"], peaks.rms_mask("value", "threshold", 0.2, 0.5), "value", "threshold")
    key = lambda df: sorted((r["rec"], r["run"], r["frame_idx"], r["t"], r["value"], round(r["score"], 9), r["run_length"]) for r in df.collect())
    folder, out = tmp_path / "frames", str(tmp_path / "peaks")
    for k in range(4):  # files that arrive one after the other, each a batch
        spark.createDataFrame(rows[k::4], SCHEMA).coalesce(1).write.parquet(str(folder / f"part={k}"))
        arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        q = write_peaks(stream_peaks(arriving.select("rec", "frame_idx", "t", "value"), ["rec"], 21, 1.0, 0.2, 0.5), out, str(tmp_path / "checkpoint"))
        assert q.awaitTermination(120) and q.exception() is None
    got = spark.read.parquet(out)
    assert key(got) == key(want) and len(key(want)) > 20
    assert got.select(F.countDistinct("rec", "run")).first()[0] == got.count()


def test_arriving_files_equal_the_batch(spark, tmp_path):
    import wave

    from tidemark.model import Settings, overlay
    from tidemark.plans import pipelines
    from tidemark.sources import audio
    from tidemark.streaming.chunks import arriving_peaks

    rate, folder, hidden = 2000, tmp_path / "recording", tmp_path / "hidden"
    folder.mkdir(), hidden.mkdir()
    settings = overlay(Settings(), {"audio": {"sample_rate": rate}, "detection": {"strategy": "rms_energy", "rms_energy": {"threshold_sigma": 1.0, "min_score_dbfs": 0.5, "baseline_window_seconds": 5.0}}})
    rng, rows = np.random.default_rng(4), []
    for k, seconds in ((1, 90), (2, 33), (3, 0.2)):
        n = int(seconds * rate)
        x = (rng.normal(0, 0.05, n) * (1 + 3 * (np.arange(n) // 600 % 17 == 8))).clip(-1, 1)  # a burst every five seconds
        name = f"DJI_2024010112000{k}_000{k}_D.wav"
        with wave.open(str(hidden / name), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes((x * 32767).astype("<i2").tobytes())
        (hidden / "other.wav").write_bytes(b"")
        (hidden / name).rename(folder / name)
        q = write_peaks(arriving_peaks(spark, f"file://{folder}", settings), str(tmp_path / "peaks"), str(tmp_path / "checkpoint"))
        assert q.awaitTermination(120) and q.exception() is None
    samples = audio.read_wav(spark, str(folder)).withColumn("sequence", F.regexp_extract("source_path", r"_(\d+)_D", 1).cast("int")).withColumn("recording_id", F.lit("r"))
    want = sorted((r["sequence"], round(r["t"], 6), round(r["score"], 6)) for r in pipelines.chunk_peaks(samples, settings).collect())
    got = sorted((r["sequence"], round(r["t"], 6), round(r["score"], 6)) for r in spark.read.parquet(str(tmp_path / "peaks")).collect())
    assert got == want and len(want) > 10 and {s for s, _, _ in want} == {1, 2}
