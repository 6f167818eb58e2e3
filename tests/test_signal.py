import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.model import Settings, overlay
from tidemark.operators import signal
from tidemark.plans import pipelines


def recording(spark, chunks, rate=2000, seed=4):
    """Chunks of noise with bursts at the given seconds."""
    rng, rows = np.random.default_rng(seed), []
    for k, (seconds, bursts) in enumerate(chunks, 1):
        x = rng.normal(0, 0.01, seconds * rate)
        for b in bursts:
            x[int(b * rate) : int((b + 0.3) * rate)] = rng.normal(0, 0.5, int(0.3 * rate))
        rows += [("r", k, i, x[i * rate : (i + 1) * rate].astype("f4").tolist()) for i in range(seconds)]
    samples = spark.createDataFrame(rows, "recording_id string, sequence int, block_idx long, block array<float>")
    starts = np.cumsum([0] + [float(s) for s, _ in chunks])
    table = spark.createDataFrame([("r", k, float(s), float(starts[k - 1])) for k, (s, _) in enumerate(chunks, 1)], "recording_id string, sequence int, duration_seconds double, global_start_seconds double")
    return samples, table


def settings(**sections):
    return overlay(Settings(), {"audio": {"sample_rate": 2000}, **sections})


def test_rolling_forms_agree(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, i, float(v)) for k in range(3) for i, v in enumerate(rng.random(40 + k))], "k int, i int, v double")
    a = signal.rolling_threshold(df, ["k"], ["i"], "v", 11, 2.0).orderBy("k", "i").collect()
    b = signal.rolling_threshold_sql(df, ["k"], ["i"], "v", 11, 2.0).orderBy("k", "i").collect()
    for x, y in zip(a, b, strict=True):
        assert x["threshold"] == pytest.approx(y["threshold"], abs=1e-12)


def test_rolling_median_edges():
    v = np.array([5.0, 1.0, 2.0, 9.0, 3.0])
    want = [np.median(np.pad(v, 2, mode="edge")[i : i + 5]) for i in range(5)]
    assert signal.rolling_median(v, 5).tolist() == want
    assert signal.odd_size(30, 0.01) == 3001 and signal.odd_size(0.1, 0.1) == 3


def test_frames_leave_out_the_rest(spark):
    df = spark.createDataFrame([(1, [1.0] * 10), (2, [1.0] * 3)], "k int, block array<float>")
    out = signal.frame_rms(df, ["k"], "block", 4, 3)
    assert [(r["k"], r["frame_idx"], round(r["rms"], 6)) for r in out.collect()] == [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0)]


def test_bursts_are_found(spark):
    samples, chunks = recording(spark, [(90, [20, 40, 70])])
    s = settings(detection={"strategy": "rms_energy"})
    times = [r["t"] for r in pipelines.chunk_peaks(samples, s).orderBy("t").collect()]
    assert times == [r["t"] for r in pipelines.chunk_peaks(samples, s, rows_per_range=50).orderBy("t").collect()]
    assert len(times) == 3 and all(abs(t - b) < 0.6 for t, b in zip(times, [20, 40, 70]))
    flux = settings(detection={"strategy": "onset_flux", "onset_flux": {"min_score": 0.3}})
    times = [r["t"] for r in pipelines.chunk_peaks(samples, flux).orderBy("t").collect()]
    assert {b for b in (20, 40, 70) for t in times if abs(t - b) < 1} == {20, 40, 70}


def test_quiet_gives_nothing(spark):
    samples, _ = recording(spark, [(30, [])])
    assert pipelines.chunk_peaks(samples, settings(detection={"strategy": "rms_energy"})).count() == 0


def test_detect_over_two_chunks_and_warmup(spark):
    samples, chunks = recording(spark, [(60, [5, 20]), (60, [10])])
    s = settings(detection={"strategy": "rms_energy"}, timeline={"lookback_seconds": 5, "post_peak_seconds": 5, "min_gap_seconds": 5, "min_interval_seconds": 1, "warmup_seconds": 10})
    starts = [r["start"] for r in pipelines.detect(samples, chunks, s).orderBy("start").collect()]
    assert len(starts) == 2 and abs(starts[0] - 15) < 1 and abs(starts[1] - 65) < 1


def test_batch_review_covers_the_rest(spark):
    samples, chunks = recording(spark, [(90, [30, 60])])
    found, negatives = pipelines.batch_review(samples, chunks, settings(), ["crowd_loose", "crowd_strict"])
    assert {r["strategy"] for r in found.select("strategy").distinct().collect()} == {"crowd_loose", "crowd_strict"}
    assert negatives.agg(F.max("end")).first()[0] == 90.0
    clips = pipelines.render(found.where("strategy = 'crowd_loose'").withColumn("source", F.lit("x")), chunks.withColumns({"source_path": F.lit("f"), "proxy_path": F.lit(None).cast("string")}))
    assert clips.count() == 2
