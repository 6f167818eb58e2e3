import json

import pytest
from pyspark.sql import functions as F

from tidemark import catalog, model
from tidemark.functions.text import clip_name, offset_seconds, safe_caption
from tidemark.sources import recordings, sinks


def test_settings(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("timeline:\n  lookback_seconds: 30\n")
    s = model.load_settings(str(p), {"TIDEMARK__DETECTION__ONSET_FLUX__MIN_SCORE": "0.7", "TIDEMARK__AUDIO__MONO": "no"}, {"detection": {"strategy": "combined"}})
    assert (s.timeline.lookback_seconds, s.detection.onset_flux.min_score, s.audio.mono, s.detection.strategy) == (30, 0.7, False, "combined")
    for bad in ({"nothing": {}}, {"timeline": {"nothing": 1}}):
        with pytest.raises(ValueError):
            model.overlay(model.Settings(), bad)
    assert model.preset(s, "strike_strict").detection.onset_flux.threshold_sigma == 2.0 and s.detection.onset_flux.threshold_sigma == 2.5


def test_settings_files(tmp_path):
    p = tmp_path / "all.yaml"
    p.write_text("input:\n  source_dir: 'd'\ndetection:\n  strategy: combined\n  rms_energy:\n    min_score_dbfs: 1.5\n  combined:\n    window_before_seconds: 3\ntimeline:\n  post_peak_seconds: 7\nreview:\n  crf: 20\n  max_negative_clip_seconds: 60\nmetadata:\n")
    s = model.load_settings(str(p), {"TIDEMARK__REVIEW__THREADS": "2", "TIDEMARK__VISION__ENABLED": "on", "OTHER": "x"})
    assert (s.input.source_dir, s.detection.rms_energy.min_score_dbfs, s.detection.combined.window_before_seconds, s.timeline.post_peak_seconds) == ("d", 1.5, 3, 7)
    assert (s.review.crf, s.review.threads, s.review.max_negative_clip_seconds, s.vision.enabled, s.export.crf) == (20, 2, 60, True, 18)
    q = tmp_path / "strategies.yaml"
    q.write_text("strategies:\n  a:\n    detection:\n      strategy: rms_energy\n      rms_energy:\n        threshold_sigma: 4\n  b:\n")
    found = model.load_presets(s, str(q))
    assert found["a"].detection.rms_energy.threshold_sigma == 4 and found["b"].detection.strategy == "combined" and s.detection.rms_energy.threshold_sigma == 3
    for bad in ({"detection": {"rms_energy": {"none": 1}}}, {"detection": 5}, {"timeline": {"post_seconds": 1}}):
        with pytest.raises(ValueError, match="there is no setting"):
            model.overlay(model.Settings(), bad)
    with pytest.raises(ValueError, match="TIDEMARK__NONE"):
        model.load_settings(None, {"TIDEMARK__NONE": "1"})


def test_presets(spark):
    assert model.preset_table(spark).count() == 6


def test_chunks_and_samples(spark, tmp_path):
    for name in ("DJI_20240101120000_0002_D.MP4", "DJI_20240101110000_0001_D.MP4", "DJI_20240101110000_0001_D.LRF", "other.MP4"):
        (tmp_path / name).write_bytes(b"x")
    found = recordings.discover(spark, str(tmp_path)).orderBy("sequence").collect()
    assert [(r["sequence"], r["proxy_path"] is not None) for r in found] == [(1, True), (2, False)]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "x.txt").write_text("")
        recordings.discover(spark, str(tmp_path / "none"))


def test_proxies_of_one_name_give_one_chunk(spark):
    a, b = "r/DJI_20240101110000_0001_D", "r/DJI_20240101120000_0002_D"
    listed = spark.createDataFrame([(x,) for x in (a + ".MP4", a + ".MP4", a + ".LRF", a + ".LRF", b + ".MP4", b + ".lrf", b + ".LRF")], "path string")
    found = sorted((r["source_path"], r["proxy_path"]) for r in recordings.chunks_of(listed).collect())
    assert found == [(a + ".MP4", a + ".LRF")] * 2 + [(b + ".MP4", b + ".LRF")]


def test_sheets_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("loose", 1, 1.0, 2.5, 0.123456), ("loose", 1000, 5.0, 6.0, None)], "strategy string, idx long, start double, end double, max_value double")
    sinks.write_csv(sinks.review_sheet(rows, ["strategy"]).drop("strategy"), str(tmp_path / "loose/sheet.csv"))
    got = recordings.read_sheets(spark, str(tmp_path / "loose/sheet.csv")).orderBy("start_seconds").collect()
    assert [(r["clip_file"], r["max_peak_score"], r["verdict"]) for r in got] == [("clip_001.mp4", 0.1235, ""), ("clip_1000.mp4", 0.0, "")]
    bom = tmp_path / "strict"
    bom.mkdir()
    (bom / "review_sheet.csv").write_text("﻿clip_file,start_seconds,verdict,notes\nclip_001.mp4,3.5,tp,\"a, b\"\n", encoding="utf-8")
    r = recordings.read_sheets(spark, str(bom / "review_sheet.csv")).first()
    assert (r["strategy"], r["clip_file"], r["notes"], r["start_seconds"]) == ("strict", "clip_001.mp4", "a, b", 3.5)


def test_events_json(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1/events.json").write_text(json.dumps([{"start_seconds": 1.0, "end_seconds": 2.0, "duration_seconds": 1.0, "peaks": [{"time_seconds": 1.5, "score": 0.3}]}, {"start_seconds": 4.0, "end_seconds": 9.0, "duration_seconds": 5.0, "peaks": []}], indent=1))
    got = recordings.read_events_json(spark, str(tmp_path / "*/events.json")).orderBy("idx").collect()
    assert [(r["strategy"], r["idx"], r["end_seconds"], len(r["peaks"])) for r in got] == [("s1", 1, 2.0, 1), ("s1", 2, 9.0, 0)]


def test_empty_cache(spark, tmp_path):
    assert recordings.read_or_empty(spark, str(tmp_path / "none"), model.SENT).count() == 0


def test_text(spark):
    got = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert got(safe_caption(F.lit('a<b>: "c"\n  d / e'))) == "ab c d e"
    assert len(got(safe_caption(F.lit("x" * 200)))) == 80 and got(safe_caption(F.lit(" . "))) == "highlight" and got(safe_caption(F.lit(None).cast("string"))) == "highlight"
    assert got(clip_name(F.lit(1000))) == "clip_1000.mp4" and got(offset_seconds(F.lit("none"))) is None


def test_every_query_runs_and_most_have_sql(spark):
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 40
    out = catalog.QUERIES["golden_score"](spark, "/root/testdata/sf0.001")
    assert out.count() > 0


def test_sessions_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.sessions import session_intervals, stream_intervals

    ev = spark.createDataFrame([("a", t) for t in (0, 10, 21, 300)] + [("b", 5)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    args = (["k"], "ts", 6_000_000, 4_000_000, 0)
    batch = session_intervals(ev, *args)
    assert sorted((r["k"], r["n"]) for r in batch.collect()) == [("a", 1), ("a", 1), ("a", 2), ("b", 1)]
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = stream_intervals(stream, *args, "1 second", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    closed = sorted((r["k"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert closed == [("a", 1), ("a", 2), ("b", 1)]  # the last session is still open
