"""The commands on files and on frames, with stand-ins for models."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.model import VERDICT_CACHE, Settings
from tidemark.operators import verdicts
from tidemark.plans import pipelines
from tidemark.sources import recordings

RATE = 2000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A recording of two chunks with bursts, settings for it, and replies."""
    top, rng = tmp_path_factory.mktemp("recording"), np.random.default_rng(3)
    for k, bursts in ((1, (20, 45)), (2, (30,))):
        x = rng.normal(0, 0.01, 60 * RATE)
        for b in bursts:
            x[b * RATE : b * RATE + 600] = rng.normal(0, 0.5, 600)
        with wave.open(str(top / f"DJI_2024010112000{k}_000{k}_D.WAV"), "wb") as w:
            w.setnchannels(2), w.setsampwidth(2), w.setframerate(RATE)
            w.writeframes(np.repeat((x.clip(-1, 1) * 32767).astype("<i2"), 2).tobytes())
    config = top.parent / "settings.yaml"
    config.write_text("audio:\n  sample_rate: 2000\ndetection:\n  strategy: rms_energy\n  rms_energy:\n    min_score_dbfs: 3.5\ntimeline:\n  min_interval_seconds: 1\n")
    said = top.parent / "replies.json"
    said.write_text("\n".join(json.dumps({"clip_file": f"clip_00{k}.mp4", "reply": r}) for k, r in ((1, '{"is_event": false, "confidence": 0.9}'), (2, '{"is_event": true, "confidence": "0.8", "caption": "a/b"}'))))
    gold = top.parent / "golden.json"
    gold.write_text(json.dumps([{"time_seconds": 45.0, "sources": ["x"]}, {"time_seconds": 90.0, "sources": []}, {"time_seconds": 119.0, "sources": []}], indent=1))
    return str(top), str(config), str(said), str(gold), str(top.parent / "out")


def command(spark, folder, *rest):
    return cli.run(spark, cli.parser().parse_args(["--config", folder[1], "--source-dir", folder[0], "--out", folder[4], *rest]))


def test_written_commands_are_read_back(spark, folder, tmp_path):
    out = str(tmp_path / "written")
    for name in ("detect", "batch-review", "review-sheet"):
        args = cli.parser().parse_args(["--config", folder[1], "--source-dir", folder[0], "--out", out, name])
        for key, frame in cli.run(spark, args).items():
            cli.write(key, frame, f"{out}/{name}/{key}")
    events = recordings.read_events_json(spark, f"{out}/detect/events/*/events.json")
    assert [(r["idx"], len(r["peaks"])) for r in events.orderBy("idx").collect()] == [(1, 1), (2, 1), (3, 1)]
    sheet = recordings.read_review_root(spark, f"{out}/review-sheet/sheet")
    assert [r["start_seconds"] for r in sheet.orderBy("idx").collect()] == [r["start_seconds"] for r in events.orderBy("idx").collect()]
    by = {r["strategy"]: r["n"] for r in recordings.read_events_json(spark, f"{out}/batch-review/events/*/*/events.json").groupBy("strategy").agg(F.count("*").alias("n")).collect()}
    assert by["crowd_loose"] == 3


def test_comparisons_go_on_from_the_cache(spark, folder, tmp_path):
    cache, none = ["--cache", str(tmp_path / "cache")], tmp_path / "none.json"
    none.write_text("")
    full = command(spark, folder, *cache, "vision-compare", "--golden", folder[3], "--replies", folder[2])["sweep"].collect()
    again = command(spark, folder, *cache, "vision-compare", "--golden", folder[3], "--replies", str(none))["sweep"].collect()  # nothing is told now
    assert full == again
    fresh = command(spark, folder, "--cache", str(tmp_path / "other"), "vision-compare", "--golden", folder[3], "--replies", str(none))["sweep"].collect()
    assert fresh != full


def test_detect_and_render(spark, folder):
    events = command(spark, folder, "detect")["events"].orderBy("idx").collect()
    assert [round(r["peaks"][0]["time_seconds"]) for r in events] == [20, 45, 90] or len(events) == 3
    clips = command(spark, folder, "render")["clips"].collect()
    assert len(clips) == 3 and all(p["duration"] > 0 for r in clips for p in r["parts"])
    full = command(spark, folder, "export")["clips"].collect()
    assert {r["encode"]["crf"] for r in full} == {18}
    assert command(spark, folder, "review-sheet")["sheet"].count() == 3


def test_model_commands(spark, folder):
    out = command(spark, folder, "vision-highlights", "--replies", folder[2])
    assert [(r["kept"], r["path"].startswith("pruned/")) for r in out["clips"].orderBy("idx").collect()] == [(False, True), (True, False), (True, False)]
    assert out["log"].count() == 3
    sheet = command(spark, folder, "pre-label")["sheet"].collect()
    assert len(sheet) == 3 and {(r["verdict"], r["ai_score"]) for r in sheet} == {("", "")}
    lines = [r["line"] for r in command(spark, folder, "golden-score", "--golden", folder[3], "--replies", folder[2])["golden"].collect()]
    assert lines[0] == "clips=3  TP=2  FP=1  FN=1" and lines[3] == "clips=2  TP=2  FP=0  FN=1"
    table = command(spark, folder, "vision-compare", "--golden", folder[3], "--replies", folder[2])["sweep"].collect()
    assert table[0]["line"].startswith(" threshold      kept") and len(table) == 9


def test_sheets_commands(spark, folder, tmp_path):
    for name, rows in (("loose", "clip_001.mp4,1,9,TP,\nclip_002.mp4,20,25,FN,\nclip_003.mp4,30,35,,"), ("negatives", "clip_001.mp4,60,70,FN,at 3 sec\nclip_002.mp4,80,90,,")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "review_sheet.csv").write_text("clip_file,start_seconds,end_seconds,verdict,notes\n" + rows + "\n")
    sheets = str(tmp_path / "*/review_sheet.csv")
    out = command(spark, folder, "score", "--sheets", sheets)
    r = out["scores"].first()
    assert (r["strategy"], r["total"], r["labeled"], r["tp"], r["truths"], r["recall"]) == ("loose", 3, 1, 1, 2, 0.5)
    assert out["report"].first()["line"].endswith(": 2") and out["report"].count() == 5
    one = str(tmp_path / "loose/review_sheet.csv")
    assert [r["clip_file"] for r in command(spark, folder, "export-picks", "--sheet", one, "--clips", "clip_002.mp4")["picks"].collect()] == ["clip_002.mp4"]
    sent = tmp_path / "sent.json"
    sent.write_text('{"clip_001.mp4": {"message_id": 5, "sent_at": "now"}}')
    posts = command(spark, folder, "telegram-post", "--sheet", one, "--clips", "clip_001.mp4", "clip_003.mp4", "--done", str(sent))["posts"].collect()
    assert [(r["clip_file"], r["action"]) for r in posts] == [("clip_003.mp4", "send")]
    audit = command(spark, folder, "label-audit", "--sheets", one)
    assert audit["audit"].count() == 2 and {r["agreement"] for r in audit["flagged"].collect()} == {""}  # nothing is judged, so all is flagged


def test_label_audit_and_describe_only(spark):
    rows = spark.createDataFrame([(i, "s", f"clip_{i:03d}.mp4", "TP", None, 0.0, 1.0) for i in range(4)], "idx long, strategy string, clip_file string, verdict string, notes string, start double, end double")
    asked = []

    def describe(frame):
        asked.append(frame.count())
        return frame.withColumn("describe", verdicts.parse_describe(F.lit('{"score": 2, "caption": "c", "description": "d"}')))

    def judge(frame):
        return frame.withColumn("judge", verdicts.parse_judge(F.when(F.col("idx") == 2, '{"agreement": "ai_likely_wrong", "distance_score": 0.9}').otherwise('{"agreement": "consistent", "distance_score": 0.1}')))

    empty = rows.limit(0).select("idx", "strategy", "clip_file").withColumn("describe", verdicts.parse_describe(F.lit("")))
    every, fresh = pipelines.describe_only(rows, empty, describe)
    assert every.count() == fresh.count() == 4 and asked[0] == 4
    again, _ = pipelines.describe_only(rows, fresh.where("idx < 3"), describe)
    assert asked[-1] == 1 and again.where("describe.score = 2").count() == 4
    cached = fresh.withColumn("judge", verdicts.parse_judge(F.lit("")))
    audited, flagged = pipelines.label_audit(rows, cached, describe, judge, Settings())
    assert [r["idx"] for r in flagged.collect()] == [2] and audited.first()["idx"] == 2 and audited.count() == 4


def test_vision_compare_asks_only_for_what_is_missing(spark):
    found = spark.createDataFrame([("r", 1, 0.0, 10.0), ("r", 2, 20.0, 30.0)], "recording_id string, idx long, start double, end double")
    cached = spark.createDataFrame([(1, 0.0, 10.0, (True, 0.9, None, "", ""))], VERDICT_CACHE)
    asked = []

    def classify(frame):
        asked.append(frame.count())
        return frame.withColumn("verdict", verdicts.parse_verdict(F.lit('{"is_event": false, "confidence": 0.6}')))

    gold = spark.createDataFrame([("r", 5.0)], "recording_id string, at double")
    table, fresh = pipelines.vision_compare(found, cached, classify, gold, ["recording_id"])
    kept = {r["threshold"]: r["kept"] for r in table.collect()}
    assert asked == [1] and kept[0.6] == 1 and kept[0.65] == 2 and fresh.count() == 2


def test_vision_compare_of_long_microseconds_fills_few_buckets(spark, tmp_path, monkeypatch):
    from tidemark import catalog
    from tidemark.operators import ranges

    start = "timestamp_ntz '2024-01-03 00:00:00'"
    events = spark.range(24).selectExpr("id as event_id", f"{start} + make_interval(0, 0, 0, 0, cast(id div 2 * 30 as int), 0, 0) as ts", "0L as user_id", "if(id % 2 = 0, 'error', 'purchase') as event_type", "1.0D as value", "'' as props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    bucketed, listed = ranges.bucketed, []
    monkeypatch.setattr(ranges, "bucketed", lambda intervals, *args, **named: listed.append((intervals, bucketed(intervals, *args, **named))) or listed[-1][1])
    table = catalog.QUERIES["vision_compare"](spark, str(tmp_path))
    assert len(listed) == 2
    for intervals, rows in listed:
        assert 0 < rows.count() <= (ranges.FACTOR + 1) * intervals.count()
    assert {(r["total"], r["found"]) for r in table.where("threshold > 1").collect()} == {(12, 12)}


def test_scan_events_without_a_frame_keep_their_verdict(spark):
    v = spark.range(1).select(verdicts.parse_verdict(F.lit('{"is_event": true, "confidence": 0.9}'), True).alias("v"))
    at = verdicts.scan_peak(F.lit(0.0), F.lit(5.0), F.col("v.is_event"), F.col("v.confidence"), F.col("v.frame_index"), 5, 0.75)
    assert v.select(F.col("v").isNotNull().alias("v"), at.alias("at")).first()[:] == (True, None)


def test_retries():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    assert pipelines.with_retries(flaky, 2)(7) == 7 and len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        pipelines.with_retries(lambda: 1 / 0, 1)()


def test_short_inputs_and_small_rates(spark):
    s = Settings()
    s.audio.sample_rate = 50
    samples = spark.createDataFrame([("r", 1, 0, [0.1, -0.1])], "recording_id string, sequence int, block_idx long, block array<float>")
    assert pipelines.flux_trace(samples, s).count() >= 0 and pipelines.rms_trace(samples, s).count() == 0


def test_sources_of_sessions(spark, folder, tmp_path):
    sent = tmp_path / "s.json"
    sent.write_text('{"a": {"message_id": 1, "sent_at": "t"}}')
    assert recordings.read_sent(spark, str(sent)).first()[:] == ("a", 1, "t")
    assert [r["at"] for r in recordings.read_golden(spark, folder[3]).orderBy("at").collect()] == [45.0, 90.0, 119.0]
