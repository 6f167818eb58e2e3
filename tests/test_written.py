import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.numbers import half_even
from tidemark.plans import pipelines
from tidemark.sources import recordings, sinks


def test_half_even_is_as_python_rounds(spark):
    rng = random.Random(3)
    values = [2.675, 1.005, 0.125, 0.375, -0.125, 2.5, -2.675, 0.0, 1e300, 123456.785, 1.115] + [rng.randrange(10**7) / 1000 for _ in range(3000)] + [rng.uniform(-1e4, 1e4) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3, 4):
        got = [r["r"] for r in df.select(half_even(F.col("v"), digits).alias("r")).collect()]
        assert got == [round(v, digits) for v in values]
    assert spark.range(1).select(half_even(F.lit(None), 2).alias("r")).first()["r"] is None


@pytest.fixture(scope="module")
def found(spark):
    peaks = F.expr("transform(sequence(1, cast(idx % 3 as int) + 1), i -> struct(start + i as time_seconds, i / 8.0D as score))")
    rows = spark.range(600).selectExpr("cast(id % 7 as string) AS n", "id DIV 7 + 1 AS idx", "CAST(id AS double) AS start", "id + 3.5D AS end")
    return rows.withColumn("strategy", F.concat(F.lit("s"), "n")).withColumn("peaks", peaks).drop("n").repartition(5)


def test_events_written_are_read_back(spark, found, tmp_path):
    root = str(tmp_path / "review")
    for _ in range(2):  # a second time in their place
        sinks.write_events(sinks.events_json(found, keys=("strategy", "idx")), root, F.col("strategy"))
    got = recordings.read_events_json(spark, f"{root}/*/events.json")
    want = sinks.events_json(found, keys=("strategy", "idx"))
    key = lambda df: sorted((r["strategy"], r["idx"], r["start_seconds"], r["end_seconds"], r["duration_seconds"], tuple(map(tuple, r["peaks"]))) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 600
    assert sorted(p.name for p in (tmp_path / "review").iterdir()) == [f"s{i}" for i in range(7)]  # nothing temporary is left


def test_sheets_written_are_read_back(spark, found, tmp_path):
    root = str(tmp_path / "sheets")
    notes = F.when(F.col("idx") == 1, 'a "b", c\nd').otherwise(F.lit(""))
    sheet = sinks.review_sheet(found.withColumn("max_value", F.lit(0.25)), ["strategy"]).withColumn("notes", F.when(F.col("clip_file") == "clip_001.mp4", F.lit('a "b", c\nd')).otherwise(F.lit("")))
    sinks.write_sheets(sheet, f"file://{root}", F.col("strategy"))
    (tmp_path / "sheets" / "bare").mkdir()
    (tmp_path / "sheets" / "other").mkdir()
    (tmp_path / "sheets" / "other" / "review_sheet.csv").write_bytes("﻿verdict,clip_file,mine,start_seconds\r\ntp,clip_001.mp4,x,4.5\r\nfn,clip_002.mp4,y,none\r\n".encode())
    got = recordings.read_review_root(spark, root)
    rows = {(r["strategy"], r["idx"]): r for r in got.collect()}
    assert len(rows) == 602 and notes is not None
    assert rows["s0", 1]["notes"] == 'a "b", c\nd' and rows["s0", 10]["clip_file"] == "clip_010.mp4" and rows["s3", 2]["start_seconds"] == 10.0
    assert (rows["other", 1]["verdict"], rows["other", 1]["start_seconds"], rows["other", 1]["extra"], rows["other", 1]["end_seconds"], rows["other", 2]["start_seconds"]) == ("tp", 4.5, {"mine": "x"}, None, None)
    sinks.write_events(sinks.events_json(found, keys=("strategy", "idx")), root, F.col("strategy"))
    events = recordings.read_events_json(spark, f"{root}/*/events.json")
    both = recordings.with_events(got.where("strategy != 'other'"), events)
    assert both.count() == 600 and both.where("size(peaks) != idx % 3 + 1").count() == 0
    with pytest.raises(Exception, match="no event for"):
        recordings.with_events(got, events).collect()


def test_reference_events_of_a_review_root(spark, tmp_path):
    """Directories with blanks and signs, without either file, with sheets longer or shorter than their events."""
    head = "clip_file,start_seconds,end_seconds,verdict,notes\n"

    def directory(name, rows, events):
        (tmp_path / name).mkdir()
        if rows is not None:
            lines = [f"clip_{i:03d}.mp4,{s},{s + 11},{v},{n}\n" for i, (s, v, n) in enumerate(rows, 1)]
            (tmp_path / name / "review_sheet.csv").write_text(head + "".join(lines))
        if events is not None:
            shown = [{"start_seconds": s, "end_seconds": s + 11, "duration_seconds": 11, "peaks": [{"time_seconds": t, "score": v} for t, v in peaks]} for s, peaks in events]
            (tmp_path / name / "events.json").write_text(json.dumps(shown))

    assert pipelines.golden_of_root(spark, str(tmp_path)).collect() == []
    directory("loud 50%25 + ä", [(100.0, " tp ", ""), (200.0, "FP", ""), (500.0, "TP", ""), (700.0, "TP", "")], [(100.0, [(104.0, 1.0), (105.5, 2.0), (107.0, 2.0)]), (200.0, [(201.0, 9.0)]), (500.0, [])])
    directory("crowd", [(101.0, "TP", "")], [(101.0, [(106.5, 1.0)]), (600.0, [(601.0, 1.0)])])
    directory("no events", [(800.0, "TP", "")], None)
    directory("no sheet", None, [(900.0, [(901.0, 1.0)])])
    directory("negatives", [(300.0, "fn", "20 seconds in there was a shot"), (400.0, "TN", "")], [(300.0, [(301.0, 1.0)])])
    got = [(r["at"], r["sources"]) for r in pipelines.golden_of_root(spark, str(tmp_path)).collect()]
    assert got == [(106.0, ["loud 50%25 + ä/clip_001.mp4", "crowd/clip_001.mp4"]), (320.0, ["negatives/clip_001.mp4"])]
    both = recordings.paired(recordings.read_review_root(spark, str(tmp_path)), recordings.read_root_events(spark, str(tmp_path)))
    assert sorted((r["strategy"], r["idx"], len(r["peaks"])) for r in both.collect()) == [("crowd", 1, 1), ("loud 50%25 + ä", 1, 3), ("loud 50%25 + ä", 2, 1), ("loud 50%25 + ä", 3, 0), ("negatives", 1, 1)]
    sheets = recordings.read_sheets(spark, f"{tmp_path}/*/review_sheet.csv")
    assert {r["strategy"] for r in sheets.collect()} == {"crowd", "loud 50%25 + ä", "negatives", "no events"}


def test_lines_instead_of_an_array_are_an_error(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "events.json").write_text('{"start_seconds": 1.0}\n{"start_seconds": 2.0}\n')
    with pytest.raises(Exception, match="not one array"):
        recordings.read_events_json(spark, str(tmp_path / "s" / "events.json")).collect()
    (tmp_path / "s" / "events.json").write_text("[]\n")
    assert recordings.read_events_json(spark, str(tmp_path / "s" / "events.json")).count() == 0


def test_a_failed_write_leaves_the_old_file(spark, found, tmp_path):
    root = str(tmp_path / "kept")
    one = sinks.events_json(found.where("strategy = 's1'"), keys=("strategy", "idx"))
    sinks.write_events(one, root, F.col("strategy"))
    before = (tmp_path / "kept" / "s1" / "events.json").read_text()
    bad = one.withColumn("start_seconds", F.when(F.col("idx") == 50, F.raise_error(F.lit("lost"))).otherwise(0.0).cast("double"))
    with pytest.raises(Exception):
        sinks.write_events(bad, root, F.col("strategy"))
    assert (tmp_path / "kept" / "s1" / "events.json").read_text() == before and [p.name for p in (tmp_path / "kept").iterdir()] == ["s1"]


def test_cached_files_of_one_name_give_one_chunk(spark):
    chunks = spark.createDataFrame([("r", "d/a.LRF"), ("r", None)], "recording_id string, proxy_path string")
    cached = spark.createDataFrame([("x/a.LRF",), ("y/a.LRF",)], "path string")
    assert sorted(r["proxy_path"] or "" for r in recordings.redirect_proxies(chunks, cached).collect()) == ["", "x/a.LRF"]


def test_sheets_of_all_directories(spark, found, tmp_path):
    from tidemark import cli
    from tidemark.plans import pipelines

    root, out = str(tmp_path / "root"), str(tmp_path / "out")
    sinks.write_events(sinks.events_json(found, keys=("strategy", "idx")), root, F.col("strategy"))
    (tmp_path / "root" / "bare").mkdir()
    prior = tmp_path / "prior" / "old"
    prior.mkdir(parents=True)
    prior.joinpath("review_sheet.csv").write_text("clip_file,start_seconds,end_seconds,verdict,notes\nclip_001.mp4,6,7.5,tp,\nclip_002.mp4,20,30,fp,dull\nclip_003.mp4,21,22,fn,\n")
    cli.main(["--out", out, "review-sheet", "--root", root, "--prior-root", str(tmp_path / "prior")])
    rows = {(r["strategy"], r["idx"]): r for r in recordings.read_review_root(spark, root).collect()}
    assert len(rows) == 600 and not (tmp_path / "root" / "bare" / "review_sheet.csv").exists()
    assert (rows["s6", 1]["start_seconds"], rows["s6", 1]["guess"], rows["s6", 1]["guess_basis"]) == (6.0, "TP", "old=TP")
    assert (rows["s0", 4]["start_seconds"], rows["s0", 4]["guess"], rows["s0", 4]["guess_basis"]) == (21.0, "AMBIGUOUS", "old=FP (dull); old=FN")
    assert rows["s5", 9]["guess_basis"] == "no overlapping prior label" and rows["s0", 1]["verdict"] == ""
    plain = pipelines.all_review_sheets(recordings.read_events_json(spark, f"{root}/*/events.json"))
    assert "guess" not in plain.columns and plain.count() == 600


def test_manifests_of_parts(spark):
    part = "array<struct<sequence: int, source: string, local_start: double, duration: double>>"
    clips = spark.createDataFrame([("r", 1, [(1, "a", 5.0, 10.0)], "clip_001.mp4"), ("r", 2, [(1, "it's", 50.0, 9.0), (2, "b", 0.0, 1.0)], "it's.mp4"), ("r", 3, [(1, "c", 0.0, 0.0)], "clip_003.mp4")], f"rec string, idx long, parts {part}, clip_file string")
    got = {r["idx"]: r for r in sinks.join_manifest(clips, True).collect()}
    assert (got[1]["join_by"], got[1]["part_files"], got[1]["file_list"]) == ("rename", ["clip_001.mp4"], None)
    assert (got[2]["join_by"], got[2]["file_list"]) == ("reencode", "file 'it'\\''s_part0.mp4'\nfile 'it'\\''s_part1.mp4'\n")
    stills = sinks.frame_manifest(clips, ["rec"], 4, 320).orderBy("idx", "frame").collect()
    assert [(r["idx"], r["file"], r["source"], r["at"]) for r in stills] == [(1, f"frame_00{i}.jpg", "a", 5 + 2.5 * (i + 0.5)) for i in range(4)] + [(2, "frame_000.jpg", "it's", 51.125), (2, "frame_001.jpg", "it's", 53.375), (2, "frame_002.jpg", "it's", 55.625), (2, "frame_003.jpg", "it's", 57.875)]
    assert sinks.frame_manifest(clips, ["rec"], 0, 320).count() == 0
