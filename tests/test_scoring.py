import pytest
from pyspark.sql import functions as F

from tidemark.operators import cache, golden, scoring, verdicts


def one(df):
    return df.collect()[0].asDict()


@pytest.fixture
def labels(spark):
    rows = [
        ("r", "loose", 0.0, 10.0, "tp"), ("r", "loose", 50.0, 60.0, "TP "), ("r", "loose", 80.0, 90.0, "FP"), ("r", "loose", 95.0, 96.0, ""),
        ("r", "strict", 2.0, 8.0, "TP"), ("r", None, 200.0, 210.0, "FN"),
    ]
    return spark.createDataFrame(rows, "k string, strategy string, start double, end double, verdict string")


def test_scores(labels):
    out = {r["strategy"]: r for r in scoring.score_strategies(labels, ["k"], 20.0).collect()}
    assert (out["loose"]["truths"], out["loose"]["labeled"], out["loose"]["total"]) == (3, 3, 4)
    assert out["loose"]["precision"] == pytest.approx(2 / 3) and out["loose"]["recall"] == pytest.approx(2 / 3)
    assert out["strict"]["precision"] == 1.0 and out["strict"]["recall"] == pytest.approx(1 / 3)


def test_unlabelled_strategies_have_no_ratios(labels):
    out = one(scoring.score_strategies(labels.withColumn("verdict", F.lit("")), ["k"], 20.0).where("strategy = 'loose'"))
    assert out["precision"] is None and out["recall"] is None and out["f1"] is None


def test_golden_score(spark):
    clips = spark.createDataFrame([("r", 0.0, 10.0), ("r", 20.0, 30.0), ("r", 50.0, 60.0)], "k string, start double, end double")
    events = spark.createDataFrame([("r", 10.0), ("r", 25.0), ("r", 100.0)], "k string, at double")
    s = one(scoring.golden_score(clips, events, ["k"], 20.0))
    assert (s["tp"], s["fp"], s["fn"], s["found"]) == (2, 1, 1, 2)
    none = one(scoring.golden_score(clips.limit(0), events, ["k"], 20.0))
    assert none["precision"] is None and none["recall"] == 0.0 and none["max_duration"] == 0.0 and none["mean_duration"] is None
    blob = one(scoring.golden_score(spark.createDataFrame([("r", 0.0, 1000.0)], "k string, start double, end double"), events, ["k"], 20.0))
    assert (blob["precision"], blob["recall"], blob["f1"], blob["max_duration"]) == (1.0, 1.0, 1.0, 1000.0)


def test_prior_guess(spark):
    new = spark.createDataFrame([("r", 1, 0.0, 10.0), ("r", 2, 20.0, 30.0), ("r", 3, 40.0, 50.0), ("r", 4, 60.0, 70.0)], "k string, idx int, start double, end double")
    old = spark.createDataFrame([("r", "a", 1, 5.0, 6.0, "tp", ""), ("r", "n", 1, 22.0, 23.0, "TN", "x"), ("r", "a", 2, 45.0, 55.0, "FP", ""), ("r", "n", 2, 44.0, 46.0, "FN", ""), ("r", "a", 3, 70.0, 80.0, "TP", "")], "k string, source string, idx int, start double, end double, verdict string, notes string")
    out = {r["idx"]: (r["guess"], r["guess_basis"]) for r in scoring.prior_guess(new, old, ["k"], 15.0).collect()}
    assert out == {1: ("TP", "a=TP"), 2: ("FP", "n=TN (x)"), 3: ("AMBIGUOUS", "a=FP; n=FN"), 4: ("", "no overlapping prior label")}


def test_golden_build(spark):
    points = spark.createDataFrame([("r", 105.0, "b"), ("r", 107.0, "a"), ("r", 320.0, "c")], "k string, at double, source string")
    out = sorted((round(r["at"], 3), r["sources"]) for r in golden.build_golden(points, ["k"], "at", "source", 12.0).collect())
    assert out == [(106.0, ["b", "a"]), (320.0, ["c"])]
    fn = spark.createDataFrame([(300.0, "about 20 seconds in")], "start double, notes string")
    assert one(golden.missed_times(fn, "start", "notes"))["at"] == 320.0
    with pytest.raises(Exception, match="no offset"):
        golden.missed_times(spark.createDataFrame([(300.0, "late")], "start double, notes string"), "start", "notes").collect()


def test_verdicts(spark):
    texts = ['```json\n{"is_event": true, "confidence": 0.9, "frame_index": 1, "caption": "c"}\n```', '{"is_event": true}', '{"is_event": true, "confidence": 1.5}', "nonsense", '{"is_event": "false", "confidence": 0.5}', '{"is_event": false, "confidence": 0.75}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", verdicts.parse_verdict(F.col("t")))
    assert {r["i"] for r in df.where("v is not null").collect()} == {0, 5}
    kept = df.where(verdicts.keep_confirmed(F.col("v.is_event"), F.col("v.confidence"), 0.75))
    assert {r["i"] for r in kept.collect()} == {0, 1, 2, 3, 4, 6}
    at = verdicts.scan_peak(F.lit(100.0), F.lit(112.0), F.lit(True), F.lit(0.9), F.lit(1), 3, 0.75)
    assert spark.range(1).select(at.alias("a")).first()["a"] == 106.0


def test_describe_and_judge(spark):
    d = ['{"score": 3, "caption": "a", "description": "b", "goal_this_end": true}', '{"score": 6, "caption": "a", "description": "b"}', '{"score": 3, "caption": " ", "description": "b"}']
    df = spark.createDataFrame([(x,) for x in d], "t string").select(verdicts.parse_describe(F.col("t")).alias("d"))
    assert [r["d"] is not None for r in df.collect()] == [True, False, False]
    j = ['{"agreement": "consistent", "distance_score": 0.2}', '{"agreement": "maybe", "distance_score": 0.2}', '{"agreement": "consistent", "distance_score": 2}']
    df = spark.createDataFrame([(x,) for x in j], "t string").select(verdicts.parse_judge(F.col("t")).alias("j"))
    assert [r["j"] is not None for r in df.collect()] == [True, False, False]
    flag = df.select(verdicts.is_flagged(F.col("j.agreement"), F.col("j.distance_score"), 0.5).alias("f"))
    assert [r["f"] for r in flag.collect()] == [False, True, True]


def test_frames(spark):
    got = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert got(verdicts.frame_offsets(F.lit(10.0), 5)) == [1.0, 3.0, 5.0, 7.0, 9.0]
    assert got(verdicts.frame_offsets(F.lit(0.0), 2)) == [0.0, 0.0] and got(verdicts.frame_offsets(F.lit(9.0), 0)) == []
    share = lambda ds, n: got(verdicts.allocate_frames(F.array(*[F.lit(float(d)) for d in ds]), n))
    assert share([10, 10], 5) == [2, 3] and share([1, 99], 5) == [1, 4] and share([5, 5, 5], 2) == [1, 1, 0]
    low, high = verdicts.peak_window(F.lit(0.0), F.lit(20.0), F.lit(1.0), F.lit(4.0))
    assert (got(low), got(high)) == (0.0, 3.0)


def test_cache_keeps_all_entries(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 20.0)], "idx int, start double")
    old = spark.createDataFrame([(1, 0.2, None), (2, 10.0, "b"), (3, 20.0, "c")], "idx int, start double, verdict string")
    got = cache.resume(rows, old, "idx", {"start": 0.5}, "verdict")
    assert [r["idx"] for r in cache.todo(got, "verdict").collect()] == [1]
    new = spark.createDataFrame([(1, 0.0, "a")], "idx int, start double, verdict string")
    assert sorted(r["verdict"] for r in cache.upsert(old, new, ["idx"]).collect()) == ["a", "b", "c"]
    with pytest.raises(Exception, match="cache doesn't match"):
        cache.resume(rows, old.withColumn("start", F.col("start") + 1), "idx", {"start": 0.5}, "verdict").collect()


def test_picks(spark):
    sheet = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3)], "idx int, clip_file string, v int")
    assert [r["v"] for r in cache.last_of(sheet, "clip_file", "idx").orderBy("v").collect()] == [2, 3]
    with pytest.raises(Exception, match="no such clip"):
        cache.pick(sheet, spark.createDataFrame([("z",)], "clip_file string"), "clip_file").collect()
