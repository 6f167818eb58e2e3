"""Model verdicts: reading their JSON, deciding by them, and the frames they look at.

String booleans in JSON are invalid here (they don't become true by being non-empty).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VERDICT = "is_event boolean, confidence string, frame_index int, rationale string, caption string"
_DESCRIBE = "score double, caption string, description string, rationale string, goal_this_end boolean"
_JUDGE = "agreement string, distance_score double, rationale string"
#: What a judge may say of a label.
AGREEMENTS = ("consistent", "ai_likely_wrong", "human_likely_wrong", "ambiguous")


def unfenced(text: Column) -> Column:
    """The text without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def parse_verdict(text: Column, scan: bool = False) -> Column:
    """A verdict, or null if malformed. A number may be written as text. frame_index is read in scans alone;
    an event without one keeps its verdict and gives no peak."""
    v = F.from_json(unfenced(text), _VERDICT)
    sure = v["confidence"].try_cast("double")
    ok = v["is_event"].isNotNull() & sure.between(0, 1)
    index = v["frame_index"] if scan else F.lit(None).cast("int")
    rest = [F.coalesce(v[c], F.lit("")).alias(c) for c in ("rationale", "caption")]
    return F.when(ok, F.struct(v["is_event"].alias("is_event"), sure.alias("confidence"), index.alias("frame_index"), *rest))


def parse_describe(text: Column) -> Column:
    """A description with a whole score 1 to 5 and non-blank texts, or null."""
    d = F.from_json(unfenced(text), _DESCRIBE)
    score = d["score"].cast("int")
    ok = score.between(1, 5) & ~_blank(d["caption"]) & ~_blank(d["description"])
    return F.when(ok, F.struct(score.alias("score"), *[d[c].alias(c) for c in ("caption", "description", "rationale", "goal_this_end")]))


def parse_judge(text: Column) -> Column:
    """A judgement with a known agreement and a distance in 0 to 1, or null."""
    j = F.from_json(unfenced(text), _JUDGE)
    return F.when(j["agreement"].isin(*AGREEMENTS) & j["distance_score"].between(0, 1), j)


def keep_confirmed(is_event: Column, confidence: Column, drop_at: float) -> Column:
    """Kept unless the verdict says no event with confidence drop_at or more; null keeps."""
    return F.coalesce(is_event | (confidence < drop_at), F.lit(True))


def is_flagged(agreement: Column, distance: Column, at: float) -> Column:
    """Without a judgement, not consistent, or far off."""
    return F.coalesce((agreement != "consistent") | (distance >= at), F.lit(True))


def frame_offsets(duration: Column, count: int) -> Column:
    """Midpoints of ``count`` equal parts; none for a count of 0, zeros without a duration."""
    if count <= 0:
        return F.array().cast("array<double>")
    step = F.when(duration > 0, duration / F.lit(float(count))).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: step * (i + 0.5))


def peak_window(start: Column, end: Column, peak: Column, width) -> tuple[Column, Column]:
    """A window of ``width`` around the peak (the middle without one) inside the interval; all of it if shorter."""
    middle = F.coalesce(peak, (start + end) / 2)
    low, high = F.greatest(start, middle - width / 2), F.least(end, middle + width / 2)
    return F.when(high > low, low).otherwise(start), F.when(high > low, high).otherwise(end)


def scan_peak(start: Column, end: Column, is_event: Column, confidence: Column, frame: Column, count: int, add_at: float) -> Column:
    """The time of a scan's event, or null: sure enough, and a frame that was looked at."""
    at = start + (end - start) / F.lit(float(count)) * (frame + 0.5)
    return F.when(is_event & (confidence >= add_at) & frame.between(0, count - 1), at)


def allocate_frames(durations: Column, count: int) -> Column:
    """Frames for each of an interval's slices in order: in proportion, one at least while they last; the last takes the rest.

    Halves round to even. The remainder makes this a fold over the array.
    """
    total = F.aggregate(durations, F.lit(0.0), lambda a, d: a + d)
    n = F.size(durations)
    start = F.struct(F.array().cast("array<int>").alias("got"), F.lit(0).alias("used"))

    def step(acc, pair):
        left = F.lit(count) - acc["used"]
        share = F.greatest(F.lit(1), F.coalesce(F.bround(F.lit(float(count)) * pair["d"] / F.nullif(total, F.lit(0.0))), F.lit(0.0)).cast("int"))
        own = F.greatest(F.lit(0), F.when(pair["i"] == n - 1, left).otherwise(F.least(left, share)))
        return F.struct(F.concat(acc["got"], F.array(own)).alias("got"), (acc["used"] + own).alias("used"))

    pairs = F.transform(durations, lambda d, i: F.struct(d.cast("double").alias("d"), i.alias("i")))
    return F.aggregate(pairs, start, step, lambda acc: acc["got"])


def by_disagreement(rows: DataFrame, distance: str, idx: str) -> DataFrame:
    """Furthest first; rows without a judgement count as 1, ties keep their order."""
    return rows.orderBy(F.coalesce(F.col(distance), F.lit(1.0)).desc(), F.col(idx))
