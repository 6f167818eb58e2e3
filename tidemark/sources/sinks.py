"""Sinks: what is written out, as DataFrames ready to write, and the writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import half_even
from tidemark.functions.text import clip_name, fixed, flagged_name, safe_caption
from tidemark.operators import verdicts
from tidemark.operators.ranges import points_in_intervals
from tidemark.sources.directories import write_arrays, write_tables


def events_json(intervals: DataFrame, peaks: str = "peaks", keys: tuple[str, ...] = ()) -> DataFrame:
    """start, end, duration (of the unrounded ends) and peaks, rounded as they are stored."""
    shown = F.transform(peaks, lambda p: F.struct(half_even(p["time_seconds"], 2).alias("time_seconds"), half_even(p["score"], 4).alias("score")))
    length = half_even(F.col("end") - F.col("start"), 2)
    return intervals.select(*keys, half_even(F.col("start"), 2).alias("start_seconds"), half_even(F.col("end"), 2).alias("end_seconds"), length.alias("duration_seconds"), shown.alias("peaks"))


def review_sheet(intervals: DataFrame, keys: list[str], unit: float = 1.0, score: str = "max_value", extra: list[str] = []) -> DataFrame:  # noqa: B006
    """A row for each interval to be judged; ``extra`` are guess columns, kept as they are."""
    at = lambda c: half_even(c / F.lit(unit), 2)
    return intervals.select(
        *keys, clip_name(F.col("idx")).alias("clip_file"), at(F.col("start")).alias("start_seconds"), at(F.col("end")).alias("end_seconds"),
        at(F.col("end") - F.col("start")).alias("duration_seconds"), half_even(F.coalesce(score, F.lit(0.0)), 4).alias("max_peak_score"),
        F.lit("").alias("verdict"), F.lit("").alias("notes"), *extra,
    )


def golden_json(golden: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return golden.select(*keys, half_even(F.col("at"), 2).alias("time_seconds"), "sources")


def vision_log(entries: DataFrame) -> DataFrame:
    """kind, window, verdict (null stays null) and whether the interval was kept."""
    v = F.when(F.col("verdict").isNotNull(), F.col("verdict").withField("confidence", half_even(F.col("verdict.confidence"), 3)))
    return entries.select("kind", half_even(F.col("start"), 2).alias("start_seconds"), half_even(F.col("end"), 2).alias("end_seconds"), v.alias("verdict"), "kept")


def audit_report(rows: DataFrame) -> DataFrame:
    """Two decimals, blanks for what is missing, and two columns to fill in by hand."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    two = lambda c: F.when(c.isNull(), "").otherwise(F.format_string("%.2f", c))
    return rows.select(
        "strategy", "clip_file", two(F.col("start")).alias("start_seconds"), two(F.col("end")).alias("end_seconds"), "verdict", text(F.col("notes")).alias("notes"),
        *[text(F.col(f"describe.{c}")).alias(f"ai_{c}") for c in ("score", "caption", "description", "rationale")],
        text(F.col("judge.agreement")).alias("agreement"), two(F.col("judge.distance_score")).alias("distance_score"), text(F.col("judge.rationale")).alias("judge_rationale"),
        F.lit("").alias("corrected_verdict"), F.lit("").alias("reviewer_notes"),
    )


def with_ai_columns(sheet: DataFrame, described: DataFrame, keys: list[str]) -> DataFrame:
    """A review sheet with the model's score, caption and description, joined by clip; blank where there is none."""
    own = described.select(*keys, *[F.col(f"describe.{c}").cast("string").alias(f"ai_{c}") for c in ("score", "caption", "description")])
    out = sheet.join(own, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("ai_score", "ai_caption", "ai_description")})


def _padded(text: Column, width: int, left: bool = False) -> Column:
    """Text in a column of a report, which longer text widens."""
    blanks = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.char_length(text)))
    return F.concat(text, blanks) if left else F.concat(blanks, text)


def _number(c: str, digits: int, width: int, left: bool = False) -> Column:
    return _padded(fixed(F.col(c), digits), width, left)


def score_lines(scores: DataFrame) -> DataFrame:
    """The score report: no, line; the truths, a blank, a header, a rule, and a line for each strategy by name."""
    names = (("strategy", 16), ("labeled/total", 16), ("TP", 6), ("FP", 6), ("precision", 12), ("recall", 12), ("F1", 8))
    header = "".join(n.ljust(w) for n, w in names)
    cells = [_padded(c, w, True) for c, w in ((F.col("strategy"), 16), (F.concat_ws("/", "labeled", "total"), 16), (F.col("tp").cast("string"), 6), (F.col("fp").cast("string"), 6))]
    cells += [_number(c, 2, w, True) for c, w in (("precision", 12), ("recall", 12), ("f1", 8))]
    rows = scores.select((F.row_number().over(Window.orderBy("strategy")) + 3).alias("no"), F.concat(*cells).alias("line"))  # a row a strategy
    truths = F.concat(F.lit("Ground truth events (union of all TP + FN-flagged negatives): "), F.coalesce(F.max("truths"), F.lit(0)).cast("string"))
    top = scores.agg(F.array(truths, F.lit(""), F.lit(header), F.lit("-" * len(header))).alias("t")).select(F.posexplode("t").alias("no", "line"))
    return top.unionByName(rows)


def sweep_lines(points: DataFrame) -> DataFrame:
    """The sweep table: no, line; a header and a line for each threshold, the highest first."""
    header = "  ".join(n.rjust(w) for n, w in (("threshold", 10), ("kept", 8), ("precision", 9), ("recall", 7), ("f1", 6), ("FN", 3)))
    share = F.concat(_padded(F.col("kept").cast("string"), 4), F.lit("/"), _padded(F.col("total").cast("string"), 3, True))
    line = F.concat_ws("  ", _number("threshold", 2, 10), share, _number("precision", 3, 9), _number("recall", 3, 7), _number("f1", 3, 6), _padded(F.col("fn").cast("string"), 3))
    rows = points.select(F.row_number().over(Window.orderBy(F.desc("threshold"))).alias("no"), line.alias("line"))  # a row a threshold
    return points.sparkSession.createDataFrame([(0, header)], "no int, line string").unionByName(rows)


def golden_lines(score: DataFrame) -> DataFrame:
    """A golden score with the report's three lines."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    seconds = lambda c: F.concat(fixed(F.col(c).cast("double"), 1), F.lit("s"))
    mean = F.when(F.col("mean_duration").isNull(), "n/a").otherwise(seconds("mean_duration"))
    lines = [
        F.concat(F.lit("clips="), text("clips"), F.lit("  TP="), text("tp"), F.lit("  FP="), text("fp"), F.lit("  FN="), text("fn")),
        F.concat(F.lit("precision="), text("precision"), F.lit("  recall="), text("recall"), F.lit("  F1="), text("f1")),
        F.concat(F.lit("mean_clip_duration="), mean, F.lit("  max_clip_duration="), seconds("max_duration"), F.lit("  total_duration="), seconds("total_duration"), F.lit(" ("), fixed(F.col("percent_of_game"), 1), F.lit("% of game)")),
    ]
    return score.withColumn("lines", F.array(*lines))


def golden_line(score: DataFrame, game: float) -> DataFrame:
    """A golden score with its share of the game, 0 where the game has no length."""
    return score.withColumn("percent_of_game", F.coalesce(F.try_divide(100 * F.col("total_duration"), F.lit(game)), F.lit(0.0)))


def clip_manifest(slices: DataFrame, keys: list[str], source: Column) -> DataFrame:
    """What an encoder needs: a clip's parts in chunk order, one for each slice it spans."""
    part = F.struct("sequence", source.alias("source"), "local_start", (F.col("local_end") - F.col("local_start")).alias("duration"))
    return slices.groupBy(*keys, "idx").agg(F.array_sort(F.collect_list(part)).alias("parts")).withColumn("clip_file", clip_name(F.col("idx")))


def join_manifest(clips: DataFrame, reencode: bool = False) -> DataFrame:
    """How a clip's parts become one file: a single part is renamed, others are joined by a list of files.

    Parts of a clip with several are named after it; quotes in the list's names are escaped
    as shells do.
    """
    stem = F.regexp_replace("clip_file", r"\.[^.]*$", "")
    names = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.concat(stem, F.lit("_part"), i.cast("string"), F.lit(".mp4")))
    quoted = lambda n: F.concat(F.lit("file '"), F.replace(n, F.lit("'"), F.lit("'\\''")), F.lit("'\n"))
    one = F.size("parts") == 1
    return clips.withColumns({
        "part_files": F.when(one, F.array("clip_file")).otherwise(names),
        "join_by": F.when(one, "rename").when(F.lit(reencode), "reencode").otherwise("copy"),
        "file_list": F.when(~one, F.array_join(F.transform(names, quoted), "")),
    })


def frame_manifest(clips: DataFrame, keys: list[str], count: int, max_width: int) -> DataFrame:
    """A row for each still of a clip, evenly spaced over its parts in proportion to their lengths.

    frame (from 0), source, at (seconds into it), file and max_width. A clip without a
    length, or a count of 0, has none.
    """
    length = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["duration"].cast("double"))
    each = F.transform(F.arrays_zip("parts", verdicts.allocate_frames(F.transform("parts", lambda p: p["duration"]), count).alias("n")), lambda x: F.struct(x["parts"].alias("p"), x["n"].alias("n")))
    at = lambda x, i: F.when(x["p"]["duration"] > 0, x["p"]["duration"].cast("double") / x["n"]).otherwise(0.0) * (i + 0.5) + x["p"]["local_start"]
    stills = lambda x: F.when(x["n"] > 0, F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: F.struct(x["p"]["source"].alias("source"), at(x, i).alias("at")))).otherwise(F.array().cast("array<struct<source: string, at: double>>"))
    rows = clips.where(length > 0) if count > 0 else clips.where("false")
    rows = rows.select(*keys, "idx", F.posexplode(F.flatten(F.transform(each, stills))).alias("frame", "still"))
    return rows.select(*keys, "idx", "frame", "still.source", "still.at", F.format_string("frame_%03d.jpg", "frame").alias("file"), F.lit(max_width).alias("max_width"))


def encode_manifest(clips: DataFrame, width: int, fps: float, crf: int, preset: str) -> DataFrame:
    return clips.withColumn("encode", F.struct(F.lit(width).alias("width"), F.lit(fps).alias("fps"), F.lit(crf).alias("crf"), F.lit(preset).alias("preset")))


def skim_manifest(chunks: DataFrame, keys: list[str], source: Column) -> DataFrame:
    """The whole session as one list of parts in order."""
    return chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sequence", source.alias("source")))).alias("parts"))


def flagged_copies(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("copy_as", flagged_name(F.col("rank"), F.col("judge.distance_score"), F.col("judge.agreement"), F.col("strategy"), F.col("clip_file")))


def routed_clips(clips: DataFrame, keep: Column) -> DataFrame:
    """Kept clips by their start and caption; others under pruned/."""
    name = F.concat(F.format_string("%.0f - ", "start"), safe_caption(F.col("caption")), F.lit(".mp4"))
    return clips.withColumn("path", F.when(keep, name).otherwise(F.concat(F.lit("pruned/"), name)))


def plot_frame(trace: DataFrame, slices: DataFrame, keys: list[str], at: str, width=60.0) -> DataFrame:
    """A trace with whether each frame lies in a slice of its chunk; ``width`` as in range joins."""
    own = slices.select(*keys, "local_start", "local_end")
    hit = points_in_intervals(trace.select(*keys, at).distinct(), own, keys, at, "local_start", "local_end", width, "left_semi").withColumn("shaded", F.lit(True))
    return trace.join(hit, [*keys, at], "left").withColumn("shaded", F.coalesce("shaded", F.lit(False)))


def posts(picks: DataFrame, cap_bytes: int) -> DataFrame:
    """Picks with what to do: those over the size cap are passed over."""
    return picks.withColumn("action", F.when(F.col("size") > cap_bytes, "too large").otherwise("send"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_events(events: DataFrame, path: str, directory: Column) -> None:
    """An events.json of one array in each directory, as ``recordings.read_events_json`` scans them."""
    shown = [c for c in ("start_seconds", "end_seconds", "duration_seconds", "peaks") if c in events.columns]
    place = [F.col("idx" if "idx" in events.columns else "start_seconds").alias("_place")]
    write_arrays(events.select(*shown, *place, directory.alias("_directory")), path, F.col("_directory"), ["_place"])


def write_sheets(sheets: DataFrame, path: str, directory: Column, order: str = "clip_file") -> None:
    """A review_sheet.csv in each directory, as ``recordings.read_review_root`` scans them."""
    shown = [c for c in sheets.columns if c not in ("recording_id", "strategy", "idx", "place")]
    place = F.coalesce(F.regexp_extract(order, "([0-9]+)", 1).try_cast("long"), F.lit(0)).alias("_place")
    write_tables(sheets.select(*shown, place, F.col(order).alias("_name"), directory.alias("_directory")), path, F.col("_directory"), ["_place", "_name"])
