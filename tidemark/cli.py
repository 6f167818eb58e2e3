"""The commands on files: ``python -m tidemark.cli COMMAND ...``.

Recordings are WAV files beside or instead of the named chunk files; results are Parquet,
CSV or JSON folders under ``--out``. What a model says comes from ``--replies``, JSON
lines of {clip_file, reply}; without a reply a clip has no verdict or description. Media
are never encoded: manifests say what an encoder has to do.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions.text import clip_name
from tidemark.operators import verdicts
from tidemark.plans import pipelines
from tidemark.sources import audio, recordings, sinks
from tidemark.sources.log import CacheLog
from tidemark.written import hadoop

REC = ["recording_id"]
CLIP = "idx long, strategy string, clip_file string"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__.split("\n")[0])
    top.add_argument("--config")
    top.add_argument("--presets", help="a file of named overlays instead of the built-in ones")
    top.add_argument("--source-dir")
    top.add_argument("--strategy")
    top.add_argument("--out", default="output")
    top.add_argument("--cache", help="folder of what models have said; beside the results where not given")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("detect", "render", "batch-review", "export"):
        sub.add_parser(name)
    sheet = sub.add_parser("review-sheet")
    sheet.add_argument("--prior-root")
    sheet.add_argument("--root", help="sheets for all directories with events, written beside them")
    for name in ("score", "label-audit"):
        sub.add_parser(name).add_argument("--sheets", required=True, help="path or pattern of review sheets")
    sub.choices["label-audit"].add_argument("--replies")
    sub.choices["label-audit"].add_argument("--judgements")
    sub.choices["label-audit"].add_argument("--limit", type=int)
    for name in ("export-picks", "telegram-post"):
        one = sub.add_parser(name)
        one.add_argument("--sheet", required=True)
        one.add_argument("--clips", nargs="+", required=True)
        one.add_argument("--done", help="outputs written, or the file of clips sent")
    golden = sub.add_parser("golden-score")
    golden.add_argument("--golden", required=True)
    golden.add_argument("--replies", help="also score the intervals that verdicts confirm")
    for name in ("vision-highlights", "pre-label"):
        sub.add_parser(name).add_argument("--replies")
    sub.choices["pre-label"].add_argument("--lrf-cache-dir")
    compare = sub.add_parser("vision-compare")
    compare.add_argument("--golden", required=True)
    compare.add_argument("--replies", required=True)
    return top


def settings_of(args) -> model.Settings:
    """Flags over environment over the file over defaults."""
    flags = {"input": {"source_dir": args.source_dir}} if args.source_dir else {}
    if args.strategy:
        flags["detection"] = {"strategy": args.strategy}
    return model.load_settings(args.config, None, flags)


def chunks_and_samples(spark: SparkSession, settings: model.Settings) -> tuple[DataFrame, DataFrame]:
    """Chunks of a folder of WAV files named like chunks, and their samples at the settings' rate."""
    source = settings.input.source_dir
    chunks = recordings.discover(spark, source, "WAV")
    chunks = recordings.with_durations(chunks, audio.wav_durations(spark, f"{source}/*.[wW][aA][vV]"))
    named = chunks.select(recordings.plain_path(F.col("source_path")).alias("source_path"), *REC, "sequence")
    samples = audio.read_wav(spark, source)
    samples = samples.withColumn("source_path", recordings.plain_path(F.col("source_path"))).join(named, "source_path")
    return chunks, audio.at_rate(samples, [*REC, "sequence"], settings.audio.sample_rate)


def replies(spark: SparkSession, path: str | None, parse) -> callable:
    """A stand-in for a model: adds what the file's replies say of each clip, null without one."""

    def say(rows: DataFrame, column: str) -> DataFrame:
        named = rows if "clip_file" in rows.columns else rows.withColumn("clip_file", clip_name(F.col("idx")))
        if path is None:
            return named.withColumn(column, parse(F.lit(None).cast("string")))
        told = spark.read.schema("clip_file string, reply string").json(path)
        return named.join(told, "clip_file", "left").withColumn(column, parse(F.col("reply"))).drop("reply")

    return say


def cache_of(spark: SparkSession, args, name: str, columns: str, parsed: dict) -> CacheLog:
    """The log of what a model has said of each clip."""
    schema = spark.createDataFrame([], columns).withColumns(parsed).schema if parsed else columns
    return CacheLog(spark, f"{args.cache or args.out + '/cache'}/{name}", schema, ["idx"])


def sheets_of(spark: SparkSession, path: str) -> DataFrame:
    """The sheets of a review root's directories, or those that a path or pattern names."""
    if not any(c in path for c in "*?[{"):
        at, system = hadoop(spark, path)
        if system.exists(at) and system.getFileStatus(at).isDirectory():
            return recordings.read_review_root(spark, path)
    rows = recordings.read_sheets(spark, path)
    return rows.withColumn("idx", F.coalesce(F.regexp_extract("clip_file", "([0-9]+)", 1).try_cast("long"), F.lit(0)))


def run(spark: SparkSession, args) -> dict[str, DataFrame]:
    """The command's results by name; only what models say is written already, to the cache."""
    s, c = settings_of(args), args.command
    if c == "score":
        scores, lines = pipelines.score(sheets_of(spark, args.sheets).withColumn("recording_id", F.lit("")), REC)
        return {"scores": scores, "report": lines.orderBy("no")}
    if c in ("export-picks", "telegram-post"):
        sheet = sheets_of(spark, args.sheet)
        wanted = spark.createDataFrame([(x,) for x in args.clips], "clip_file string")
        none = spark.createDataFrame([], "clip_file string")
        if c == "telegram-post":
            sent = recordings.read_sent(spark, args.done).select("clip_file") if args.done else none
            return {"posts": pipelines.post_picks(pipelines.export_picks(sheet, wanted, none).withColumn("size", F.lit(0)), sent, s)}
        done = spark.read.format("binaryFile").load(args.done).select(F.regexp_extract("path", "([^/]*)$", 1).alias("clip_file")) if args.done else none
        return {"picks": pipelines.export_picks(sheet, wanted, done)}
    if c == "label-audit":
        rows = sheets_of(spark, args.sheets).withColumns({"idx": F.xxhash64("strategy", "clip_file"), "start": F.col("start_seconds"), "end": F.col("end_seconds")})
        log = cache_of(spark, args, "audit", CLIP, {"describe": verdicts.parse_describe(F.lit("")), "judge": verdicts.parse_judge(F.lit(""))})
        say, judge = replies(spark, args.replies, verdicts.parse_describe), replies(spark, args.judgements, verdicts.parse_judge)
        every, flagged = pipelines.label_audit(rows, log.read(), lambda r: say(r, "describe"), lambda r: judge(r, "judge"), s, args.limit, log)
        return {"audit": sinks.audit_report(every), "flagged": sinks.audit_report(flagged)}
    if c == "review-sheet" and args.root:
        events = recordings.read_events_json(spark, f"{args.root}/*/events.json")
        prior = pipelines.prior_labels(sheets_of(spark, args.prior_root)) if args.prior_root else None
        return {"sheet": pipelines.all_review_sheets(events, prior)}
    chunks, samples = chunks_and_samples(spark, s)
    if c == "batch-review":
        found, negatives = pipelines.batch_review(samples, chunks, s, named=model.load_presets(s, args.presets) if args.presets else None)
        return {"events": sinks.events_json(found, keys=("recording_id", "strategy", "idx")), "negatives": negatives, "skim": sinks.skim_manifest(chunks, REC, recordings.source_of(True))}
    found = pipelines.detect(samples, chunks, s)
    if c == "detect":
        return {"events": sinks.events_json(found, keys=("recording_id", "idx"))}
    if c == "render":
        return {"clips": pipelines.render(found, chunks, s.input.use_lrf_for_detection)}
    if c == "export":
        return {"clips": pipelines.export(found, chunks, spark.createDataFrame([], "clip_file string"), s)}
    if c == "review-sheet":
        prior = None
        if args.prior_root:
            prior = pipelines.prior_labels(sheets_of(spark, args.prior_root)).join(found.select(*REC).distinct())
        return {"sheet": pipelines.review_sheets(found, REC, prior)}
    if c == "vision-highlights":
        say = replies(spark, args.replies, verdicts.parse_verdict)
        clips, log = pipelines.vision_highlights(found, lambda r: say(r, "verdict"), s)
        return {"clips": clips.select(*REC, "idx", "path", "kept"), "log": log}
    if c == "pre-label":
        if args.lrf_cache_dir:
            chunks = recordings.redirect_proxies(chunks, spark.read.format("binaryFile").load(args.lrf_cache_dir).select("path"))
        say = replies(spark, args.replies, verdicts.parse_describe)
        log = cache_of(spark, args, "descriptions", CLIP, {"describe": verdicts.parse_describe(F.lit(""))})
        out = pipelines.pre_label(found, chunks, log.read(), lambda r: say(r, "describe"), s, log)
        return {k: v for k, v in out.items() if k != "cache"}
    gold = recordings.read_golden(spark, args.golden).join(found.select(*REC).distinct())  # of one recording
    say = replies(spark, args.replies, verdicts.parse_verdict)
    if c == "vision-compare":
        log = cache_of(spark, args, "verdicts", model.VERDICT_CACHE, {})
        table, _ = pipelines.vision_compare(found, log.read(), lambda r: say(r, "verdict"), gold, REC, log)
        return {"sweep": sinks.sweep_lines(table).orderBy("no")}
    game = chunks.agg(F.sum("duration_seconds")).first()[0] or 0.0
    kept = None
    if args.replies:
        seen = say(found, "verdict")
        kept = seen.where(verdicts.keep_confirmed(F.col("verdict.is_event"), F.col("verdict.confidence"), s.vision.drop_confidence_threshold))
    return {"golden": pipelines.golden_report(found, gold, REC, game, kept).select("pass", F.explode("lines").alias("line"))}


def write(name: str, frame: DataFrame, path: str) -> None:
    """Events and sheets as files that the scans read, a directory each; audits as CSV; the rest as JSON lines."""
    if name in ("events", "sheet"):
        parts = [F.url_encode(c) for c in ("recording_id", "strategy") if c in frame.columns]
        place = F.concat_ws("/", *parts) if parts else F.lit(".")
        (sinks.write_events if name == "events" else sinks.write_sheets)(frame, path, place)
    elif name in ("audit", "flagged"):
        sinks.write_csv(frame, path)
    else:
        sinks.write_json(frame, path)


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"tidemark {args.command}").getOrCreate()
    for name, frame in run(spark, args).items():
        to = getattr(args, "root", None) if name == "sheet" else None
        write(name, frame, to or f"{args.out}/{name}")
        print(f"{args.out}/{name}")


if __name__ == "__main__":
    main()
