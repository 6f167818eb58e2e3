"""The commands, as compositions of operators: DataFrames in, DataFrames out.

Media encoding, drawing, posting and calls to models stay outside: they show as manifest
tables, or as functions that a caller passes in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clip_name
from tidemark.model import GOLDEN_CLUSTER_SECONDS, PRESETS, SWEEP_THRESHOLDS, Settings, preset
from tidemark.operators import cache, golden, intervals, peaks, scan, scoring, segments, signal, verdicts
from tidemark.sources import outbox, recordings, sinks
from tidemark.sources.log import CacheLog
from tidemark.written import keep

CHUNK = ["recording_id", "sequence"]
WIDTH = 60.0  # seconds of a range join's buckets


def _frame_sizes(settings: Settings, rate: int, kind: str) -> tuple[int, int, int]:
    """Window and hop in samples, cut to whole ones, and the baseline's rows from the nominal hop."""
    own = getattr(settings.detection, kind)
    least = 2 if kind == "onset_flux" else 1
    return max(least, int(own.window_seconds * rate)), max(1, int(own.hop_seconds * rate)), signal.odd_size(own.baseline_window_seconds, own.hop_seconds)


def trace(samples: DataFrame, settings: Settings, kind: str, block_size: int | None = None) -> DataFrame:
    """t, value, baseline and mad of each frame of a chunk, by segments of it.

    kind: rms_energy (dBFS, times of frame starts) or onset_flux (times of frame centres).
    The baseline starts anew in each chunk. ``block_size``: samples of a block, of a second
    by default.
    """
    rate = settings.audio.sample_rate
    window, hop, size = _frame_sizes(settings, rate, kind)
    frames = segments.rms_frames if kind == "rms_energy" else segments.flux_frames
    found = frames(samples, CHUNK, window, hop, block_size or rate)
    found = signal.rolling_threshold(found, CHUNK, ["frame_idx"], "value", size, 0.0, index="frame_idx")
    return found.select(*CHUNK, "frame_idx", (F.col("at") / rate).alias("t"), "value", "baseline", "mad")


def with_threshold(found: DataFrame, sigma: float) -> DataFrame:
    return found.select(*CHUNK, "frame_idx", "t", "value", (F.col("baseline") + sigma * F.col("mad") * signal.MAD_SCALE).alias("threshold"))


def rms_trace(samples: DataFrame, settings: Settings) -> DataFrame:
    """t, value (dBFS) and threshold of each frame of a chunk."""
    return with_threshold(trace(samples, settings, "rms_energy"), settings.detection.rms_energy.threshold_sigma)


def flux_trace(samples: DataFrame, settings: Settings) -> DataFrame:
    """t, value (spectral flux) and threshold of each frame of a chunk."""
    return with_threshold(trace(samples, settings, "onset_flux"), settings.detection.onset_flux.threshold_sigma)


#: What each strategy looks at.
SIGNALS = {"rms_energy": ("rms_energy",), "onset_flux": ("onset_flux",), "combined": ("onset_flux", "rms_energy")}


def traces(samples: DataFrame, wanted: list[Settings]) -> dict[tuple, DataFrame]:
    """The traces that some settings need, each made once and written: thresholds differ later, frames don't."""
    found: dict[tuple, DataFrame] = {}
    for s in wanted:
        for kind in SIGNALS.get(s.detection.strategy, ()):
            key = (kind, s.audio.sample_rate, *_frame_sizes(s, s.audio.sample_rate, kind))
            if key not in found:
                found[key] = keep(trace(samples, s, kind), f"trace-{kind}")
    return found


def chunk_peaks(samples: DataFrame, settings: Settings, made: dict[tuple, DataFrame] | None = None, rows_per_range: int | None = None) -> DataFrame:
    """Peaks (t, score) on each chunk's own axis, by the settings' strategy; from ``traces`` where they are given.

    ``rows_per_range`` cuts the traces of longer chunks into ranges (see ``scan``), so that
    the runs of a chunk that goes on for days are found by many tasks.
    """
    s, d = settings, settings.detection
    cut = lambda found: scan.long_ranges(found, CHUNK, "frame_idx", rows_per_range) if rows_per_range else None

    def own(kind: str) -> DataFrame:
        sigma = getattr(d, kind).threshold_sigma
        key = (kind, s.audio.sample_rate, *_frame_sizes(s, s.audio.sample_rate, kind))
        return with_threshold(made[key] if made else trace(samples, s, kind), sigma)

    if d.strategy == "rms_energy":
        one = own("rms_energy")
        found = peaks.analyze("rms_energy", one, CHUNK, ["frame_idx"], d.rms_energy.min_score_dbfs, d.rms_energy.min_absolute_dbfs, cut(one))
    elif d.strategy == "onset_flux":
        one = own("onset_flux")
        found = peaks.analyze("onset_flux", one, CHUNK, ["frame_idx"], d.onset_flux.min_score, cut(one))
    else:
        found = peaks.analyze(d.strategy, own("onset_flux"), own("rms_energy"), CHUNK, "t", d.combined.window_before_seconds, d.combined.window_after_seconds, WIDTH, d.onset_flux.min_score, d.rms_energy.min_score_dbfs, d.rms_energy.min_absolute_dbfs)
    return found.select(*CHUNK, "t", "score")


def after_warmup(found: DataFrame, at: str, warmup) -> DataFrame:
    """Without what lies before the end of the warm-up."""
    return found.where(F.col(at) >= warmup)


def detect(samples: DataFrame, chunks: DataFrame, settings: Settings, made: dict[tuple, DataFrame] | None = None) -> DataFrame:
    """Merged intervals (idx, start, end, peaks) of each recording, on its common axis."""
    tl = settings.timeline
    local = chunk_peaks(samples, settings, made)
    glob = local.join(chunks.select(*CHUNK, "global_start_seconds"), CHUNK).withColumn("time_seconds", F.col("global_start_seconds") + F.col("t"))
    glob = after_warmup(glob, "time_seconds", tl.warmup_seconds).select("recording_id", "time_seconds", "score")
    padded = intervals.pad_peaks(glob, "time_seconds", tl.lookback_seconds, tl.post_peak_seconds)
    listed = F.array_sort(F.collect_list(F.struct("time_seconds", "score"))).alias("peaks")
    out = intervals.merge_intervals(padded, ["recording_id"], tl.min_gap_seconds, tl.min_interval_seconds, ["time_seconds"], [listed])
    return out.withColumn("max_value", F.array_max(F.transform("peaks", lambda p: p["score"])))


def batch_review(samples: DataFrame, chunks: DataFrame, settings: Settings, names: list[str] | None = None, named: dict[str, Settings] | None = None) -> tuple[DataFrame, DataFrame]:
    """Intervals of every preset (strategy), and the pieces of what none covers.

    Samples are read once for each distinct signal, not for each preset. ``named`` are
    settings in the place of the built-in presets'.
    """
    named = named or {name: preset(settings, name) for name in names or list(PRESETS)}
    made, found = traces(samples, list(named.values())), None
    for name, own in named.items():  # a handful of presets: one plan of a union
        own = detect(samples, chunks, own, made).withColumn("strategy", F.lit(name))
        found = own if found is None else found.unionByName(own)
    total = chunks.groupBy("recording_id").agg(F.sum("duration_seconds").alias("total"))
    union = intervals.merge_intervals(found.select("recording_id", "start", "end"), ["recording_id"], 0.0, 0.0)
    gaps = intervals.invert(union, total, ["recording_id"], "total")
    return found, intervals.split_long(gaps, ["recording_id"], settings.review.max_negative_clip_seconds, settings.review.min_negative_clip_seconds)


def render(found: DataFrame, chunks: DataFrame, use_proxy: bool = True) -> DataFrame:
    """A clip manifest: each interval's parts in the chunks it spans."""
    from tidemark.sources.recordings import source_of

    spans = chunks.withColumns({"chunk_start": F.col("global_start_seconds"), "chunk_end": F.col("global_start_seconds") + F.col("duration_seconds")})
    return sinks.clip_manifest(intervals.slices(found, spans, ["recording_id"], WIDTH), ["recording_id"], source_of(use_proxy))


def review_sheets(found: DataFrame, keys: list[str], prior: DataFrame | None = None) -> DataFrame:
    """Sheets to fill in, with guesses where labels of an earlier round are given."""
    if prior is None:
        return sinks.review_sheet(found, keys)
    return sinks.review_sheet(scoring.prior_guess(found, prior, [k for k in keys if k != "strategy"], WIDTH), keys, extra=["guess", "guess_basis"])


def prior_labels(sheets: DataFrame) -> DataFrame:
    """Rows of an earlier round's sheets as labels: source, idx (the place in a sheet), start, end, verdict, notes."""
    return sheets.select(F.col("strategy").alias("source"), "idx", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), "verdict", "notes")


def all_review_sheets(events: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """A sheet for every directory (strategy) that has events; with guesses where prior labels are given."""
    peak = F.array_max(F.transform("peaks", lambda p: p["score"]))
    found = events.select("strategy", "idx", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), peak.alias("max_value"), F.lit(0).alias("game"), F.col("idx").alias("place"))
    if prior is None:
        return sinks.review_sheet(found, ["strategy", "place"])
    # A guess is looked up by its row, so rows of all directories need numbers of their own.
    row = F.struct("strategy", "place")
    guessed = scoring.prior_guess(found.withColumn("idx", row), prior.withColumn("game", F.lit(0)), ["game"], WIDTH)
    return sinks.review_sheet(guessed.withColumn("idx", F.col("place")), ["strategy", "place"], extra=["guess", "guess_basis"])


def score(sheets: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Strategies' scores, and the report's lines; sheets of ``negatives`` give the missed ones.

    Every row of a strategy's sheet counts, whatever its verdict; of negatives only FN do.
    """
    own = F.when(F.col("strategy") != "negatives", F.col("strategy"))
    rows = sheets.select(*keys, own.alias("strategy"), F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), F.coalesce("verdict", F.lit("")).alias("verdict"))
    out = scoring.score_strategies(rows.where(F.col("strategy").isNotNull() | (scoring.normal_verdict(F.col("verdict")) == "FN")), keys, WIDTH)
    return out, sinks.score_lines(out)


def golden_from_sheets(sheets: DataFrame, events: DataFrame, keys: list[str], window: float = GOLDEN_CLUSTER_SECONDS) -> DataFrame:
    """Reference events: strongest peaks of TP clips, and missed times. A clip without peaks gives none."""
    v = scoring.normal_verdict(F.col("verdict"))
    tp = sheets.where((v == "TP") & (F.col("strategy") != "negatives"))
    listed = tp.join(events.where(F.size("peaks") > 0).select(*keys, "strategy", "idx", "peaks"), [*keys, "strategy", "idx"])
    top = F.element_at(F.array_sort("peaks", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)), 1)["time_seconds"]
    anchors = listed.select(*keys, top.alias("at"), F.concat_ws("/", "strategy", "clip_file").alias("source"))
    fn = golden.missed_times(sheets.where((v == "FN") & (F.col("strategy") == "negatives")), "start_seconds", "notes")
    missed = fn.select(*keys, "at", F.concat_ws("/", "strategy", "clip_file").alias("source"))
    return golden.build_golden(anchors.unionByName(missed), keys, "at", "source", window)


def golden_of_root(spark: SparkSession, root: str, window: float = GOLDEN_CLUSTER_SECONDS) -> DataFrame:
    """Reference events of a review root: at and sources, by time.

    Sheets meet the events of their directory by place; directories that lack either file
    say nothing, but for ``negatives``, whose notes tell what was missed.
    """
    sheets = recordings.read_review_root(spark, root).withColumn("recording_id", F.lit(""))
    events = recordings.read_root_events(spark, root).withColumn("recording_id", F.lit(""))
    return golden_from_sheets(sheets, events, ["recording_id"], window).select("at", "sources").orderBy("at")


def refine(found: DataFrame, gaps: DataFrame, confirm: Callable[[DataFrame], DataFrame], scan: Callable[[DataFrame], DataFrame], keys: list[str], settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Intervals after a model's look: confirmed ones and those found in gaps; and the log.

    ``confirm`` and ``scan`` add a column ``verdict`` (see ``verdicts.parse_verdict``).
    """
    vs, tl = settings.vision, settings.timeline
    seen = confirm(found)
    seen = seen.withColumn("kept", verdicts.keep_confirmed(F.col("verdict.is_event"), F.col("verdict.confidence"), vs.drop_confidence_threshold))
    looked = scan(gaps)
    at = verdicts.scan_peak(F.col("start"), F.col("end"), F.col("verdict.is_event"), F.col("verdict.confidence"), F.col("verdict.frame_index"), vs.frames_per_window, vs.add_confidence_threshold)
    looked = looked.withColumn("at", at).withColumn("kept", F.col("at").isNotNull())
    added = intervals.pad_peaks(looked.where("kept"), "at", tl.lookback_seconds, tl.post_peak_seconds)
    both = seen.where("kept").select(*keys, "start", "end").unionByName(added.select(*keys, "start", "end"))
    merged = intervals.merge_intervals(both, keys, tl.min_gap_seconds, tl.min_interval_seconds)
    log = seen.select(F.lit("confirm").alias("kind"), "start", "end", "verdict", "kept").unionByName(looked.select(F.lit("scan").alias("kind"), "start", "end", "verdict", "kept"))
    return merged, sinks.vision_log(log)


def vision_compare(found: DataFrame, cached: DataFrame, classify: Callable[[DataFrame], DataFrame], reference: DataFrame, keys: list[str], log: CacheLog | None = None, width=WIDTH) -> tuple[DataFrame, DataFrame]:
    """A sweep of the drop threshold over cached verdicts; only missing ones are asked for. Also the new cache.

    New verdicts are committed to ``log``, where one is given. ``width``, of the range
    join's buckets, is in the unit of the times.
    """
    rows = cache.resume(found, cached.withColumnsRenamed({"start_seconds": "start", "end_seconds": "end"}), "idx", {"start": 0.5}, "verdict")
    asked = keep(classify(cache.todo(rows, "verdict").drop("verdict")), "verdicts")  # asked for once
    every = rows.where(F.col("verdict").isNotNull()).unionByName(asked, allowMissingColumns=True)
    steps = found.sparkSession.createDataFrame([(x,) for x in SWEEP_THRESHOLDS], "threshold double")
    judged = every.select(*keys, "start", "end", "verdict.is_event", "verdict.confidence")
    table = scoring.sweep(judged, steps, reference, keys, width)
    fresh = asked.where(F.col("verdict").isNotNull()).select("idx", F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), "verdict")
    if log:
        log.append(fresh)
    return table, cache.upsert(cached, fresh, ["idx"])


def label_audit(rows: DataFrame, cached: DataFrame, describe: Callable, judge: Callable, settings: Settings, limit: int | None = None, log: CacheLog | None = None) -> tuple[DataFrame, DataFrame]:
    """All labelled rows with a description and a judgement, furthest apart first, and the flagged ones.

    New descriptions are committed to ``log`` before any is judged, and judgements after.
    """
    labelled = rows.where(F.trim("verdict") != "").withColumn("verdict", scoring.normal_verdict(F.col("verdict")))
    if limit is not None:
        labelled = labelled.orderBy("idx").limit(limit)
    got = cache.resume(labelled, cached, "idx", {"strategy": 0, "clip_file": 0}, "describe")
    got = cache.resume(got, cached, "idx", {}, "judge")
    done = got.where(F.col("describe").isNotNull() & F.col("judge").isNotNull())
    described = got.where("describe is null").drop("describe", "judge")
    described = keep(describe(described), "descriptions").withColumn("judge", F.lit(None).cast(dict(cached.dtypes)["judge"])) if describe else got.where("describe is null")
    if log:
        log.append(described.where("describe is not null").select(*cached.columns))
    todo = got.where("describe is not null and judge is null").unionByName(described)
    judged = keep(judge(todo.drop("judge")), "judgements")
    if log:
        log.append(judged.where("judge is not null").select(*cached.columns))
    every = done.unionByName(judged)
    flagged = every.where(verdicts.is_flagged(F.col("judge.agreement"), F.col("judge.distance_score"), settings.label_audit.flag_distance_threshold))
    order = F.coalesce("judge.distance_score", F.lit(1.0)).desc()
    return every.orderBy(order, "idx"), flagged.orderBy(order, "idx")


def describe_only(rows: DataFrame, cached: DataFrame, describe: Callable[[DataFrame], DataFrame], log: CacheLog | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with a description, asked for only where the cache has none, and the new cache; nothing is judged."""
    got = cache.resume(rows, cached, "idx", {"strategy": 0, "clip_file": 0}, "describe")
    asked = keep(describe(cache.todo(got, "describe").drop("describe")), "descriptions")
    every = got.where("describe is not null").unionByName(asked)
    fresh = asked.where("describe is not null").select(*cached.columns)
    if log:
        log.append(fresh)
    return every, cache.upsert(cached, fresh, ["idx"])


def pre_label(found: DataFrame, chunks: DataFrame, cached: DataFrame, describe: Callable[[DataFrame], DataFrame], settings: Settings, log: CacheLog | None = None) -> dict[str, DataFrame]:
    """For a recording without labels: events, clips to encode, a sheet with descriptions, and the new cache."""
    rows = found.withColumns({"strategy": F.lit("candidates"), "clip_file": clip_name(F.col("idx"))})
    described, fresh = describe_only(rows, cached, describe, log)
    review = settings.review
    clips = sinks.encode_manifest(render(found, chunks, settings.input.use_lrf_for_detection), review.max_width, review.fps, review.crf, review.preset)
    sheet = sinks.with_ai_columns(sinks.review_sheet(rows, ["recording_id"]), described, ["recording_id", "clip_file"])
    return {"events": sinks.events_json(found, keys=("recording_id", "idx")), "clips": clips, "sheet": sheet, "cache": fresh}


def vision_highlights(found: DataFrame, classify: Callable[[DataFrame], DataFrame], settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Each interval with its verdict, whether it stays and where its clip goes; and the log. Nothing is added."""
    seen = classify(found)
    kept = verdicts.keep_confirmed(F.col("verdict.is_event"), F.col("verdict.confidence"), settings.vision.drop_confidence_threshold)
    seen = seen.withColumns({"kept": kept, "caption": F.col("verdict.caption")})
    return sinks.routed_clips(seen, F.col("kept")), sinks.vision_log(seen.withColumn("kind", F.lit("confirm")))


def golden_report(found: DataFrame, reference: DataFrame, keys: list[str], game_seconds: float, refined: DataFrame | None = None) -> DataFrame:
    """The score of the intervals against reference events, and of the refined ones where given, with the report's lines."""
    out = None
    for name, own in (("audio", found), ("vision", refined)):
        if own is not None:
            one = sinks.golden_lines(sinks.golden_line(scoring.golden_score(own, reference, keys, WIDTH), game_seconds)).withColumn("pass", F.lit(name))
            out = one if out is None else out.unionByName(one)
    return out


def export(found: DataFrame, chunks: DataFrame, written: DataFrame, settings: Settings) -> DataFrame:
    """Clips to encode at full quality, without those whose output is there already."""
    e = settings.export
    return cache.outbox(sinks.encode_manifest(render(found, chunks, False), e.max_width, e.fps, e.crf, e.preset), written, ["clip_file"])


def with_retries(call: Callable, retries: int, wait: Callable[[int], None] = lambda attempt: None) -> Callable:
    """A call that is made again after an exception, ``retries`` times more at most; the last one passes."""

    def again(*args, **kwargs):
        for attempt in range(retries + 1):
            try:
                return call(*args, **kwargs)
            except Exception:
                if attempt == retries:
                    raise
                wait(attempt)

    return again


def export_picks(sheet: DataFrame, wanted: DataFrame, written: DataFrame) -> DataFrame:
    """The last row of each wanted clip, without those whose output is there already."""
    return cache.outbox(cache.pick(cache.last_of(sheet, "clip_file", "idx"), wanted, "clip_file"), written, ["clip_file"])


def post_picks(picks: DataFrame, sent: DataFrame, settings: Settings) -> DataFrame:
    return sinks.posts(cache.outbox(picks, sent, ["clip_file"]), _cap(settings))


def _cap(settings: Settings) -> int:
    return int(settings.telegram.max_file_size_mb * 1024 * 1024)


def post_all(picks: DataFrame, send: Callable[[dict], int], path: str, settings: Settings, dry_run: bool = False) -> DataFrame:
    """Send the picks (clip_file, size, caption ...) by ``send``, each once ever; what became of each."""
    return outbox.post(picks, send, path, _cap(settings), settings.telegram.max_retries, dry_run)
