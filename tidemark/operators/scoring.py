"""Precision, recall and coverage of strategies' intervals, and labels of earlier rounds.

Precision counts clips, recall counts truths: the two come from separate joins. Undefined
ratios are null. Durations always go along, as one long interval can buy any coverage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import merge_intervals
from tidemark.operators.ranges import intervals_with_points, overlapping, points_in_intervals


def normal_verdict(verdict: Column) -> Column:
    return F.upper(F.trim(verdict))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))


def strategy_counts(labels: DataFrame, by: list[str], verdict: str = "verdict") -> DataFrame:
    """total, labeled, tp and fp: only TP and FP count as labels of a strategy's own clips."""
    v = normal_verdict(F.col(verdict))
    return labels.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(v.isin("TP", "FP")).alias("labeled"), F.count_if(v == "TP").alias("tp"), F.count_if(v == "FP").alias("fp")
    )


def truths(labels: DataFrame, keys: list[str]) -> DataFrame:
    """The union of strategies' TP intervals and missed ones (FN of no strategy), merged where they meet."""
    v, own = normal_verdict(F.col("verdict")), F.col("strategy").isNotNull()
    return merge_intervals(labels.where(own & (v == "TP") | ~own & (v == "FN")).select(*keys, "start", "end"), keys, 0, 0)


def score_strategies(labels: DataFrame, keys: list[str], width) -> DataFrame:
    """Per strategy: counts, precision, recall over the shared truths, and F1.

    ``labels`` has keys, strategy, start, end, verdict; FN rows stand for missed events and
    belong to the strategy None.
    """
    counts = strategy_counts(labels.where("strategy is not null"), ["strategy"])
    true = truths(labels, keys)  # known by keys and start
    own = labels.where((normal_verdict(F.col("verdict")) == "TP") & F.col("strategy").isNotNull()).select(*keys, "strategy", F.col("start").alias("s"), F.col("end").alias("e"))
    found = overlapping(true.select(*keys, "start", "end"), own, keys, ("start", "end"), ("s", "e"), width)
    covered = found.groupBy("strategy").agg(F.countDistinct(*keys, "start").alias("covered"))
    total = true.agg(F.count(F.lit(1)).alias("truths"))
    out = counts.join(covered, "strategy", "left").join(F.broadcast(total))  # one row
    out = out.withColumn("covered", F.coalesce("covered", F.lit(0)))
    out = out.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide("covered", "truths")})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def golden_score(intervals: DataFrame, golden: DataFrame, keys: list[str], width, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Clips with a reference event, events inside a clip, ratios and durations.

    Without ``by`` there is always one row. ``by`` are columns of intervals beside the keys,
    such as the strategy; reference events then count for each.
    """
    length = F.col("end") - F.col("start")
    clips = intervals.groupBy(*by).agg(F.count(F.lit(1)).alias("clips"), F.sum(length).alias("total_duration"), F.coalesce(F.max(length), F.lit(0)).alias("max_duration"), F.avg(length).alias("mean_duration"))
    hit = intervals_with_points(intervals, golden, keys, "start", "end", "at", width).groupBy(*by).agg(F.count(F.lit(1)).alias("tp"))
    events = golden.groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("__n"))
    inside = points_in_intervals(events, intervals.select(*keys, *by, "start", "end"), keys, "at", "start", "end", width)
    found = inside.select(*by, *keys, "at", "__n").distinct().groupBy(*by).agg(F.sum("__n").alias("found"))
    total = golden.agg(F.count(F.lit(1)).alias("golden"))
    if by:
        out = clips.join(hit, by, "left").join(found, by, "left").join(F.broadcast(total))
    else:
        out = clips.join(F.broadcast(hit)).join(F.broadcast(found)).join(F.broadcast(total))  # one row each
    zero = F.lit(0).cast("long")
    out = out.withColumns({"tp": F.coalesce("tp", zero), "found": F.coalesce("found", zero), "total_duration": F.coalesce("total_duration", zero)})
    out = out.withColumns({"fp": F.col("clips") - F.col("tp"), "fn": F.col("golden") - F.col("found"), "precision": F.try_divide("tp", "clips"), "recall": F.try_divide("found", "golden")})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def prior_guess(intervals: DataFrame, prior: DataFrame, keys: list[str], width) -> DataFrame:
    """Guess TP, FP, AMBIGUOUS or '' from labels of overlapping intervals, and what it rests on.

    TP and FN labels speak for TP, FP and TN for FP. ``prior`` has source, idx (its order),
    start, end, verdict, notes; ``intervals`` keeps its columns and needs an ``idx``.
    """
    v = normal_verdict(F.col("verdict"))
    known = prior.where(v.isin("TP", "FP", "TN", "FN")).select(
        *keys, F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.struct("source", F.col("idx").alias("no"), v.alias("verdict"), F.coalesce("notes", F.lit("")).alias("notes")).alias("label")
    )
    met = overlapping(intervals.select(*keys, "idx", "start", "end"), known, keys, ("start", "end"), ("p_start", "p_end"), width)
    good = F.col("label.verdict").isin("TP", "FN")
    text = lambda x: F.concat(x["source"], F.lit("="), x["verdict"], F.when(x["notes"] != "", F.concat(F.lit(" ("), x["notes"], F.lit(")"))).otherwise(F.lit("")))
    told = met.groupBy(*keys, "idx").agg(F.bool_and(good).alias("all_good"), F.bool_or(good).alias("any_good"), F.array_sort(F.collect_list("label")).alias("labels"))
    told = told.select(*keys, "idx", F.when(F.col("all_good"), "TP").when(~F.col("any_good"), "FP").otherwise("AMBIGUOUS").alias("guess"), F.array_join(F.transform("labels", text), "; ").alias("guess_basis"))
    out = intervals.join(told, [*keys, "idx"], "left")
    return out.withColumns({"guess": F.coalesce("guess", F.lit("")), "guess_basis": F.coalesce("guess_basis", F.lit("no overlapping prior label"))})


def sweep(candidates: DataFrame, thresholds: DataFrame, golden: DataFrame, keys: list[str], width) -> DataFrame:
    """The golden score of what each threshold keeps; ``thresholds`` is a small table (threshold).

    A candidate with a null verdict is kept; one judged no event is dropped from the
    threshold's confidence up.
    """
    # A product with a parameter table of a few rows.
    each = candidates.crossJoin(F.broadcast(thresholds))
    kept = each.withColumn("kept", F.coalesce(F.col("is_event") | (F.col("confidence") < F.col("threshold")), F.lit(True)))
    counts = kept.groupBy("threshold").agg(F.count(F.lit(1)).alias("total"), F.count_if("kept").alias("kept"))
    return counts.join(golden_score(kept.where("kept").drop("kept"), golden, keys, width, ["threshold"]), "threshold", "left")
