"""Threshold crossings to peak events, and corroboration of one signal by another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import scan
from tidemark.operators.ranges import levels_for, points_in_intervals


def rms_mask(value: str, threshold: str, min_score: float, floor: float) -> Column:
    """The excess is min_score or more, and the value strictly over the floor."""
    return (F.col(value) - F.col(threshold) >= min_score) & (F.col(value) > floor)


def flux_mask(value: str, threshold: str, min_score: float) -> Column:
    return F.col(value) - F.col(threshold) >= min_score


def run_apexes(trace: DataFrame, keys: list[str], order: list[str], mask: Column, value: str, threshold: str, ranges: scan.Ranges | None = None) -> DataFrame:
    """A row for each run of rows in the mask: that of the largest value, the first of equals.

    ``score`` is the value over the threshold at that row, and ``run_length`` the run's rows.
    With ``ranges`` a long trace is cut up, and a run's rows meet as partial results only.
    """
    flagged = scan.lagged(trace.withColumn("__m", F.coalesce(mask, F.lit(False))), keys, order, "__m", "__was", ranges)
    flagged = flagged.withColumn("__new", (F.col("__m") & ~F.coalesce("__was", F.lit(False))).cast("int"))
    flagged = scan.running_count(flagged, keys, order, "__new", "run", ranges).where("__m").drop("__m", "__was", "__new", scan.RANGE)
    if ranges is None or ranges.table is None:
        top = Window.partitionBy(*keys, "run").orderBy(F.col(value).desc(), *order)
        ranked = flagged.withColumn("__r", F.row_number().over(top)).withColumn("run_length", F.count(F.lit(1)).over(Window.partitionBy(*keys, "run")))
        ranked = ranked.where("__r = 1").drop("__r")
    else:
        first = F.min_by(F.struct(*[F.col(c) for c in flagged.columns]), F.struct((-F.col(value)).alias("v"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)]))
        ranked = flagged.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("run").alias("__run")).agg(first.alias("__top"), F.count(F.lit(1)).alias("run_length")).select("__top.*", "run_length")
    return ranked.withColumn("score", F.col(value) - F.col(threshold))


def corroborated(events: DataFrame, others: DataFrame, keys: list[str], at: str, before, after, width) -> DataFrame:
    """Events with one of ``others`` in [at - before, at + after], both ends included."""
    windows = others.select(*keys, (F.col(at) - after).alias("start"), (F.col(at) + before).alias("end"))
    return points_in_intervals(events, windows, keys, at, "start", "end", width, "left_semi", levels_for(before + after, width))


#: Strategy name -> function of a trace (and its settings) that returns peaks.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def strategy(name: str):
    def register(f):
        STRATEGIES[name] = f
        return f

    return register


def analyze(name: str, *args, **kwargs) -> DataFrame:
    """Run a registered strategy; an unknown name is an error."""
    if name not in STRATEGIES:
        raise ValueError(f"no strategy is called {name}")
    return STRATEGIES[name](*args, **kwargs)


@strategy("rms_energy")
def rms_energy(rms: DataFrame, keys: list[str], order: list[str], min_score: float, floor: float, ranges: scan.Ranges | None = None) -> DataFrame:
    return run_apexes(rms, keys, order, rms_mask("value", "threshold", min_score, floor), "value", "threshold", ranges)


@strategy("onset_flux")
def onset_flux(flux: DataFrame, keys: list[str], order: list[str], min_score: float, ranges: scan.Ranges | None = None) -> DataFrame:
    return run_apexes(flux, keys, order, flux_mask("value", "threshold", min_score), "value", "threshold", ranges)


@strategy("combined")
def combined(flux: DataFrame, rms: DataFrame, keys: list[str], at: str, before, after, width, flux_score: float, rms_score: float, floor: float) -> DataFrame:
    """Flux peaks near an RMS peak of the same chunk."""
    return corroborated(onset_flux(flux, keys, [at], flux_score), rms_energy(rms, keys, [at], rms_score, floor), keys, at, before, after, width)
