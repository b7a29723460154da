"""Drift profiles: probe grids, text under a window, smoothed overlap, flagged runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import timeline


def dense_grid(tracks: DataFrame, interval_ms: int, win_ms: int) -> DataFrame:
    """Probe windows (i, t0, t1) at every interval up to the last one that fits; one at 0 for short tracks."""
    last = F.greatest(F.col("dur_ms") - win_ms, F.lit(0))
    own = tracks.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / interval_ms))))
    return own.withColumn("t0", F.least(F.col("i") * interval_ms, last)).withColumn("t1", F.col("t0") + win_ms)


def capped(probes: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most ``most`` evenly spread probes of each group, first and last among them."""
    n = F.count("*").over(Window.partitionBy(*by))
    marks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.bround(j * (n - 1) / max(most - 1, 1)).cast("long"))
    return probes.withColumn("_keep", (n <= most) | F.array_contains(marks, F.col("i"))).where("_keep").drop("_keep")


def sparse_grid(tracks: DataFrame, points: int, win_ms: int) -> DataFrame:
    """``points`` probes between 2 % and 96 % of each track, in tenths of a second."""
    own = tracks.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    share = F.lit(0.02) + F.col("i") * 0.94 / max(points - 1, 1)
    t0 = F.least(share * F.col("dur_ms"), (F.col("dur_ms") - win_ms).cast("double"))
    return own.withColumn("t0", (F.round(t0 / 100) * 100).cast("long"))


def spread(rows: DataFrame, by: list[str], order: str, most: int = 6) -> DataFrame:
    """Up to ``most`` rows of each group, evenly over its sorted rows."""
    own = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    k = F.least(F.col("_n"), F.lit(most))
    marks = F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda j: F.bround(F.when(k > 1, j * (F.col("_n") - 1) / (k - 1)).otherwise(F.lit(0.0))).cast("long"))
    return own.where(F.array_contains(marks, F.col("_i").cast("long"))).drop("_i", "_n")


def aligned_window(probes: DataFrame, segments: DataFrame, by: list[str], width: int) -> DataFrame:
    """The text under each window (t0, t1): all segments that touch it, in order; if none does, the one whose
    middle is nearest the window's start.

    Segments touch windows in bins of ``width`` ms, so no track is compared with all its windows.
    """
    keys = [*by, "i"]
    spans = segments.select(*by, "id", "start_ms", "end_ms", F.col("text").alias("_text"))
    both = timeline.interval_join(probes.select(*keys, "t0", "t1"), spans, by, ("t0", "t1"), ("start_ms", "end_ms"), width, closed=True)
    found = both.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "_text"))), lambda x: x["_text"]), " ").alias("_found"))
    own = probes.join(found, keys, "left")
    empty = own.where(F.col("_found").isNull()).drop("_found")
    middles = spans.withColumn("_mid", F.col("start_ms") + F.col("end_ms")).withColumn("id", F.col("id"))
    doubled = empty.withColumn("_twice", F.col("t0") * 2)
    near = timeline.nearest(doubled, middles, by, "_twice", "_mid", "_id").drop("_twice")
    near = near.join(spans.select(*by, F.col("id").alias("_id"), "_text"), [*by, "_id"], "left").drop("_id")
    return own.where(F.col("_found").isNotNull()).withColumnRenamed("_found", "aligned").unionByName(near.withColumnRenamed("_text", "aligned"))


def rolling_median(rows: DataFrame, by: list[str], order: str, value: str, k: int, out: str = "smoothed") -> DataFrame:
    """A centred median over k rows, fewer at the ends; an even k counts as k + 1."""
    if k <= 1:
        return rows.withColumn(out, F.col(value))
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-(k // 2), k // 2)
    return rows.withColumn(out, F.percentile(F.col(value), F.lit(0.5)).over(frame))


def flagged_runs(windows: DataFrame, by: list[str], below: float) -> DataFrame:
    """Runs of neighbouring windows whose smoothed overlap is below a threshold (islands of row numbers)."""
    order = Window.partitionBy(*by).orderBy("i")
    own = windows.withColumn("_n", F.row_number().over(order)).where(F.col("smoothed") < below)
    own = own.withColumn("_g", F.col("_n") - F.row_number().over(order))
    return own.groupBy(*by, "_g").agg(
        F.min("i").alias("i_start"), F.min("t0").alias("t_start"), F.max_by("t1", "i").alias("t_end"), F.count("*").alias("n_windows"),
        F.round(F.min("overlap"), 3).alias("min_overlap"), F.round(F.sum("overlap") / F.count("*"), 3).alias("mean_overlap"),
    ).drop("_g")


def longest_run(runs: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """Each group's longest run, the first on ties, and the first segment that starts in or after it."""
    order = Window.partitionBy(*by).orderBy(F.desc("n_windows"), "i_start")
    best = runs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    begins = segments.groupBy(*by, "start_ms").agg(F.min("id").alias("suggest_seg"))
    turned = begins.select(*by, (-F.col("start_ms")).alias("_s"), "suggest_seg")
    found = timeline.range_assign(best.withColumn("_t", -F.col("t_start")), turned, by, "_t", "_s", ["_s", "suggest_seg"])  # the next start
    return found.drop("_t", "_s")


def windows_of_runs(windows: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Flagged windows that start within a run's span; overlapping windows may reach past the run."""
    own = windows.where("flagged").select(*by, "i", "t0", "overlap")
    spans = runs.select(*by, "i_start", "t_start", "t_end")
    width = spans.agg(F.max(F.col("t_end") - F.col("t_start"))).first()[0]  # one number: bins as wide as the longest run
    both = timeline.interval_join(own.withColumn("_t1", F.col("t0")), spans, by, ("t0", "_t1"), ("t_start", "t_end"), max(1, width or 1), closed=True)
    return both.drop("_t1", "t_start", "t_end")


def flagged(smoothed: Column, below: float) -> Column:
    return smoothed < below


def word_counts(windows: DataFrame, aligned: str = "align_text", heard: str = "heard_text") -> DataFrame:
    """Adds n_aligned and n_heard: the distinct words of each window's text and of what was heard there."""
    count = lambda c: F.coalesce(F.size(F.array_distinct(T.words_of(F.col(c)))).cast("long"), F.lit(0).cast("long"))
    return windows.withColumn("n_aligned", count(aligned)).withColumn("n_heard", count(heard))
