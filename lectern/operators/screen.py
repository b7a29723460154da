"""Robust screening of speaking rates: medians, outliers, neighbours, systematic failures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

LEAST_UNITS = 5  # a median of fewer units is not trusted
MOST_FLAGGED = 0.40  # a larger share of flagged units is a systematic failure


def rate(words: Column, seconds: Column) -> Column:
    """Words a second; 0 without a usable duration, which no screen lets pass."""
    return F.when(seconds > 0, words / seconds).otherwise(F.lit(0.0))


def auto_rate(words: Column, seconds: Column, default: Column) -> Column:
    """A chapter's own rate at three places, the default one where there are no words or no seconds."""
    return F.when((seconds > 0) & (words > 0), F.round(words / seconds, 3)).otherwise(default)


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def median_mad(units: DataFrame, book: str = "book_id", value: str = "wps") -> DataFrame:
    """Per book: count of finite values, their median and the median distance from it.

    Both medians come from one array of the book's rates, so a book is shuffled once.
    """
    own = units.groupBy(book).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(_finite(F.col(value)), F.col(value)))).alias("_v"))
    middle = lambda a: F.when(F.size(a) == 0, F.lit(0.0)).otherwise((F.get(a, F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(a, F.floor(F.size(a) / 2).cast("int"))) / 2)
    own = own.withColumn("median", middle(F.col("_v")))
    own = own.withColumn("_d", F.array_sort(F.transform("_v", lambda x: F.abs(x - F.col("median")))))
    return own.select(book, "n", F.size("_v").cast("long").alias("n_finite"), "median", middle(F.col("_d")).alias("mad"))


def check_thresholds(tol: float, low: float, high: float) -> None:
    if not (math.isfinite(tol) and tol >= 0):
        raise ValueError(f"the tolerance must be finite and not negative: {tol}")
    if not (math.isfinite(low) and math.isfinite(high)):
        raise ValueError(f"the band must be finite: {low} to {high}")
    if low > high:
        raise ValueError(f"the band is inverted: {low} to {high}")


def wps_gate(units: DataFrame, tol: float = 0.35, low: float = 1.7, high: float = 3.5) -> DataFrame:
    """Every unit (book_id, idx, label, wps) with ``reason`` (null if it passes), ``dev``, ``cause`` and ``rank``.

    Reasons, the first that holds: non-finite, relative (from the book's median), absolute (outside the band),
    association (a neighbour on the other side of the median of a unit flagged otherwise). Books of fewer than
    five finite rates know the absolute band only.
    """
    check_thresholds(tol, low, high)
    stats = median_mad(units).withColumn("too_few", F.col("n_finite") < LEAST_UNITS)
    w, m = F.col("wps"), F.col("median")
    good = _finite(w)
    first = (
        F.when(~good, "non-finite")
        .when(~F.col("too_few") & (m > 0) & (F.abs(w - m) / m > tol), "relative")
        .when((w < low) | (w > high), "absolute")
    )
    own = units.join(stats, "book_id").withColumn("_first", first)
    order = Window.partitionBy("book_id").orderBy("idx")

    def pulls(step):
        other, reason = step("wps").over(order), step("_first").over(order)
        return reason.isNotNull() & ~F.isnan(other) & ~F.isnan(w) & ((other - m) * (w - m) < 0)

    beside = F.coalesce(pulls(F.lag), F.lit(False)) | F.coalesce(pulls(F.lead), F.lit(False))
    reason = F.coalesce("_first", F.when(~F.col("too_few") & (m > 0) & beside, F.lit("association")))
    own = own.withColumn("reason", reason)
    dev = F.when(~good, F.lit(float("nan"))).when(m > 0, (w - m) / m).otherwise(F.lit(0.0))
    cause = F.when(F.col("reason").isNull(), F.lit(None).cast("string")).when(good & (w >= m), "squished").otherwise("slack")
    by = Window.partitionBy("book_id", F.col("reason").isNull()).orderBy(F.when(good, 1).otherwise(0), F.when(good, -F.abs(w - m)), "idx")
    return own.withColumn("dev", dev).withColumn("cause", cause).withColumn("rank", F.when(F.col("reason").isNotNull(), F.row_number().over(by).cast("long"))).drop("_first")


def wps_header(screened: DataFrame, low: float = 1.7, high: float = 3.5) -> DataFrame:
    """One row per book of ``wps_gate``: counts, systematic failure and the verdict."""
    own = screened.groupBy("book_id").agg(F.first("n").alias("n"), F.first("n_finite").alias("n_finite"), F.first("median").alias("median"), F.first("mad").alias("mad"), F.first("too_few").alias("too_few"), F.count("reason").alias("n_flagged"))
    why = F.when(F.col("too_few"), F.lit(None).cast("string")).when(~F.col("median").between(low, high), "band").when(F.col("n_flagged") > MOST_FLAGGED * F.col("n"), "majority")
    own = own.withColumn("systematic_reason", why).withColumn("systematic", F.col("systematic_reason").isNotNull())
    return own.withColumn("ok", (F.col("n_flagged") == 0) & ~F.col("systematic"))


def adjacent_pairs(screened: DataFrame) -> DataFrame:
    """Neighbours that are both flagged for opposite causes: (book_id, idx, low_idx, high_idx)."""
    order = Window.partitionBy("book_id").orderBy("idx")
    flagged = screened.where(F.col("reason").isNotNull())
    own = flagged.withColumn("_i", F.lead("idx").over(order)).withColumn("_c", F.lead("cause").over(order))
    own = own.where((F.col("_i") == F.col("idx") + 1) & (F.col("_c") != F.col("cause")))
    slack = F.col("cause") == "slack"
    return own.select("book_id", "idx", F.when(slack, F.col("idx")).otherwise(F.col("_i")).alias("low_idx"), F.when(slack, F.col("_i")).otherwise(F.col("idx")).alias("high_idx"))


def wps_advisory(units: DataFrame, tol: float = 0.15, mad_k: float | None = None) -> DataFrame:
    """The advisory screen: rates rounded to 3 places and null without words or seconds, deviations in percent and in MADs."""
    w = F.when((F.col("seconds") > 0) & (F.col("words") > 0), F.round(F.col("words") / F.col("seconds"), 3))
    own = units.withColumn("wps", w)
    own = own.join(median_mad(own.where(F.col("wps").isNotNull())).select("book_id", "median", F.when(F.col("mad") == 0, 1e-9).otherwise(F.col("mad")).alias("mad")), "book_id", "left")
    own = own.withColumn("dev_pct", (F.col("wps") - F.col("median")) / F.col("median") * 100).withColumn("dev_mad", (F.col("wps") - F.col("median")) / F.col("mad"))
    flag = F.abs("dev_pct") > tol * 100
    if mad_k:
        flag = flag | (F.abs("dev_mad") >= mad_k)
    return own.withColumn("flagged", F.coalesce(flag, F.lit(False)))


def starved(words: Column, seconds: Column, wps: Column, share: Column) -> Column:
    """Whether a step committed too few words for the audio it took."""
    return (seconds > 0) & (words < share * wps * seconds)


def durations(units: DataFrame, audio: DataFrame, manifest: DataFrame, planned: DataFrame) -> DataFrame:
    """Minutes of each unit's track from audio, else the manifest, else the planned span; the rate is 0 if unmeasured."""
    own = units.join(audio.select("track", (F.col("dur_sec") / 60).alias("_a")), "track", "left")
    own = own.join(manifest.select("track", F.col("minutes").alias("_m")), "track", "left").join(planned.select("track", ((F.col("end") - F.col("start")) / 60).alias("_p")), "track", "left")
    minutes = F.coalesce("_a", "_m", "_p")
    own = own.withColumn("minutes", F.when(minutes > 0, minutes)).drop("_a", "_m", "_p")
    return own.withColumn("measured", F.col("minutes").isNotNull()).withColumn("wps", F.coalesce(rate(F.col("words"), F.col("minutes") * 60), F.lit(0.0)))


def units_from_documents(tables: dict[str, DataFrame], audio: DataFrame, manifest: DataFrame, planned: DataFrame, key: str = "doc_key") -> DataFrame:
    """Units of per-track documents: label, words of all segments, and minutes of the track by ``durations``.

    tables: docs with title and ``track``, segments with text; the track's number is the join key of the three sources.
    """
    n = tables["segments"].groupBy(key).agg(F.sum(T.alignable(F.col("text"))).alias("words"))
    own = tables["docs"].join(n, key, "left").select(key, "track", F.col("title").alias("label"), F.coalesce("words", F.lit(0)).alias("words"))
    return durations(own, audio, manifest, planned)


def coverage(books: DataFrame) -> DataFrame:
    """Verdict of each aligned book: fail without aligned words, gap if the text ran out long before the audio.

    Columns: aligned, pending (words), audio_total, last_end (seconds). Text that is left over is no failure.
    """
    gap = F.col("audio_total") - F.col("last_end")
    code = F.when(F.col("aligned") == 0, 1).when((F.col("pending") == 0) & (gap > F.greatest(F.lit(120.0), 0.02 * F.col("audio_total"))), 3).otherwise(0)
    return books.withColumn("gap", gap).withColumn("code", code)


def gate(rows: DataFrame, by: list[str], failed: str, most: float) -> DataFrame:
    """Share of failed rows per group and whether it is too large; a group without rows can't pass."""
    own = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(failed)).alias("n_failed"))
    share = F.when(F.col("n") > 0, F.col("n_failed") / F.col("n")).otherwise(F.lit(1.0))
    return own.withColumn("fail_share", share).withColumn("ok", F.col("fail_share") <= most)
