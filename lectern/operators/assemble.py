"""From word times to segments, and the sums that decide how much of a window fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assemble(tokens: DataFrame, by: list[str], truncate: bool = True) -> DataFrame:
    """Segments (seg, start, end, n_words, words) from tokens (seg, pos, w, nw, status, s, e).

    Sentences from the first one that holds a pending alignable token are left out (not with ``truncate`` false).
    Tokens without a time stand with zero width at the end of the timed one before them in the sentence, else at
    the sentence's first time, else at the latest end of all sentences before. Ends are rounded to 3 places
    before they are carried on.
    """
    timed = F.col("status") == "ALIGNED"
    own = tokens
    if truncate:
        cut = tokens.where((F.col("status") == "PENDING") & (F.col("nw") != "")).groupBy(*by).agg(F.min("seg").alias("_cut"))
        own = own.join(cut, by, "left").where(F.col("_cut").isNull() | (F.col("seg") < F.col("_cut"))).drop("_cut")
    sums = own.groupBy(*by, "seg").agg(F.min_by(F.when(timed, F.col("s")), F.when(timed, F.col("pos"))).alias("_seed"), F.max(F.when(timed, F.round("e", 3))).alias("_top"))
    before = Window.partitionBy(*by).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_last", F.coalesce(F.max("_top").over(before), F.lit(0.0))).withColumn("_seed", F.coalesce("_seed", "_last")).select(*by, "seg", "_seed", "_last")
    own = own.join(sums, [*by, "seg"])
    prior = Window.partitionBy(*by, "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev = F.coalesce(F.last(F.when(timed, F.col("e")), ignorenulls=True).over(prior), F.col("_seed"))
    own = own.withColumn("_s", F.round(F.when(timed, F.col("s")).otherwise(prev), 3)).withColumn("_e", F.round(F.when(timed, F.col("e")).otherwise(prev), 3))
    words = F.array_sort(F.collect_list(F.struct("pos", "w", F.col("_s").alias("s"), F.col("_e").alias("e"))))
    return own.groupBy(*by, "seg").agg(
        F.round(F.min_by("_s", "pos"), 3).alias("start"), F.round(F.max("_e"), 3).alias("end"), F.count("*").alias("n_words"), F.transform(words, lambda x: x.dropFields("pos")).alias("words"),
    )


def tail_fit(queue: DataFrame, by: list[str], frames: str = "frames") -> DataFrame:
    """How many queued words fit a window of ``frames``: the most whose letters and repeated letters do.

    Columns: pos, nw, frames. Repeats are neighbouring equal letters of the joined words.
    """
    order = Window.partitionBy(*by).orderBy("pos")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    letters = F.split("nw", "")
    inner = F.size(F.filter(letters, lambda c, i: (i > 0) & (c == F.get(letters, i - 1))))
    across = F.coalesce((F.right(F.lag("nw").over(order), F.lit(1)) == F.left("nw", F.lit(1))).cast("int"), F.lit(0))
    own = queue.withColumn("_across", across).withColumn("_need", F.length("nw") + inner + F.col("_across"))
    own = own.withColumn("_sum", F.sum("_need").over(run))
    return own.groupBy(*by).agg(F.count_if(F.col("_sum") <= F.col(frames)).alias("n_fit"), F.count("*").alias("n_queued"))


def sub_chunks(windows: DataFrame, sub_ms: int, least_ms: int = 500) -> DataFrame:
    """The chunks of each window (dur_ms): a last one shorter than ``least_ms`` is left out, unless it is the first."""
    own = windows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("dur_ms") / sub_ms) - 1, F.lit(0)))))
    own = own.withColumn("c0", F.col("chunk") * sub_ms).withColumn("c1", F.least(F.col("c0") + sub_ms, "dur_ms"))
    return own.where((F.col("chunk") == 0) | (F.col("c1") - F.col("c0") >= least_ms))


def tail_slice(samples, end_ms, rate_hz, keep_ms, t0, t1):
    """The part [t0, t1) of a kept tail of samples that ends at ``end_ms``; null if the tail doesn't hold all of it."""
    kept = F.slice(samples, F.greatest(F.size(samples) - (keep_ms * rate_hz / 1000).cast("int") + 1, F.lit(1)), (keep_ms * rate_hz / 1000).cast("int"))
    start = end_ms - F.size(kept) * 1000 / rate_hz
    first = F.round((t0 - start) * rate_hz / 1000).cast("int")
    n = F.round((t1 - t0) * rate_hz / 1000).cast("int")
    return F.when((t0 >= start) & (t1 <= end_ms), F.slice(kept, first + 1, n))
