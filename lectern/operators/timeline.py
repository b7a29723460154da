"""Timeline algebra: offsets, range assignment, interval joins, splitting and joining of tracks.

Times are whole milliseconds where rows meet, so that every comparison is exact. All window functions carry a
book or track key; there is no window over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cumulative(rows: DataFrame, by: list[str], order: str, length: str, out: str = "offset") -> DataFrame:
    """Adds the sum of ``length`` over the rows before, 0 for the first."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(length).over(before), F.lit(0)))


def renumber(rows: DataFrame, by: list[str], order: list, out: str = "id") -> DataFrame:
    """Dense numbers from 0 in the given order."""
    return rows.withColumn(out, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def range_assign(rows: DataFrame, bounds: DataFrame, by: list[str], at: str, start: str, take: list[str]) -> DataFrame:
    """For each row the bound of the greatest ``start`` at or before ``at`` (an as-of join backward), null if none.

    One sort instead of a range join: bounds and rows are stacked, and each row takes the last bound before it.
    Of equal starts the greatest of ``take`` counts.
    """
    known = F.struct(*[F.col(c) for c in take])
    kind = known.cast(bounds.select(known).schema[0].dataType)
    left = bounds.select(*by, F.col(start).alias("_at"), F.lit(0).alias("_side"), kind.alias("_b"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("_r"))
    right = rows.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(bounds.select(known).schema[0].dataType).alias("_b"), F.struct(*rows.columns).alias("_r"))
    order = Window.partitionBy(*by).orderBy("_at", "_side", "_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = left.unionByName(right).withColumn("_last", F.last("_b", ignorenulls=True).over(order)).where(F.col("_side") == 1)
    return own.select(*[F.col(f"_r.{c}").alias(c) for c in rows.columns], *[F.col(f"_last.{c}").alias(f"{c}" if c not in rows.columns else f"bound_{c}") for c in take])


def words_to_segments(words: DataFrame, segments: DataFrame, by: list[str], slack: int = 250) -> DataFrame:
    """The segment of each word by time: the first id whose end lies after the word's start, dropped if the
    segment starts more than ``slack`` later.

    As a skipped segment never takes a later word, the first id with a later end is the first place where the
    running maximum of the ends exceeds the start. Running maxima rise, so this is an as-of join forward.
    """
    order = Window.partitionBy(*by).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("id")
    tops = segments.withColumn("_top", F.max("end_ms").over(order))
    tops = tops.withColumn("_was", F.lag("_top").over(before)).where(F.col("_was").isNull() | (F.col("_top") > F.col("_was")))
    # a word at s belongs to the first top > s: the one whose predecessor's top is the greatest at or before s
    tops = tops.select(*by, "id", "start_ms", F.coalesce("_was", F.lit(-(1 << 62))).alias("_from"))
    found = range_assign(words, tops, by, "s_ms", "_from", ["_from", "id", "start_ms"])
    ends = segments.groupBy(*by).agg(F.max("end_ms").alias("_last"))
    found = found.join(ends, by).where((F.col("s_ms") < F.col("_last")) & (F.col("s_ms") >= F.col("start_ms") - slack))
    return found.drop("_from", "_last", "start_ms")


def markers_to_segments(markers: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """Chapter markers with their segment's start; ``dropped`` tells those outside the segments. ``first_line``
    stands in for a missing ``seg``."""
    own = markers.withColumn("seg", F.coalesce("seg", "first_line")).withColumn("title", F.coalesce(F.trim("title"), F.lit("Chapter")))
    found = own.join(segments.select(*by, F.col("id").alias("seg"), F.col("start_ms").alias("start")), [*by, "seg"], "left")
    return found.withColumn("dropped", F.col("start").isNull())


def split_local(segments: DataFrame, tracks: DataFrame, book: str = "book_id") -> DataFrame:
    """Segments of a whole book in their track's own time: shifted, held within the track, ids from the track's first."""
    spans = cumulative(tracks, [book], "track", "dur_ms", "t0")
    own = range_assign(segments, spans.select(book, "track", "t0", "dur_ms"), [book], "start_ms", "t0", ["t0", "track", "dur_ms"]).where(F.col("track").isNotNull())
    hold = lambda x: F.least(F.greatest(x - F.col("t0"), F.lit(0)), F.col("dur_ms"))
    first = F.min("id").over(Window.partitionBy(book, "track"))
    return own.select(book, "track", "id", (F.col("id") - first).alias("local_id"), hold(F.col("start_ms")).alias("start_ms"), hold(F.col("end_ms")).alias("end_ms"))


def reconcile(segments: DataFrame, split: DataFrame, book: str = "book_id") -> DataFrame:
    """Whether every segment of a book is in exactly one track."""
    a, b = segments.groupBy(book).agg(F.count("*").alias("n_segments")), split.groupBy(book).agg(F.count("*").alias("n_split"), F.countDistinct("id").alias("n_ids"))
    own = a.join(b, book, "left").withColumn("n_split", F.coalesce("n_split", F.lit(0))).withColumn("n_ids", F.coalesce("n_ids", F.lit(0)))
    return own.withColumn("ok", (F.col("n_segments") == F.col("n_split")) & (F.col("n_split") == F.col("n_ids")))


def recombine(parts: DataFrame, groups: DataFrame, tolerance: int = 5000, book: str = "book_id") -> DataFrame:
    """Segments of chapters in the book's time, renumbered; ``fits`` is false where one ends too long after its group."""
    starts = cumulative(groups, [book], "part", "dur_ms", "offset")
    own = parts.join(starts, [book, "part"])
    own = own.withColumn("fits", F.col("end_ms") <= F.col("dur_ms") + tolerance)
    own = own.withColumn("start_ms", F.col("start_ms") + F.col("offset")).withColumn("end_ms", F.col("end_ms") + F.col("offset"))
    return renumber(own.withColumnRenamed("id", "local_id"), [book], ["part", "local_id"]).drop("dur_ms", "offset")


def exactly_once(expected: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Keys with ``reason`` missing, duplicate or extra; none if every expected key is found once."""
    n = found.groupBy(*by).agg(F.count("*").alias("_n"))
    own = expected.select(*by).distinct().withColumn("_e", F.lit(True)).join(n, by, "full")
    reason = F.when(F.col("_n").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_n") > 1, "duplicate")
    return own.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_n", "_e")


def interval_join(a: DataFrame, b: DataFrame, by: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int, closed: bool = False) -> DataFrame:
    """Pairs of rows with the same key whose spans overlap: half-open, or ``closed`` at both ends.

    Both sides are dealt to bins of ``width`` that they touch, so the join is one on equal keys and never
    compares all pairs; a pair counts in the first bin that both touch.
    """
    end = 0 if closed else 1
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.greatest(F.col(e) - end, F.col(s)) / width)))
    left, right = a.withColumn("_bin", bins(*a_span)), b.withColumn("_bin", bins(*b_span))
    both = left.join(right, [*by, "_bin"])
    meets = (F.col(a_span[1]) >= F.col(b_span[0])) & (F.col(a_span[0]) <= F.col(b_span[1])) if closed else (F.col(a_span[1]) > F.col(b_span[0])) & (F.col(a_span[0]) < F.col(b_span[1]))
    return both.where(meets & (F.col("_bin") == F.floor(F.greatest(a_span[0], b_span[0]) / width))).drop("_bin")


def clip_spans(spans: DataFrame, tracks: DataFrame, width: int, book: str = "book_id") -> DataFrame:
    """The part of each span (s_ms, e_ms) in each track it crosses, in the track's own time."""
    own = cumulative(tracks, [book], "track", "dur_ms", "g0").withColumn("g1", F.col("g0") + F.col("dur_ms"))
    both = interval_join(spans, own, [book], ("s_ms", "e_ms"), ("g0", "g1"), width)
    return both.withColumn("in_ms", F.greatest("s_ms", "g0") - F.col("g0")).withColumn("out_ms", F.least("e_ms", "g1") - F.col("g0")).drop("g0", "g1", "dur_ms")


def nearest(rows: DataFrame, segments: DataFrame, by: list[str], at: str, time: str, out: str) -> DataFrame:
    """For each row the segment with the nearest ``time``, the smallest id on ties: the last one before or the first one after."""
    one = segments.groupBy(*by, time).agg(F.min("id").alias("_id"))
    before = range_assign(rows, one.withColumnRenamed(time, "_t0").withColumnRenamed("_id", "_id0"), by, at, "_t0", ["_t0", "_id0"])
    turned = one.select(*by, (-F.col(time)).alias("_t1"), F.col("_id").alias("_id1"))
    both = range_assign(before.withColumn("_neg", -F.col(at)), turned, by, "_neg", "_t1", ["_t1", "_id1"])
    d0, d1 = F.col(at) - F.col("_t0"), -F.col("_t1") - F.col(at)
    pick = F.when(d1.isNull() | (d0 < d1), F.col("_id0")).when(d0.isNull() | (d1 < d0), F.col("_id1")).otherwise(F.least("_id0", "_id1"))
    return both.withColumn(out, pick).drop("_t0", "_id0", "_t1", "_id1", "_neg")


def backward(rows: DataFrame, by: list[str], order: str, value: str = "start_ms") -> DataFrame:
    """Rows whose value lies below the greatest one before, as ``top``: a timeline that steps back, which is worth a warning."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("top", F.max(value).over(before)).where(F.col(value) < F.col("top"))


def local_segments(chapters: DataFrame, split: DataFrame, by: list[str]) -> DataFrame:
    """Chapters (seg, start_ms in their track) with the segment of their track that they begin with, as ``local_seg``.

    The chapter's own segment if it lies in the track, else the one that starts nearest, the first on ties, else 0.
    """
    exact = split.select(*by, F.col("id").alias("seg"), F.col("local_id").alias("_exact"))
    own = chapters.join(exact, [*by, "seg"], "left")
    own = nearest(own, split.select(*by, F.col("local_id").alias("id"), "start_ms"), by, "start_ms", "start_ms", "_near")
    return own.withColumn("local_seg", F.coalesce("_exact", "_near", F.lit(0)).cast("long")).drop("_exact", "_near")


def shift(segments: DataFrame, low: Column, high: Column, delta: Column) -> DataFrame:
    """Segments with ids in the closed range moved by ``delta`` ms, held at 0, their words with them."""
    inside = F.col("id").between(low, high)
    moved = lambda x: F.when(inside, F.greatest(x + delta, F.lit(0))).otherwise(x)
    own = segments.withColumn("start_ms", moved(F.col("start_ms"))).withColumn("end_ms", moved(F.col("end_ms")))
    if "words" in segments.columns:
        own = own.withColumn("words", F.transform("words", lambda w: F.struct(w.w.alias("w"), moved(w.s_ms).alias("s_ms"), moved(w.e_ms).alias("e_ms"))))
    return own


def set_boundary(markers: DataFrame, segments: DataFrame, chapter: int, seg: int, title: str | None = None, by: str = "book_id") -> DataFrame:
    """Chapter ``chapter`` of every book begins at segment ``seg``; a chapter beyond the last is added in order of seg."""
    start = segments.where(F.col("id") == seg).select(by, F.col("start_ms").alias("_s"))
    own = markers.join(start, by, "left")
    hit = (F.col("idx") == chapter) & F.col("_s").isNotNull()
    own = own.withColumn("seg", F.when(hit, seg).otherwise(F.col("seg"))).withColumn("start_ms", F.when(hit, F.col("_s")).otherwise(F.col("start_ms")))
    if title is not None:
        own = own.withColumn("title", F.when(hit, F.lit(title)).otherwise(F.col("title")))
    books = markers.groupBy(by).agg(F.max("idx").alias("_m")).where(F.col("_m") < chapter).join(start, by)
    new = books.select(by, (F.col("_m") + 1).alias("idx"), F.lit(title or f"Chapter {chapter}").alias("title"), F.lit(seg).cast("long").alias("seg"), F.col("_s").alias("start_ms"))
    out = own.select(by, "idx", "title", F.col("seg").cast("long").alias("seg"), "start_ms").unionByName(new)
    grown = out.join(books.select(by, F.lit(True).alias("_g")), by, "left")
    order = Window.partitionBy(by).orderBy(F.when(F.col("_g"), F.col("seg")).otherwise(F.col("idx")), "idx")
    return grown.withColumn("idx", (F.row_number().over(order) - 1).cast("long")).drop("_g")


def stitch(first: DataFrame, second: DataFrame, dur_ms: DataFrame, by: str = "book_id") -> DataFrame:
    """Segments of two parts in one timeline: the second is moved by the first one's length, ids run on."""
    moved = second.join(dur_ms, by).select(by, "id", (F.col("start_ms") + F.col("dur_ms")).alias("start_ms"), (F.col("end_ms") + F.col("dur_ms")).alias("end_ms"))
    both = first.select(by, "id", "start_ms", "end_ms").withColumn("part", F.lit(1)).unionByName(moved.withColumn("part", F.lit(2)))
    return renumber(both.withColumnRenamed("id", "local_id"), [by], ["part", "local_id"])


def page_anchors(segments: DataFrame, by: str = "book_id") -> DataFrame:
    """For each page from 0 to the last: the first segment that starts on it, else the last one that starts before."""
    ends = segments.groupBy(by, "page").agg(F.min("seg").alias("_first"), F.max("seg").alias("_last"))
    pages = segments.groupBy(by).agg(F.max("page").alias("_m")).select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m"))).alias("page"))
    before = Window.partitionBy(by).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    own = pages.join(ends, [by, "page"], "left")
    return own.select(by, "page", F.coalesce("_first", F.max("_last").over(before), F.lit(0)).alias("seg"))


def column_of(x: Column, width: Column) -> Column:
    """The text column that a place in pixels belongs to; half a pixel of tolerance."""
    return F.greatest(F.lit(0), F.floor((x + 0.5) / width)).cast("long")
