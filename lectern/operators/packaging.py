"""Tables of contents, cut plans, merged units, manifests and incremental work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import timeline


def toc_order(nodes: DataFrame, by: list[str], chapter: str = r"/([a-z0-9-]+)/?$", volume: str = r"(?i)volume\s+(\d+)") -> DataFrame:
    """Chapter links in page order with the volume of the last heading before; of equal URLs the first stays.

    Columns of nodes: ord, kind (heading or link), text, href.
    """
    order = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.when(F.col("kind") == "heading", F.nullif(F.regexp_extract("text", volume, 1), F.lit("")).cast("long"))
    own = nodes.withColumn("volume", F.last(found, ignorenulls=True).over(order)).where("kind = 'link'")
    own = own.withColumn("slug", F.lower(F.regexp_extract("href", chapter, 1))).where("slug <> ''")
    own = own.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "href").orderBy("ord"))).where("_r = 1")
    return timeline.renumber(own, by, ["ord"], "idx").select(*by, "idx", "volume", "slug", F.col("href").alias("url"), F.col("text").alias("label"))


def toc_slice(toc: DataFrame, by: list[str], first: str, last: str) -> DataFrame:
    """Chapters from the first that ``first`` selects to the last that ``last`` selects, both included."""
    a, b = T.selector(F.lit(first)), T.selector(F.lit(last))
    ends = toc.groupBy(*by).agg(F.min(F.when(T.selects(F.col("slug"), a), F.col("idx"))).alias("_a"), F.max(F.when(T.selects(F.col("slug"), b), F.col("idx"))).alias("_b"))
    return toc.join(ends, by).where(F.col("idx").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def parse_merges(specs: DataFrame, by: list[str]) -> DataFrame:
    """Ranges (lo, hi) of specs such as ``i-j,k-l`` for n items, with ``error``: form, descending, range or overlap."""
    own = specs.select(*by, "n", F.explode(F.split("spec", ",")).alias("_p")).withColumn("_p", F.trim("_p")).where("_p <> ''")
    lo, hi = F.regexp_extract("_p", r"^\s*(\d+)\s*-\s*(\d+)\s*$", 1).try_cast("long"), F.regexp_extract("_p", r"^\s*(\d+)\s*-\s*(\d+)\s*$", 2).try_cast("long")
    own = own.withColumn("lo", lo).withColumn("hi", hi)
    before = F.max("hi").over(Window.partitionBy(*by).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    error = F.when(F.col("lo").isNull(), "form").when(F.col("lo") > F.col("hi"), "descending").when(F.col("hi") >= F.col("n"), "range").when(F.col("lo") <= before, "overlap")
    return own.withColumn("error", error).drop("_p")


def merged_groups(items: DataFrame, merges: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``group``: the first index of the merged range an item is in, else its own."""
    own = timeline.range_assign(items, merges.select(*by, "lo", "hi"), by, "idx", "lo", ["lo", "hi"])
    return own.withColumn("group", F.when(F.col("idx") <= F.col("hi"), F.col("lo")).otherwise(F.col("idx"))).drop("lo", "hi")


def units_from_boundaries(chapters: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Cut units of grouped chapters (idx, group, title, seg, start_ms): each ends where the next begins, the last at the
    end. ``error`` tells starts that don't ascend, lie beyond the end, or segments that descend."""
    order = Window.partitionBy(*by).orderBy("idx")
    own = chapters.join(totals, by)
    error = F.concat_ws(
        ",", F.when(F.col("start_ms") <= F.lag("start_ms").over(order), F.lit("start")), F.when(F.col("start_ms") >= F.col("total_ms"), F.lit("end")), F.when(F.col("seg") < F.lag("seg").over(order), F.lit("seg"))
    )
    own = own.withColumn("error", error)
    units = own.groupBy(*by, "group").agg(F.min_by("title", "idx").alias("title"), F.min_by("seg", "idx").alias("seg"), F.min_by("start_ms", "idx").alias("start_ms"), F.max("total_ms").alias("total_ms"), F.max("error").alias("error"), F.count("*").alias("n_chapters"))
    nxt = Window.partitionBy(*by).orderBy("group")
    units = units.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(nxt), F.col("total_ms"))).drop("total_ms")
    return timeline.renumber(units, by, ["group"], "unit").withColumn("unit", F.col("unit") + 1)


def units_from_marks(starts: DataFrame, marks: DataFrame, by: list[str]) -> DataFrame:
    """Units from chosen mark indices: mark ``raw_idx`` begins a unit, the next chosen one ends it. ``ok`` needs a
    known mark, ascending indices and a positive length. The file's end is the mark with a null title, if any."""
    order = Window.partitionBy(*by).orderBy("unit")
    own = starts.withColumn("_next", F.lead("raw_idx").over(order))
    ends = marks.groupBy(*by).agg(F.max("end_ms").alias("_end"))
    own = own.join(marks.select(*by, "raw_idx", "start_ms"), [*by, "raw_idx"], "left")
    own = own.join(marks.select(*by, F.col("raw_idx").alias("_next"), F.col("start_ms").alias("_n")), [*by, "_next"], "left").join(ends, by, "left")
    own = own.withColumn("end_ms", F.coalesce("_n", "_end"))
    ok = F.col("start_ms").isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col("raw_idx"))) & (F.col("end_ms") > F.col("start_ms"))
    return own.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_next", "_n", "_end")


def unit_markers(chapters: DataFrame, units: DataFrame, by: list[str]) -> DataFrame:
    """Chapter markers in the unit that holds their segment: local ordinals, held within the unit's sentences."""
    own = timeline.range_assign(chapters, units.withColumnRenamed("seg", "_u"), by, "seg", "_u", ["_u", "unit", "n_sentences"])
    held = F.least(F.greatest(F.col("seg") - F.col("_u"), F.lit(0)), F.greatest(F.col("n_sentences") - 1, F.lit(0)))
    return own.withColumn("local_seg", held).drop("_u", "n_sentences")


def track_map_errors(entries: DataFrame, by: list[str]) -> DataFrame:
    """Errors of a track map (idx, title, seg, tracks): empty, seg, descending, shared."""
    order = Window.partitionBy(*by).orderBy("idx")
    own = entries.withColumn("_p", F.lag("seg").over(order))
    one = F.when(F.coalesce(F.size("tracks"), F.lit(0)) < 1, "empty").when(F.col("seg").isNull(), "seg").when(F.col("seg") < F.col("_p"), "descending")
    lone = own.withColumn("error", one).where("error is not null").select(*by, "idx", "error", F.lit(None).cast("long").alias("track"))
    each = entries.select(*by, "idx", F.explode("tracks").alias("track"))
    n = F.count("*").over(Window.partitionBy(*by, "track"))
    return lone.unionByName(each.withColumn("_n", n).where("_n > 1").select(*by, "idx", F.lit("shared").alias("error"), F.col("track").cast("long").alias("track")))


def stale(wanted: DataFrame, done: DataFrame, by: list[str], least_size: int = 1000) -> DataFrame:
    """Work that has no output as new as its inputs and of enough size (columns input_time, output_time, size)."""
    good = done.where(F.col("size") > least_size).select(*by, "output_time")
    own = wanted.join(good, by, "left")
    return own.where(F.col("output_time").isNull() | (F.col("output_time") < F.col("input_time")))


def manifest(segments: DataFrame, markers: DataFrame, tracks: DataFrame, book: str = "book_id") -> DataFrame:
    """One row per track: minutes, sentences and the markers as an ordered array."""
    n = segments.groupBy(book, "track").agg(F.count("*").alias("sentences"))
    m = markers.groupBy(book, "track").agg(F.array_sort(F.collect_list(F.struct("start_ms", "title"))).alias("chapters"))
    own = tracks.join(n, [book, "track"], "left").join(m, [book, "track"], "left")
    return own.select(book, "track", F.round(F.col("dur_ms") / 60000, 1).alias("minutes"), F.coalesce("sentences", F.lit(0)).alias("sentences"), F.coalesce("chapters", F.array().cast("array<struct<start_ms:long,title:string>>")).alias("chapters"))


def patched(manifest_: DataFrame, news: DataFrame, by: list[str]) -> DataFrame:
    """A manifest with the sentences and chapters of corrected tracks."""
    own = manifest_.join(news.select(*by, F.col("sentences").alias("_s"), F.col("chapters").alias("_c")), by, "left")
    return own.withColumn("sentences", F.coalesce("_s", "sentences")).withColumn("chapters", F.coalesce("_c", "chapters")).drop("_s", "_c")


def text_slices(entries: DataFrame, sentences: DataFrame, by: list[str]) -> DataFrame:
    """Sentences (seg) with the entry (idx, seg) of the track map whose slice they lie in; the last one runs to the end."""
    starts = entries.select(*by, "idx", F.col("seg").alias("_from"))
    return timeline.range_assign(sentences, starts, by, "seg", "_from", ["_from", "idx"]).where("idx IS NOT NULL").drop("_from")


def units_from_track_map(entries: DataFrame, sentences: DataFrame, audio: DataFrame, by: list[str], words: str = "n_words") -> DataFrame:
    """Units of a track map (idx, title, seg, tracks): words of their slice, seconds of their tracks and the rate.

    sentences: seg and its alignable words; audio: track, dur_sec. ``error`` names what makes a map unusable: a start that
    descends or lies beyond the text, a track without audio. A chapter's rate is 0 without words or seconds.
    """
    order = Window.partitionBy(*by).orderBy("idx")
    total = sentences.groupBy(*by).agg((F.max("seg") + 1).alias("_total"))
    own = entries.join(total, by, "left").withColumn("_next", F.coalesce(F.lead("seg").over(order), "_total"))
    said = text_slices(entries, sentences, by).groupBy(*by, "idx").agg(F.sum(words).alias("words"))
    each = entries.select(*by, "idx", F.explode("tracks").alias("track")).join(audio, [*by, "track"], "left")
    heard = each.groupBy(*by, "idx").agg(F.sum("dur_sec").alias("seconds"), F.count_if(F.col("dur_sec").isNull()).alias("_none"))
    own = own.join(said, [*by, "idx"], "left").join(heard, [*by, "idx"], "left")
    own = own.withColumn("words", F.coalesce("words", F.lit(0))).withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))
    error = F.when(F.col("_next").isNull() | (F.col("_next") < F.col("seg")), "order").when(F.coalesce("_none", F.lit(0)) > 0, "track")
    rate = F.when((F.col("words") > 0) & (F.col("seconds") > 0), F.col("words") / F.col("seconds")).otherwise(F.lit(0.0))
    return own.select(*by, "idx", F.col("title").alias("label"), "words", "seconds", (F.col("seconds") / 60).alias("minutes"), rate.alias("wps"), error.alias("error"))


def volume_counts(toc: DataFrame, by: list[str]) -> DataFrame:
    """Chapters of each volume; those under no volume have a null one."""
    return toc.groupBy(*by, "volume").agg(F.count("*").alias("n"))


def single_marker(units: DataFrame, segments: DataFrame, markers: DataFrame, by: list[str]) -> DataFrame:
    """The markers of each unit, or one with the unit's title at its first segment where it has none."""
    first = segments.groupBy(*by, "unit").agg(F.min_by("start_ms", "id").alias("start_ms"))
    bare = units.join(markers.select(*by, "unit").distinct(), [*by, "unit"], "left_anti").join(first, [*by, "unit"])
    own = bare.select(*by, "unit", "title", "start_ms", F.lit(0).cast("long").alias("seg"))
    return markers.select(*by, "unit", "title", "start_ms", F.col("seg").cast("long")).unionByName(own)


def openings(chapters: DataFrame, lines: DataFrame, by: list[str], n_lines: int = 6, n_words: int = 45) -> DataFrame:
    """The first words of each chapter (title, seg), from its first lines (seg, line), as one text; empty beyond the end."""
    asked = chapters.select(*by, "title", F.col("seg").alias("_c"), F.explode(F.sequence(F.col("seg"), F.col("seg") + n_lines - 1)).alias("seg"))
    own = asked.join(lines.select(*by, "seg", "line"), [*by, "seg"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("seg", "line")))), lambda x: x["line"]), " ")
    own = own.groupBy(*by, "title", F.col("_c").alias("seg")).agg(text.alias("_t"))
    return own.select(*by, "title", "seg", F.array_join(F.slice(T.tokens(F.col("_t")), 1, n_words), " ").alias("opening"))


def without_ends(items: DataFrame, by: list[str], order: list, first: int = 0, last: int = 0) -> DataFrame:
    """Ordered items without the first and the last few. The last ones go first, so little may be left for the others."""
    up = Window.partitionBy(*by).orderBy(*order)
    own = items.withColumn("_i", F.row_number().over(up)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return own.where((F.col("_i") > first) & (F.col("_i") <= F.col("_n") - last)).drop("_i", "_n")


def is_credits(title):
    """Marks of credits, which nothing is heard for."""
    return F.coalesce(title.rlike("(?i)credits"), F.lit(False))


def to_do(wanted: DataFrame, done: DataFrame, by: list[str], least_size: int = 1000) -> DataFrame:
    """What incremental work does with each wanted output: ``skip``, ``run``, ``rerun`` (invalid) or ``delete`` (gapped, and run).

    done: output_time, size, valid, gapped. An output that is as new as its input and large enough is skipped only if it
    is valid and its audio is covered; a gapped one goes first, so that no later run takes it for a finished one.
    """
    own = wanted.join(done.select(*by, "output_time", "size", "valid", "gapped"), by, "left")
    there = F.col("output_time").isNotNull() & (F.col("size") > least_size) & (F.col("output_time") >= F.col("input_time"))
    action = F.when(F.col("output_time").isNull(), "run").when(F.col("gapped"), "delete").when(~F.col("valid"), "rerun").when(there, "skip").otherwise("run")
    return own.withColumn("action", action)
