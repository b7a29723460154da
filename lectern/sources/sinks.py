"""Sinks: validated documents, manifests, text reports; a new version is written aside and then takes the place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import validate


def documents(segments: DataFrame, markers: DataFrame, titles: DataFrame, key: list[str]) -> DataFrame:
    """One JSON document per key with its ordered segments and markers."""
    seg = segments.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("id", "start", "end", "text"))).alias("segments"))
    marks = markers.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seg", "start", "title"))).alias("chapters"))
    own = titles.join(seg, key).join(marks, key, "left")
    return own.select(*key, F.to_json(F.struct("title", "audio", "chapters", "segments")).alias("value"))


def replace(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    """Write ``df`` aside, keep what was at ``path`` as ``path``.bak, and move the new version there.

    Refuses to write nothing, and leaves the old version where it is if it can't be kept. An older backup goes only after the
    new one stands; between the two moves the old version is at ``path``.bak.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    aside, gone = f"{path}.new-{mark}", f"{path}.bak-{mark}"
    writer = df.write.format(form)
    (writer.partitionBy(*by) if by else writer).save(aside)
    empty = spark.read.format(form).schema(df.schema).load(aside).isEmpty()
    jvm = spark.sparkContext._jvm
    new, old, kept, older = (jvm.org.apache.hadoop.fs.Path(p) for p in (aside, path, f"{path}.bak", gone))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if empty:
        fs.delete(new, True)
        raise ValueError(f"nothing to write to {path}")

    def move(a, b) -> bool:
        try:
            return fs.rename(a, b)
        except Exception:  # noqa: BLE001  the file system's own errors count as refusal
            return False

    if fs.exists(old):
        aged = fs.exists(kept)
        if aged and not move(kept, older):
            raise OSError(f"{path}.bak could not be moved; {path} is unchanged")
        if not move(old, kept):
            if aged:
                move(older, kept)
            raise OSError(f"{path} could not be kept as {path}.bak")
    if not move(new, old):
        move(kept, old)
        raise OSError(f"{aside} could not become {path}")
    if fs.exists(older):
        fs.delete(older, True)


def validated(df: DataFrame, found: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    """``replace`` behind the validator: documents that break the contract are not written."""
    validate.require(found)
    replace(df, path, form, by)


def document_files(docs: DataFrame, path: str) -> None:
    """One folder a document key (the first column), with its JSON as UTF-8 text; no name of a file can clash."""
    docs.write.partitionBy(docs.columns[0]).text(path)


def sentence_file(sentences: DataFrame, by: list[str]) -> DataFrame:
    """The lines (key, n, line) of a book's text file: a sentence a line, a blank one after each paragraph.

    sentences: chapter, para, sent, text. Between chapters stands one blank line as well, none at the end.
    """
    order = Window.partitionBy(*by).orderBy("chapter", "para", "sent")
    own = sentences.withColumn("_last", (F.lead("para").over(order) != F.col("para")) | (F.lead("chapter").over(order) != F.col("chapter")))
    own = own.withColumn("line", F.explode(F.when(F.col("_last"), F.array("text", F.lit(""))).otherwise(F.array("text"))))
    place = Window.partitionBy(*by).orderBy("chapter", "para", "sent", F.col("line") == "")
    return own.select(*by, (F.row_number().over(place) - 1).cast("long").alias("n"), "line")


def chapter_markers(chapters: DataFrame, sentences: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(markers, failures): title, url, first running sentence and number of sentences of each chapter; those without any fail."""
    n = sentences.groupBy(*by, "chapter").agg(F.count("*").alias("n_sentences"))
    own = chapters.join(n, [*by, "chapter"], "left").withColumn("n_sentences", F.coalesce("n_sentences", F.lit(0)))
    before = Window.partitionBy(*by).orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("seg", F.coalesce(F.sum("n_sentences").over(before), F.lit(0)))
    names = [*by, "chapter", "title", "url", "seg", "n_sentences"]
    return own.where("n_sentences > 0").select(*names), own.where("n_sentences = 0").select(*by, "chapter", "title", "url")


def require_complete(markers: DataFrame, failures: DataFrame, strict: bool) -> None:
    """Refuse partial output: any failure if ``strict`` (read from an archive), and in any case an empty book."""
    failed = failures.limit(5).collect()
    if strict and failed:
        raise ValueError("chapters without sentences: " + ", ".join(str(r["title"]) for r in failed))
    if markers.isEmpty():
        raise ValueError("no chapters, nothing to write")


def report(windows: DataFrame) -> DataFrame:
    """Lines of a drift report: time, overlap, counts, bar and verdict."""
    return windows.withColumn("line", F.format_string("t=%.1fmin %.2f %s %s", F.col("t0") / 60000, F.col("overlap"), T.bar(F.col("overlap")), F.when(F.col("flagged"), "FLAG").otherwise("PASS")))


def flag_report(runs: DataFrame, windows: DataFrame, by: list[str], snippet: int = 120) -> DataFrame:
    """Lines of the report of flagged runs, in order (key, t_start, t0, k): the run, and for each of its windows the counts
    and both texts, cut to ``snippet``."""
    head = runs.select(*by, "t_start", F.lit(None).cast("long").alias("t0"), F.lit(0).alias("k"), F.format_string("FLAG t=%.1f-%.1fmin min=%.2f mean=%.2f n_win=%d", F.col("t_start") / 60000, F.col("t_end") / 60000, "min_overlap", "mean_overlap", "n_windows").alias("line"))
    own = windows.select(*by, "t_start", "t0", F.posexplode(F.array(
        F.format_string("  t=%.1fmin overlap=%.2f n_aligned=%d n_heard=%d", F.col("t0") / 60000, "overlap", "n_aligned", "n_heard"),
        F.concat(F.lit("    ALIGN: "), F.left("align_text", F.lit(snippet))), F.concat(F.lit("    AUDIO: "), F.left("heard_text", F.lit(snippet))),
    )).alias("k", "line"))
    return head.unionByName(own.select(*by, "t_start", "t0", (F.col("k") + 1).alias("k"), "line"))


def profile_json(windows: DataFrame, runs: DataFrame, tracks: DataFrame, by: list[str]) -> DataFrame:
    """One JSON document a track: its settings, its windows in order, its runs, and how many windows passed."""
    w = windows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("i", "t0", "t1", F.round("overlap", 3).alias("overlap"), F.round("smoothed", 3).alias("smoothed"), "flagged"))).alias("windows"),
        F.count("*").alias("n_windows"), F.count_if(~F.col("flagged")).alias("n_pass"), F.count_if(F.col("flagged")).alias("n_fail"),
    )
    r = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t_start", "t_end", "n_windows", "min_overlap", "mean_overlap"))).alias("runs"))
    own = tracks.join(w, by, "left").join(r, by, "left")
    rest = [c for c in tracks.columns if c not in by]
    return own.select(*by, F.to_json(F.struct(*rest, "n_windows", "n_pass", "n_fail", F.coalesce("windows", F.array()).alias("windows"), F.coalesce("runs", F.array()).alias("runs"))).alias("value"))


def cut_log(cuts: DataFrame, by: list[str]) -> DataFrame:
    """The audit log of skipped text, counts only: no word of it is kept."""
    return cuts.where("logged").select(*by, "a0", "a1", (F.col("a1") - F.col("a0")).alias("n_words"))


def drift_chart(windows: list[tuple[float, float, bool]], title: str, below: float, width: int = 640, height: int = 160) -> str:
    """A static SVG of one track's windows (minute, overlap, flagged), for a report; a bounded profile on the driver."""
    from xml.sax.saxutils import escape

    end = max((t for t, _, _ in windows), default=0.0) or 1.0
    x, y = (lambda t: 40 + (width - 50) * t / end), (lambda v: 10 + (height - 40) * (1 - v))
    dots = "".join(f'<circle cx="{x(t):.1f}" cy="{y(v):.1f}" r="3" fill="{"#c0392b" if bad else "#2874a6"}"/>' for t, v, bad in windows)
    line = f'<line x1="40" x2="{width - 10}" y1="{y(below):.1f}" y2="{y(below):.1f}" stroke="#888" stroke-dasharray="4"/>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><title>{escape(title)}</title>{line}{dots}<text x="40" y="{height - 8}" font-size="12">{escape(title)}</text></svg>'


def url_list(urls: DataFrame, header: str) -> DataFrame:
    """A list file's lines in order (idx, value): two comments, a blank line, then the links (url, idx); no links, the comments alone."""
    n = urls.agg(F.count("*").alias("_n"))
    head = n.select(F.posexplode(F.array(F.lit(f"# {header}"), F.concat(F.lit("# "), F.col("_n").cast("string"), F.lit(" chapters")), F.lit(""))).alias("_p", "value"))
    head = head.select((F.col("_p") - 3).cast("long").alias("idx"), "value")
    return head.unionByName(urls.select(F.col("idx").cast("long"), F.col("url").alias("value")))
