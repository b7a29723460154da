"""Strict validation of player documents, and corrections that must pass it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import timeline

EPSILON = 1e-6


class InvalidDocument(ValueError):
    """A document breaks the contract."""


def number(raw: Column) -> Column:
    """A finite number from raw JSON text; null for null, quoted, true, false or what is no number.

    Types are judged before any cast, so that a truth value never passes as 1.
    """
    plain = raw.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
    x = F.when(plain, raw.try_cast("double"))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def violations(docs: DataFrame, segments: DataFrame, words: DataFrame, chapters: DataFrame, key: str = "doc_key") -> DataFrame:
    """One row per broken rule: (doc_key, level, rule, seg, word). Values are raw JSON text; null means absent.

    docs: title, audio; segments: i, start, end, text; words: i, j, w, s, e; chapters: i, title, start, seg.
    Strings come unquoted with ``*_is_string`` left to the reader; a null string is a violation.
    """
    none = F.lit(None).cast("long")
    rows: list[DataFrame] = []

    def add(frame: DataFrame, broken: Column, rule: str, seg: Column = none, word: Column = none, level: str = "ERROR"):
        rows.append(frame.where(F.coalesce(broken, F.lit(False))).select(key, F.lit(level).alias("level"), F.lit(rule).alias("rule"), seg.cast("long").alias("seg"), word.cast("long").alias("word")))

    add(docs, F.coalesce(F.trim("title"), F.lit("")) == "", "title")
    add(docs, F.col("audio").isNull(), "audio")
    n = segments.groupBy(key).agg(F.count("*").alias("_n"))
    counted = docs.join(n, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    add(counted, F.col("_n") == 0, "segments")

    seg = segments.withColumn("_s", number(F.col("start"))).withColumn("_e", number(F.col("end")))
    i = F.col("i")
    add(seg, F.col("_s").isNull() | (F.col("_s") < 0), "segment.start", i)
    add(seg, F.col("_e").isNull(), "segment.end", i)
    add(seg, F.col("_e") + EPSILON < F.col("_s"), "segment.order", i)
    add(seg, F.col("text").isNull(), "segment.text", i)
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    top = seg.withColumn("_m", F.greatest(F.coalesce(F.max("_s").over(before), F.lit(-1.0)), F.lit(-1.0)))
    add(top, F.col("_s") + EPSILON < F.col("_m"), "segment.monotone", i, level="WARN")

    own = words.withColumn("_s", number(F.col("s"))).withColumn("_e", number(F.col("e")))
    named = own.where(F.col("w").isNotNull())
    j = F.col("j")
    add(own, F.col("w").isNull(), "word.w", i, j)
    add(named, F.col("_s").isNull() | (F.col("_s") < 0), "word.s", i, j)
    add(named, F.col("_e").isNull(), "word.e", i, j)
    add(named, F.col("_e") + EPSILON < F.col("_s"), "word.order", i, j)

    marks = chapters.join(n, key, "left").withColumn("_t", number(F.col("start")))
    whole = F.when(F.col("seg").rlike("^-?[0-9]+$"), F.col("seg").try_cast("long"))
    add(marks, F.col("title").isNull(), "chapter.title", i)
    add(marks, F.col("_t").isNull() | (F.col("_t") < 0), "chapter.start", i)
    add(marks.withColumn("_g", whole), F.col("seg").isNotNull() & (F.col("_g").isNull() | (F.col("_g") < 0) | (F.col("_g") >= F.coalesce("_n", F.lit(0)))), "chapter.seg", i)
    return reduce(DataFrame.unionByName, rows)


def require(found: DataFrame) -> None:
    """Raise InvalidDocument if there is an ERROR; a bounded number of them is named."""
    first = found.where("level = 'ERROR'").limit(5).collect()
    if first:
        raise InvalidDocument("; ".join(f"{r[0]}: {r.rule} at segment {r.seg}, word {r.word}" for r in first))


def broken_files(keys: DataFrame, key: str = "doc_key") -> DataFrame:
    """Files that could not be read as a document, as violations."""
    return keys.select(key, F.lit("ERROR").alias("level"), F.lit("json").alias("rule"), F.lit(None).cast("long").alias("seg"), F.lit(None).cast("long").alias("word"))


def check_ops(ops: list[dict]) -> None:
    """Raise before any plan is made if an operation is unknown or lacks what it needs."""
    needs = {"offset": ("seg_range", "delta_sec"), "set_boundary": ("chapter", "seg"), "split_realign": ("at_seg",)}
    for op in ops:
        if op.get("op") not in needs:
            raise ValueError(f"unknown operation {op.get('op')!r} (expected {', '.join(needs)})")
        for name in needs[op["op"]]:
            if op.get(name) is None:
                raise ValueError(f"{op['op']} needs {name}")


def correct(segments: DataFrame, markers: DataFrame, ops: list[dict], by: str = "book_id", realigned=None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """Apply corrections in order, renumber, and derive marker starts from segments anew.

    offset moves segments, set_boundary moves a marker, split_realign takes the two parts that ``realigned(op)`` gives
    (first, second, lengths of the first) as one timeline with a marker for each; with ``dry_run`` it leaves the
    segments as they are. Only plans are composed here; nothing runs.
    """
    check_ops(ops)
    for op in ops:
        if op["op"] == "offset":
            low, high = op["seg_range"]
            segments = timeline.shift(segments, F.lit(low), F.lit(high), F.lit(int(round(op["delta_sec"] * 1000))))
        elif op["op"] == "set_boundary":
            markers = timeline.set_boundary(markers, segments, op["chapter"], op["seg"], op.get("title"), by)
        elif not dry_run:
            if realigned is None:
                raise ValueError("split_realign needs the parts aligned anew")
            segments, markers = split_markers(*realigned(op), [p.get("title") for p in op.get("parts") or []], by)
    segments = timeline.renumber(segments.withColumnRenamed("id", "_old"), [by], ["_old"]).drop("_old")
    starts = segments.select(by, F.col("id").alias("seg"), F.col("start_ms").alias("_s"))
    markers = markers.join(starts, [by, "seg"], "left").withColumn("start_ms", F.coalesce("_s", "start_ms")).drop("_s")
    return segments, markers


def split_markers(first: DataFrame, second: DataFrame, dur_ms: DataFrame, titles: list, by: str = "book_id") -> tuple[DataFrame, DataFrame]:
    """Two parts as one timeline, and the markers of their first segments."""
    both = timeline.stitch(first, second, dur_ms, by)
    names = [(titles[k] if k < len(titles) and titles[k] else f"Part {k + 1}") for k in range(2)]
    heads = both.groupBy(by, "part").agg(F.min("id").alias("seg"), F.min_by("start_ms", "id").alias("start_ms"))
    marks = heads.select(by, (F.col("part") - 1).cast("long").alias("idx"), F.when(F.col("part") == 1, names[0]).otherwise(names[1]).alias("title"), "seg", "start_ms")
    return both.select(by, "id", "start_ms", "end_ms"), marks


def patch_document(tables: tuple[DataFrame, DataFrame], by: str = "book_id") -> DataFrame:
    """What a manifest takes from a corrected document: its number of sentences and its chapters in order."""
    segments, markers = tables
    n = segments.groupBy(by).agg(F.count("*").alias("sentences"))
    m = markers.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "title", "start_ms"))), lambda x: F.struct(x["title"].alias("title"), x["start_ms"].alias("start_ms"))).alias("chapters"))
    return n.join(m, by, "left")
