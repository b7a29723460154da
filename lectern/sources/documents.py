"""Readers: sync maps, word lists, player documents, track maps, corrections, link lists, captured marks, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

SYNC = "fragments array<struct<id:string,lines:array<string>,text:string,begin:string,end:string>>"
WORDS = "w string, word string, text string, s string, start string, begin string, e string, end string"
CORRECTION = (
    "target string, audio string, manifest string, ops array<struct<op:string,seg_range:array<long>,delta_sec:double,chapter:long,seg:long,title:string,"
    "at_seg:long,at_min:double,parts:array<struct<title:string>>>>"
)
TRACK_MAP = "title string, seg string, tracks array<int>"
MARKS = "chapters array<struct<start_time:string,end_time:string,tags:struct<title:string>>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file, every number as its raw text, so that types are judged and not coerced."""
    return spark.read.schema(schema).option("multiLine", True).option("primitivesAsString", True).json(path).withColumn("doc_key", F.input_file_name())


def sync_segments(fragments: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    """Segments of sync fragments (lines, text, begin, end): blank texts and rows without both times go, ids are dense."""
    line = F.array_join(F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: x != ""), " ")
    text = F.coalesce(F.when(F.coalesce(F.size("lines"), F.lit(0)) > 0, line), F.trim("text"), F.lit(""))
    own = fragments.withColumn("_t", text).withColumn("start", F.round(F.col("begin").try_cast("double"), 3)).withColumn("end", F.round(F.col("end").try_cast("double"), 3))
    own = own.where((F.col("_t") != "") & F.col("start").isNotNull() & F.col("end").isNotNull())
    return own.withColumn("id", (F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1).cast("long")).select(*key, "id", "start", "end", F.col("_t").alias("text"))


def sync_map(docs: DataFrame, key: str = "doc_key") -> DataFrame:
    return sync_segments(docs.select(key, F.posexplode("fragments").alias("pos", "f")).select(key, "pos", "f.*"), [key])


def flat_words(rows: DataFrame, key: list[str]) -> DataFrame:
    """Words under any of their names: (w, s, e); the first name that is there counts, incomplete rows go."""
    own = rows.select(*key, F.trim(F.coalesce("w", "word", "text")).alias("w"), F.coalesce("s", "start", "begin").try_cast("double").alias("s"), F.coalesce("e", "end").try_cast("double").alias("e"))
    return own.where("w IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its path as ``doc_key``, and its text ``value``."""
    return spark.read.text(path, wholetext=True).withColumn("doc_key", F.input_file_name())


def _at(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _string(value: Column) -> Column:
    """A JSON string; null for any other type, so that the validator sees it as missing."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _raw(value: Column) -> Column:
    """A value's own JSON text, quotes included: "1" and true stay apart from 1. Null and absent are null."""
    return F.nullif(F.to_json(value), F.lit("null"))


def player_tables(files: DataFrame, key: str = "doc_key", value: str = "value") -> dict[str, DataFrame]:
    """The tables of player documents given as JSON text: docs, segments, words, chapters, and the keys of ``broken`` files.

    Numbers stay as raw text, so that types are judged before any cast. A file that is no JSON object, or with segments or
    chapters that are no list, is broken; what lies under an ``align`` key is the document if there is one.
    """
    own = files.select(key, F.try_parse_json(value).alias("_v"))
    inner = _at(F.col("_v"), "align")
    own = own.withColumn("_v", F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner).otherwise(F.col("_v")))
    listed = lambda c, name: F.try_variant_get(c, f"$.{name}", "array<variant>")
    sound = F.schema_of_variant("_v").startswith("OBJECT")
    for name in ("segments", "chapters"):
        kind = F.schema_of_variant(_at(F.col("_v"), name))
        sound = sound & (kind.isNull() | kind.startswith("ARRAY") | (kind == "VOID"))
    own = own.withColumn("_sound", F.coalesce(sound, F.lit(False)))
    good = own.where("_sound")
    seg = good.select(key, F.posexplode(listed(F.col("_v"), "segments")).alias("i", "x"))
    field = lambda name: _at(F.col("x"), name)
    word = seg.select(key, "i", F.posexplode(listed(F.col("x"), "words")).alias("j", "y"))
    return {
        "docs": good.select(key, _string(_at(F.col("_v"), "title")).alias("title"), _string(_at(F.col("_v"), "audio")).alias("audio")),
        "segments": seg.select(key, F.col("i").cast("long"), _raw(field("start")).alias("start"), _raw(field("end")).alias("end"), _string(field("text")).alias("text")),
        "words": word.select(key, F.col("i").cast("long"), F.col("j").cast("long"), _string(_at(F.col("y"), "w")).alias("w"), _raw(_at(F.col("y"), "s")).alias("s"), _raw(_at(F.col("y"), "e")).alias("e")),
        "chapters": good.select(key, F.posexplode(listed(F.col("_v"), "chapters")).alias("i", "x")).select(key, F.col("i").cast("long"), _string(field("title")).alias("title"), _raw(field("start")).alias("start"), _raw(field("seg")).alias("seg")),
        "broken": own.where("NOT _sound").select(key),
    }


def corrections(spark: SparkSession, path: str) -> dict:
    """One correction file: target, audio, manifest (or None) and its operations in order. A missing key is an error.

    The file is an operator's short list, read whole to compose plans from.
    """
    found = spark.read.schema(CORRECTION).option("multiLine", True).option("mode", "FAILFAST").json(path).collect()
    if len(found) != 1:
        raise ValueError(f"{path} is not one correction")
    own = found[0].asDict(recursive=True)
    for name in ("target", "audio", "ops"):
        if own[name] is None:
            raise ValueError(f"{path} has no {name}")
    return own | {"ops": [{k: v for k, v in op.items() if v is not None} for op in own["ops"]]}


def track_map(spark: SparkSession, path: str) -> DataFrame:
    """A track map file (a list of title, seg, tracks) in its order: (idx, title, seg, tracks). What is no whole number is null."""
    own = spark.read.text(path, wholetext=True).select(F.posexplode(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("idx", "x"))
    number = lambda v: F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "long"))
    tracks = F.transform(F.try_variant_get("x", "$.tracks", "array<variant>"), lambda t: number(t).cast("int"))
    return own.select(F.col("idx").cast("long"), _string(_at(F.col("x"), "title")).alias("title"), number(_at(F.col("x"), "seg")).alias("seg"), tracks.alias("tracks"))


def durations_by_track(files: DataFrame) -> DataFrame:
    """(track, dur_sec) of measured audio files (path, dur_sec) by the first number in their name; of several the last path."""
    own = files.withColumn("track", T.first_number(F.col("path"))).where("track IS NOT NULL")
    return own.groupBy("track").agg(F.max_by("dur_sec", "path").alias("dur_sec"))


def link_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """The links of a list file: blank lines and those that begin with # are left out."""
    own = lines.select(F.trim(column).alias("url"))
    return own.where((F.col("url") != "") & ~F.startswith("url", F.lit("#")))


def captured_marks(captures: DataFrame, key: list[str], column: str = "json") -> DataFrame:
    """Chapter marks of captured probe output: raw_idx, start_ms, end_ms, title (the index where there is none)."""
    own = captures.select(*key, F.posexplode(F.from_json(column, MARKS)["chapters"]).alias("raw_idx", "m"))
    ms = lambda c: F.round(c.try_cast("double") * 1000).cast("long")
    return own.select(*key, F.col("raw_idx").cast("long"), ms(F.col("m.start_time")).alias("start_ms"), ms(F.col("m.end_time")).alias("end_ms"), F.coalesce("m.tags.title", F.col("raw_idx").cast("string")).alias("title"))
