"""Views of the test tables in the shapes the operators take. There is no audio: durations are proxies from text lengths
(fifteen characters a second) or event values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import sentences


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


SHELF = 1000
BOOK = f"concat_ws('/', source, doc_id // {SHELF})"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source", "n_chars")


def book():
    """The book of a document: its source and its thousand of ids, so that no book grows with the table."""
    return F.concat_ws("/", "source", F.floor(F.col("doc_id") / SHELF).cast("long")).alias("book_id")


def units(spark, d):
    """One unit per document; its place is its rank by id in its book."""
    own = docs(spark, d).select(book(), "doc_id", F.concat(F.lit("doc "), F.col("doc_id")).alias("label"), T.alignable(F.col("text")).alias("words"), (F.col("n_chars") / 15.0).alias("seconds"))
    own = own.withColumn("idx", (F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id")) - 1).cast("long"))
    return own.withColumn("wps", F.when(F.col("seconds") > 0, F.col("words") / F.col("seconds")).otherwise(F.lit(0.0)))


UNITS = rf"""
units AS (
  SELECT {BOOK} AS book_id, doc_id, 'doc ' || doc_id AS label, words, n_chars / 15.0::DOUBLE AS seconds, row_number() OVER (PARTITION BY {BOOK} ORDER BY doc_id) - 1 AS idx,
         CASE WHEN n_chars > 0 THEN words / (n_chars / 15.0::DOUBLE) ELSE 0.0::DOUBLE END AS wps
  FROM (SELECT *, len(list_filter(list_transform(string_split_regex(text, '\s+'), lambda x: trim(regexp_replace(lower(x), '[^a-z'']', '', 'g'), '''')), lambda x: x <> '')) AS words FROM documents)
)"""
WORDS = r"list_filter(list_transform(string_split_regex({}, '\s+'), lambda x: trim(regexp_replace(lower(x), '[^a-z'']', '', 'g'), '''')), lambda x: x <> '')"


def segments(spark, d):
    """A user's events as segments in order of time, in whole ms from the first of 2024."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    own = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("book_id"), "event_id", F.floor((ts - 1704067200000000) / 1000).alias("start_ms"), F.round(F.col("value") * 1000).cast("long").alias("len_ms"), F.concat_ws(" ", "event_type", "props").alias("text"))
    own = own.withColumn("end_ms", F.col("start_ms") + F.col("len_ms"))
    return own.withColumn("id", (F.row_number().over(Window.partitionBy("book_id").orderBy("start_ms", "event_id")) - 1).cast("long"))


SEGMENTS = r"""
segs AS (
  SELECT *, start_ms + len_ms AS end_ms, row_number() OVER (PARTITION BY book_id ORDER BY start_ms, event_id) - 1 AS id
  FROM (SELECT 'u' || user_id AS book_id, event_id, (epoch_us(ts) - 1704067200000000) // 1000 AS start_ms, round(value * 1000)::BIGINT AS len_ms, concat_ws(' ', event_type, props) AS text FROM events)
)"""
DAY = 86_400_000
TRACKS = 31


def tracks(spark, d):
    """One track a day for every book."""
    own = segments(spark, d).select("book_id").distinct()
    return own.select("book_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TRACKS - 1).cast("long"))).alias("track"), F.lit(DAY).cast("long").alias("dur_ms"))


TRACKS_SQL = f"tracks AS (SELECT book_id, unnest(range({TRACKS})) AS track, {DAY}::BIGINT AS dur_ms FROM (SELECT DISTINCT book_id FROM segs))"


def heard(spark, d, size: int | None = None):
    words = T.words_of(F.col("text"))
    return table(spark, d, "benchmark").select(F.col("item_id"), (F.slice(words, 1, size) if size else words).alias("heard"))


def book_tokens(spark, d):
    """All tokens of a book as one text, in the order of doc_id: (book_id, pos, apos, w, nw)."""
    own = docs(spark, d).select(book(), "doc_id", "text")
    sizes = own.select("book_id", "doc_id", F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0)).alias("_n"), F.coalesce(T.alignable(F.col("text")), F.lit(0)).alias("_a"))
    before = Window.partitionBy("book_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("book_id", "doc_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_a").over(before), F.lit(0)).alias("_a"))
    each = sentences.token_stream(own.join(sizes, ["book_id", "doc_id"]), ["book_id", "doc_id", "_n", "_a"])  # whole texts meet their offsets, not tokens
    return each.select("book_id", "doc_id", (F.col("pos") + F.col("_n")).alias("pos"), "w", "nw", (F.col("apos") + F.col("_a")).alias("apos"))


def book_texts(spark, d):
    """The alignable words of each text, and where they begin in its book: (book_id, start, words)."""
    own = docs(spark, d).select(book(), "doc_id", T.words_of(F.col("text")).alias("words"))
    before = Window.partitionBy("book_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("start", F.coalesce(F.sum(F.size("words")).over(before), F.lit(0)).cast("long")).select("book_id", "start", "words")


def book_lines(spark, d):
    """The texts that have lines, as lines of normal forms, in the order of ``place`` in their book: (book_id, place, lines)."""
    own = docs(spark, d).select(book(), F.col("doc_id").alias("place"), T.normal_lines(sentences.kept_lines(F.col("text"))).alias("lines"))
    return own.where("lines is not null")


BOOK_WORDS = f"""
bw AS (
  SELECT book_id, unnest(ws) AS nw, unnest(range(len(ws))) AS apos
  FROM (SELECT {BOOK} AS book_id, flatten(list({WORDS.format('text')} ORDER BY doc_id)) AS ws FROM documents GROUP BY 1)
)"""
