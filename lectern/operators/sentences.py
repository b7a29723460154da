"""From texts to lines, sentences and tokens with running ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# Words after which a full stop ends no sentence.
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "st", "lt", "sgt", "capt", "vs", "etc", "no", "vol"]
# Fixed value: an end mark, closers that go, white space, and what may begin a sentence
BOUNDARY = "([.!?…])[\"”’')\\]]*\\s+([A-Z\"“\\[‘])"
CUT = "\u001f"


def kept_lines(text):
    """The non-blank lines of a text, trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), T.trimmed), lambda x: x != "")


def lines(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Non-blank lines, trimmed, with their dense place ``para`` in the text."""
    return docs.select(*key, F.posexplode(kept_lines(text)).alias("para", "line")).withColumn("para", F.col("para").cast("long"))


def pieces(paragraph):
    """A paragraph's pieces before abbreviations are joined. A bracketed block is one piece."""
    whole = F.startswith(paragraph, F.lit("[")) & F.endswith(paragraph, F.lit("]"))
    cut = F.filter(F.transform(F.split(F.regexp_replace(paragraph, BOUNDARY, f"$1{CUT}$2"), CUT), T.trimmed), lambda x: x != "")
    return F.when(paragraph == "", F.array().cast("array<string>")).when(whole, F.array(paragraph)).otherwise(cut)


def sentences(paragraphs: DataFrame, key: list[str], text: str = "line") -> DataFrame:
    """Sentences of paragraphs: ``key`` with the place ``sent`` in the paragraph and ``text``.

    A piece joins its predecessor if that ends with an abbreviation. That depends on the piece before alone, so
    it is a look back within the paragraph's own array: no shuffle and no window.
    """
    own = paragraphs.select(*key, pieces(T.trimmed(F.col(text))).alias("_p"))
    last = lambda p: F.lower(F.element_at(F.filter(F.split(F.rtrim(p, F.lit(".")), r"\s+"), lambda w: w != ""), -1))
    joins = F.transform("_p", lambda p, i: (i > 0) & F.coalesce(last(F.get(F.col("_p"), i - 1)).isin(ABBREVIATIONS), F.lit(False)))
    marked = F.zip_with("_p", joins, lambda p, j: F.when(j, F.concat(F.lit(" "), p)).otherwise(F.concat(F.lit(CUT), p)))
    out = F.filter(F.split(F.array_join(marked, ""), CUT), lambda x: x != "")
    return own.select(*key, F.posexplode(out).alias("sent", "text")).withColumn("sent", F.col("sent").cast("long"))


def token_stream(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Every shown token with its place ``pos``, normal form ``nw`` and place ``apos`` among alignable ones (or null).

    Both places come from the text's own array, so nothing is shuffled or sorted.
    """
    place = F.transform(T.tokens(F.col(text)), lambda w, i: F.struct(i.cast("long").alias("pos"), w.alias("w"), T.norm_word(w).alias("nw")))
    own = texts.select(*key, place.alias("_t"))
    counted = F.transform(F.filter("_t", lambda t: t["nw"] != ""), lambda t, i: F.struct(t["pos"].alias("pos"), t["w"].alias("w"), t["nw"].alias("nw"), i.cast("long").alias("apos")))
    others = F.transform(F.filter("_t", lambda t: t["nw"] == ""), lambda t: F.struct(t["pos"].alias("pos"), t["w"].alias("w"), t["nw"].alias("nw"), F.lit(None).cast("long").alias("apos")))
    return own.select(*key, F.inline(F.concat(counted, others)))


def running_ordinals(chapters: DataFrame, book: str = "book_id", order: str = "idx", count: str = "n_sentences") -> DataFrame:
    """The first running sentence of each chapter; chapters without sentences are marked as skipped."""
    before = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chapters.withColumn("seg", F.coalesce(F.sum(count).over(before), F.lit(0))).withColumn("skipped", F.col(count) == 0)
