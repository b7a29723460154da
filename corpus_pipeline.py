"""The corpus pipeline: language, quality, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common, jaccard, langid, packing, quality, repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits one of the languages that the documents' own labels teach."""
    found = langid.identify(docs, langid.fit(docs), COLUMNS)
    return found.where(~F.col("rejected")).select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model, COLUMNS).where(F.col("score") >= quality.REJECT).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document of the smallest id.

    Rows without an id stay; of rows that repeat an id the one with the least (text, lang, source, n_chars) stays.
    """
    found = common.written(jaccard.near_duplicates(docs), "groups")
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    left = docs.select(*COLUMNS).join(first, "doc_id", "left_semi").select(*COLUMNS)
    if not found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        least = left.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("_m"))
        left = least.select("doc_id", "_m.*").select(*COLUMNS)
    return left.union(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus."""
    return repeats.without_repeats(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("language", language), ("quality", good), ("near duplicates", distinct), ("repeats", unrepeated), ("packing", packed)]

#: models and packing are beyond SQL; tests compare the stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, name.replace(" ", "-"))
    return docs
