"""From raw documents to packed training sequences: five stages, each of which works on all that the one
before it has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, lines, mixture, neardup, packing, shared, tokens

#: Languages that the corpus is made of, and the least share of a document's n-grams that its language holds.
LANGUAGES = ("de", "en", "es", "fr")
LEAST_COVERAGE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be in one of LANGUAGES with at least LEAST_COVERAGE of their n-grams in its
    filter; those without a letter, in another language or in none that was learned go."""
    return langid.identified(docs, LANGUAGES, LEAST_COVERAGE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of passages that stand earlier too."""
    return lines.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a similarity of 0.8 or more."""
    return neardup.documents(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, cut where it takes a part."""
    return mixture.materialised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its sequence and its offset there."""
    return packing.pack(docs, tokens.vocabulary())


STAGES = [("language", language), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mixed), ("packing", packed)]

#: Filters of n-grams, signatures and token ids are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.settled(docs, name.replace(" ", "-"))
    return docs
