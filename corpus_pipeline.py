"""The corpus pipeline: five stages over ``documents``, each written and read again.

Language identification, line dedup, near-dedup, mixing of sources, piece encoding. All stages but the
last return the columns of ``documents``; every stage works on all rows the one before kept.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import language, lines, minmax, mixing, pieces
from telemill.llm.staging import staged


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all columns of the documents in one struct, so that no column an operator
    adds (``lang_pred``, ``score``, ``n_lines``, ``n_dropped``) can clash with one of theirs."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_documents"))


def _unpacked(frame: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    return frame.select(
        *[F.col(text).alias(c) if c == "text" and text else F.col("_documents").getField(c).alias(c) for c in docs.columns]
    )


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the language model rejects go: those without a letter (null, empty or none in the text).

    The language is learned from the labelled documents; where no document has a usable label, nothing
    is learned and only texts without a letter go. All columns stay, whatever their names.
    """
    texts = language.training_text(docs, F.lit(True))
    if not texts:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    judged = language.predict(_packed(docs), texts)
    return _unpacked(judged.where(F.col("lang_pred") != language.UNKNOWN), docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in five documents or more stay in the last one only.

    All columns stay, whatever their names; ``text`` is the text that is left.
    """
    return _unpacked(lines.dropped(_packed(docs)), docs, text="text")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, similarity 0.8)."""
    return minmax.dedup(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encoded(docs.select("doc_id", "source", "text"), path).drop("text")


STAGES = [
    ("language", known_language),
    ("lines", fresh_lines),
    ("near duplicates", distinct_documents),
    ("mix", mixed_sources),
    ("tokens", tokens),
]

#: No SQL: language models, fingerprints and piece merging; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
