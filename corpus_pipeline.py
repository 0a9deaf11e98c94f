"""A corpus pipeline of five stages, each on everything its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluiceway.llm import exact_dedup, jaccard, language, packing, quality
from sluiceway.llm.common import batch_rows, table
from sluiceway.session import cut

#: A text is kept if a language was found that at least this share of its letters belongs to.
LANGUAGE_SHARE = 0.4


#: Rows of a batch that a stage hands to Python.
BATCH_ROWS = 1000


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` with neutral names for all but id and text, so that no column clashes with one of an operator."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"other{i}" for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that ``documents`` teaches; texts without letters and even mixtures of many languages go."""
    model = language.learn(table(spark, sf_dir, "documents"))
    own = plain(docs)
    out = language.identify(own, model, with_spans=False)
    return out.where((F.col("__lang_pred") != language.UNKNOWN) & (F.col("__score") >= LANGUAGE_SHARE)).select(*own.columns).toDF(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier does not reject."""
    net = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    own = plain(docs)
    return quality.score(own, net).where(F.col("__score") >= quality.THRESHOLD).select(*own.columns).toDF(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space."""
    own = plain(docs)
    return exact_dedup.drop_copies(own).select(*own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of Jaccard similarity join."""
    own = plain(docs)
    return jaccard.drop_near_copies(own).select(*own.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 1024 tokens."""
    out = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("packing", pack_sequences),
]

#: SQL can express neither the trained stages nor the plan of the sequences.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    with batch_rows(spark, BATCH_ROWS):  # a batch holds whole texts beside all other columns
        for _, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir))
    return docs
