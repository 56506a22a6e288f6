"""A training corpus from documents, in five stages: good texts, no copies, mixed, tokenised.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return
the columns of documents. The result can't be stated in SQL (a trained model and sketches decide).

Defined results of every stage: a null text is empty, a null id is an id of its own, texts of any length are taken
whole, ties go to the larger id, an empty table gives an empty one, and further columns of documents are
passed on whatever their names (the last stage reads only id and text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bpe, exact_dedup, mixing, near_dedup
from loomgraph.llm import quality as nb
from loomgraph.session import materialise, ship, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3."""
    return nb.good_documents(docs, nb.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five words, 0.8) the one with the largest id."""
    return near_dedup.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document of a second epoch has a second row."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (the token ids, two little-endian bytes each), n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return bpe.encode_documents(docs, bpe.vocabulary_path(), with_ids=True)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
