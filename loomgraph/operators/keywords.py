"""Inverted keyword index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import node_keywords
from loomgraph.session import spread

MOST = 200


def postings(nodes: DataFrame) -> DataFrame:
    """(keyword, node, source_file, node_type) of every keyword of every node."""
    words = F.explode(node_keywords(F.col("name"), F.col("description")))
    few = spread(nodes.select("name", "description", "source_file", "node_type"))
    return few.select(words.alias("keyword"), F.col("name").alias("node"), F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("node_type", F.lit("concept")).alias("node_type"))


def keyword_index(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """postings with at most `most` nodes for a keyword, in node order (the stored index's own limit)."""
    order = Window.partitionBy("keyword").orderBy("node")
    return postings(nodes).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= most).drop("__n")


def lookup(index: DataFrame, word: str) -> DataFrame:
    return index.filter(F.col("keyword") == word.strip().lower())


def lookup_any(index: DataFrame, words: list[str]) -> DataFrame:
    """Postings of any word, the first for each node (in the order of the words)."""
    wanted = [w.strip().lower() for w in words]
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("keyword"))
    first = Window.partitionBy("node").orderBy(place)
    return index.filter(F.col("keyword").isin(wanted)).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def document_frequency(texts: DataFrame, text: str = "text") -> DataFrame:
    from loomgraph.functions.text import keyword_tokens

    return texts.select(F.explode(keyword_tokens(F.col(text))).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("df"))
