"""The vector table: embedding with a cache, upsert, deletion and exact search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.schemas import VECTORS
from loomgraph.session import numbered

Embed = Callable[[list[str]], list[list[float]]]
CACHE = "key string, model string, dim int, embedding array<float>"


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared L2, cosine distance or 1 - inner product."""
    if metric == "l2":
        return squared_l2(a, b)
    if metric == "cosine":
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    if metric == "ip":
        return 1 - dot(a, b)
    raise ValueError(f"unknown metric {metric}")


def search(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "l2") -> DataFrame:
    """The k nearest by distance, then id; score = max(0, 1 - distance). Exact, one pass, no shuffle."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    near = vectors.withColumn("distance", distance(F.col("embedding"), wanted, metric)).orderBy("distance", "id").limit(k)
    return near.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("distance")))


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 256) -> DataFrame:
    """(query, id, distance, rank): the k nearest vectors of each query (query, embedding) by squared L2, then id.

    Exact. Blocks of queries are sent to all vectors; only the best k of each batch are shuffled.
    """
    spark = vectors.sparkSession
    asked = numbered(queries.select("query", "embedding"), ["query"])
    out = None
    for at in range(0, max(1, asked.count()), block):
        rows = asked.filter(F.col("pos").between(at + 1, at + block)).collect()
        held = spark.sparkContext.broadcast(([r["query"] for r in rows], np.array([r["embedding"] for r in rows], dtype=np.float64)))
        part = vectors.select("id", "embedding").mapInPandas(_nearest(held, k), "query string, id string, distance double")
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy("query").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _nearest(held, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, wanted = held.value
        for frame in frames:
            if not len(frame) or not len(names):
                continue
            ids, rows = frame["id"].to_numpy(), np.stack(frame["embedding"].to_numpy()).astype(np.float64)
            place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
            far = np.zeros((len(names), len(ids)))
            for d in range(rows.shape[1]):  # summed in the order of SQL
                far += (rows[:, d] - wanted[:, d, None]) ** 2
            for name, own in zip(names, far, strict=True):
                near = np.flatnonzero(own <= np.partition(own, min(k, len(own)) - 1)[min(k, len(own)) - 1])
                near = near[np.lexsort((place[near], own[near]))[:k]]
                yield pd.DataFrame({"query": name, "id": ids[near], "distance": own[near]})

    return run


def cache_key(text: Column, model: str, dim: int) -> Column:
    return F.sha2(F.concat(F.sha2(text, 256), F.lit(f"|{model}|{dim}")), 256)


def embed_texts(texts: DataFrame, embed: Embed, model: str, dim: int, cache: DataFrame | None = None, batch: int = 64, concurrency: int = 1) -> tuple[DataFrame, DataFrame]:
    """(text, embedding) for each distinct text, and the rows to add to the cache.

    A text is embedded once, in batches, `concurrency` of them at a time in a task; cached ones of this model and
    dimension not at all.
    """
    need = texts.select("text").distinct().withColumn("key", cache_key(F.col("text"), model, dim))
    known = None
    if cache is not None:
        known = cache.filter((F.col("model") == model) & (F.col("dim") == dim)).select("key", "embedding").dropDuplicates(["key"])
        missing = need.join(known, "key", "left_anti")
    else:
        missing = need

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for frame in frames:
                parts = [frame.iloc[at : at + batch] for at in range(0, len(frame), batch)]
                for part, got in zip(parts, pool.map(lambda x: embed(x["text"].tolist()), parts), strict=True):
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                    yield part.assign(embedding=[list(map(float, x)) for x in got])

    made = missing.mapInPandas(run, "text string, key string, embedding array<float>")
    every = made.select("text", "embedding") if known is None else made.select("text", "embedding").unionByName(need.join(known, "key").select("text", "embedding"))
    return every, made.select("key", F.lit(model).alias("model"), F.lit(dim).alias("dim"), "embedding")


def index_nodes(nodes: DataFrame, embedded: DataFrame) -> DataFrame:
    """Vector rows of (source_file, node, description); blank descriptions are left out."""
    said = nodes.filter(F.trim(F.coalesce("description", F.lit(""))) != "")
    return said.join(embedded, said["description"] == embedded["text"]).select(
        F.concat("source_file", F.lit("::"), "node").alias("id"), "source_file", "node", F.col("description").alias("document"), "embedding"
    )


def upsert(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """vectors with the rows of new in the place of equal ids; of repeated new ids the largest row counts."""
    rest = [c for c in new.columns if c != "id"]
    one = new.groupBy("id").agg(F.max(F.struct(*rest)).alias("x")).select("id", *[f"x.{c}" for c in rest])
    return vectors.join(new.select("id").distinct(), "id", "left_anti").unionByName(one)


def delete_sources(vectors: DataFrame, sources: DataFrame) -> DataFrame:
    return vectors.join(sources, "source_file", "left_anti")


class VectorStoreBackend(Protocol):
    """What a store of vectors of one's own must do. A build tells it what its version of the table `vectors` changes.

    Both calls come before the version is committed and may come again for the same sources, if the build fails after them.
    """

    def delete_by_source(self, sources: DataFrame) -> None:
        """sources (source_file): all their vectors go; those that stay are indexed after this call."""

    def index_nodes(self, nodes: DataFrame, embedded: DataFrame) -> None:
        """nodes (source_file, node, description) and embedded (text, embedding), one row a text."""

    def search(self, query: list[float], k: int = 10) -> DataFrame:
        """The k nearest, with the columns of the function `search`."""


class TableStore:
    """Vectors as a DataFrame that is replaced by each change."""

    def __init__(self, vectors: DataFrame) -> None:
        self.vectors = vectors

    def delete_by_source(self, sources: DataFrame) -> None:
        self.vectors = delete_sources(self.vectors, sources)

    def index_nodes(self, nodes: DataFrame, embedded: DataFrame) -> None:
        self.vectors = upsert(self.vectors, index_nodes(nodes, embedded))

    def search(self, query: list[float], k: int = 10) -> DataFrame:
        return search(self.vectors, query, k)


def list_ids(vectors: DataFrame) -> DataFrame:
    return vectors.select("id")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VECTORS)
