"""An inverted-file index of vectors with product codes: approximate search that reads a few cells, re-ranked exactly.

Cells and codes are fitted on a bounded sample (SAMPLE vectors, those with the smallest hash of their id); every vector is assigned.
How many cells a query probes and how many of its candidates are ranked exactly is measured on that sample too, for the
recall that is asked for. A search deals queries to the cells they probe, scans codes there, and computes
distances only for the best candidates. Cells with many vectors or many queries are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.vectors import squared_l2
from loomgraph.session import materialise

SAMPLE, QUERIES = 20_000, 256
#: Cells at most (they are sent to all tasks), centroids of a code book, and components that one code stands for.
CELLS, CODES, WIDTH = 4_096, 256, 4
#: Vectors and queries of one cell that meet in one task.
MEMBERS, ASKED = 20_000, 5_000


@dataclass(frozen=True)
class VectorIndex:
    cells: np.ndarray
    books: list[np.ndarray]
    probes: int
    depth: int

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, at : at + WIDTH] for at in range(0, x.shape[1], WIDTH)]

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """A byte for each part of the rest of x beside its cell's centroid."""
        rest = x - self.cells[cell]
        return np.stack([_far(part, book).argmin(axis=1) for part, book in zip(self.parts(rest), self.books, strict=True)], axis=1).astype(np.uint8)

    def guess(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of a query to coded vectors of a cell, by sums of table entries."""
        rest = (query - self.cells[cell])[None]
        return sum(_far(part, book)[0][codes[:, p]] for p, (part, book) in enumerate(zip(self.parts(rest), self.books, strict=True)))


def _far(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ to.T + (to * to).sum(axis=1), 0)


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    own = x[np.random.default_rng(3).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        to = _far(x, own).argmin(axis=1)
        n, total = np.bincount(to, minlength=len(own)), np.zeros_like(own)
        np.add.at(total, to, x)
        own[n > 0] = total[n > 0] / n[n > 0, None]
    return own


def fit(vectors: DataFrame, k: int = 10, recall: float = 0.97) -> VectorIndex | None:
    """The index of vectors (id, embedding), set for this recall of the k nearest; None without vectors."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()
    if not rows:
        return None
    x = np.array([r["embedding"] for r in rows], np.float64)
    cells = _centroids(x, min(CELLS, max(1, round(vectors.count() ** 0.5 / 2)), len(x)))
    of = _far(x, cells).argmin(axis=1)
    books = [_centroids(np.ascontiguousarray((x - cells[of])[:, at : at + WIDTH]), min(CODES, len(x))) for at in range(0, x.shape[1], WIDTH)]
    index = VectorIndex(cells, books, len(cells), k)
    asked = x[:QUERIES]
    far = _far(asked, x)
    far[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if not near.shape[1]:
        return index
    # the place of each neighbour's cell among those of the query, and of each neighbour among all by codes
    order = np.argsort(np.argsort(_far(asked, cells), axis=1, kind="stable"), axis=1, kind="stable")
    place = np.take_along_axis(order, of[near], 1)
    codes = index.codes(x, of)
    by_code = np.empty((len(asked), len(x)))
    for cell in range(len(cells)):
        mine = np.flatnonzero(of == cell)
        for q in range(len(asked)):
            by_code[q, mine] = index.guess(asked[q], cell, codes[mine]) if len(mine) else 0
    by_code[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    rank = np.take_along_axis(np.argsort(np.argsort(by_code, axis=1, kind="stable"), axis=1, kind="stable"), near, 1)
    share = (1 + recall) / 2  # half of what may be lost goes to either step
    return VectorIndex(cells, books, int(np.quantile(place, share, method="higher")) + 1, max(2 * k, int(np.quantile(rank, share, method="higher")) + 1 + k))


def assign(vectors: DataFrame, index: VectorIndex) -> DataFrame:
    """(id, cell, code, embedding) of every vector, written."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.array(frame["embedding"].tolist(), np.float64)
                cell = _far(x, index.cells).argmin(axis=1)
                yield frame.assign(cell=cell.astype(np.int32), code=[c.tobytes() for c in index.codes(x, cell)])[["id", "cell", "code", "embedding"]]

    kind = vectors.schema["embedding"].dataType.simpleString()
    return materialise(vectors.select("id", "embedding").mapInPandas(run, f"id string, cell int, code binary, embedding {kind}"), "cells")


def _probe(index: VectorIndex):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                near = np.argsort(_far(np.array(frame["embedding"].tolist(), np.float64), index.cells), axis=1, kind="stable")[:, : index.probes]
                yield frame.assign(cell=list(near.astype(np.int32))).explode("cell").astype({"cell": "int32"})

    return run


def _scan(index: VectorIndex):
    def run(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            codes, ids = np.array([np.frombuffer(c, np.uint8) for c in held["code"]]), held["id"].to_numpy(object)
            most = min(index.depth, len(ids))
            for query, v in zip(asked["query"], asked["embedding"], strict=True):
                far = index.guess(np.asarray(v, np.float64), int(key[0]), codes)
                best = np.argpartition(far, most - 1)[:most]
                out.append(pd.DataFrame({"query": query, "id": ids[best], "far": far[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "far": []})

    return run


def search(held: DataFrame, queries: DataFrame, index: VectorIndex, k: int = 10) -> DataFrame:
    """(query, id, distance, rank) of the k nearest found for each query (query, embedding), by squared L2, then id.

    held is the table that `assign` has written. Distances are exact; a neighbour outside the probed cells is missed.
    """
    asked = materialise(queries.select("query", "embedding").mapInPandas(_probe(index), queries.select("query", "embedding", F.lit(0).alias("cell")).schema), "probes")
    sizes = held.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    lanes = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("lanes"))
    plan = F.broadcast(materialise(sizes.join(lanes, "cell"), "plan"))  # a row for each cell, CELLS at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(plan, "cell").withColumn("lane", F.pmod(F.xxhash64("query"), "lanes").cast("int")).withColumn("part", every("parts"))
    right = held.select("id", "cell", "code").join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("lane", every("lanes"))
    group = ("cell", "part", "lane")
    found = left.select("query", "embedding", *group).groupBy(*group).cogroup(right.select("id", "code", *group).groupBy(*group)).applyInPandas(_scan(index), "query string, id string, far double")
    first = Window.partitionBy("query").orderBy("far", "id")
    some = found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= index.depth).select("query", "id")
    exact = some.join(held.select("id", "embedding"), "id").join(queries.select("query", F.col("embedding").alias("asked")), "query")
    exact = exact.select("query", "id", squared_l2(F.col("embedding"), F.col("asked")).alias("distance"))
    best = Window.partitionBy("query").orderBy("distance", "id")
    return exact.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
