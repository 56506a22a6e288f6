"""Centroid clustering by Lloyd's rounds over the distinct quantised vectors.

Each vector becomes integers, floor(scale * x). Equal integer vectors are grouped first and counted, so a vector that a
third of all rows share is one row of a round. A round sends the centroids (k rows) to the distinct vectors; every
task adds up its own vectors times their counts, in integers, and only these k sums of each task are shuffled. The
assignments go back to the rows by a join on the integer vector. All decisions are made on exact integers, so
the result does not depend on how rows are dealt to tasks.

Defined results: only vectors of exactly `dims` components, none null or non-finite, are kept, others have no row; an
integer beyond 2**27 is held at that bound, so that distances fit the long they are returned in; a null id hashes as an
empty one, ids that repeat are rows of their own, and of equal hashes the smaller packed vector comes first; of equal
distances the smaller number wins; with fewer rows than k there are as many centroids as rows; empty clusters keep their
centroid; an empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.skew import join_counted
from loomgraph.llm.vectors import matrices
from loomgraph.session import materialise, table

DIMS, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
_BOUND = 1 << 27


def _pack(q: np.ndarray) -> list[bytes]:
    """Each integer vector as two bytes a component, or four where two don't hold it."""
    short, small = (q >= -(1 << 15)) & (q < 1 << 15), q.astype("<i2")
    return [small[i].tobytes() if short[i].all() else q[i].astype("<i4").tobytes() for i in range(len(q))]


def unpack(packed: list[bytes], dims: int) -> np.ndarray:
    return np.array([np.frombuffer(x, "<i2" if len(x) == 2 * dims else "<i4") for x in packed], np.int64).reshape(-1, dims)


def _quantiser(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column("v")):
                if x.shape[1] == dims:
                    q = np.clip(np.floor(scale * x.astype(np.float64)), -_BOUND, _BOUND).astype(np.int64)
                    kept = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("uid"), pa.array(_pack(q), pa.binary())], ["id", "uid", "q"])

    return run


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row, and the squared distance; exact for integers up to 2**27."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # every step is exact in doubles too, which are multiplied faster
        x, centroids = x.astype(np.float64), centroids.astype(np.float64)
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)
    to = far.argmin(axis=1)
    return to, far[np.arange(len(x)), to].astype(np.int64)


def _summer(centroids: np.ndarray):
    """Of a task's vectors, by cluster: the number (at -1) and the sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        sums = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x, n = unpack(batch.column("q").to_pylist(), dims), batch.column("n").to_numpy(zero_copy_only=False)
            to, _ = nearest(x, centroids)
            np.add.at(sums, to, np.concatenate((n[:, None], x * n[:, None]), axis=1))
        used = np.flatnonzero(sums[:, 0])
        if len(used):
            at = np.arange(-1, dims, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, dims + 1).astype(np.int32)), pa.array(np.tile(at, len(used))), pa.array(sums[used].ravel())], ["cluster", "at", "s"]
            )

    return run


def _assigner(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, far = nearest(unpack(batch.column("q").to_pylist(), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("n"), pa.array(to.astype(np.int32)), pa.array(far)], ["q", "n", "cluster", "distance"])

    return run


def moved(centroids: np.ndarray, distinct: DataFrame) -> np.ndarray:
    """The centroids after one round over distinct(q, n); what comes to the driver is k sums of each component."""
    part = distinct.select("q", "n").mapInArrow(_summer(centroids), "cluster int, at int, s long")
    out, total = centroids.copy(), {}
    for r in part.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        total[r["cluster"], r["at"]] = int(r["s"])
    for (cluster, at), s in total.items():
        if at >= 0:
            out[cluster, at] = s // total[cluster, -1]
    return out


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid (its integers) and centroid_sha256."""
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(vector_col).alias("v"))
    kind = src.schema["id"].dataType.simpleString()
    rows = materialise(src.mapInArrow(_quantiser(dims, scale), f"id {kind}, uid long, q binary"), "quantised")
    distinct = materialise(rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "distinct")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(hashed.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    centroids = unpack([r["q"] for r in sorted(first, key=lambda r: (r["h"], bytes(r["q"])))], dims)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(centroids, distinct)
    else:
        centroids = np.zeros((1, dims), np.int64)  # no vector will be assigned
    assigned = materialise(distinct.mapInArrow(_assigner(centroids), "q binary, n long, cluster int, distance long"), "assigned")
    whole = F.col("distance").cast("decimal(38,0)") * F.col("n")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(whole.cast("decimal(38,0)")).alias("s")).collect()}
    said = [(i, inertia.get(i, 0), sum(inertia.values()), c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    about = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")  # k rows
    out = join_counted(rows, assigned, ["q"], ["uid"], "n").join(F.broadcast(about), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


def _oracle() -> str:
    parts = [
        """k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS cluster, q FROM k QUALIFY cluster < 40)",
    ]
    far = "list_sum(list_transform(list_zip(k.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, vec_id, k.q, c.cluster, CAST({far} AS BIGINT) AS distance FROM k, c{r} c QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c.cluster) = 1)")
        if r < ROUNDS:
            parts.append(f"m{r} AS (SELECT cluster, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM (SELECT cluster, i, sum(q[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL))")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (SELECT cluster, list(v ORDER BY i) AS q FROM m{r} GROUP BY cluster) m USING (cluster))")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)"""


QUERIES = {"op11_centroid_clustering": op11_centroid_clustering}
ORACLE = {"op11_centroid_clustering": _oracle()}
