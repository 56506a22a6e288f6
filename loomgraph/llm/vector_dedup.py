"""Embedding near-dedup by an inverted multi-index.

The first and the second half of the unit vectors get a codebook each, fitted on a bounded sample (SAMPLE vectors); every
vector lies in one cell of the grid of both codebooks. If another vector lies in the cell (i, j), each of its halves
is on the far side of the plane between one's own centroid and that cell's, so the distances to these planes bound the
distance from below. A multi-sequence traversal visits the cells of a vector in ascending order of the sum of the two squared
bounds and ends at a radius. With target_recall = 1 this is the square of the largest distance of a link, and no
link can be missed. Below 1 it is the radius within which this share of partners at exactly the threshold (the hardest ones;
directions drawn at random for each vector of the sample) would be found.

A pair is looked at once, in the later cell of the two. The members of a cell are dealt to parts of some MEMBERS, its
visitors to lanes of some VISITORS, so a cell with a third of all vectors is many tasks, and a task holds one part and
streams the visitors. Cosines are computed exactly in doubles. A group of near copies is not expanded into pairs: a batch gives
the number of links of each vector and a spanning forest of its links, from which components are formed.

Equal vectors are one node with a count from the start.

Defined results: a null, empty or zero vector and one with a null or non-finite component has no link and is its own component; vectors link with
those of equal length only; a null id counts as the largest, so a component is named by it only when it has no other; `kept` is whether
a row's id names its component (two nulls are alike), so of rows that repeat that id all are kept; cosines are taken after scaling each vector by
its largest component, so large and tiny vectors neither overflow nor vanish; an empty table gives an empty result; further columns are not read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.components import components
from loomgraph.llm.skew import join_counted
from loomgraph.llm.vectors import matrices
from loomgraph.session import materialise, table

THRESHOLD, TARGET_RECALL = 0.95, 0.999
#: Vectors that the codebooks are fitted on (fewer of long ones: at most SAMPLE_FLOATS numbers), and vectors of a cell on average.
SAMPLE, SAMPLE_FLOATS, CELL = 16_384, 1 << 22, 256
#: Partners that are drawn, at least, to find the radius.
DRAWS = 16_384
#: Centroids of a codebook at most: with half a vector each they are sent to all tasks.
CENTROIDS = 1_024
#: Own centroids from which a bound is taken.
PLANES = 8
MEMBERS, VISITORS, BLOCK = 2_048, 16_384, 512
_EDGE = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles (zero rows stay zero)."""
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(np.float64).tiny)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), np.finfo(np.float64).tiny)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """In doubles, summed from the first component to the last."""
    a, b = ((x / max(abs(v) for v in x)).tolist() for x in (a.astype(np.float64), b.astype(np.float64)))
    ab = aa = bb = 0.0
    for x, y in zip(a, b, strict=True):
        ab, aa, bb = ab + x * y, aa + x * x, bb + y * y
    return ab / math.sqrt(aa * bb)


def _reader(kind: str):
    """Rows that can link, with their node (a digest of length and bytes) and packed vector; others with neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node: list[bytes | None] = [None] * batch.num_rows
            vec: list[bytes | None] = [None] * batch.num_rows
            for rows, x in matrices(batch.column("v")):
                x = np.ascontiguousarray(x.astype(kind))
                for i, v in zip(rows[np.any(x != 0, axis=1)].tolist(), x[np.any(x != 0, axis=1)], strict=True):
                    vec[i] = v.tobytes()
                    node[i] = hashlib.sha256(vec[i]).digest()[:16]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("uid"), pa.array(node, pa.binary()), pa.array(vec, pa.binary())], ["id", "uid", "node", "vec"])

    return run


def codebook(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """At most k centroids by Lloyd's rounds from distinct rows."""
    x = np.unique(x, axis=0)
    own = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        to = ((own * own).sum(axis=1) - 2 * x @ own.T).argmin(axis=1)
        n = np.bincount(to, minlength=len(own))
        total = np.zeros_like(own)
        np.add.at(total, to, x)
        own[n > 0] = total[n > 0] / n[n > 0, None]
    return np.unique(own, axis=0)


def multi_sequence(a: list[float], b: list[float], radius: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) in ascending order of a[i] + b[j], both lists ascending, while the sum is at most radius."""
    heap = [(a[0] + b[0], 0, 0)]
    while heap:
        both, i, j = heapq.heappop(heap)
        if both > radius:
            return
        yield i, j
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


class Index:
    """Two codebooks and the radius of the traversal."""

    def __init__(self, sample: np.ndarray, k: int, threshold: float, target_recall: float) -> None:
        self.dims = sample.shape[1]
        self.half = self.dims // 2
        self.books = [codebook(self.part(sample, h), k) for h in (0, 1)]
        self.apart = [np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 0)) for c in self.books]
        self.most = max(0.0, 2 - 2 * threshold) + _EDGE
        self.radius = self.most if target_recall >= 1 else self._radius(sample, threshold, target_recall)

    def part(self, x: np.ndarray, h: int) -> np.ndarray:
        return x[:, self.half :] if h else x[:, : self.half]

    def fit(self, x: np.ndarray) -> np.ndarray:
        """Vectors of another length cut or filled with zeros, which makes no two of them farther apart."""
        n = x.shape[1]
        return x if n == self.dims else x[:, : self.dims] if n > self.dims else np.pad(x, ((0, 0), (0, self.dims - n)))

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each half: the own centroid of each row, and the squared bounds of the distance to what each centroid holds."""
        out = []
        for h in (0, 1):
            book, apart = self.books[h], self.apart[h]
            y = self.part(x, h)
            far = np.maximum((y * y).sum(axis=1)[:, None] - 2 * y @ book.T + (book * book).sum(axis=1), 0)
            near = np.argsort(far, axis=1, kind="stable")[:, :PLANES]
            low = np.zeros_like(far)
            for p in range(near.shape[1]):
                own = near[:, p]
                between = apart[own]
                gap = far - far[np.arange(len(y)), own][:, None]
                np.maximum(low, np.divide(gap, 2 * between, out=np.zeros_like(far), where=between > 0), out=low)
            out.append((near[:, 0], low * low))
        return out

    def _radius(self, sample: np.ndarray, threshold: float, target_recall: float) -> float:
        """The share target_recall of partners at the threshold, in random directions, has bounds within it."""
        sample = np.tile(sample, (math.ceil(DRAWS / len(sample)), 1)) if len(sample) * self.dims < SAMPLE_FLOATS else sample
        drawn = np.random.default_rng(7).standard_normal(sample.shape)
        drawn -= (drawn * sample).sum(axis=1, keepdims=True) * sample
        partner = threshold * sample + math.sqrt(max(0.0, 1 - threshold * threshold)) * unit(drawn)
        (_, a), (_, b) = self.bounds(sample)
        (i, _), (j, _) = self.bounds(partner)
        at = np.arange(len(sample))
        return min(self.most, float(np.quantile(a[at, i] + b[at, j], target_recall, method="higher")))

    def visits(self, x: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """For each row its own cell and all later cells of the traversal."""
        (i, a), (j, b) = self.bounds(x)
        wide = len(self.books[1])
        order = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, order[0], 1), np.take_along_axis(b, order[1], 1)
        reach_a, reach_b = (a <= self.radius).sum(axis=1), (b <= self.radius).sum(axis=1)
        for r in range(len(x)):
            home = int(i[r]) * wide + int(j[r])
            row, column = order[0][r], order[1][r]
            seen = multi_sequence(a[r, : reach_a[r]].tolist(), b[r, : reach_b[r]].tolist(), self.radius)
            yield home, [c for c in (int(row[p]) * wide + int(column[q]) for p, q in seen) if c > home]


def _cells(index: Index, kind: str):
    """Of each vector: its size and own cell, and the later cells that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec").to_pylist()
            size = np.array([len(v) for v in vec])
            home, later = [0] * len(vec), [[]] * len(vec)
            for n in np.unique(size).tolist():
                for at in range(0, len(vec), 4096):
                    rows = at + np.flatnonzero(size[at : at + 4096] == n)
                    if len(rows):
                        x = index.fit(unit(np.array([np.frombuffer(vec[r], kind) for r in rows])))
                        for r, (own, others) in zip(rows.tolist(), index.visits(x), strict=True):
                            home[r], later[r] = own, others
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(size.astype(np.int32)), pa.array(home, pa.int32()), pa.array(later, pa.list_(pa.int32()))], ["node", "size", "home", "later"])

    return run


class _Part:
    """The members of one part of a cell, and the links that are found with them."""

    def __init__(self, key: tuple, threshold: float) -> None:
        self.key, self.threshold = key, threshold
        self.raw: list[np.ndarray] = []
        self.node: list[bytes] = []
        self.n: list[int] = []

    def add(self, node: bytes, n: int, raw: np.ndarray) -> None:
        self.node.append(node)
        self.n.append(n)
        self.raw.append(raw)

    def close(self) -> None:
        self.unit = unit(np.array(self.raw))
        self.weight = np.array(self.n, np.int64)

    def links(self, raw: list[np.ndarray], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): rows of raw (with unit vectors of) and members whose cosine reaches the threshold."""
        s = of @ self.unit.T
        i, j = np.nonzero(s >= self.threshold - _EDGE)
        doubt = np.flatnonzero(s[i, j] < self.threshold + _EDGE)
        sure = np.ones(len(i), bool)
        for d in doubt.tolist():
            sure[d] = cosine(raw[i[d]], self.raw[j[d]]) >= self.threshold
        return i[sure], j[sure]

    def inner(self) -> Iterator[tuple]:
        for at in range(0, len(self.raw), BLOCK):
            i, j = self.links(self.raw[at : at + BLOCK], self.unit[at : at + BLOCK])
            once = j > i + at
            yield from self.said(self.node[at : at + BLOCK], self.weight[at : at + BLOCK], i[once], j[once], at)

    def met(self, node: list[bytes], n: list[int], raw: list[np.ndarray]) -> Iterator[tuple]:
        i, j = self.links(raw, unit(np.array(raw)))
        yield from self.said(node, np.array(n, np.int64), i, j, None)

    def said(self, node: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray, at: int | None) -> Iterator[tuple]:
        """(node, other, links): the links of each row and member, and a spanning forest of them (other is its root)."""
        if not len(i):
            return
        m = len(self.node)
        i = i + m if at is None else i + at  # visitors are numbered after the members
        count = np.bincount(i, self.weight[j], m + len(node)) + np.bincount(j, (n if at is None else self.weight)[i - m if at is None else i], m + len(node))
        label = np.arange(m + len(node))
        while True:
            before = label.copy()
            np.minimum.at(label, i, label[j])
            np.minimum.at(label, j, label[i])
            label = label[label]
            if (label == before).all():
                break
        name = lambda x: self.node[x] if x < m else node[x - m]
        for x in np.flatnonzero(count).tolist():
            yield name(x), name(int(label[x])), int(count[x])


_LINKS = "a binary, b binary, n long"


def _verifier(kind: str, threshold: float):
    """Rows of a part come together: its members (role 0), then its visitors (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: _Part | None = None
        wait: list[tuple] = []
        out: list[tuple] = []
        closed = False

        def flush() -> None:
            nonlocal wait
            if wait:
                out.extend(part.met(*map(list, zip(*wait, strict=True))))
                wait = []

        def finish() -> None:
            nonlocal closed
            if part is not None and part.node and not closed:
                part.close()
                closed = True
                if part.key[-1] == 0:  # pairs of members are looked at in one lane
                    out.extend(part.inner())

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("size", "cell", "part", "lane")), strict=True)
            for key, role, node, n, vec in zip(keys, *(batch.column(c).to_pylist() for c in ("role", "node", "n", "vec")), strict=True):
                if part is None or part.key != key:
                    finish()
                    flush()
                    part, closed = _Part(key, threshold), False
                raw = np.frombuffer(vec, kind)
                if role == 0:
                    part.add(node, n, raw)
                    continue
                if not part.node:
                    continue  # nobody lives here
                finish()
                wait.append((node, n, raw))
                if len(wait) == BLOCK:
                    flush()
            if out:
                a, b, n = (list(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])
                out.clear()
        finish()
        flush()
        if out:
            a, b, n = (list(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return run


def fit_index(distinct: DataFrame, kind: str, threshold: float, target_recall: float) -> Index | None:
    """The index of distinct(node, vec): its most frequent length, the sample by smallest digests, codebooks by the number of vectors."""
    size = F.octet_length("vec")
    lengths = distinct.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not lengths:
        return None
    dims = lengths[0]["size"] // np.dtype(kind).itemsize
    rows = distinct.filter(size == lengths[0]["size"]).orderBy("node").limit(max(64, min(SAMPLE, SAMPLE_FLOATS // dims))).select("vec").collect()
    k = min(CENTROIDS, max(2, round(math.sqrt(lengths[0]["n"] / CELL))))
    return Index(unit(np.array([np.frombuffer(r["vec"], kind) for r in rows])), k, threshold, target_recall)


def similar(distinct: DataFrame, index: Index, kind: str, threshold: float) -> DataFrame:
    """(a, b, n) for distinct(node, vec, n): partial counts n of the rows linked with a, and b, a vector of a's component."""
    placed = materialise(distinct.mapInArrow(_cells(index, kind), "node binary, size int, home int, later array<int>"), "cells")
    vec = distinct.select("node", "vec", "n")
    homes = placed.groupBy("size", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("members")).withColumn("parts", F.ceil(F.col("members") / MEMBERS).cast("int"))
    homes = materialise(homes, "homes")
    member = join_counted(placed.select("node", "size", F.col("home").alias("cell")), homes.drop("members"), ["size", "cell"], ["node"], "members", counted=homes)
    member = materialise(member.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")), "members")
    # a visitor meets every part of a later cell, a member every later part of its own
    later = placed.select("node", "size", F.explode("later").alias("cell"))
    asked = materialise(later.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("calls")), "calls")
    at = homes.join(asked, ["size", "cell"], "left").select("size", "cell", "parts", F.coalesce("calls", F.lit(0)).alias("calls"))
    outer = join_counted(later, at.select("size", "cell", "parts"), ["size", "cell"], ["node"], "calls", counted=asked)
    outer = outer.select("node", "size", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    inner = member.filter("part + 1 < parts").select("node", "size", "cell", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"))
    visitor = outer.unionByName(inner)
    lanes = F.ceil((F.col("calls") + F.col("members")) / VISITORS).cast("int").alias("lanes")
    lanes = materialise(homes.join(asked, ["size", "cell"], "left").withColumn("calls", F.coalesce("calls", F.lit(0))).select("size", "cell", lanes, (F.col("calls") + F.col("members") * F.col("parts")).alias("rows")), "lanes")
    visitor = join_counted(visitor, lanes.drop("rows"), ["size", "cell"], ["node"], "rows", counted=lanes).withColumn("lane", F.pmod(F.xxhash64("node", F.lit(5)), "lanes").cast("int"))
    resident = join_counted(member, lanes.drop("rows"), ["size", "cell"], ["node"], "rows", counted=lanes).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    key = ["size", "cell", "part", "lane"]
    rows = visitor.select("node", *key, F.lit(1).alias("role")).unionByName(resident.select("node", *key, F.lit(0).alias("role"))).join(vec, "node")
    dealt = rows.repartition(*key).sortWithinPartitions(*key, "role").select(*key, "role", "node", "n", "vec")
    return materialise(dealt.mapInArrow(_verifier(kind, threshold), _LINKS), "links")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row per vector: id, n_links, component_id, component_size (rows) and kept."""
    src = vectors.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(vector_col).alias("v"))
    kind = "<f4" if src.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    id_type = src.schema["id"].dataType.simpleString()
    read = src.mapInArrow(_reader(kind), f"id {id_type}, uid long, node binary, vec binary")
    rows = materialise(read, "rows")
    distinct = materialise(rows.filter("node is not null").groupBy("node").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("id").alias("low")), "distinct")
    index = fit_index(distinct, kind, threshold, target_recall)
    alone = rows.filter("node is null").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(1).cast("long").alias("component_size"), F.lit(True).alias("kept"))
    if index is None:
        return alone
    found = similar(distinct, index, kind, threshold)
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    label = components(found.select("a", "b").filter("a != b").distinct())
    node = distinct.select("node", "n", "low").join(links, "node", "left").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    node = materialise(node, "nodes")
    comp = node.groupBy("comp").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_size"), F.count(F.lit(1)).alias("m"))
    comp = materialise(comp, "components")
    named = join_counted(node, comp.drop("m"), ["comp"], ["node"], "m", counted=comp)
    named = materialise(named.select("node", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", "component_size"), "named")
    out = join_counted(rows.select("id", "uid", "node").filter("node is not null"), named, ["node"], ["uid"], "n")
    out = out.select(F.col("id").alias(id_col), "n_links", "component_id", "component_size", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(alone)


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


QUERIES = {"op12_embedding_near_dedup": op12_embedding_near_dedup}

ORACLE = {
    "op12_embedding_near_dedup": """
        WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (SELECT x.rid AS a, y.rid AS b FROM v x, v y WHERE x.rid <> y.rid AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95),
        reach AS (SELECT rid AS a, rid AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        comp AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON b = rid GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
        named AS (SELECT rid, vec_id, coalesce(n_links, 0) AS n_links, component_id FROM v JOIN comp ON rid = comp.a LEFT JOIN n ON rid = n.a)
        SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM named
        UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings
        WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0"""
}
