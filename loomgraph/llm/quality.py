"""Quality classifier: Naive Bayes support vectors (NB-SVM).

Indicators of n-grams (words, and shapes of one to three tokens) are scaled by their class log-count
ratios, rows are brought to unit length, and a linear hinge-loss model is fitted by dual coordinate
descent. The margin becomes a probability by a logistic fit on rows that the model has not seen.

Training reads a bounded sample of labelled rows (`sample_rows`, by hash order of the id), so it is
one small task; scoring is a map over all whole texts without a shuffle. Labels, lang, source and id
never enter a score: equal texts get equal scores.

Defined results: a null text is empty; an empty text has only the constant feature; rows whose label
is null don't count; of repeated labels for an id the largest counts, of repeated rows the least text;
without labels every score is 0.5, and with labels of one class alone every score is that label; a text of any length
is scored whole (one must fit in a task); equal ranks of the sample go by id, and a score equal to a threshold is good;
an empty table gives an empty result; `score` reads no further columns, `good_documents` passes them on, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.arrays import fingerprints, mix64, slices
from loomgraph.session import table

BITS = 18
SAMPLE_ROWS = 12_000
_U = np.uint64

_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each distinct n-gram of each text; feature 0 is the constant."""
    n = len(off) - 1
    keys = [np.arange(n, dtype=np.int64) << BITS]
    if len(buf):
        kind = _CLASS[buf]
        edge = np.concatenate(([True], kind[1:] != kind[:-1]))
        edge[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(edge)
        end = np.concatenate((start[1:], [len(buf)]))
        solid = kind[start] > 0
        start, end = start[solid], end[solid]
        text = np.searchsorted(off, start, "right") - 1
        token = fingerprints(_LOWER[buf], start, end, 3)

        def share(lo: int, hi: int) -> np.ndarray:
            seen = np.concatenate(([0], np.cumsum((buf >= lo) & (buf <= hi), dtype=np.int32)))
            return (seen[end] - seen[start]) > 0

        size = np.minimum(end - start, 15) // 4
        again = np.concatenate(([False], (token[1:] == token[:-1]) & (text[1:] == text[:-1])))
        shape = share(65, 90) + 2 * share(97, 122) + 4 * share(48, 57) + 8 * again + 16 * size
        shape = np.where(kind[start] == 1, mix64(shape.astype(np.uint64) + _U(1)), token ^ (again.astype(np.uint64) * _U(977)))
        grams = [(text, mix64(token + _U(5)))]
        gram = shape
        for k in range(3):
            if k:
                gram = mix64(gram[:-1] * _U(31) + shape[k:])
            same = text[k:] == text[: len(text) - k]
            grams.append((text[k:][same], mix64(gram + _U(k))[same]))
        keys += [(t.astype(np.int64) << BITS) | np.maximum((g >> _U(64 - BITS)).astype(np.int64), 1) for t, g in grams]
    key = np.unique(np.concatenate(keys))
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    """ratio: log-count ratios; weight: the fitted model times the ratios; a, b: logistic fit."""

    ratio: np.ndarray
    weight: np.ndarray
    a: float
    b: float

    def margins(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        length = np.sqrt(np.bincount(text, self.ratio[feature] ** 2, n))
        return np.bincount(text, self.weight[feature], n) / np.maximum(length, 1e-9)

    def scores(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(text, feature, n) + self.b, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = [np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)]
    for feature, label in zip(rows, y, strict=True):
        counts[label][feature] += 1
    p, q = counts[1] / counts[1].sum(), counts[0] / counts[0].sum()
    ratio = np.log(p / q)
    ratio[0] = 1.0
    return ratio


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 5) -> np.ndarray:
    """Weights of min |w|^2 / 2 + c * sum of hinge losses; every row has unit length."""
    w, alpha, sign = np.zeros(1 << BITS), np.zeros(len(rows)), np.where(y > 0, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - slope, 0.0), c)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * sign[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def logistic_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of P(1) = 1 / (1 + exp(-(a * margin + b))), by damped Newton steps, slightly shrunk."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - y) * margin).sum() + 1e-2 * a, (p - y).sum()])
        h = p * (1 - p)
        m = np.array([[(h * margin**2).sum() + 1e-2, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(m, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    one = np.ones(1 << BITS)
    if not len(y) or y.min() == y.max():
        return Model(one, np.zeros(1 << BITS), 0.0, 0.0 if not len(y) else (30.0 if y[0] else -30.0))
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    use = np.flatnonzero(~held)
    ratio = log_count_ratios([rows[i] for i in use], y[use])
    values = [v / np.sqrt((v**2).sum()) for v in (ratio[r] for r in rows)]
    w = dual_coordinate_descent([rows[i] for i in use], [values[i] for i in use], y[use])
    check = np.flatnonzero(held) if held.any() else use
    a, b = logistic_fit(np.array([w[rows[i]] @ values[i] for i in check]), y[check])
    return Model(ratio, w * ratio, a, b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, off in slices(batch, "text"):
            text, feature = features(buf, off)
            at = np.searchsorted(text, np.arange(len(off)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("rank"), rows.column("label"), pa.array([feature[at[i] : at[i + 1]].astype(np.int32).tobytes() for i in range(len(off) - 1)], pa.binary())], ["rank", "label", "features"]
            )


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = sorted((r, x, f) for b in batches for r, x, f in zip(*(b.column(c).to_pylist() for c in ("rank", "label", "features")), strict=True))
    model = fit([np.frombuffer(f, np.int32).astype(np.int64) for _, _, f in got], np.array([x for _, x, _ in got], np.int64))
    yield pa.RecordBatch.from_pydict({"ratio": [model.ratio.astype(np.float32).tobytes()], "weight": [model.weight.astype(np.float32).tobytes()], "a": [model.a], "b": [model.b]})


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows labelled rows that are not held out."""
    key = F.col(id_col)
    known = (
        labels.filter(F.col(label_col).isNotNull() & ~held_out(key))
        .groupBy(key.alias("__id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .withColumn("rank", F.xxhash64(F.lit(29), F.col("__id").cast("string")))
        .orderBy("rank", "__id")
        .limit(sample_rows)
    )
    # the sample is bounded by a parameter, so it can be sent to every executor
    rows = docs.select(key.alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "__id")
    rows = rows.groupBy("__id", "rank", "label").agg(F.min("text").alias("text")).select("rank", "label", "text")
    got = rows.mapInArrow(_extract, "rank long, label int, features binary").repartition(1).mapInArrow(_train, "ratio binary, weight binary, a double, b double").first()
    if got is None:
        return fit([], np.zeros(0, np.int64))
    return Model(*(np.frombuffer(got[k], np.float32).astype(np.float64) for k in ("ratio", "weight")), got["a"], got["b"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id column with score: the probability that a text is of class 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                got = held.value.scores(*features(buf, off), len(off) - 1)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(got)], ["id", "score"])

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def good_documents(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least threshold, with all their columns; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, text_col):
                yield rows.filter(pa.array(held.value.scores(*features(buf, off), len(off) - 1) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
ORACLE: dict[str, str] = {}
