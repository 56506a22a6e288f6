"""MinHash near-dedup by ProbMinHash.

Shingles of five words are weighted by 1 + ln(count). Each element sends arrivals of a Poisson process of
that rate to random signature components, and stops as soon as its next arrival is later than the
latest minimum of its text; equal components then estimate the probability Jaccard similarity J_P. Bands of
seven components (44 of them: a pair at 0.8 is missed with probability 3e-5) are buckets.

No bucket is expanded into all pairs. First every member is compared with the bucket's leader. Then
components are formed, and only buckets that still hold texts of several components go on: a bounded
number of members outside the bucket's largest component is compared with members of other
components, and leaves. A parity sketch of 1024 bits, one flip per shingle, comes first: the bits in
which two sketches differ are never more than the shingles in which the texts differ, so it bounds
their similarity from above, and pairs whose bound is below the threshold are not compared. This ends
when each pair of a bucket has been compared, ruled out by the bound, or is known to be in one
component, so the classes are those of all bucket pairs. Each comparison computes J_P exactly.

Texts that are equal byte for byte are one node throughout (their rows are combined before the shuffle),
so thousands of copies cost no comparison. Pairs are sorted by leader, so a leader's text travels once for
some thousand pairs; the pairs of one leader and the members of one bucket are dealt to several tasks.

Defined results: a null text is empty; a text of fewer than five words is one shingle; a text without
words is only in the class of its equal texts; a text of any length is taken whole (a pair of them must fit in a
task); a null id counts as the smallest; exactly one row of a class stays, the one with the largest id, and of
repeated rows of that id any; an empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.arrays import exact_shingles, mix64, shingles, slices
from loomgraph.llm.components import components
from loomgraph.llm.exact_dedup import keep_rows
from loomgraph.llm.skew import join_counted
from loomgraph.session import materialise, table

WORDS, THRESHOLD, ROWS, BANDS, LEADERS = 5, 0.8, 7, 44, 512
#: The pairs of one leader that are compared in one task; more are dealt to several.
PAIRS_A_PART = 2_000
#: The members of one bucket that meet its leaders in one task.
MEMBERS_A_PART = 1_000
_U = np.uint64


def prob_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k signatures: for each component the element with the earliest arrival (0: no element)."""
    first, signature = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    limit = np.where(np.bincount(text, minlength=n) > 0, np.inf, 0.0) if len(text) else np.zeros(n)
    clock, active, j = np.zeros(len(element)), np.arange(len(element)), 0
    while len(active):
        block = 1 if len(active) > 20_000 else min(64, 1 + 40_000 // len(active))
        steps = np.arange(j + 1, j + block + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
        h = mix64(element[active, None] + steps)
        gap = -np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[active, None]
        at = clock[active, None] + np.cumsum(gap, axis=1)
        cell = text[active, None] * k + ((mix64(h + _U(1)) >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)
        use = at < limit[text[active], None]
        flat, when, what = cell[use], at[use], np.broadcast_to(element[active, None], at.shape)[use]
        np.minimum.at(first, flat, when)
        win = when == first[flat]
        signature[flat[win]] = what[win]
        limit = first.reshape(n, k).max(axis=1)
        clock[active] = at[:, -1]
        active = active[at[:, -1] < limit[text[active]]]
        j += block
    return signature.reshape(n, k)


def weights(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(count)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets (sorted elements, weights), in O(n log n)."""
    (da, wa), (db, wb) = a, b
    if not len(da) or not len(db):
        return 0.0
    at = np.minimum(np.searchsorted(db, da), len(db) - 1)
    common = db[at] == da
    if not common.any():
        return 0.0
    x, y = wa[common], wb[at[common]]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # sum over all j of max(x_j / x_i, y_j / y_i): the ratio x / y decides which of the two it is
    ratio = x / y
    less = np.searchsorted(ratio, ratio, "left")
    below_x, below_y = np.concatenate(([0.0], np.cumsum(x)))[less], np.concatenate(([0.0], np.cumsum(y)))[less]
    more_x, less_y = wa.sum() - below_x, wb.sum() - y.sum() + below_y
    return float((1.0 / (more_x / x + less_y / y)).sum())


def _signer(words: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                n = len(off) - 1
                text, element, count = shingles(buf, off, words)
                sig = prob_minhash(text, element, weights(count), n, rows * bands).reshape(n, bands, rows)
                key = np.broadcast_to(salt, (n, bands)).copy()
                for r in range(rows):
                    key = mix64(key * _U(31) + sig[:, :, r])
                has = np.bincount(text, minlength=n) > 0
                keys = [k.view(np.int64) if ok else [] for k, ok in zip(key, has, strict=True)]
                digest = [hashlib.sha256(buf[off[i] : off[i + 1]]).digest()[:16] for i in range(n)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("uid"), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "uid", "th", "keys"])

    return run


def exact_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two texts from their `exact_shingles`."""
    return probability_jaccard(*[(digest, weights(count)) for digest, count in (a, b)])


def _verifier(words: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader: tuple | None = None  # the first row of each (a, part) has the leader's own text and no b
        whole, exact = b"", None
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                text, element, count = shingles(buf, off, words)
                at, weight = np.searchsorted(text, np.arange(len(off))), weights(count)
                out = []
                for i, (a, b) in enumerate(zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), strict=True)):
                    own = element[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]
                    if b is None:
                        leader, whole, exact = own, buf[off[i] : off[i + 1]].tobytes(), None
                        continue
                    ok = probability_jaccard(leader, own) >= threshold - 1e-12
                    if ok:
                        exact = exact or exact_shingles(whole, words)
                        ok = exact_similarity(exact, exact_shingles(buf[off[i] : off[i + 1]].tobytes(), words)) >= threshold - 1e-12
                    out.append((a, b, ok))
                if out:
                    a, b, ok = (list(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(ok)], ["a", "b", "ok"])

    return run


_SKETCH = [f"p{i}" for i in range(16)]


def _sketches(words: int):
    """Of each text: n distinct shingles, extra (their weight above n) and its parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                text, element, count = shingles(buf, off, words)
                size = len(off) - 1
                bit = (mix64(element + _U(9)) % _U(64 * len(_SKETCH))).astype(np.int64)
                odd = (np.bincount(text * (64 * len(_SKETCH)) + bit, minlength=size * 64 * len(_SKETCH)) & 1).astype(np.uint8)
                packed = np.packbits(odd.reshape(size, -1), axis=1).view(np.int64)
                n = np.bincount(text, minlength=size)
                extra = np.bincount(text, weights(count), size) - n
                yield pa.RecordBatch.from_arrays([part.column("th"), pa.array(n), pa.array(extra), *(pa.array(packed[:, i].copy()) for i in range(len(_SKETCH)))], ["th", "n", "extra", *_SKETCH])

    return run


def _bound(threshold: float):
    """Whether J_P of a row and its leader can reach the threshold.

    J_P is at most (|x and y| + both extras) / |x or y|, and the sketches bound |x minus y| + |y minus x|.
    """
    differ = F.lit(0)
    for p in _SKETCH:
        differ = differ + F.bit_count(F.col(p).bitwiseXOR(F.col(f"lead_{p}")))
    n = F.col("n") + F.col("lead_n")
    return (n - differ) / 2 + F.col("extra") + F.col("lead_extra") >= threshold * (n + differ) / 2 - 1e-9


def _digest(text_col: str):
    return F.unhex(F.substr(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), F.lit(1), F.lit(32)))


class _Texts:
    """Whole texts by digest, for the candidates only."""

    def __init__(self, docs: DataFrame, text_col: str, nodes: DataFrame) -> None:
        src = docs.select(_digest(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        # the same join at every size; the aggregation finds the rows where it has put them
        src = src.join(materialise(nodes, "candidates").hint("merge"), "th", "left_semi")
        self.texts = materialise(src.groupBy("th").agg(F.first("text").alias("text")), "candidate-texts")

    def sketches(self, nodes: DataFrame, words: int) -> DataFrame:
        text = self.texts.join(nodes, "th", "left_semi")
        return materialise(text.mapInArrow(_sketches(words), "th binary, n long, extra double, " + ", ".join(f"{p} long" for p in _SKETCH)), "sketches")

    def verify(self, pairs: DataFrame, words: int, threshold: float) -> DataFrame:
        """pairs(a, b) with ok: whether the two texts are similar.

        The pairs of a leader a are dealt to parts of some PAIRS_A_PART; its text goes once to each part,
        not to each pair.
        """
        pairs = materialise(pairs, "pairs")
        parts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / PAIRS_A_PART).cast("int"))
        parts = materialise(parts, "leaders")
        dealt = join_counted(pairs, parts, ["a"], ["b"], "n").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
        # a text is a member of at most one pair for each of its buckets and leaders, so b is not hot
        members = dealt.select("a", "part", "b").join(self.texts.withColumnRenamed("th", "b"), "b")
        leaders = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(self.texts.withColumnRenamed("th", "a"), "a")
        both = members.select("a", "part", "b", "text").unionByName(leaders.withColumn("b", F.lit(None).cast("binary")))
        sorted_ = both.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return materialise(sorted_.select("a", "b", "text").mapInArrow(_verifier(words, threshold), "a binary, b binary, ok boolean"), "verified")


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per document: id, uid (its row), th (digest of the text) and keys (one per band)."""
    src = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(_signer(words, rows, bands), f"id {src.schema['id'].dataType.simpleString()}, uid long, th binary, keys array<long>")


def text_classes(docs: DataFrame, distinct: DataFrame, text_col: str, words: int, threshold: float) -> DataFrame:
    """(node, comp) of the texts that have a similar different text; distinct has th and keys of each text once."""
    spread = distinct.select("th", F.explode("keys").alias("key"))
    many = materialise(spread.groupBy("key").agg(F.min("th").alias("leader"), F.max("th").alias("last")).filter("leader != last").select("key", "leader"), "buckets")
    bucket = materialise(spread.join(many, "key").select("key", "th", "leader"), "members")
    texts = _Texts(docs, text_col, bucket.select("th").distinct())
    first = bucket.filter("th != leader").select(F.col("leader").alias("a"), F.col("th").alias("b")).distinct()
    seen = texts.verify(first, words, threshold)
    links = seen.filter("ok").select("a", "b")
    label = components(links)
    open_rows, sketch = bucket.filter("th != leader").select("key", "th"), None
    while True:
        rows = materialise(_several(open_rows, label), "open")
        if rows.isEmpty():
            return label
        if sketch is None:
            sketch = texts.sketches(rows.select("th").distinct(), words)
        largest = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"))
        turn = Window.partitionBy("key").orderBy("th")
        leaders = rows.join(largest, "key").filter("comp != largest").withColumn("__n", F.row_number().over(turn)).filter(F.col("__n") <= LEADERS)
        leaders = materialise(leaders.select("key", "th", "comp"), "leaders")
        # members of a bucket are dealt to parts; the leaders, at most LEADERS a bucket, go to each part
        parts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        parts = materialise(parts.withColumn("parts", F.ceil(F.col("size") / MEMBERS_A_PART).cast("int")), "bucket-parts")
        dealt = join_counted(rows, parts, ["key"], ["th"], "size").withColumn("part", F.pmod(F.xxhash64("th"), "parts").cast("int"))
        lead = leaders.join(sketch, "th").join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        other = lead.select(*[F.col(c).alias(f"lead_{c}") for c in ("key", "part", "th", "comp", "n", "extra", *_SKETCH)])
        here = (F.col("key") == F.col("lead_key")) & (F.col("part") == F.col("lead_part"))
        met = dealt.join(sketch, "th").join(other, here & (F.col("comp") != F.col("lead_comp")) & _bound(threshold))
        pairs = met.select(F.least("th", "lead_th").alias("a"), F.greatest("th", "lead_th").alias("b")).distinct()
        found = texts.verify(pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti"), words, threshold)
        seen = seen.unionByName(found)
        if not found.filter("ok").isEmpty():
            links = links.unionByName(found.filter("ok").select("a", "b"))
            label = components(links)
        open_rows = rows.select("key", "th").join(leaders.select("key", "th"), ["key", "th"], "left_anti")


def _several(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with comp, of the buckets that hold more than one component."""
    rows = rows.join(label.withColumnRenamed("node", "th"), "th", "left").withColumn("comp", F.coalesce("comp", "th"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    return rows.join(mixed, "key")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, group_id (the id that stays), group_size, n_texts, kept and text_hash."""
    signed = materialise(signatures(docs, id_col, text_col, words), "signed")
    texts = materialise(signed.groupBy("th").agg(F.first("keys").alias("keys"), F.max(F.struct("id", "uid")).alias("best"), F.count(F.lit(1)).alias("n")), "digests")
    label = text_classes(docs, texts, text_col, words, threshold)
    texts = materialise(texts.drop("keys").join(label.withColumnRenamed("node", "th"), "th", "left").withColumn("comp", F.coalesce("comp", "th")), "texts")
    group = texts.groupBy("comp").agg(F.max("best").alias("top"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("n_texts"))
    group = materialise(group, "components")
    of = join_counted(texts.select("th", "comp", "n"), group, ["comp"], ["th"], "n_texts").drop("comp")
    out = join_counted(signed.select("id", "uid", "th"), materialise(of, "groups"), ["th"], ["uid"], "n")
    return out.select(F.col("id").alias(id_col), F.col("top.id").alias("group_id"), "group_size", "n_texts", (F.col("uid") == F.col("top.uid")).alias("kept"), F.lower(F.hex("th")).alias("text_hash"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    keep = near_groups(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__sha"))
    return keep_rows(docs, keep, id_col, text_col, 32)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_size", "n_texts", "kept")


QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLE: dict[str, str] = {}
