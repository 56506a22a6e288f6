"""Exact dedup by content-defined chunk recipes.

Each text becomes a recipe, the ordered list of its chunks' digests. Chunks are deduplicated to
verified identifiers: occurrences that share a 128-bit digest must also agree on an independent
SHA-256 prefix and on the length, otherwise they get different identifiers. Texts are equal when
their ordered identifier lists are. Texts never move: only digests are shuffled, about 40 bytes for
each KB of text, and copies are folded into one recipe before that (map-side combine).

Defined results: a null text equals the empty text; a null id counts as the smallest; of equal texts
the row with the largest id stays, and exactly one row if that id repeats; an empty table gives an
empty result; a text of any length is taken whole (one must fit in a task, its recipe of some 5 % of its size too);
only the id and the text column are read, and the rows that stay keep all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.arrays import slices
from loomgraph.llm.cdc import cuts
from loomgraph.llm.names import own_columns, unused
from loomgraph.llm.skew import join_counted
from loomgraph.session import materialise, table

_SKETCH = "uid long, sha string, n_bytes long, rk binary, recipe array<struct<d:binary,c:binary>>"


def _sketch(bits: int, least: int, most: int):
    chunk = pa.struct([("d", pa.binary()), ("c", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                sha, n, keys, recipes = [], [], [], []
                for i, ends in enumerate(cuts(buf, off, bits, least, most)):
                    text = buf[off[i] : off[i + 1]].tobytes()
                    view, start, recipe = memoryview(text), 0, []
                    for end in ends.tolist():
                        part = view[start:end]
                        check = hashlib.sha256(part).digest()[:8] + (end - start).to_bytes(4, "big")
                        recipe.append({"d": xxhash.xxh3_128_digest(part), "c": check})
                        start = end
                    sha.append(hashlib.sha256(text).hexdigest())
                    n.append(len(text))
                    keys.append(hashlib.blake2b(b"".join(x["d"] + x["c"] for x in recipe), digest_size=16).digest())
                    recipes.append(recipe)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("uid"), pa.array(sha), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(recipes, pa.list_(chunk))],
                    ["id", "uid", "sha", "n_bytes", "rk", "recipe"],
                )

    return run


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 10, least: int = 256, most: int = 8192) -> DataFrame:
    """One row per document: id, uid (its row), sha, n_bytes, rk (recipe key) and recipe."""
    src = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(_sketch(bits, least, most), f"id {src.schema['id'].dataType.simpleString()}, {_SKETCH}")


def chunk_identifiers(distinct: DataFrame) -> DataFrame:
    """(d, c, chunk_id): the verified identifier of each distinct chunk.

    The identifier is the digest where all chunks with it agree on the check value, else both.
    """
    seen = distinct.select(F.explode("recipe").alias("x")).select("x.d", "x.c").groupBy("d", "c").agg(F.count(F.lit(1)).alias("n_uses"))
    agree = seen.groupBy("d").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return seen.join(agree, "d").select("d", "c", F.when(F.col("lo") == F.col("hi"), F.col("d")).otherwise(F.concat("d", "c")).alias("chunk_id"), "n_uses")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **chunking: int) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, n_bytes."""
    sketch = materialise(recipes(docs, id_col, text_col, **chunking), "recipes")
    distinct = materialise(
        sketch.groupBy("rk").agg(F.first("recipe").alias("recipe"), F.max(F.struct("id", "uid")).alias("best"), F.count(F.lit(1)).alias("n")), "recipe-groups"
    )
    ids = materialise(chunk_identifiers(distinct), "chunks")
    listed = (
        distinct.select("rk", F.posexplode_outer("recipe").alias("pos", "x"))
        .select("rk", "pos", F.col("x.d").alias("d"), F.col("x.c").alias("c"))
        .join(ids.select("d", "c", "chunk_id"), ["d", "c"], "left")
        .groupBy("rk")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    )
    same = listed.join(distinct.select("rk", "best", "n"), "rk").groupBy("ids").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"), F.collect_list("rk").alias("rks"))
    groups = materialise(same.select(F.explode("rks").alias("rk"), "best", "group_size"), "groups")
    # a text that a third of all rows hold is dealt to several tasks
    return join_counted(sketch, groups, ["rk"], ["uid"], "n", counted=distinct).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("text_sha256"), "n_bytes"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Repeated rows of one id and text leave one row. The text moves once, to meet the decision.
    """
    keep = exact_groups(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    return keep_rows(docs, keep, id_col, text_col)


def keep_rows(docs: DataFrame, keep: DataFrame, id_col: str, text_col: str, digits: int = 64) -> DataFrame:
    """Rows of docs whose (id, first digits of the text's SHA-256) is in keep(__id, __sha), each once."""
    sha = F.substr(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), F.lit(1), F.lit(digits))
    # one key column, so that the join finds the rows where the aggregation has put them
    key = lambda i, h: F.sha2(F.concat(F.coalesce(F.concat(F.lit("k"), i.cast("string")), F.lit("null")), F.lit("|"), h), 256)
    # repeated rows are combined before the shuffle, so a row that is a third of the table is no hot key
    k = unused(docs) + "k"
    mine = docs.withColumn(k, key(F.col(id_col), sha)).dropDuplicates([k])
    return mine.join(keep.select(key(F.col("__id"), F.col("__sha")).alias(k)), k, "left_semi").select(*own_columns(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op7_exact_dedup": op7_exact_dedup}

ORACLE = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
