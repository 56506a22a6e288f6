"""Weighted rendezvous sharding, in SQL functions only.

Each record key draws a uniform number for each shard from a hash of (seed, key, shard) and goes to
the shard with the largest weight / -ln(number). Adding a shard moves only the rows that the new one
wins, a share of about its weight; changing a weight moves rows only to or from that shard. Slots
number the rows of a shard without gaps in hash order: rows are counted in blocks of bounded size,
block offsets are summed, and each block is numbered on its own, so no shard is one task's work.

Defined results: a null key hashes as its own value; a null text has size 1 and CRC 0; repeated
rows are counted before the shuffle and expanded after it, each with a slot of its own; an empty table
gives an empty result; with ties in the draw the lower shard wins, and rows of equal place in the order go by
their further columns; only the size and CRC of a text of any length move; columns other than the id and the text
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.session import materialise, table

ROWS_A_BLOCK = 200_000


def _key(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))


def rendezvous(key: Column, weights: Sequence[float], seed: int = 17) -> Column:
    """The shard (0 to len(weights) - 1) of a key; shards of weight 0 get nothing."""
    if not weights or max(weights) <= 0 or min(weights) < 0:
        raise ValueError("weights must be non-negative with at least one above 0")
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), _key(key), F.lit(shard)), 11)
            uniform = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
            draws.append(F.struct((F.lit(float(weight)) / -F.log(uniform)).alias("s"), F.lit(-shard).alias("k")))
    best = draws[0] if len(draws) == 1 else F.greatest(*draws)
    return -best["k"]


def slots(rows: DataFrame, shard: str, order: Sequence[str], total: int) -> DataFrame:
    """rows, repeated ones included, with a gapless slot from 0 in each shard."""
    cols = rows.columns
    blocks = max(1, -(-total // ROWS_A_BLOCK))
    counted = materialise(rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(blocks))), "shard-rows")
    sums = counted.groupBy(shard, "__b").agg(F.sum("__n").alias("__s"))
    at = Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(shard, "__b", F.coalesce(F.sum("__s").over(at), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(shard, "__b").orderBy(*order, *[c for c in cols if c not in order and c != shard]).rowsBetween(Window.unboundedPreceding, -1)
    first = counted.join(offsets, [shard, "__b"]).withColumn("__f", F.col("__o") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    step = 4096
    return (
        first.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / step))).alias("__c"))
        .select("*", F.explode(F.sequence(F.col("__c") * step, F.least((F.col("__c") + 1) * step, F.col("__n")) - 1)).alias("__i"))
        .select(*cols, (F.col("__f") + F.col("__i")).alias("slot"))
    )


def shard_documents(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """One narrow row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    grown = [*weights, sum(weights) / len(weights)]
    key, text = F.col(id_col), F.col(text_col)
    rows = docs.select(
        key.alias(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights, seed).cast("int").alias("shard"),
        rendezvous(key, grown, seed).cast("int").alias("grown_shard"),
    )
    return slots(rows, "shard", [id_col, "text_crc32"], docs.count())


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * 8)


QUERIES = {"op5_rendezvous_sharding": op5_rendezvous_sharding}
ORACLE: dict[str, str] = {}
