"""A join that spreads hot keys, whose rows may be a third of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than ROWS rows and more than 1 / KEYS of all rows, so there are fewer than KEYS hot keys.
ROWS, KEYS = 2_000, 2_000


def join_counted(rows: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str], count: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """rows joined to right, which has at most one row for each key.

    counted, a materialised table (right itself by default), holds the number of rows of each key in the
    column `count`. The rows of a hot key are dealt by a hash of the columns `spread` to several tasks, each
    with a copy of the key's row of right. Only the hot keys, fewer than KEYS at any size, are broadcast. A
    null key meets nothing; empty tables give what a plain join gives.
    """
    counted = right if counted is None else counted
    total = counted.agg(F.sum(count)).first()[0] or 0
    limit = max(ROWS, total // KEYS)
    hot = F.broadcast(counted.filter(F.col(count) > limit).select(*keys, F.ceil(F.col(count) / limit).cast("int").alias("__parts")))
    left = rows.join(hot, list(keys), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*spread), "__parts").cast("int"), F.lit(0)))
    copies = right.join(hot, list(keys), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return left.drop("__parts").join(copies.drop("__parts"), [*keys, "__salt"], how).drop("__salt")
