"""Names for helper columns beside a table's own, whatever those are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame) -> str:
    """A prefix that no column of df starts with."""
    prefix, taken = "__", [c.lower() for c in df.columns]
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of df, in order, quoted."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
