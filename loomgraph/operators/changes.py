"""What has changed, and what the last state of a log is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import schema_number

IDENTITY = ("sha256", "extraction_config", "llm_model", "index_config", "embedding_config")


def detect_changes(files: DataFrame, manifest: DataFrame, identity: tuple[str, ...] = IDENTITY) -> DataFrame:
    """path and change (added, modified, deleted, unchanged) of each path of either table."""
    now = files.select(F.col("path"), F.struct(*identity).alias("now"))
    old = manifest.select(F.col("path"), F.struct(*identity).alias("old"))
    same = F.lit(True)
    for c in identity:
        same = same & F.col(f"now.{c}").eqNullSafe(F.col(f"old.{c}"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return now.join(old, "path", "full_outer").select("path", change.alias("change"))


def to_process(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("change").isin("added", "modified")).select("path").distinct()


def converge(log: DataFrame) -> DataFrame:
    """The last record of each source: largest ts as text, then version number, then first written (pos)."""
    last = Window.partitionBy("source_file").orderBy(F.desc("ts"), F.desc(schema_number(F.col("schema_version"))), "pos")
    return log.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def check_versions(log: DataFrame, target: str) -> None:
    """Raise when a record is of another schema version; there are no migrations."""
    if not log.filter(~F.col("schema_version").eqNullSafe(F.lit(target))).isEmpty():
        raise ValueError(f"the log has records that are not of schema version {target}")
