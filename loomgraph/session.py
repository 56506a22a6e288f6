"""Session helpers shared by every part of the library."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers on this host import the package (a cluster uses --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (only where unset, with a local master) a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _local_folder()
    return path.rstrip("/")


@lru_cache(maxsize=1)
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="loomgraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def work_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; `clean` removes it."""
    return f"{shared_dir(spark)}/loomgraph-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application: call it when results have been written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    The files outlive lost executors; unlike a local checkpoint nothing has to be recomputed.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to tasks, for work that costs far more than its input's bytes, which alone decide how a file is split."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """df with name: each row's place in this order, from 1.

    Rows are sorted in ranges and numbered within them; only the sizes of the ranges come to the driver.
    """
    spark = df.sparkSession
    ranges = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    i = F.col("__i")
    held = materialise(ranges.withColumn("__i", F.monotonically_increasing_id()), "numbered").withColumn("__p", F.shiftright(i, 33))
    starts, start = [], 0
    for r in held.groupBy("__p").count().orderBy("__p").collect():
        starts.append((r["__p"], start))
        start += r["count"]
    first = spark.createDataFrame(starts, "__p long, __s long")
    return held.join(F.broadcast(first), "__p").withColumn(name, F.col("__s") + i.bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__i", "__p", "__s")


def carried(df: DataFrame, order: str, value: str) -> DataFrame:
    """df with `value` filled by the last one that is not null up to each row, in the order of a column.

    As in `numbered` rows are sorted in ranges; one row a range comes to the driver, to start the next one.
    """
    spark = df.sparkSession
    ranges = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order)
    held = materialise(ranges.withColumn("__p", F.spark_partition_id()), "carried")
    known, last = [], None
    for r in held.groupBy("__p").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("v")).orderBy("__p").collect():
        known.append((r["__p"], last))
        last = last if r["v"] is None else r["v"]
    before = spark.createDataFrame(known, df.select(F.lit(0).alias("__p"), F.col(value).alias("__v")).schema)
    here = F.last(value, ignorenulls=True).over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn(value, here).join(F.broadcast(before), "__p").withColumn(value, F.coalesce(value, "__v")).drop("__p", "__v")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
