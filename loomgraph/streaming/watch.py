"""Watching a folder, and debouncing change events, with Structured Streaming.

The file source of Spark reports only new paths, so the folder is listed in each micro-batch and compared
by fingerprint: additions, changes and deletions all count. A build runs when the listing has
changed and then stayed the same for one interval; batches of a query run one after the other.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.session import carried, materialise
from loomgraph.sources.files import scan

log = logging.getLogger("loomgraph")


def listing(spark: SparkSession, raw_dir: str) -> DataFrame:
    """(path, mark) of each supported path: size and time; contents are not read."""
    return scan(spark, raw_dir).select("path", F.concat_ws("|", "size", "modified").alias("mark"))


def fingerprint(listed: DataFrame) -> tuple:
    """One row for a whole listing, whatever its order; no path comes to the driver."""
    mark = F.xxhash64("path", "mark")
    return tuple(listed.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)"))).first())


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """path: added, changed and deleted ones, by a join of two listings."""
    both = old.withColumnRenamed("mark", "before").join(new.withColumnRenamed("mark", "after"), "path", "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select("path")


class Watch:
    """start() runs on_change(paths) for settled changes; errors of the callback are logged."""

    def __init__(self, spark: SparkSession, raw_dir: str, on_change: Callable[[list[str]], None], seconds: float = 0.5) -> None:
        self.spark, self.raw_dir, self.on_change, self.seconds = spark, raw_dir, on_change, seconds
        self.known = materialise(listing(spark, raw_dir), "listing")
        self.last = self.seen = fingerprint(self.known)
        self.query: StreamingQuery | None = None

    def tick(self) -> list[str]:
        """One look; the settled paths that were given to the callback. Only changed paths come to the driver."""
        found = fingerprint(listing(self.spark, self.raw_dir))
        settled, self.seen = found == self.seen, found
        if not settled or found == self.last:
            return []
        now = materialise(listing(self.spark, self.raw_dir), "listing")
        paths = sorted(r["path"] for r in changed_paths(self.known, now).collect())
        self.known, self.last = now, fingerprint(now)
        if paths:
            try:
                self.on_change(paths)
            except Exception:
                log.exception("build for %d changed paths failed", len(paths))
        return paths

    def start(self) -> StreamingQuery:
        source = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        self.query = source.writeStream.trigger(processingTime=f"{int(self.seconds * 1000)} milliseconds").foreachBatch(lambda *_: self.tick() and None).start()
        return self.query

    def flush(self) -> list[str]:
        """Without waiting for silence."""
        self.seen = fingerprint(listing(self.spark, self.raw_dir))
        return self.tick()

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()


def slices(events: DataFrame, gap: str) -> tuple[DataFrame, DataFrame]:
    """Sessions of (ts, path) without a common key: (slice, path, n) and (slice, start, until) in microseconds.

    Time is cut into slices of the gap's length. Events of a slice are closer than the gap, so they are one session, and
    its first and last event are all that counts; a slice goes on from the one before it if that ended less than
    a gap ago. Starts are then carried along the slices in ranges. Rows without time or path are no events.
    """
    gap_us = events.sparkSession.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.lit(gap).cast("interval"))).first()[0]
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.filter("ts IS NOT NULL AND path IS NOT NULL").select("path", t.alias("t"), (t - F.pmod(t, F.lit(gap_us))).alias("slice"))
    seen = materialise(rows.groupBy("slice", "path").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("n")), "slices")
    each = seen.groupBy("slice").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    before = each.select((F.col("slice") + gap_us).alias("slice"), F.col("last").alias("before"))
    opens = F.col("before").isNull() | (F.col("first") - F.col("before") >= gap_us)
    run = carried(each.join(before, "slice", "left").select("slice", "last", F.when(opens, F.col("first")).alias("start")), "slice", "start")
    return seen.select("slice", "path", "n"), run.select("slice", "start", (F.col("last") + gap_us).alias("until"))


def session_paths(events: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """(start, path, n): the distinct paths of each session of a table of events, a row each; no session is held as one row."""
    seen, run = slices(events, gap)
    return seen.join(run, "slice").groupBy(F.timestamp_micros("start").alias("start"), "path").agg(F.sum("n").alias("n"))


def _table_sessions(events: DataFrame, gap: str) -> DataFrame:
    seen, run = slices(events, gap)
    run = materialise(run, "runs")
    path = seen.join(run, "slice").groupBy("start", "path").agg(F.sum("n").alias("n"))
    own = path.groupBy("start").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.sum("n").alias("n"))
    ends = run.groupBy("start").agg(F.max("until").alias("end"))
    return own.join(ends, "start").select(F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "paths", "n")


def debounced(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 minutes", formats: tuple[str, ...] | None = None) -> DataFrame:
    """Sessions of (ts, path): the sorted distinct paths of each stretch without a gap.

    Each event restarts the gap, as a debounce timer does. Of a stream late events are dropped by the watermark;
    a table is cut into slices and no task gets all of it. For long sessions of a table see session_paths.
    """
    if formats:
        events = events.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*formats))
    if not events.isStreaming:
        return _table_sessions(events, gap)
    # a streaming session needs a key; all events of the folder have the same
    events = events.filter("path IS NOT NULL").withWatermark("ts", late).withColumn("folder", F.when(F.col("path").isNotNull(), "watched"))
    out = events.groupBy("folder", F.session_window("ts", gap).alias("w")).agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "n")


def moves_as_two(events: DataFrame) -> DataFrame:
    """A move is a change of its source and of its destination."""
    return events.select("ts", F.explode(F.array_compact(F.array("path", "moved_to"))).alias("path"))
