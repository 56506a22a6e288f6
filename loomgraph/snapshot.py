"""Versioned tables; one file makes a version, so readers see the old or the new one, never a mixture."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schemas import COMMUNITIES, EDGES, KEYWORDS, LOG, MANIFEST, NODES, REVIEW, VECTORS

TABLES = {"nodes": NODES, "edges": EDGES, "concepts": f"{NODES}, seq long", "communities": COMMUNITIES, "keywords": KEYWORDS, "vectors": VECTORS, "manifest": MANIFEST}


def replace_with_retry(replace: Callable[[], None], retries: int = 10, delay: float = 0.005) -> None:
    """Run replace; a refusal (another program has the file open) is tried again, the last one raised."""
    for attempt in range(retries):
        try:
            return replace()
        except (PermissionError, Py4JJavaError) as e:
            if attempt == retries - 1 or (isinstance(e, Py4JJavaError) and "AccessDenied" not in str(e.java_exception) and "AccessControl" not in str(e.java_exception)):
                raise
            time.sleep(delay)


#: Buckets of the tables of sources, by a hash of the source: what a build of a few changed files has to write.
BUCKETS = 64
KEYED = {"edges": "source_file", "concepts": "source_file", "vectors": "source_file", "manifest": "path"}


def bucket(source: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(source, F.lit(""))), F.lit(BUCKETS)).cast("int")


class ConcurrentBuildError(RuntimeError):
    """Another build has committed the version that this one was to become."""


class Store:
    """The tables below out_dir, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, out_dir: str) -> None:
        self.spark, self.out = spark, out_dir.rstrip("/")
        self.pinned: int | None = None
        self.jvm = spark._jvm.org.apache.hadoop
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self.jvm.fs.Path(f"{self.out}/{name}")
        return path.getFileSystem(self.conf), path

    def read_text(self, name: str) -> str | None:
        fs, path = self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Write beside the file, then put it in its place."""
        fs, path = self._path(name)
        _, new = self._path(name + ".new")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(self.jvm.fs.Options.Rename, 1)
        options[0] = self.jvm.fs.Options.Rename.OVERWRITE
        context = self.jvm.fs.FileContext.getFileContext(fs.makeQualified(path).toUri(), self.conf)
        replace_with_retry(lambda: context.rename(fs.makeQualified(new), fs.makeQualified(path), options))

    # A version is one file, versions/<N>.json: the folders that hold each table's buckets, and the folders of the log up
    # to it. Publishing that file is the commit; it fails if the file is there, so of two builds on one version one wins.

    @property
    def version(self) -> int:
        return self.pinned if self.pinned is not None else self._latest()

    def _latest(self) -> int:
        fs, path = self._path("versions")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def pin(self) -> int:
        """From now on read this version, and commit on top of it alone."""
        self.pinned = self._latest()
        return self.pinned

    def _about(self, version: int) -> dict:
        return json.loads(self.read_text(f"versions/{version}.json") or '{"tables": {}, "log": []}')

    def layout(self, version: int) -> dict[str, dict[str, str]]:
        """Of each table of a version the buckets (one without a name for whole tables) and the folder that holds them."""
        return self._about(version)["tables"]

    def read(self, name: str) -> DataFrame:
        parts = self.layout(self.version).get(name, {})
        if not parts:
            return self.spark.createDataFrame([], TABLES[name])
        paths = [f"{self.out}/{at}/{name}" + (f"/bucket={k}" if k else "") for k, at in parts.items()]
        return self.spark.read.schema(TABLES[name]).parquet(*paths)

    def write(self, tables: dict[str, DataFrame], touched: DataFrame | None = None, log: DataFrame | None = None) -> int:
        """Write a new version with its part of the log, then commit both by one file.

        Tables of sources are kept in BUCKETS buckets by source. With touched (source_file), the sources that have
        changed, only their buckets are written; the others stay where an older version has put them. A version that
        another build has committed meanwhile raises ConcurrentBuildError, and nothing of this one stays.
        """
        old = self.version
        new, about = old + 1, self._about(old)
        before, mine = about["tables"], f"v={new}-{uuid.uuid4().hex[:12]}"
        wanted = None if touched is None or not old else {r[0] for r in touched.select(bucket(F.col("source_file"))).distinct().collect()}
        after: dict[str, dict[str, str]] = {}
        for name in TABLES:
            path = f"{self.out}/{mine}/{name}"
            if name not in KEYED:
                tables[name].write.parquet(path)
                after[name] = {"": mine}
                continue
            rows = tables[name].withColumn("bucket", bucket(F.col(KEYED[name])))
            if wanted is not None:
                rows = rows.filter(F.col("bucket").isin(*wanted)) if wanted else rows.limit(0)
            rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
            written = {str(k): mine for k in range(BUCKETS) if self.exists(f"{mine}/{name}/bucket={k}")}
            after[name] = written | {k: v for k, v in before.get(name, {}).items() if wanted is not None and int(k) not in wanted}
        logs = list(about["log"])
        if log is not None:
            log.withColumn("seq", F.lit(new).cast("long")).write.json(f"{self.out}/triples_log/{mine}")
            logs.append(mine)
        if not self._publish(f"versions/{new}.json", json.dumps({"tables": after, "log": logs})):
            for left in (mine, f"triples_log/{mine}"):
                self._delete(left)
            raise ConcurrentBuildError(f"version {new} has been committed by another build")
        if self.pinned is not None:
            self.pinned = new
        self._sweep(new)
        return new

    def _publish(self, name: str, text: str) -> bool:
        """Put a whole file in its place, unless there is one: False then.

        Locally by a hard link; elsewhere by a rename that does not overwrite, which file systems like HDFS do in one step.
        """
        fs, path = self._path(name)
        _, new = self._path(f"{name}.{uuid.uuid4().hex}.new")
        stream = fs.create(new, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        path, new = fs.makeQualified(path), fs.makeQualified(new)
        try:
            if fs.getScheme() == "file":
                of = self.spark._jvm.java.nio.file.Paths.get
                self.spark._jvm.java.nio.file.Files.createLink(of(path.toUri()), of(new.toUri()))
            else:
                self.jvm.fs.FileContext.getFileContext(path.toUri(), self.conf).rename(new, path, self.spark.sparkContext._gateway.new_array(self.jvm.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(new, False)
        return True

    def _delete(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    def _sweep(self, new: int) -> None:
        """Delete what neither this version nor the last one uses; readers of the last may still be at work.

        Folders of builds that crashed or lost on an older version go too; the log stays.
        """
        used = {at for v in (new, new - 1) for parts in self.layout(v).values() for at in parts.values()}
        tables = {(name, at) for v in (new, new - 1) for name, parts in self.layout(v).items() for at in parts.values()}
        fs, top = self._path("")
        for found in fs.listStatus(top):
            at = found.getPath().getName()
            if not at.startswith("v=") or int(at[2:].split("-")[0]) >= new - 1 and at in used or int(at[2:].split("-")[0]) > new:
                continue
            if at not in used:
                fs.delete(found.getPath(), True)
                continue
            for name in TABLES:
                if (name, at) not in tables:
                    self._delete(f"{at}/{name}")
        fs, path = self._path("versions")
        for found in fs.listStatus(path):
            name = found.getPath().getName()
            if name.endswith(".json") and int(name[:-5]) < new - 1:
                fs.delete(found.getPath(), False)

    def export_graph(self, kind: str = "json") -> None:
        """The current graph as lines below graph.json or graph.graphml, for other programs."""
        nodes, edges = self.read("nodes"), self.read("edges")
        if kind == "graphml":
            rows = graphml(nodes, edges).select("value")
        elif kind == "json":
            tagged = [df.select(F.lit(what).alias("kind"), F.struct(*df.columns).alias(what)) for what, df in (("node", nodes), ("link", edges))]
            rows = tagged[0].unionByName(tagged[1], allowMissingColumns=True).select(F.to_json(F.struct("kind", "node", "link")).alias("value"))
        else:
            raise ValueError(f"unknown serialization {kind}")
        rows.write.mode("overwrite").text(f"{self.out}/graph.{kind}")

    def exists(self, name: str) -> bool:
        fs, path = self._path(name)
        return fs.exists(path)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").json(f"{self.out}/{name}")

    def read_log(self) -> DataFrame:
        """All log records of committed versions, with pos, the build that wrote them; a malformed line is an error."""
        parts = self._about(self.version)["log"]
        if not parts:
            return self.spark.createDataFrame([], LOG).withColumn("pos", F.lit(0).cast("long"))
        rows = self.spark.read.schema(LOG).option("mode", "FAILFAST").json([f"{self.out}/triples_log/{at}" for at in parts])
        return rows.withColumn("pos", F.coalesce("seq", F.lit(0).cast("long")))

    def read_cache(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.out}/{name}") if self.exists(name) else self.spark.createDataFrame([], schema)

    # the review queue

    def flag(self, question: str, reason: str, entities: str, ts: str) -> None:
        self.append("review", self.spark.createDataFrame([(question, reason, entities, ts, False)], REVIEW))

    def pending(self) -> DataFrame:
        rows = self.spark.read.schema(REVIEW).json(f"{self.out}/review") if self.exists("review") else self.spark.createDataFrame([], REVIEW)
        return rows.filter("not done").orderBy("ts", "question")

    def clear_review(self) -> None:
        fs, path = self._path("review")
        fs.delete(path, True)


def review_lines(pending: DataFrame) -> DataFrame:
    """The queue as check-list lines."""
    return pending.select(F.concat(F.lit("- [ ] "), F.concat_ws(" | ", "question", "reason", "entities", "ts")).alias("value"))


def node_link_json(nodes: DataFrame, edges: DataFrame) -> str:
    """The graph as one node-link JSON text: an export of graphs that fit on the driver."""
    n = [json.loads(x) for x in nodes.orderBy("name").toJSON().toLocalIterator()]
    e = [json.loads(x) for x in edges.orderBy("source_file", "head", "relation", "tail").toJSON().toLocalIterator()]
    return json.dumps({"directed": True, "multigraph": True, "nodes": [x | {"id": x["name"]} for x in n], "links": [x | {"source": x["head"], "target": x["tail"]} for x in e]}, ensure_ascii=False)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML file in order (part, key, value); nulls are left out, maps become JSON text."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), esc(F.to_json(c) if c == "extra" else F.col(c).cast("string")), F.lit("</data>"))).otherwise("")
    n = nodes.select(F.lit(1).alias("part"), F.col("name").alias("key"), F.concat(F.lit('<node id="'), esc(F.col("name")), F.lit('">'), *map(data, ("description", "source_file", "confidence", "node_type", "extra")), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws("|", "source_file", "head", "relation", "tail").alias("key"), F.concat(F.lit('<edge source="'), esc(F.col("head")), F.lit('" target="'), esc(F.col("tail")), F.lit('">'), *map(data, ("relation", "confidence", "source_file", "track", "chunk_index")), F.lit("</edge>")).alias("value"))
    keys = "".join(f'<key id="{k}" for="all" attr.name="{k}" attr.type="string"/>' for k in ("description", "source_file", "confidence", "node_type", "extra", "relation", "track", "chunk_index"))
    ends = [(0, "", f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "", "</graph></graphml>")]
    return nodes.sparkSession.createDataFrame(ends, "part int, key string, value string").unionByName(n).unionByName(e).orderBy("part", "key")
