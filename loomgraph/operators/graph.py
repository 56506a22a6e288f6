"""The multigraph as two tables: nodes and edges. All operators are transforms of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialise

EDGE_KEY = ("source_file", "head", "relation", "tail")


def upsert_edges(edges: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """One edge per (source_file, head, relation, tail): the last written (largest seq)."""
    rows = edges if new is None else edges.unionByName(new, allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in EDGE_KEY]
    return rows.groupBy(*EDGE_KEY).agg(F.max_by(F.struct(*columns), "seq").alias("x")).select(*EDGE_KEY, *[f"x.{c}" for c in columns])


def remove_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select(*EDGE_KEY).distinct(), list(EDGE_KEY), "left_anti")


def merge_nodes(concepts: DataFrame, edges: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Nodes of all concepts and edge ends; the last concept in this order gives the attributes.

    An empty `extra` keeps the last one that was not empty. Ends without a concept have no description.
    """
    full = F.size(F.coalesce("extra", F.create_map().cast("map<string,string>"))) > 0
    said = concepts.groupBy("name").agg(
        F.max_by(F.struct("description", "source_file", "confidence", "node_type"), F.struct(*order)).alias("x"), F.max_by("extra", F.when(full, F.struct(*order))).alias("extra")
    )
    ends = edges.select(F.explode(F.array("head", "tail")).alias("name")).distinct()
    return ends.join(said, "name", "full_outer").select("name", "x.description", "x.source_file", "x.confidence", "x.node_type", "extra")


def delete_source(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the edges of these sources (source_file), and without ends that no other edge touches."""
    marked = edges.join(sources.select("source_file").distinct().withColumn("__gone", F.lit(True)), "source_file", "left")
    ends = marked.select(F.explode(F.array("head", "tail")).alias("name"), F.col("__gone").isNotNull().alias("gone"))
    orphan = ends.groupBy("name").agg(F.bool_and("gone").alias("gone")).filter("gone").select("name")
    return nodes.join(orphan, "name", "left_anti"), edges.join(sources, "source_file", "left_anti")


def incidence(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends: node, dir (0 out, 1 in), neighbour; a self-loop counts twice."""
    end = lambda node, way, other: F.struct(F.col(node).alias("node"), F.lit(way).alias("dir"), F.col(other).alias("neighbour"))
    both = edges.select(F.explode(F.array(end("head", 0, "tail"), end("tail", 1, "head"))).alias("x"), "relation", "seq")
    return both.select("x.node", "x.dir", "relation", "x.neighbour", "seq")


def fallback_descriptions(nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(name, description) of nodes with edges but no description: the first edges, out before in."""
    blank = nodes.filter(F.trim(F.coalesce("description", F.lit(""))) == "").select(F.col("name").alias("node"))
    order = Window.partitionBy("node").orderBy("dir", "seq", "relation", "neighbour")
    top = incidence(edges).join(blank, "node", "left_semi").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
    text = top.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rn", F.concat("relation", F.lit(" "), "neighbour").alias("s")))).alias("p"))
    return text.select(F.col("node").alias("name"), F.concat("node", F.lit(": "), F.array_join(F.transform("p", lambda x: x["s"]), "; ")).alias("description"))


def with_fallbacks(nodes: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """nodes with descriptions filled in; such nodes are entities, INFERRED unless labelled."""
    made = fallback_descriptions(nodes, edges, most).withColumnRenamed("description", "__d")
    new = F.col("__d").isNotNull()
    return nodes.join(made, "name", "left").select(
        "name",
        F.coalesce("__d", "description").alias("description"),
        "source_file",
        F.when(new, F.coalesce("confidence", F.lit("INFERRED"))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(new, "entity").otherwise(F.col("node_type")).alias("node_type"),
        "extra",
    )


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2, cap: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the undirected neighbourhood: all edges at nodes less than `hops` away.

    Each hop is two equi-joins of the frontier, never an OR join. With a cap, at most so many edges, the
    nearest first and then by key.
    """
    seen = frontier = seeds.select(F.col("name")).distinct()
    found: DataFrame | None = None
    for hop in range(hops):
        near = frontier.withColumnRenamed("name", "__n")
        touch = edges.join(near, edges["head"] == near["__n"], "left_semi").unionByName(edges.join(near, edges["tail"] == near["__n"], "left_semi"))
        touch = touch.withColumn("hop", F.lit(hop))
        if hop + 1 < hops:  # else each hop would look at the edges for all hops before it, several times
            touch = materialise(touch, "touch")
        found = touch if found is None else found.unionByName(touch)
        frontier = touch.select(F.explode(F.array("head", "tail")).alias("name")).distinct().join(seen, "name", "left_anti")
        seen = seen.unionByName(frontier)
        if hop % 4 == 3:
            seen, frontier = (materialise(x, "expand") for x in (seen, frontier))
    if found is None:
        return seen, edges.limit(0)
    columns = [c for c in edges.columns if c not in EDGE_KEY]
    near = found.groupBy(*EDGE_KEY).agg(F.min_by(F.struct(*columns), "hop").alias("x"), F.min("hop").alias("hop")).select(*EDGE_KEY, *[f"x.{c}" for c in columns], "hop")
    if cap > 0:
        near = near.orderBy("hop", *EDGE_KEY).limit(cap)
        seen = seeds.select("name").unionByName(near.select(F.explode(F.array("head", "tail")).alias("name"))).distinct()
    return seen, near.drop("hop")


def weighted_pairs(edges: DataFrame) -> DataFrame:
    """Directed pairs weighted by their number of parallel edges."""
    return edges.groupBy("head", "tail").agg(F.count(F.lit(1)).alias("weight"))


def symmetrize(pairs: DataFrame, strategy: str = "sum") -> DataFrame:
    """Unordered pairs: sum or max of both directions; a self-loop stays once."""
    how = {"sum": F.sum, "max": F.max}[strategy]
    return pairs.groupBy(F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")).agg(how("weight").alias("weight"))


def source_nodes(edges: DataFrame) -> DataFrame:
    """(source_file, node) for the ends of each source's edges."""
    return edges.select("source_file", F.explode(F.array("head", "tail")).alias("node")).distinct()


def hubs(edges: DataFrame, k: int = 20) -> DataFrame:
    """The k nodes with the largest weighted degree."""
    pairs = symmetrize(weighted_pairs(edges))
    ends = pairs.select(F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("node"), "weight")
    return ends.groupBy("node").agg(F.sum("weight").alias("degree"), F.count(F.lit(1)).alias("neighbours")).orderBy(F.desc("degree"), "node").limit(k)
