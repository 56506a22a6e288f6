"""The star schema as a knowledge graph, and other inputs made from the given tables.

Everything here covers whole tables. ORACLE_* holds the same inputs in ANSI SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import table


def raw_triples(spark: SparkSession, d: str) -> DataFrame:
    """Edge writes with seq: suppliers supply parts, are located in nations, nations are part of regions."""
    name = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    line = table(spark, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", "EXTRACTED").when(F.col("l_returnflag") == "R", "INFERRED").otherwise("AMBIGUOUS")
    supplies = line.select(
        name("supplier", "l_suppkey").alias("head"), F.lit("supplies").alias("relation"), name("part", "l_partkey").alias("tail"), label.alias("confidence"),
        F.concat(F.lit("lineitem/"), "l_linestatus").alias("source_file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    located = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    located = located.select(name("supplier", "s_suppkey").alias("head"), F.lit("located_in").alias("relation"), F.col("n_name").alias("tail"), F.lit("EXTRACTED").alias("confidence"), F.lit("supplier").alias("source_file"), F.col("s_suppkey").alias("seq"))
    part = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    part = part.select(F.col("n_name").alias("head"), F.lit("part_of").alias("relation"), F.col("r_name").alias("tail"), F.lit("EXTRACTED").alias("confidence"), F.lit("nation").alias("source_file"), F.col("n_nationkey").cast("long").alias("seq"))
    return supplies.unionByName(located).unionByName(part)


def triples(spark: SparkSession, d: str) -> DataFrame:
    from loomgraph.operators.graph import upsert_edges

    return upsert_edges(raw_triples(spark, d)).withColumns({"track": F.lit("semantic"), "chunk_index": F.lit(None).cast("int")})


def node_table(edges: DataFrame) -> DataFrame:
    """All ends as nodes; regions and nations have descriptions, the others none."""
    end = edges.select(F.explode(F.array("head", "tail")).alias("name")).distinct()
    about = F.when(~F.col("name").contains(":"), F.concat(F.lit("place "), F.lower("name")))
    return end.select("name", about.alias("description"), F.lit("nation").alias("source_file"), F.lit("EXTRACTED").alias("confidence"), F.lit("concept").alias("node_type"), F.create_map().cast("map<string,string>").alias("extra"))


ORACLE_TRIPLES = """
raw AS (
  SELECT concat('supplier:', CAST(l_suppkey AS VARCHAR)) AS head, 'supplies' AS relation, concat('part:', CAST(l_partkey AS VARCHAR)) AS tail,
         CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'R' THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence,
         concat('lineitem/', l_linestatus) AS source_file, l_orderkey * 10 + l_linenumber AS seq FROM lineitem
  UNION ALL SELECT concat('supplier:', CAST(s_suppkey AS VARCHAR)), 'located_in', n_name, 'EXTRACTED', 'supplier', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'part_of', r_name, 'EXTRACTED', 'nation', n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
triples AS (
  SELECT head, relation, tail, confidence, source_file, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY source_file, head, relation, tail ORDER BY seq DESC, confidence) AS rn FROM raw) WHERE rn = 1)"""
