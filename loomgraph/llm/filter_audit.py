"""Filter interaction audit: what each filter of a chain removes in every order of the chain.

Every document gets a mask, one bit for each filter that it fails. Documents are counted by part, mask and labels:
at most 32 masks times four labels for a part, whatever the number of documents. These cells are unpivoted against the
steps of all orders; a running bit-or over the earlier steps of an order tells whether a cell has been removed before,
conditional sums give the figures of a step, and a window over all steps of a filter its Shapley total.

The filters: A too few words, B repetitive words, C too many capitals, D holds a forbidden character, E a copy of a
text with a smaller id. Copies are found by SHA-256: one row of (digest, smallest id, count) for each text, joined
back with hot texts dealt to several tasks; texts never move.

Defined results: a null text is empty, and so are two null texts alike; a null part is the empty string; a null id is no
copy and nothing is a copy of it, it has no labels; rows that repeat one id and text are no copies of each other; of an id labelled
twice the larger label counts; a text of any length is taken whole; an empty table gives an empty result; further
columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.skew import join_counted
from loomgraph.session import materialise, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _bit(name: str, fails: Column) -> Column:
    return F.when(fails, 1 << FILTERS.index(name)).otherwise(0)


def own_failures(text: Column) -> Column:
    """The bits of the filters that look at a text alone."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return (
        _bit("A", n < 100) + _bit("B", 100 * distinct.cast("long") < 80 * n.cast("long"))
        + _bit("C", 100 * capitals.cast("long") > 10 * F.length(text).cast("long")) + _bit("D", text.rlike(r"[#$%&*|]"))
    )


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per document: id, part and mask."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("th"), own_failures(text).alias("own"))
    src = materialise(src, "failures")
    texts = materialise(src.groupBy("th").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "texts")
    both = join_counted(src, texts, ["th"], ["id", "part"], "n")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return both.select("id", "part", (F.col("own") + _bit("E", copy)).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, failed filters and labels."""
    said = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # rows of one id meet its labels as one row for each mask
    few = masks.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(said, "id", "left")
    no = F.lit(False)
    return few.groupBy("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))


def audit(found: DataFrame) -> DataFrame:
    """The figures of each (part, filter_order, step) from cells; there are some hundred cells for a part."""
    order = F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")
    steps = found.select("*", order).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    steps = steps.withColumns({"step": F.col("at") + 1, "bit": F.element_at(F.create_map(*[F.lit(x) for f in FILTERS for x in (f, 1 << FILTERS.index(f))]), F.col("filter"))})
    steps = steps.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    cell = Window.partitionBy("part", "filter_order", "mask", "good", "toxic").orderBy("step")
    steps = steps.withColumn("before", F.coalesce(F.bit_or("fails").over(cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fails, gone = F.col("fails") != 0, F.col("before") != 0
    here = fails & ~gone
    sums = {"kept": ~fails & ~gone, "removed": here, "redundant": fails & gone, "unique_fails": fails & (F.col("mask") == F.col("bit")), "good_lost": here & F.col("good"), "toxic_lost": here & F.col("toxic")}
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(*[F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name) for name, cond in sums.items()])
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(cells(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")), "cells")
    return audit(found).drop("filter")


QUERIES = {"op13_filter_audit": op13_filter_audit}

ORACLE = {
    "op13_filter_audit": f"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
            map(['A', 'B', 'C', 'D', 'E'], [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x),
              regexp_matches(x, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)]) AS f
          FROM t LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, good, toxic, f, count(*) AS n FROM d GROUP BY ALL),
        o AS (SELECT unnest({ORDERS!r}) AS filter_order),
        s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS filter, filter_order[1:i - 1] AS earlier FROM o, range(1, 6) r(i)),
        e AS (SELECT c.*, s.*, f[filter] AS fails, len(list_filter(string_split(earlier, ''), lambda y: y <> '' AND f[y])) > 0 AS gone,
            len(list_filter(map_values(f), lambda y: y)) = 1 AS alone FROM c, s),
        g AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND alone THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM e GROUP BY ALL)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM g"""
}
