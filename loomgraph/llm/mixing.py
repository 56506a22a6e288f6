"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Leaves are (domain, lang, source) paths. Weights propagate from the root; a node can take at most
`max_epochs` times its tokens. Where a child is short, its siblings share the shortage by weight, and
only what all of them can't take goes up: a parent's capacity is the sum of its children's, so the
ancestors' siblings absorb the rest. Each leaf then takes whole epochs and a token-prefix of the next
epoch, whose order is a seeded hash of (seed, epoch, id). Budgets are exact integers.

The prefix is a distributed running sum: hash order is cut into blocks of bounded size, block sums
give each block's offset, and each block is summed on its own, so a leaf with a third of all rows is no
single task. Texts are not shuffled.

Defined results: null levels are nodes of their own; a null text has no tokens; nodes without a
weight get 1, those of weight 0 get nothing; documents of a leaf without tokens are not selected;
repeated rows count and are selected each by itself; with ties in the hash the smaller id, then the smaller
text goes first; a text of any length counts whole; an empty table gives an empty result; `mix` reads only the
id, text and level columns, `mixed_documents` passes further ones on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.names import own_columns, unused
from loomgraph.session import materialise, table

#: Rows of a leaf that are ordered in one task; one window then orders a leaf's block sums, 24 bytes each.
ROWS_A_BLOCK = 2_000
LEVELS = ("domain", "lang", "source")
#: Production weights: whole numbers for the nodes of each level.
WEIGHTS: dict[str, dict[str, int]] = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 2}, "source": {}}
BUDGET = (9, 10)
MAX_EPOCHS = 2
SEED = 2024


def tokens(text: Column) -> Column:
    """Four UTF-8 bytes are one token, rounded up."""
    return F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + 3) / 4).cast("long")


def domain(source: Column) -> Column:
    """The domain a source belongs to: sources are dealt to four by CRC."""
    return F.concat(F.lit("d"), (F.crc32(F.coalesce(source, F.lit(""))) % 4).cast("string"))


def _node(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("null"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(f"__{level}") == "v" + name, F.lit(int(weight))).otherwise(out)
    return out


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def share_out(nodes: DataFrame, parents: Sequence[str], child: str) -> DataFrame:
    """Adds alloc: the budget of each parent over its children by weight, none above its cap.

    nodes has w, cap and budget. A child is full if the level at which it fills, cap / w, leaves the
    rest no less than that level; the others share what remains, rounded down, and the lost units go
    one each to the first of them by name.
    """
    w = Window.partitionBy(*parents)
    order = w.orderBy(F.col("cap") / F.col("w"), child)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    n = nodes.withColumns({"__c": F.sum("cap").over(upto), "__a": F.sum("w").over(w) - F.sum("w").over(upto)})
    n = n.withColumn("__full", _big(F.col("budget") - F.col("__c")) * F.col("w") >= _big("cap") * F.col("__a"))
    n = n.withColumns({"__left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("cap"))).over(w), F.lit(0)), "__w": F.sum(F.when(~F.col("__full"), F.col("w"))).over(w)})
    base = F.floor(_big("__left") * F.col("w") / F.col("__w")).cast("long")
    n = n.withColumn("__base", F.when(F.col("__full"), F.col("cap")).otherwise(F.greatest(base, F.lit(0))))
    n = n.withColumn("__rest", F.col("__left") - F.coalesce(F.sum(F.when(~F.col("__full"), F.col("__base"))).over(w), F.lit(0)))
    turn = F.row_number().over(Window.partitionBy(*parents, "__full").orderBy(child))
    n = n.withColumn("alloc", F.col("__base") + F.when(~F.col("__full") & (turn <= F.col("__rest")), 1).otherwise(0))
    return n.drop("__c", "__a", "__full", "__left", "__w", "__base", "__rest")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: tuple[int, int], max_epochs: int) -> DataFrame:
    """leaves (node columns, total) with alloc: tokens for each leaf.

    Capacities go up level by level, then budgets go down, with windows over the nodes alone.
    """
    nodes = [f"__{x}" for x in levels]
    out = leaves
    for level in levels:
        out = out.withColumn(f"w_{level}", _weight(level, weights).cast("long"))
    zero = F.lit(False)
    for level in levels:
        zero = zero | (F.col(f"w_{level}") <= 0)
    out = out.withColumn("cap", F.when(zero, F.lit(0)).otherwise(F.col("total") * max_epochs))
    asked = F.floor(_big(F.sum("total")) * budget[0] / budget[1]).cast("long")
    top = out.agg(F.least(asked, F.sum("cap")).alias("alloc")).first()["alloc"]
    node = None
    for depth, level in enumerate(levels):
        path, parents = nodes[: depth + 1], nodes[:depth]
        here = out.groupBy(*path).agg(F.sum("cap").alias("cap"), F.greatest(F.max(f"w_{level}"), F.lit(1)).alias("w"))
        here = here.withColumn("budget", F.lit(top or 0)) if node is None else here.join(node.select(*parents, F.col("alloc").alias("budget")), parents)
        node = share_out(here, parents, nodes[depth]).select(*path, "alloc")
    return leaves.join(node, nodes)


def mix(
    docs: DataFrame,
    budget: tuple[int, int] = BUDGET,
    weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    levels: Sequence[str] = LEVELS,
) -> DataFrame:
    """One narrow row per row of docs: id, levels, n_tokens, text_hash and copies.

    copies: in how many epochs the row is taken. budget is (numerator, denominator) of all tokens. A
    missing domain column is derived from the source.
    """
    if "domain" in levels and "domain" not in docs.columns:
        docs = docs.withColumn("domain", domain(F.col("source")))
    nodes = [f"__{x}" for x in levels]
    rows = docs.select(F.col(id_col).alias("id"), *levels, tokens(F.col(text_col)).alias("n_tokens"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    rows = materialise(rows.withColumns({f"__{x}": _node(x) for x in levels}), "mix-rows")
    leaves = materialise(rows.groupBy(*nodes).agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("n_rows")), "mix-leaves")
    plan = budgets(leaves, levels, weights, budget, max_epochs)
    whole = F.when(F.col("total") > 0, F.floor(F.col("alloc") / F.col("total"))).otherwise(0).cast("long")
    plan = materialise(plan.withColumn("whole", whole).withColumn("rest", F.col("alloc") - F.col("whole") * F.col("total")), "mix-plan")
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    placed = rows.join(plan.select(*nodes, "n_rows", "total", "whole", "rest"), nodes).withColumn("__h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), key), 256))
    blocks = F.ceil(F.col("n_rows") / ROWS_A_BLOCK)
    placed = placed.withColumn("__b", F.floor(F.conv(F.substr("__h", F.lit(1), F.lit(8)), 16, 10).cast("long") * blocks / (1 << 32)))
    sums = placed.groupBy(*nodes, "__b").agg(F.sum("n_tokens").alias("__s"))
    before = Window.partitionBy(*nodes).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*nodes, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(*nodes, "__b").orderBy("__h", "id", "n_tokens", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(offsets, [*nodes, "__b"]).withColumn("__e", F.col("__o") + F.sum("n_tokens").over(inside))
    copies = F.col("whole") + F.when((F.col("rest") > 0) & (F.col("__e") <= F.col("rest")), 1).otherwise(0)
    return out.select(F.col("id").alias(id_col), *levels, "n_tokens", "text_hash", copies.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs, each as often as it is taken, with docs' columns."""
    levels = [x for x in settings.get("levels", LEVELS) if x in docs.columns]
    chosen = mix(docs, id_col=id_col, text_col=text_col, **settings)
    # one key column, so that the window finds the rows where the join has put them
    key = lambda text: F.sha2(F.concat_ws("|", *[_node(c).alias(c) for c in (id_col, *levels)], text.cast("string")), 256)
    k, s, m, n, c, e = (unused(docs) + x for x in "ksmnce")
    chosen = chosen.groupBy(key(F.col("text_hash")).alias(k)).agg(F.sum("copies").alias(s), F.count(F.lit(1)).alias(m)).filter(F.col(s) > 0)
    mine = docs.withColumn(k, key(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    out = mine.join(chosen, k).withColumn(n, F.row_number().over(Window.partitionBy(k).orderBy(F.lit(1))))
    out = out.withColumn(c, F.floor((F.col(s) + F.col(m) - F.col(n)) / F.col(m))).filter(F.col(c) > 0)
    return out.select(*own_columns(docs), F.explode(F.sequence(F.lit(1), F.col(c))).alias(e)).select(*own_columns(docs))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *LEVELS, "n_tokens", "copies")


QUERIES = {"op8_mixing": op8_mixing}


def _cases(level: str, column: str) -> str:
    named = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    return f"CASE {column} {named} ELSE 1 END" if named else "1"


def _fill(name: str, source: str, parents: str, child: str) -> str:
    by = f"PARTITION BY {parents}" if parents else ""
    key = f"{parents}, {child}" if parents else child
    return f"""
    {name}a AS (SELECT *, sum(cap) OVER u AS c, sum(w) OVER ({by}) - sum(w) OVER u AS a FROM {source}
      WINDOW u AS ({by} ORDER BY cap / w, {child} ROWS UNBOUNDED PRECEDING)),
    {name}b AS (SELECT *, CAST(budget - c AS HUGEINT) * w >= CAST(cap AS HUGEINT) * a AS f FROM {name}a),
    {name}c AS (SELECT *, budget - coalesce(sum(cap) FILTER (WHERE f) OVER ({by}), 0) AS l, sum(w) FILTER (WHERE NOT f) OVER ({by}) AS sw FROM {name}b),
    {name}d AS (SELECT *, CASE WHEN f THEN cap ELSE l * w // sw END AS base FROM {name}c),
    {name} AS (SELECT {key}, base + CASE WHEN NOT f AND row_number() OVER (PARTITION BY {parents + ',' if parents else ''} f ORDER BY {child})
      <= l - coalesce(sum(base) FILTER (WHERE NOT f) OVER ({by}), 0) THEN 1 ELSE 0 END AS alloc FROM {name}d)"""


# crc32 is not in DuckDB, so the oracle names the domains of the twenty sources of the tables
_DOMAIN = "CASE source " + " ".join(f"WHEN 'src{i}' THEN 'd{__import__('zlib').crc32(f'src{i}'.encode()) % 4}'" for i in range(20)) + " END"

ORACLE = {
    "op8_mixing": f"""
    WITH r AS (SELECT doc_id, {_DOMAIN} AS domain, lang, source, (coalesce(strlen(text), 0) + 3) // 4 AS n_tokens FROM documents),
    leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS total FROM r GROUP BY ALL),
    i1 AS (SELECT domain, sum(total) * {MAX_EPOCHS} AS cap, {_cases("domain", "domain")} AS w, (SELECT least(sum(total) * {BUDGET[0]} // {BUDGET[1]}, sum(total) * {MAX_EPOCHS}) FROM leaf) AS budget FROM leaf GROUP BY domain),
    {_fill("n1", "i1", "", "domain")},
    i2 AS (SELECT domain, lang, sum(total) * {MAX_EPOCHS} AS cap, {_cases("lang", "lang")} AS w, any_value(n1.alloc) AS budget FROM leaf JOIN n1 USING (domain) GROUP BY domain, lang),
    {_fill("n2", "i2", "domain", "lang")},
    i3 AS (SELECT domain, lang, source, total * {MAX_EPOCHS} AS cap, {_cases("source", "source")} AS w, n2.alloc AS budget FROM leaf JOIN n2 USING (domain, lang)),
    {_fill("n3", "i3", "domain, lang", "source")},
    p AS (SELECT *, CASE WHEN total > 0 THEN alloc // total ELSE 0 END AS whole FROM n3 JOIN leaf USING (domain, lang, source)),
    e AS (SELECT r.*, total, whole, alloc - whole * total AS rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
            ORDER BY sha256('{SEED}:' || whole || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS e FROM r JOIN p USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN rest > 0 AND e <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM e"""
}
