"""Connected components of a link table, by minimum labels with pointer jumping.

Defined results: a link of a node to itself gives a component of one; links with a null end meet nothing and give no
component of their own; repeated links count once; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links(a, b); comp is the smallest node of its component.

    Each round takes the least label of the neighbours and then the label of the label, so paths
    shrink to half and stars end after two rounds. Labels are written to the shared folder.
    """
    links = links.filter("a is not null and b is not null")
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = label.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = label.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        after = materialise(low.join(up, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "old"), "labels")
        if after.filter("comp != old").isEmpty():
            return after.select("node", "comp")
        label = after.select("node", "comp")
