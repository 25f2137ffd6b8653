"""Connected components of a link table by contraction, all in DataFrame joins.

In each round every node points at the least node beside it, pointers are followed twice, and links are
redrawn between what their ends point at. Node names must stand in no order along the links, as digests
do; then a round leaves a fraction of the nodes, and a group whose members link to its least node is done
in one. Rounds end in reliable checkpoints. Links and pointers stay in tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), one root for each component."""
    links = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found = None
    while found is None or not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
        after = low.select(F.col("node").alias("root"), F.col("root").alias("next"))
        to = cut(low.join(after, "root").select("node", F.col("next").alias("root")))
        if found is None:
            found = to
        else:
            found = cut(found.join(to.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        a, b = to.select(F.col("node").alias("a"), F.col("root").alias("x")), to.select(F.col("node").alias("b"), F.col("root").alias("y"))
        redrawn = links.join(a, "a").join(b, "b").where(F.col("x") != F.col("y"))
        links = cut(redrawn.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    return found
