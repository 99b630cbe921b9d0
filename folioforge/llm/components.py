"""Connected components of an edge list, by hooking of labels with pointer jumping.

Every round is written to the shared folder, so a lost executor costs one round.
The nodes of one label are a region.  In a round a region's root takes the least
label that any node of the region or a neighbour of one has, and every node its
root's: whole regions merge, not only the nodes at their borders.  Rounds go on
until no label shrinks; then neighbours have equal labels, the least node of
their component.  On a path of n nodes in random order that takes about
log2(n) rounds.  Minima are pre-aggregated before each shuffle, and joins on a
node with very many edges are left to Spark's splitting of skewed joins.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import saved


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """Rows `v`, `label` for every node of the edges `a`, `b` (longs); loops give a node alone."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{folder}/edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label"))
    labels = saved(labels, f"{folder}/labels-0")
    for k in count(1):
        known = labels.withColumnRenamed("v", "b")
        near = both.join(known, "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hook = lower.groupBy("old").agg(F.min("label").alias("least"))
        roots = labels.select(F.col("v").alias("old"), F.col("label").alias("up")).join(hook, "old").select("old", F.least("up", "least").alias("up"))
        step = lower.join(roots, "old").select("v", "old", F.least("label", "up").alias("label"))
        step = saved(step, f"{folder}/labels-{k}")
        labels = step.select("v", "label")
        if step.where("label < old").isEmpty():
            return labels
