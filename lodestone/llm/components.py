"""Spanning forest and connected components of an undirected graph, by hooking and pointer jumping.

Every round each component (named by its smallest vertex) hooks on to its smallest neighbour component over one edge,
and the chains of hooks collapse by doubling. Components that aren't smaller than all their neighbours vanish in each
round, so there are few rounds even for long paths. All state is in tables of the shared folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored


def _collapse(hooks: DataFrame) -> DataFrame:
    """(root, to) with every ``to`` replaced by the end of its chain."""
    while True:
        step = stored(hooks.alias("p").join(hooks.alias("q"), F.col("p.to") == F.col("q.root"), "left").select(F.col("p.root").alias("root"), F.coalesce("q.to", "p.to").alias("to"), F.col("q.to").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.drop("moved")
        hooks = step.drop("moved")


def forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (a, b) of longs -> labels (v, label) with each vertex's smallest reachable one, and the tree edges (a, b)."""
    live = stored(edges.where("a <> b").select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb")).distinct())
    ends = live.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    labels = stored(ends.select("v", F.col("v").alias("label")))
    tree = live.select("a", "b").limit(0)
    while not live.isEmpty():
        hooks = stored(live.groupBy(F.greatest("la", "lb").alias("root")).agg(F.min(F.struct(F.least("la", "lb").alias("to"), "a", "b")).alias("h")).select("root", "h.to", "h.a", "h.b"))
        tree = tree.unionAll(hooks.select("a", "b"))
        jump = _collapse(hooks.select("root", "to"))
        labels = stored(labels.join(jump, labels.label == jump.root, "left").select("v", F.coalesce("to", "label").alias("label")))
        one, two = (jump.select(F.col("root").alias(f"r{x}"), F.col("to").alias(f"t{x}")) for x in "ab")
        live = stored(live.join(one, live.la == F.col("ra"), "left").join(two, live.lb == F.col("rb"), "left").select("a", "b", F.coalesce("ta", "la").alias("la"), F.coalesce("tb", "lb").alias("lb")).where("la <> lb"))
    return labels, tree
