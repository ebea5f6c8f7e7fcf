"""Connected components of an edge table, by contraction: every round hooks each node to its smallest
neighbour, doubles the hooks and keeps only edges between different hooks. All state is in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slideqa.llm.tables import Saved


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, label): the smallest node of its component, for all nodes in edges.

    Null ends and self-links are ignored; repeated and reversed edges count once. Nodes of high degree are
    met by partial aggregation and by joins that Spark can split.
    """
    left = Saved(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        ends = left.df.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(left.df.select("b", "a"))
        hooks = ends.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        hooks = Saved(hooks, "hooks")
        up = hooks.df.select(F.col("u").alias("p"), F.col("p").alias("q"))
        once = hooks.df.join(up, "p").select("u", F.col("q").alias("p"))
        roots = Saved(once.join(up, "p").select("u", F.col("q").alias("p")), "roots")
        hooks.drop()
        if labels is None:
            labels = Saved(roots.df.select(F.col("u").alias("node"), F.col("p").alias("label")), "labels")
        else:
            new = labels.df.join(roots.df, F.col("label") == F.col("u"), "left").select("node", F.coalesce("p", "label").alias("label"))
            old, labels = labels, Saved(new, "labels")
            old.drop()
        a = roots.df.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        b = roots.df.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        rest = left.df.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        old, left = left, Saved(rest, "edges")
        old.drop()
        roots.drop()
        if left.df.isEmpty():
            left.drop()
            return labels.df
