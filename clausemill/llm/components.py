"""Connected components by hooking and pointer jumping, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component for each node of edges(a, b): component is the least node it is connected with.

    Each round, the parent of a node's parent looks at the neighbours' grandparents and takes the least;
    then parents jump to their parents. Rounds grow with the logarithm of the longest path. A node's row
    meets one row for each of its edges, and minima are taken before rows move, so a star needs no group in
    one task. Each round is written to the checkpoint folder.
    """
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = settle(edges.select(F.explode(ends).alias("x")).select("x.*"))
    # the first hook needs no join: every node looks at its neighbours
    state = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent")))
    while True:
        jump = state.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        full = settle(state.join(jump, "parent").select("node", "parent", "grand"))
        seen = both.join(full.select(F.col("node").alias("b"), F.col("grand").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("theirs"))
        near = settle(full.join(seen, F.col("node") == F.col("a"), "left").select("node", "parent", "grand", F.least("grand", F.coalesce("theirs", "grand")).alias("least")))
        hooks = near.where(F.col("least") < F.col("grand")).groupBy(F.col("parent").alias("hooked")).agg(F.min("least").alias("to"))
        after = near.join(hooks, F.col("node") == F.col("hooked"), "left").select("node", F.least("least", F.coalesce("to", "least")).alias("parent"))
        old, state = near, settle(after)
        changed = old.where((F.col("parent") != F.col("grand")) | (F.col("least") != F.col("grand"))).limit(1).count()
        if not changed:
            return state.select("node", F.col("parent").alias("component"))
