"""Connected components by rounds of joins; nothing of the graph goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that can be reached.

    Each round hangs both ends' roots under the smaller root, then halves the
    way to the root; ids only fall, so it ends when no edge joins two roots.
    The number of rounds grows with the logarithm of a component's diameter.
    """
    own = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    own = materialize(own, "edges")
    root = own.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
    root = materialize(own.select(F.col("a").alias("node"), F.col("a").alias("up")).union(root).groupBy("node").agg(F.min("up").alias("up")), "roots")
    for _ in range(rounds):
        # pointer jumping: up becomes the parent's parent until nothing falls
        while True:
            above = root.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = materialize(root.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("fell")), "roots")
            fell = jumped.where("fell").limit(1).count()
            root = jumped.select("node", "up")
            if not fell:
                break
        # edges between roots
        left = root.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = root.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        own = own.join(left, "a").join(right, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        own = materialize(own, "edges")
        if not own.limit(1).count():
            break
        hung = own.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("under"))
        root = materialize(root.join(hung, "node", "left").select("node", F.least("up", F.coalesce("under", "up")).alias("up")), "roots")
    else:
        raise RuntimeError("components didn't settle")
    return root.select("node", F.col("up").alias("component"))
