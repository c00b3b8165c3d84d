"""Connected components of an edge table by alternating large and small stars, after forests within the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import map_batches, store


def _thin(edges: DataFrame) -> DataFrame:
    """Within each Arrow batch only a star per local component: a group's many edges become one per node."""

    def run(batch: dict):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in zip(batch["a"], batch["b"]):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        nodes = [x for x in up if root(x) != x]
        yield {"a": nodes, "b": [root(x) for x in nodes]}

    return map_batches(edges.select("a", "b"), run, "a long, b long", rows=100_000)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (a, b: long, not null); root is the component's smallest node.

    Each round sends every node's larger neighbours to its smallest one (large star), then all to the smallest
    (small star); both are one aggregate and one join, so a hub is combined before the shuffle and its join can be split.
    The rounds end when no edge changes, after about the logarithm of the longest path. An empty table gives none.
    """
    current = store(_thin(edges.where("a <> b")).distinct())
    if current.isEmpty():
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        # Large star: neighbours above the node hang on the smallest of the node and its neighbours.
        both = current.select("a", "b").unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"), F.count("b").alias("many"))
        moved = large.join(low.where("many > 1"), F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = store(low.select(F.col("n").alias("a"), F.col("m").alias("b")).unionAll(moved).distinct())
        # Every node has one parent, and no parent has one: the stars are final.
        flat = after.agg(F.count("a").alias("e"), F.count_distinct("a").alias("d")).first()
        done = flat.e == flat.d and after.select("b").join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        current = after
        if done:
            own = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(own)
