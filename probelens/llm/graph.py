"""Connected components of an edge table, and the union-find used inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.llm.store import written

EDGES = "a BIGINT, b BIGINT"


class Forest:
    """Union-find over hashable names; the root of a set is its smallest name."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def join(self, x, y) -> bool:
        """Whether the two were apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        self.parent.setdefault(min(x, y), min(x, y))
        return True


def edge_batch(pairs: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components, of each task's edges no more than a spanning forest with direct roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                forest.join(a, b)
        pairs = [(x, r) for x in forest.parent if (r := forest.find(x)) != x]
        for low in range(0, len(pairs), 10_000):
            yield edge_batch(pairs[low : low + 10_000])

    return edges.mapInArrow(run, EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge and the smallest node it is connected with.

    Alternates linking neighbours to the smallest neighbour (large star) and smaller neighbours to each other's
    smallest (small star) until nothing changes. Both steps are a grouped minimum, which combines inside tasks,
    and a join; a round's edges are written to the shared folder. No edges give an empty table.
    """
    now = written(contracted(edges.where("a IS NOT NULL AND b IS NOT NULL")).distinct(), "edges")
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        small_least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(small_least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = written(small.where("a <> b").distinct(), "edges")
        stars = after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        many = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        now = after
        if stars and many:  # every node points to one root, and no root points on
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
