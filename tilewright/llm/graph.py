"""Connected components by star contraction, on Spark alone."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: At most so many edges (16 bytes each) are joined by one task; more are contracted by all.
ONE_TASK = 500_000


def _united(batches):
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``edges`` (a long, b long): comp is the component's smallest node.

    Up to ONE_TASK edges are united by a single task. Beyond that, large-star and small-star steps in turn, each an aggregation whose partial minima are made before
    the shuffle and a join; the edges are written after each round. Ends when every node hangs
    on its smallest neighbour and nothing changes any more.
    """
    now = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= ONE_TASK:
        return now.coalesce(1).mapInArrow(_united, "node long, comp long")
    last = None
    while True:
        # Large star: every larger neighbour of a node is tied to the smallest in its neighbourhood.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every smaller neighbour, and the node itself, is tied to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        now = common.written(small, "edges")
        # Stars with the same leaves and centres: the sums tell them apart well enough, and count and sums fall until then.
        state = now.agg(F.count(F.lit(1)), F.countDistinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select("b", "b").distinct())
