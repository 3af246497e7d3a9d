"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: a node's neighbours move to the least node among them.

    The least neighbour is an ordinary (partially combined) minimum that is joined
    back, never a window, so a hub with many edges is combined before the shuffle
    and its join partition can be split.
    """
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = pairs.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).withColumn("m", F.least("k", "m"))
    joined = pairs.join(low, F.col("u") == F.col("k"))
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def _union_find(batches):
    import pyarrow as pa

    top: dict[int, int] = {}

    def find(x: int) -> int:
        at = x
        while top.setdefault(at, at) != at:
            at = top[at]
        while top[x] != at:
            top[x], x = at, top[x]
        return at

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    nodes = list(top)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = 0) -> DataFrame:
    """(node, component): the least node of each component, for nodes with an edge.

    Takes an edge table of any orderable type; directions, self-loops, repeated
    edges and null ends don't matter. An empty table gives an empty result. Each
    round is written to the shared folder. The driver sees one count per round.

    Up to ``one_task`` edges between whole numbers, which are counted first, are
    joined by one executor task instead: dozens of rounds of small shuffles cost
    more than reading so few rows. More edges take the rounds; the result is the same.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    now = materialize(now, "edges")
    if one_task and now.limit(one_task + 1).count() <= one_task:
        return now.coalesce(1).mapInArrow(_union_find, "node long, component long")
    while True:
        new = materialize(_star(_star(now, True), False), "edges")
        release(now)
        now = new
        heads = now.select(F.col("b").alias("a")).distinct()
        if not now.join(heads, "a", "left_semi").take(1) and not now.groupBy("a").count().where("count > 1").take(1):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
