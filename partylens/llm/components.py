"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partylens.llm.base import Scratch

#: Graphs of at most so many distinct edges are settled by one task.
ONE_TASK = 500_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that isn't the least of its component, and that least one, of the edges (u, v)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, two, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (root[one] != root[two]).any():
        x, y = root[one], root[two]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        found = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if found:
            u, v = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in roots(u, v)], ["node", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, a: str, b: str, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node that isn't the least of its component.

    Alternating large-star and small-star steps: each is one or two shuffles of the edge table, and the
    number of rounds grows with the logarithm of the longest path. Nulls and self-loops are ignored.
    Every round is written to the shared folder, so lineage stays short and survives a lost executor. The least
    neighbour is an aggregate joined back, so the many edges of a hub don't meet in one task.

    At most ``one_task`` edges between longs go to one task instead, with the same result: each round is two
    queries of several joins, whose plans and threads the driver holds, however small the graph is.
    """
    now = scratch.save(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    if all(f.dataType == T.LongType() for f in now.schema) and now.count() <= one_task:
        return scratch.save(_in_one_task(now))
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        after = scratch.save(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        scratch.drop(now)
        now = after
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
