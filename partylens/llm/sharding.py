"""Operator 9: byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A group's rows stay in one shard. A partial partition is a tuple of k slot sums. Differencing combines the
two with the largest spread, the fullest slot of one with the emptiest of the other, until one is left.
Groups are spread over cells of about ``per_cell`` by a hash; each cell is differenced by one task, which
leaves one partial partition a cell. Those are themselves the items of the next level, and so on until
few enough are left for the driver, which takes k numbers a cell. So no task and no driver ever holds all
groups, and the last levels even out what the cells left uneven.

Defined results: rows whose group is null are one group. Null sizes count as 0. Repeated rows count each
time. Ties are broken by the group's hash, so the result doesn't depend on partitioning. An empty table
gives an empty result. A group larger than a shard's fair share makes its shard that much larger.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partylens.llm.base import Scratch, table

#: Production parameters.
SHARDS, PER_CELL, ON_DRIVER = 16, 20_000, 5_000


def difference(items: list[list[int]]) -> list[list[int]]:
    """For each item (its slot sums) the final slot of each of its slots."""
    if not items:
        return []
    k = len(items[0])
    heap = []
    for i, sums in enumerate(items):
        order = sorted(range(k), key=lambda s: (-sums[s], s))
        # a slot's content is None, a leaf or a pair of contents
        heap.append((sums[order[-1]] - sums[order[0]], i, [sums[s] for s in order], [i * k + s for s in order]))
    heapq.heapify(heap)
    n = len(items)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = sorted(((p + q, j) for j, (p, q) in enumerate(zip(a, reversed(b)))), key=lambda t: (-t[0], t[1]))
        y = y[::-1]
        sums = [t[0] for t in both]
        heapq.heappush(heap, (sums[-1] - sums[0], n, sums, [(x[j], y[j]) for _, j in both]))
        n += 1
    final = [[0] * k for _ in items]
    for slot, content in enumerate(heap[0][3]):
        stack = [content]
        while stack:
            one = stack.pop()
            if isinstance(one, tuple):
                stack += one
            else:
                final[one // k][one % k] = slot
    return final


def difference_sizes(sizes: list[int], k: int) -> list[int]:
    """The slot of each single size; like ``difference``, without the empty slots' bookkeeping."""
    heap = [(-s, i, [s], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        # only the filled slots are held, fullest first; a full slot meets an empty one where there is one
        free = 2 * k - len(a) - len(b)
        met = max(0, k - free)
        pairs = [(a[len(a) - met + j] + b[len(b) - 1 - j], (x[len(a) - met + j], y[len(b) - 1 - j])) for j in range(met)]
        pairs += list(zip(a[: len(a) - met], x[: len(a) - met])) + list(zip(b[: len(b) - met], y[: len(b) - met]))
        order = sorted(range(len(pairs)), key=lambda j: (-pairs[j][0], j))
        sums = [pairs[j][0] for j in order]
        low = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (low - sums[0], n, sums, [pairs[j][1] for j in order]))
        n += 1
    out = [0] * len(sizes)
    for slot, content in enumerate(heap[0][3] if heap else []):
        stack = [content]
        while stack:
            one = stack.pop()
            if isinstance(one, tuple):
                stack += one
            else:
                out[one] = slot
    return out


def assign_shards(docs: DataFrame, group: Column, size: Column, id_col: str = "doc_id", k: int = SHARDS, per_cell: int = PER_CELL, on_driver: int = ON_DRIVER) -> DataFrame:
    """(doc_id, group, bytes, shard) of every row; ``group`` in the result is a hash of the group."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(group).alias("group"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes")))
    groups = scratch.save(rows.groupBy("group").agg(F.sum("bytes").alias("bytes")))
    n = groups.count()
    cells = max(1, -(-n // per_cell))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True])
        return pd.DataFrame({"group": pdf["group"], "item": pdf["cell"], "slot": difference_sizes(pdf["bytes"].tolist(), k), "bytes": pdf["bytes"]})

    placed = scratch.save(groups.withColumn("cell", F.pmod(F.col("group"), F.lit(cells))).groupBy("cell").applyInPandas(first, "group long, item long, slot int, bytes long"))
    sums = placed.groupBy("item", "slot").agg(F.sum("bytes").alias("bytes"))
    items = scratch.save(sums.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bytes"))).alias("m")).select("item", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.coalesce(F.element_at("m", s), F.lit(0))).alias("sums")))
    while cells > on_driver:
        cells = -(-cells // on_driver)
        wide = cells

        def more(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("item")
            return pd.DataFrame({"item": pdf["item"], "above": pdf["above"], "slots": difference([[int(v) for v in s] for s in pdf["sums"]]), "sums": pdf["sums"]})

        level = scratch.save(items.withColumn("above", F.pmod(F.xxhash64("item"), F.lit(wide))).groupBy("above").applyInPandas(more, "item long, above long, slots array<int>, sums array<long>"))
        placed = scratch.save(placed.join(level.select("item", "above", "slots"), "item").select("group", F.col("above").alias("item"), F.element_at("slots", F.col("slot") + 1).alias("slot"), "bytes"))
        flat = level.select("above", F.explode(F.arrays_zip("slots", "sums")).alias("x")).groupBy(F.col("above").alias("item"), F.col("x.slots").alias("slot")).agg(F.sum("x.sums").alias("bytes"))
        items = scratch.save(flat.groupBy("item").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "bytes"))), lambda x: x["bytes"]).alias("sums")))
    last = sorted((r["item"], list(r["sums"])) for r in items.collect())
    final = difference([s for _, s in last])
    # one row for each cell that reached the driver and each slot: bounded by on_driver x k
    where = spark.createDataFrame([(c, s, shard) for (c, _), slots in zip(last, final) for s, shard in enumerate(slots)], "item long, slot int, shard int")
    chosen = placed.join(F.broadcast(where), ["item", "slot"]).select("group", "shard")
    return rows.join(chosen, "group").select("doc_id", "group", "bytes", "shard")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of one text are a group, so that no shard holds a copy of another's document."""
    return assign_shards(table(spark, sf_dir, "documents"), F.col("text"), F.octet_length("text"))


QUERIES = {"op9_sharding": op9_sharding}
SQL: dict[str, str] = {}
