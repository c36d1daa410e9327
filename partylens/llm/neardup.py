"""Operator 1: near duplicates by bottom-k sketches of one hash function.

1. Each document becomes the set of its word shingles, hashed once; its sketch is the k least hashes.
   Documents with equal sets are one from here on (their least id stands for them).
2. Inverted lists of retained values give candidates. Two sketches can only pass the estimate if they
   share a value among their rarest ones (the prefix principle of set-similarity joins under the global
   order by list length), so only those go into lists: common passages make no candidates, and nothing
   is lost or capped.
3. Candidates are filtered by the union-sketch estimate: the share of the k least values of both
   sketches together that both retain.
4. What passes is verified by the exact Jaccard similarity of the full shingle sets.
5. Verified pairs are edges; groups are connected components. A list of n documents needn't compare all
   its pairs: first each member meets the list's centre, groups form, and then only members that are
   still in different groups meet. That gives the same groups as all pairs would.
6. Where more than ``all_pairs`` members of a list are still apart (pages of one template, say), the full
   shingle sets decide who can meet at all: in the order of rarity among those documents, the smaller of
   two similar sets shares one of its first shingles with one of the larger one's first. What a template
   holds in common lies behind these, so its pages make no pairs, and no similar pair is lost.

Counts and centres are aggregates that are joined back, so a value, text or group that a third of all
documents have is one row of the aggregate, never one task's window.

Defined results: a null or blank text has no shingles and is in no group. A row without an id is in no
group. Rows that repeat an id are one document: it is similar to another if any of its rows is. Equal
texts under different ids form a group. Tables may be empty; columns other than id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partylens.llm import textvec
from partylens.llm.base import Scratch, map_texts, runs, table
from partylens.llm.components import components

#: Production parameters, and how many members of a list may meet in all pairs.
SHINGLE, SKETCH, THRESHOLD, ALL_PAIRS = 3, 64, 0.6, 200


def sets(texts: list[str], shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (63 bits) of each text."""
    h, bounds = textvec.shingles(textvec.words(textvec.codes(texts)), shingle)
    h = (h >> np.uint64(1)).astype(np.int64)
    return [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def sketches(docs: DataFrame, shingle: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """(id, key, n, mark, sketch) of each row of (id, text) that has a shingle; key is a hash of the text."""

    def make():
        def each(texts):
            found = sets(texts, shingle)
            with np.errstate(over="ignore"):
                marks = [int(textvec.mix(s.astype(np.uint64)).sum(dtype=np.uint64).astype(np.int64)) for s in found]
            return {"n": [len(s) for s in found], "mark": marks, "sketch": [s[:k] for s in found]}

        return each

    fields = [T.StructField("n", T.IntegerType()), T.StructField("mark", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))]
    keyed = docs.select("id", F.xxhash64("text").alias("key"), "text")
    return map_texts(keyed, "text", make, fields).select("id", "key", "n", "mark", "sketch").filter("n > 0")


def least_estimate(threshold: float, k: int) -> float:
    """The estimate that a pair at the threshold reaches with a probability of over 0.99."""
    return max(0.05, threshold - 2.4 * math.sqrt(threshold * (1 - threshold) / k))


def estimated(pairs: DataFrame, kept: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (a, b) whose union-sketch estimate is at least ``least``."""
    one = kept.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    two = kept.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    share = F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) / F.size(union)
    return pairs.join(one, "a").join(two, "b").filter(share >= F.lit(least)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose exact Jaccard similarity is at least ``threshold``."""
    schema = "a long, b long, similarity double"

    def run(batches):
        for batch in batches:
            one, two = (["" if x is None else x for x in batch.column(c).to_pylist()] for c in (2, 3))
            for p, q in runs([x + y for x, y in zip(one, two)]):
                distinct = list(dict.fromkeys(one[p:q] + two[p:q]))
                found = dict(zip(distinct, sets(distinct, shingle)))
                score = []
                for x, y in zip(one[p:q], two[p:q]):
                    s, t = found[x], found[y]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    score.append(both / max(1, len(s) + len(t) - both))
                score = np.array(score)
                keep = np.flatnonzero(score >= threshold)
                part = batch.slice(p, q - p).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score[keep])], ["a", "b", "similarity"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, schema)


def first_shingles(apart: DataFrame, texts: DataFrame, shingle: int, threshold: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes of (node, label) with different labels that share one of their first shingles.

    Shingles are ordered by the number of documents of ``apart`` that hold them; those that only one label
    holds come first and make no pairs. Two sets of sizes x <= y and a similarity of at least the threshold t
    have 2t / (1 + t) x and t y shingles in common at least, which leaves so few that can come before the first
    common one.
    """

    def run(batches):
        for batch in batches:
            found_in = [x or "" for x in batch.column(2).to_pylist()]
            for p, q in runs(found_in):
                found = sets(found_in[p:q], shingle)
                part = batch.slice(p, q - p)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in found], pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["node", "label", "n", "all"])

    full = texts.join(apart, "node").select("node", "label", "text").mapInArrow(run, "node long, label long, n int, all array<long>")
    each = scratch.save(full).select("node", "label", "n", F.explode("all").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("often"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("h", "often")
    ranked = each.join(scratch.save(often), "h").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("hs"))
    ranked = scratch.save(ranked)

    def first(share: float, *names: str) -> DataFrame:
        """The first shingles of sets that have ``share`` of theirs in common with another."""
        length = F.col("n") - F.ceil(F.col("n") * F.lit(share) - 1e-9) + 1 - (F.col("n") - F.size("hs"))
        return ranked.withColumn("length", length.cast("int")).filter("length > 0").select(*[F.col(c).alias(n) for c, n in zip(("node", "label", "n"), names)], F.explode(F.slice("hs", F.lit(1), F.col("length"))["h"]).alias("h"))

    small, large = first(2 * threshold / (1 + threshold), "a", "la", "na"), first(threshold, "b", "lb", "nb")
    met = small.join(large, "h").filter((F.col("la") != F.col("lb")) & (F.col("na") <= F.col("nb")) & (F.col("na") >= F.col("nb") * F.lit(threshold) - 1e-9))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, k: int = SKETCH, threshold: float = THRESHOLD, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """(doc_id, group_id) of every document that has a near duplicate; group_id is the least id of the group."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    least = least_estimate(threshold, k)

    made = scratch.save(sketches(docs, shingle, k))
    low = F.element_at("sketch", 1).alias("low")
    # a node is a distinct set of shingles; its number is kept by the table it is written to
    heads = made.groupBy("n", "mark", low).agg(F.min(F.struct("id", "key")).alias("who"), F.any_value("sketch").alias("sketch"))
    heads = scratch.save(heads.withColumn("node", F.monotonically_increasing_id()))
    nodes = made.select("id", "n", "mark", low).join(heads.select("n", "mark", "low", "node"), ["n", "mark", "low"]).select("id", "node")

    size = F.size("sketch")
    values = heads.select("node", size.alias("size"), F.explode("sketch").alias("value"))
    often = scratch.save(values.groupBy("value").agg(F.count("*").alias("often")).filter("often > 1"))
    single = F.col("size") - F.size("values")
    length = F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9) + 1 - single
    lists = scratch.save(
        values.hint("merge").join(often, "value")
        .groupBy("node", "size")
        .agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("values"))
        .withColumn("length", length.cast("int"))
        .filter("length > 0")
        .select("node", F.explode(F.slice("values", F.lit(1), F.col("length"))).alias("x"))
        .select("node", "x.value")
    )
    wanted = lists.select("node").distinct()
    kept = scratch.save(heads.join(wanted, "node", "left_semi").select("node", "who", "sketch"))
    # rows that repeat an id and its text are one, before they are moved
    texts = docs.withColumn("key", F.xxhash64("text")).join(kept.select("who.id", "who.key", "node"), ["id", "key"])
    texts = scratch.save(texts.groupBy("node").agg(F.any_value("text").alias("text")))

    tested = edges = labels = None
    for turn in ("first", "second", "rest"):
        now = lists.withColumn("label", F.col("node")) if labels is None else (
            lists.join(labels, "node", "left").select("node", "value", F.coalesce("root", "node").alias("label"))
        )
        if turn == "rest":
            apart = now.groupBy("value").agg(F.count("*").alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
            opened = scratch.save(now.join(scratch.save(apart.select("value", "members")), "value"))
            few = opened.filter(F.col("members") <= all_pairs)
            other = few.select("value", F.col("node").alias("b"), F.col("label").alias("label2"))
            pairs = few.withColumnRenamed("node", "a").join(other, "value").filter("a < b and label <> label2").select("a", "b")
            many = scratch.save(opened.filter(F.col("members") > all_pairs).select("node", "label").distinct())
            if not many.isEmpty():
                pairs = pairs.unionByName(first_shingles(many, texts, shingle, threshold, scratch))
        else:
            centre = now.groupBy("value").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), F.col("node"), F.col("label"))).alias("c"))
            met = now.join(scratch.save(centre), "value").filter("c.label <> label")
            pairs = met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs)
        if pairs.isEmpty():
            if labels is None:
                break
            continue  # the second centres may be the first ones while other members haven't met
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = scratch.save(verified(estimated(pairs, kept, k, least), texts, shingle, threshold))
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges, "a", "b", scratch)

    groups = nodes.withColumn("group", F.col("node"))
    if labels is not None:
        groups = nodes.join(labels, "node", "left").select("id", F.coalesce("root", "node").alias("group"))
    groups = scratch.save(groups.distinct())
    # an id with differing rows may be in two groups so far; it links them
    twice = groups.groupBy("id").agg(F.min("group").alias("a"), F.max("group").alias("b")).filter("a <> b")
    if not twice.isEmpty():
        links = groups.join(twice.select("id", "a"), "id").select("a", F.col("group").alias("b"))
        more = components(links, "a", "b", scratch)
        groups = scratch.save(groups.join(more.withColumnRenamed("node", "group"), "group", "left").select("id", F.coalesce("root", "group").alias("group")).distinct())
    whole = scratch.save(groups.groupBy("group").agg(F.count("*").alias("members"), F.min("id").alias("group_id")).filter("members > 1").select("group", "group_id"))
    scratch.keep(groups, whole)
    return groups.join(whole, "group").select(F.col("id").alias("doc_id"), "group_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` without the members of near-duplicate groups other than the one of the least id. Rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col, **parameters).filter("doc_id <> group_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_neardup": op1_neardup}
SQL: dict[str, str] = {}
