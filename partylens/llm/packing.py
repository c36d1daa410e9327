"""Operator 3: packing into optimal length buckets.

1. Texts are counted in tokens of a public byte-level vocabulary (``vocabulary`` is a path on every
   executor). Counting is exact: the pre-tokeniser's pieces are found by array passes, and each distinct
   piece is encoded once a worker.
2. Texts of more than ``longest`` tokens are cut into parts of that length and a rest.
3. The histogram of lengths over all parts (at most ``longest`` + 1 rows) goes to the driver, where
   dynamic programming picks the ``buckets`` boundaries with the least padding in total.
4. In each bucket, parts form batches of at most ``budget`` padded tokens. Their running number is
   found in two steps, within shares of a bucket and by the shares' offsets, so that no bucket is sorted
   in one place.

Defined results: null and empty texts are one part of length 0. Every row of the input is packed, repeated
ids too; rows that can't be told apart share their batches in any order. A null id is packed like others.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partylens.llm import textvec
from partylens.llm.base import Scratch, map_texts, table

#: Production parameters. The pattern is the public one of this vocabulary family; pieces() implements it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST, BUCKETS, BUDGET = 2048, 8, 65_536
#: A bucket's rows are numbered in so many shares: one for this many parts, within bounds.
PARTS_A_SHARE, LEAST_SHARES, MOST_SHARES = 1_000_000, 256, 65_536
_END = 9


@functools.cache
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(c: textvec.Codes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the pre-tokeniser's pieces in a run of texts."""
    kind = np.where(c.kind == textvec.MARK, textvec.OTHER, c.kind)
    kind[(c.points >= 0x1C) & (c.points <= 0x1F)] = textvec.OTHER
    kind[c.offsets[1:] - 1] = _END
    space = kind == textvec.SPACE
    before = np.concatenate([[_END], kind[:-1]])
    after = np.concatenate([kind[1:], [_END]])
    blank_before = np.concatenate([[False], (c.points == 32)[:-1] & space[:-1]])
    start = ~space & (kind != before) & ~blank_before
    start |= space & ((before != textvec.SPACE) | ((after != textvec.SPACE) & (after != _END)))
    start |= kind == _END
    for i in np.flatnonzero((c.points == 39) & start):
        tail = c.points[i + 1 : i + 3].tobytes().decode("utf-32-le")
        size = 1 if tail[:1] in ("s", "t", "m", "d") and tail else 2 if tail in ("re", "ve", "ll") else 0
        if size:
            start[i + 1] = False
            start[i + 1 + size] = True
    at = np.flatnonzero(start)
    end = np.append(at[1:], len(kind))
    inner = kind[at] != _END
    return at[inner], end[inner]


class TokenCounts:
    """Token counts of texts; remembers the count of each piece."""

    def __init__(self, vocabulary: str, most: int = 1_000_000):
        self.encode, self.most = encoding(vocabulary).encode_ordinary, most
        self.hash, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        c = textvec.codes(texts)
        start, end = pieces(c)
        out = np.zeros(len(texts), np.int64)
        if len(start):
            distinct, first, of = np.unique(textvec.span_hashes(c.points, start, end), return_index=True, return_inverse=True)
            if len(self.hash) > self.most:
                self.hash, self.count = self.hash[:0], self.count[:0]
            at = np.searchsorted(self.hash, distinct)
            old = at < len(self.hash)
            old[old] = self.hash[at[old]] == distinct[old]
            counts = np.empty(len(distinct), np.int64)
            counts[old] = self.count[at[old]]
            new = np.flatnonzero(~old)
            if len(new):
                counts[new] = [len(self.encode(c.points[start[i] : end[i]].tobytes().decode("utf-32-le", "replace"))) for i in first[new]]
                merged = np.concatenate([self.hash, distinct[new]])
                order = np.argsort(merged, kind="stable")
                self.hash, self.count = merged[order], np.concatenate([self.count, counts[new]])[order]
            total = np.concatenate([[0], np.cumsum(counts[of])])
            bounds = np.searchsorted(start, c.offsets)
            out = total[bounds[1:]] - total[bounds[:-1]]
        # code points whose classes the tables leave out: these texts are encoded as they are
        rare = np.flatnonzero(((c.points > 0xD7A3) & (c.points < 0xF900)) | (c.points >= 0x10000))
        for i in np.unique(np.searchsorted(c.offsets, rare, side="right") - 1):
            out[i] = len(self.encode(texts[i]))
        return out


@functools.cache
def counts_of(vocabulary: str) -> TokenCounts:
    """One a worker, so that its memory of pieces outlives a task."""
    return TokenCounts(vocabulary)


def best_bounds(length: np.ndarray, count: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """The bucket lengths with the least padding in total, and that padding; ``length`` ascends."""
    n, k = len(length), min(buckets, len(length))
    if not n:
        return [], 0
    rows = np.concatenate([[0], np.cumsum(count)]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum(count * length)]).astype(np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(k):
        # from i parts done to j: the lengths i..j-1 are padded to length[j-1]
        cost = best[:, None] + length[None, :] * (rows[None, 1:] - rows[:, None]) - (tokens[None, 1:] - tokens[:, None])
        cost[np.arange(n + 1)[:, None] > np.arange(n)[None, :]] = np.inf
        back.append(cost.argmin(0))
        best = np.concatenate([[np.inf], cost.min(0)])
    bounds, j = [], n
    for came in reversed(back):
        bounds.append(int(length[j - 1]))
        j = int(came[j - 1])
    return bounds[::-1], int(best[n])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, part, begin_token, n_tokens, bucket, bucket_length, batch): one row for each part of each row."""

    def make():
        count = counts_of(vocabulary)
        return lambda texts: {"tokens": count(texts)}

    spark = docs.sparkSession
    scratch = Scratch(spark)
    counted = map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", make, [T.StructField("tokens", T.LongType())])
    # the text counts too, so that rows that share an id are spread
    counted = counted.withColumn("spread", F.xxhash64("doc_id", "text")).drop("text")
    last = F.greatest(F.ceil(F.col("tokens") / longest), F.lit(1)) - 1
    parts = scratch.save(
        counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
        .withColumn("begin_token", F.col("part") * longest)
        .withColumn("n_tokens", F.least(F.col("tokens") - F.col("begin_token"), F.lit(longest)))
        .drop("tokens")
    )
    histogram = sorted((r["n_tokens"], r["n"]) for r in parts.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())
    bounds, _ = best_bounds(np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64), buckets)
    shares = min(MOST_SHARES, max(LEAST_SHARES, sum(r[1] for r in histogram) // PARTS_A_SHARE))
    bucket = sum((F.when(F.col("n_tokens") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0))
    bucket_length, fits = F.lit(0), F.lit(1)
    for k, b in enumerate(bounds):
        bucket_length = F.when(F.col("bucket") == k, b).otherwise(bucket_length)
        fits = F.when(F.col("bucket") == k, max(1, budget // max(1, b))).otherwise(fits)
    placed = parts.withColumn("bucket", bucket.cast("int")).withColumn("bucket_length", bucket_length.cast("long")).withColumn("share", F.pmod(F.xxhash64("spread", "part"), F.lit(shares)))
    # at most buckets x shares rows
    before = placed.groupBy("bucket", "share").agg(F.count("*").alias("n")).withColumn("offset", F.sum("n").over(Window.partitionBy("bucket").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("bucket", "share").orderBy("doc_id", "part", "n_tokens"))
    return (
        placed.withColumn("row", own - 1)
        .join(F.broadcast(before.select("bucket", "share", "offset")), ["bucket", "share"])
        .withColumn("batch", F.floor((F.col("row") + F.coalesce("offset", F.lit(0))) / fits).cast("long"))
        .select("doc_id", "part", "begin_token", "n_tokens", "bucket", "bucket_length", "batch")
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op3_packing": op3_packing}
SQL: dict[str, str] = {}
