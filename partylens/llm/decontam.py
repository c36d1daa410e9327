"""Operator 4: benchmark decontamination by SimHash fingerprints of item-sized windows.

A benchmark item of L words is looked for in every window of L words of every document. Items and windows
are weighted sets of word shingles; a shingle's weight is its inverse document frequency over all
documents. The similarity of a window to an item is the weight of the item's shingles found in the
window, as a share of the item's weight.

1. A first pass counts in how many documents each benchmark shingle occurs.
2. In the second pass a window is only taken up if it holds enough weight of benchmark shingles for any
   item of its size; the others can't reach the threshold, so nothing is lost.
3. Windows and items get 64-bit SimHash fingerprints of their benchmark shingles (what else a window holds
   tells nothing about an item, so it has no weight). Two sets at the threshold differ in 14 bits on
   average, with a deviation of 3.3. A multi-index over four blocks of 16 bits gives every item within
   RADIUS bits: at most 19 differing bits leave a block with at most four. A window's block is looked up
   with all changes of up to four bits, or compared to the items' block values where those are fewer;
   the items under a value are candidates, and only these are compared as a whole.
4. The exact similarity decides.

Defined results: null and blank texts hold no words and match nothing, as do null and blank items. A
document shorter than an item is one window as a whole. Repeated documents are reported each time;
repeated items under one id count once, under several ids each. For each document row and item the best
window is reported, the first of equals. Other columns are ignored. Items are taken in slices of at most
``slice_items``, each of which is broadcast, so what is sent out has a bound; WEIGHED slices share the first
pass. What a document needs in memory is bounded by its text: windows are compared in runs of RUN.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partylens.llm import textvec
from partylens.llm.base import find_texts, runs, table

#: Production parameters; slices that share a first pass; windows compared at a time.
SHINGLE, THRESHOLD, RADIUS, SLICE_ITEMS = 2, 0.6, 19, 20_000
WEIGHED, RUN, BLOCKS = 4, 256, 4


class Known:
    """Sorted hashes, and a table that tells most others at once."""

    def __init__(self, known: np.ndarray):
        self.known = known
        size = 1 << max(20, (16 * len(known) - 1).bit_length() if len(known) else 0)
        self.size_mask = np.uint64(size - 1)
        self.maybe = np.zeros(size, bool)
        self.maybe[(known & self.size_mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` of known shingles, and which they are."""
        at = np.flatnonzero(self.maybe[(h & self.size_mask).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.known, h[at]), max(0, len(self.known) - 1))
        right = self.known[which] == h[at] if len(self.known) else np.zeros(len(at), bool)
        return at[right], which[right]


class Items(Known):
    """The items of one slice: shingles, weights and fingerprints."""

    def __init__(self, ids: list, texts: list[str], shingle: int):
        w = textvec.words(textvec.codes(texts))
        h, bounds = textvec.shingles(w, shingle)
        some = [i for i in range(len(texts)) if bounds[i + 1] > bounds[i]]
        self.shingle = shingle
        self.ids = [ids[i] for i in some]
        self.length = np.diff(w.bounds)[some]
        self.raw = [h[bounds[i] : bounds[i + 1]] for i in some]
        self.sets = [np.unique(x) for x in self.raw]
        super().__init__(np.unique(np.concatenate(self.sets)) if some else np.zeros(0, np.uint64))

    def weigh(self, documents: int, frequency: np.ndarray) -> None:
        """Weights and fingerprints, and by length the items and their least weight."""
        self.weight = np.log((documents + 1.0) / (frequency + 1.0)) + 0.01
        self.total = np.array([self.weight[np.searchsorted(self.known, s)].sum() for s in self.sets])
        self.print = np.array([fingerprints(self.bits(np.searchsorted(self.known, h)).sum(0)[None])[0] for h in self.raw], np.uint64)
        own = [np.flatnonzero(self.length == n) for n in np.unique(self.length)]
        self.by_length = {int(self.length[o[0]]): (o, self.total[o].min()) for o in own}
        self._indexes: dict[int, MultiIndex] = {}

    def bits(self, which: np.ndarray) -> np.ndarray:
        """The weights of known shingles, signed by the bits of their hashes."""
        sign = np.unpackbits(self.known[which].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64) * 2 - 1
        return sign * self.weight[which, None]

    def index(self, length: int, radius: int) -> MultiIndex:
        """Built where it is needed first, so that it isn't sent out."""
        if length not in self._indexes:
            self._indexes[length] = MultiIndex(self.print[self.by_length[length][0]], radius)
        return self._indexes[length]


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


@functools.cache
def changes(bits: int) -> np.ndarray:
    """All 16-bit values with at most so many bits set."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= bits]


class MultiIndex:
    """Fingerprints by the values of their blocks; ``near`` finds all within the radius.

    If each block b differed in more than t_b bits, the whole would differ in more than sum(t_b) + BLOCKS - 1, which
    is the radius.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.blocks = prints, radius, []
        spare = radius - BLOCKS + 1
        blocks = prints.view(np.uint16).reshape(-1, BLOCKS)
        for b in range(BLOCKS):
            most = (spare + BLOCKS - 1 - b) // BLOCKS
            order = np.argsort(blocks[:, b], kind="stable")
            values, first = np.unique(blocks[order, b], return_index=True)
            there = np.zeros(1 << 16, bool)
            there[values] = True
            if most >= 0:
                self.blocks.append((b, most, values, np.append(first, len(prints)), order, there))

    def near(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of found, place in prints, distance), in this order."""
        keys = []
        for b, most, values, bounds, order, there in self.blocks:
            own = found.view(np.uint16).reshape(-1, BLOCKS)[:, b]
            if len(values) <= len(changes(most)):
                row, hit = np.nonzero(np.bitwise_count(own[:, None] ^ values[None]) <= most)
            else:
                changed = own[:, None] ^ changes(most)[None]
                row, column = np.nonzero(there[changed])
                hit = np.searchsorted(values, changed[row, column])
            n = bounds[hit + 1] - bounds[hit]
            item = order[np.repeat(bounds[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            keys.append(np.repeat(row, n) * len(self.prints) + item)
        row, item = np.divmod(np.unique(np.concatenate(keys)), len(self.prints))
        distance = np.bitwise_count(found[row] ^ self.prints[item])
        close = distance <= self.radius
        return row[close], item[close], distance[close]


def matches(h: np.ndarray, words: int, at: np.ndarray, which: np.ndarray, items: Items, threshold: float, radius: int) -> list[tuple]:
    """(item, similarity, distance, first shingle, shingles) of one document's best window for each item.

    ``at`` and ``which`` are its known shingles: their places in ``h`` and what they are.
    """
    n = len(h)
    weight = np.zeros(n)
    weight[at] = items.weight[which]
    rolling = np.concatenate([[0], np.cumsum(weight)])
    best: dict[int, tuple] = {}
    for length, (own, least) in items.by_length.items():
        size = min(n, max(1, min(length, words) - items.shingle + 1))
        held = rolling[size:] - rolling[: n - size + 1]
        start = np.flatnonzero(held >= threshold * least - 1e-9)
        low, high = np.searchsorted(at, start), np.searchsorted(at, start + size)
        a = 0
        while a < len(start):
            # runs of windows that lie near each other, so that their sums stay small
            b = min(a + RUN, max(a + 1, int(np.searchsorted(high, low[a] + (1 << 16), "right"))))
            sums = np.concatenate([np.zeros((1, 64)), np.cumsum(items.bits(which[low[a] : high[b - 1]]), axis=0)])
            found = fingerprints(sums[high[a:b] - low[a]] - sums[low[a:b] - low[a]])
            for k, j, distance in zip(*items.index(length, radius).near(found)):
                item, s = int(own[j]), int(start[a + k])
                if held[s] < threshold * items.total[item] - 1e-9:
                    continue
                both = np.intersect1d(which[low[a + k] : high[a + k]], np.searchsorted(items.known, items.sets[item]))
                score = float(items.weight[both].sum() / items.total[item])
                if score >= threshold - 1e-9 and (item not in best or score > best[item][1] + 1e-12):
                    best[item] = (item, score, int(distance), s, size)
            a = b
    return list(best.values())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS, slice_items: int = SLICE_ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, distance, begin, end): the item's best window in the document, in characters."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bench = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    item_kind = bench.schema["item_id"].dataType
    fields = [T.StructField("item_id", item_kind), T.StructField("similarity", T.DoubleType()), T.StructField("distance", T.IntegerType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]
    slices = max(1, -(-bench.count() // slice_items))
    out = None
    for group in range(0, slices, WEIGHED):
        each = []
        for part in range(group, min(slices, group + WEIGHED)):
            rows = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == part).filter("text is not null").collect()
            rows = sorted(rows, key=lambda r: (str(r["item_id"]), r["text"]))
            each.append(Items([r["item_id"] for r in rows], [r["text"] for r in rows], shingle))
        known = np.unique(np.concatenate([x.known for x in each]))
        if len(known):
            documents, frequency = _frequencies(docs, Known(known), shingle)
        for items in each:
            if items.ids:
                items.weigh(documents, frequency[np.searchsorted(known, items.known)])
            found = _windows(docs, spark.sparkContext.broadcast(items), fields, threshold, radius)
            out = found if out is None else out.unionByName(found)
    return out


def _frequencies(docs: DataFrame, known: Known, shingle: int) -> tuple[int, np.ndarray]:
    """The number of documents, and of those with each known shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        own, total, n = shared.value, np.zeros(len(shared.value.known), np.int64), 0
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            n += len(texts)
            for a, b in runs(texts):
                h, bounds = textvec.shingles(textvec.words(textvec.codes(texts[a:b])), shingle)
                at, which = own.find(h)
                doc = np.searchsorted(bounds, at, side="right") - 1
                total += np.bincount(np.unique(doc * len(total) + which) % len(total), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["which", "documents"])

    sums = docs.select("text").mapInArrow(run, "which long, documents long").groupBy("which").agg(F.sum("documents").alias("n")).collect()
    frequency = np.zeros(len(known.known))
    documents = 0
    for r in sums:
        if r["which"] < 0:
            documents = r["n"]
        else:
            frequency[r["which"]] = r["n"]
    return documents, frequency


def _windows(docs: DataFrame, shared, fields: list[T.StructField], threshold: float, radius: int) -> DataFrame:
    def make():
        items = shared.value
        least = threshold * items.total.min() - 1e-9 if items.ids else 0

        def each(texts):
            rows, out = [], {f.name: [] for f in fields}
            if not items.ids:
                return rows, out
            c = textvec.codes(texts)
            w = textvec.words(c)
            h, bounds = textvec.shingles(w, items.shingle)
            at, which = items.find(h)
            weight = np.zeros(len(h))
            weight[at] = items.weight[which]
            rolling = np.concatenate([[0], np.cumsum(weight)])
            # the widest window bounds what any window inside it holds
            wide = min(len(h), int(items.length.max()))
            heavy = np.flatnonzero(rolling[wide:] - rolling[: len(h) - wide + 1] >= least)
            reach = np.zeros(len(h) + 1, np.int64)
            np.add.at(reach, heavy, 1)
            np.add.at(reach, np.minimum(heavy + wide, len(h)), -1)
            inside = np.concatenate([[0], np.cumsum(np.cumsum(reach[:-1]) > 0)])
            for i in np.flatnonzero((inside[bounds[1:]] > inside[bounds[:-1]]) & (rolling[bounds[1:]] - rolling[bounds[:-1]] >= least)):
                a, b = bounds[i], bounds[i + 1]
                count = int(w.bounds[i + 1] - w.bounds[i])
                p, q = np.searchsorted(at, [a, b])
                for item, score, distance, first, size in matches(h[a:b], count, at[p:q] - a, which[p:q], items, threshold, radius) if b > a else ():
                    rows.append(int(i))
                    first_word = w.bounds[i] + first
                    last_word = min(w.bounds[i + 1], first_word + size + items.shingle - 1) - 1
                    for name, value in zip(out, (items.ids[item], round(score, 6), distance, int(w.start[first_word] - c.offsets[i]), int(w.end[last_word] - c.offsets[i]))):
                        out[name].append(value)
            return rows, out

        return each

    return find_texts(docs, "doc_id", "text", make, fields)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. A row without an id is judged by its own text."""
    hit = contaminated(docs.select(F.struct(id_col, F.xxhash64(text_col).alias("key")).alias("row"), F.col(text_col).alias("text")), benchmark, "row", "text", **how)
    hit = hit.select(F.col("doc_id").alias("__row")).distinct()
    row = F.struct(docs[id_col], F.xxhash64(docs[text_col]).alias("key"))
    return docs.join(hit, row.eqNullSafe(hit["__row"]), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}
SQL: dict[str, str] = {}
