"""Operator 2: language identification by sparse multinomial logistic regression.

Features are character n-grams (1 to 3 characters, lower case, all but letters as blanks) in hashed
buckets, weighted by sublinear term frequency and inverse document frequency and scaled to length 1.
Document frequencies are counted over all documents. The model is trained with follow the regularised
leader (per-coordinate rates, elastic-net penalty: most weights are exactly 0) on a bounded sample of
distinct labelled rows (``max_labelled``, least hashes first, so that copies take no places, and SAMPLE_CHARS
characters); a fifth of it is held out to calibrate a temperature.

Defined results: every row is kept, in (doc_id, lang, confidence). A text without letters, null or empty,
has null as its language and confidence 0. Rows without a label aren't trained on. Without any label all
languages are null; with one label every text with letters gets it. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partylens.llm import textvec
from partylens.llm.base import bounded, map_texts, runs, table

#: Production parameters.
BUCKETS, MAX_LABELLED, EPOCHS = 1 << 14, 4000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5


def grams(texts: list[str], buckets: int = BUCKETS) -> list[np.ndarray]:
    """The n-gram buckets of each text, with repetition."""
    c = textvec.codes(texts)
    p = np.where((c.kind == textvec.LETTER) | (c.kind == textvec.MARK), c.lower, 32).astype(np.uint32)
    letter = p != 32
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    out = []
    with np.errstate(over="ignore"):
        one = p * np.uint32(2654435761)
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + one[2:]
        hashed = [((h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)) >> shift for h in (one, two, three)]
    two_ok, three_ok = letter[:-1] | letter[1:], letter[:-2] | letter[1:-1] | letter[2:]
    for a, b in zip(c.offsets[:-1], c.offsets[1:] - 1):
        parts = [hashed[0][a:b][letter[a:b]]]
        if b - a > 1:
            parts.append(hashed[1][a : b - 1][two_ok[a : b - 1]])
        if b - a > 2:
            parts.append(hashed[2][a : b - 2][three_ok[a : b - 2]])
        out.append(np.concatenate(parts))
    return out


def features(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one text, of length 1."""
    count = np.bincount(found, minlength=len(idf))
    at = np.flatnonzero(count)
    value = (1 + np.log(count[at])) * idf[at]
    return at, value / max(1e-12, np.sqrt(value @ value))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weight: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0
    held_out: float = 0.0  # accuracy

    def logits(self, found: np.ndarray) -> np.ndarray:
        at, value = features(found, self.idf)
        return value @ self.weight[at] + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], labels: list[str], idf: np.ndarray, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model | None:
    """FTRL-proximal on all but the last fifth, which sets the temperature."""
    languages = sorted(set(labels))
    if not languages:
        return None
    y = np.array([languages.index(x) for x in labels])
    x = [features(g, idf) for a, b in runs(texts) for g in grams(texts[a:b], len(idf))]
    cut = len(x) - len(x) // 5
    k = len(languages)
    # the last row is the bias, whose feature is always 1
    z, n = np.zeros((len(idf) + 1, k)), np.zeros((len(idf) + 1, k))

    def weight(at):
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for i in range(cut):
            at, value = np.append(x[i][0], len(idf)), np.append(x[i][1], 1.0)
            w = weight(at)
            slope = _softmax(value @ w)
            slope[y[i]] -= 1
            g = value[:, None] * slope[None]
            square = g * g
            z[at] += g - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / alpha * w
            n[at] += square
    w = weight(np.arange(len(idf) + 1))
    model = Model(languages, idf, w[:-1], w[-1])
    if cut < len(x) and k > 1:
        logits = np.array([v @ model.weight[at] + model.bias for at, v in x[cut:]])
        truth = y[cut:]

        def loss(log_t: float) -> float:
            return -np.log(_softmax(logits / np.exp(log_t))[np.arange(len(truth)), truth] + 1e-12).mean()

        low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
        while high - low > 1e-3:
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
        model.held_out = float((logits.argmax(1) == truth).mean())
    return model


def document_frequencies(docs: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """Inverse document frequencies of the n-gram buckets, counted over all of ``docs``."""

    def run(batches):
        seen, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            n += len(texts)
            for a, b in runs(texts):
                for g in grams(texts[a:b], buckets):
                    seen += np.bincount(g, minlength=buckets) > 0
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))], ["bucket", "n"])

    sums = docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen, n = np.zeros(buckets), 0
    for r in sums:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            seen[r["bucket"]] = r["n"]
    return np.log((n + 1) / (seen + 1)) + 1


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", max_labelled: int = MAX_LABELLED, buckets: int = BUCKETS) -> Model | None:
    idf = document_frequencies(docs, text_col, buckets)
    labelled = docs.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).filter("text is not null and label is not null and trim(label) <> ''")
    # hashes of all distinct labelled rows choose the sample; only the chosen texts leave the executors
    order = F.xxhash64("text", "label")
    edge = labelled.select(order.alias("h")).distinct().orderBy("h").limit(max_labelled).agg(F.max("h")).first()[0]
    if edge is None:
        return None
    rows = labelled.withColumn("h", order).filter(F.col("h") <= F.lit(edge)).dropDuplicates(["text", "label"])
    rows = bounded(rows, "text", ["h", "text", "label"]).collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["text"], r["label"]))
    return train([r["text"] for r in rows], [r["label"] for r in rows], idf)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **how) -> DataFrame:
    """(doc_id, lang, confidence) of every row: the most probable language and its calibrated probability."""
    model = fit(docs, text_col, label_col, **how)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def each(texts):
            out = {"lang": [], "confidence": []}
            for g in grams(texts, len(own.idf)) if own else [[]] * len(texts):
                if len(g):
                    p = _softmax(own.logits(g) / own.temperature)
                    out["lang"].append(own.languages[int(p.argmax())])
                    out["confidence"].append(float(p.max()))
                else:
                    out["lang"].append(None)
                    out["confidence"].append(0.0)
            return out

        return each

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(narrow, "text", make, [T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]).drop("text")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op2_language": op2_language}
SQL: dict[str, str] = {}
