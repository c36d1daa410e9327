"""Operator 8: toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters the network as its own embedding (hashed bucket) beside the mean embedding of its character
n-grams, so that inflected or compounded forms of a known word score like it. Two gated recurrent layers
read a window of words forwards and backwards, attention pools their states, and a logistic unit scores
the window. Windows overlap and cover the whole text; a document's score is its worst window's.

Training is in numpy on a bounded sample of labelled documents (``max_labelled``, half of them toxic at
most, least hashed ids first, and SAMPLE_CHARS characters). Labels are for documents, windows are scored: of a toxic document the
windows with the strongest association to the label stand for it, of a clean one its strongest and some
others. A fifth of the sample is held out, and the rejection threshold is set on it.

Defined results: null and empty texts score 0. A repeated row is scored again. A label that isn't 0 or 1
is ignored; of several labels the largest counts. If either class is missing from the sample there is no
model: scores are 0 and nothing is rejected. Other columns pass through under any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partylens.llm import textvec
from partylens.llm.base import bounded, fresh, map_texts, runs, table

#: Production parameters.
MAX_LABELLED, WINDOW, STRIDE, STEPS, BATCH = 4000, 40, 20, 320, 160
#: Training picks from windows further apart; what is scored overlaps by half, so that phrases of 21 words lie whole in a window.
TRAINING_STRIDE = 32
WORDS, GRAMS, DW, DC, H, A = 1 << 14, 1 << 15, 8, 8, 6, 6
_BLOCK = 4096
_START = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Model:
    p: dict[str, np.ndarray]
    threshold: float = 0.5
    window: int = WINDOW
    stride: int = STRIDE
    held_out: dict = field(default_factory=dict)


@dataclass
class Types:
    """The distinct words of a run of texts, as buckets."""

    of_word: np.ndarray  # each word's type
    bucket: np.ndarray
    gram: np.ndarray  # buckets of all types' character n-grams, type after type
    gram_from: np.ndarray


def types_of(texts: list[str]) -> tuple[Types, np.ndarray]:
    """The word types of texts, taken run by run, and the bounds of each text's words."""
    hashes, buckets, grams, counts, words, lengths = np.zeros(0, np.uint64), [], [], [], [], []
    order = np.zeros(0, np.int64)
    for a, b in runs(texts):
        c = textvec.codes(texts[a:b])
        w = textvec.words(c)
        distinct, first, of_word = np.unique(w.hash, return_index=True, return_inverse=True)
        new = np.flatnonzero(~np.isin(distinct, hashes))
        bucket, gram, gram_from = _grams(c, distinct[new], w.start[first[new]], w.end[first[new]])
        buckets.append(bucket)
        grams.append(gram.astype(np.int32))
        counts.append(np.diff(gram_from))
        merged, number = np.concatenate([hashes, distinct[new]]), np.concatenate([order, len(order) + np.arange(len(new))])
        by_hash = np.argsort(merged, kind="stable")
        hashes, order = merged[by_hash], number[by_hash]
        words.append(order[np.searchsorted(hashes, distinct)][of_word].astype(np.int32))
        lengths.append(np.diff(w.bounds))
    count = np.concatenate(counts)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    return Types(np.concatenate(words), np.concatenate(buckets), np.concatenate(grams), np.concatenate([[0], np.cumsum(count)])), bounds


def _grams(c: textvec.Codes, distinct: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
    """Buckets of words, and of their n-grams of 3 to 5 characters (prefixes also marked) and the whole word."""
    forward, back = textvec.powers(len(c.lower))
    with np.errstate(over="ignore"):
        total = np.zeros(len(c.lower) + 1, np.uint64)
        np.cumsum((c.lower.astype(np.uint64) + np.uint64(1)) * forward, out=total[1:])
    parts, owners = [distinct], [np.arange(len(distinct))]
    length = end - start
    at = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    owner = np.repeat(np.arange(len(distinct)), length)
    for n in (3, 4, 5):
        fits = at + n <= end[owner]
        s, o = at[fits], owner[fits]
        with np.errstate(over="ignore"):
            h = textvec.mix((total[s + n] - total[s]) * back[s] + np.uint64(n))
        parts.append(h)
        owners.append(o)
        lead = s == start[o]
        parts.append(textvec.mix(h[lead] ^ _START))
        owners.append(o[lead])
    grams, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(distinct))
    return (distinct % np.uint64(WORDS)).astype(np.int64), (grams[order] % np.uint64(GRAMS)).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


class Known:
    """The inputs of words seen before, so that a common word is worked out once a task and not once a run."""

    def __init__(self, p: dict, most: int = 400_000):
        self.p, self.most = p, most
        self.hash, self.x = np.zeros(0, np.uint64), np.zeros((0, DW + DC), np.float32)

    def inputs(self, c: textvec.Codes, w: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
        """(inputs of the run's distinct words, each word's row)."""
        distinct, first, of_word = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.hash) > self.most:
            self.__init__(self.p, self.most)
        at = np.searchsorted(self.hash, distinct)
        old = np.zeros(len(distinct), bool)
        inside = at < len(self.hash)
        old[inside] = self.hash[at[inside]] == distinct[inside]
        x = np.empty((len(distinct), DW + DC), np.float32)
        x[old] = self.x[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            x[new] = inputs(Types(of_word, *_grams(c, distinct[new], w.start[first[new]], w.end[first[new]])), self.p)
            merged = np.concatenate([self.hash, distinct[new]])
            order = np.argsort(merged, kind="stable")
            self.hash, self.x = merged[order], np.concatenate([self.x, x[new]])[order]
        return x, of_word


def windows(bounds: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of all windows; the last of a text ends with it."""
    lengths = np.diff(bounds)
    each = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - size) // stride)), 0)
    text = np.repeat(np.arange(len(lengths)), each)
    k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    first = bounds[:-1][text] + k * stride
    return first, np.minimum(size, bounds[1:][text] - first), text


def inputs(t: Types, p: dict, block: int = 20_000) -> np.ndarray:
    out = np.empty((len(t.bucket), DW + DC), np.float32)
    for i in range(0, len(out), block):
        edge = t.gram_from[i : i + block + 1]
        sums = np.add.reduceat(p["grams"][t.gram[edge[0] : edge[-1]]], edge[:-1] - edge[0], axis=0)
        out[i : i + block, :DW] = p["words"][t.bucket[i : i + block]]
        out[i : i + block, DW:] = sums / np.diff(edge)[:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):  # infinity gives 0
        np.negative(x, out=x)
        np.exp(x, out=x)
        x += 1
        return np.reciprocal(x, out=x)


def _scatter(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums rows by their place."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        ordered = at[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        out[ordered[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _read(pre: np.ndarray, index: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, keep: list | None = None) -> np.ndarray:
    """States (window, step, H) of one direction; ``keep`` gets what the gradient needs."""
    n, steps = index.shape
    h, out = np.zeros((n, H), np.float32), np.empty((n, steps, H), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        g, hu = pre[index[:, t]], h @ u
        gates = _sigmoid(g[:, : 2 * H] + hu[:, : 2 * H])
        r, z = gates[:, :H], gates[:, H:]
        c = r * hu[:, 2 * H :]
        c += g[:, 2 * H :]
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((t, h, gates, c, hu[:, 2 * H :]))
        h = h - c
        h *= z
        h += c
        if back:  # padding comes first
            h *= mask[:, t, None]
        out[:, t] = h
    return out


def _score(x: np.ndarray, index: np.ndarray, mask: np.ndarray, p: dict, keep: dict | None = None) -> np.ndarray:
    """Logit of each window; ``index`` points into the word inputs ``x``, its last row is padding."""
    ahead, behind = ([], []) if keep is not None else (None, None)
    states = np.concatenate(
        [_read(x @ p["wf"] + p["bf"], index, mask, p["uf"], False, ahead), _read(x @ p["wb"] + p["bb"], index, mask, p["ub"], True, behind)], axis=2
    )
    a = np.tanh(states @ p["wa"] + p["ba"])
    e = a @ p["va"] + (mask - 1) * 1e4
    e = np.exp(e - e.max(axis=1, keepdims=True))
    e /= e.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", e, states)
    if keep is not None:
        keep.update(states=states, a=a, e=e, pooled=pooled, ahead=ahead, behind=behind)
    return pooled @ p["wo"] + p["bo"]


def _slope(x, index, mask, y, p) -> tuple[dict, np.ndarray, float]:
    """Gradients of the mean logistic loss by parameter, and by word input."""
    k: dict = {}
    logit = _score(x, index, mask, p, k)
    prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    n = len(y)
    d = ((prob - y) / n).astype(np.float32)
    g = {"wo": k["pooled"].T @ d, "bo": d.sum()}
    dpool = d[:, None] * p["wo"][None]
    dstates = k["e"][:, :, None] * dpool[:, None]
    de = np.einsum("nh,nth->nt", dpool, k["states"])
    de = k["e"] * (de - (k["e"] * de).sum(1, keepdims=True))
    da = de[:, :, None] * p["va"] * (1 - k["a"] ** 2)
    g["va"] = np.einsum("nt,nta->a", de, k["a"])
    g["wa"], g["ba"] = np.einsum("nth,nta->ha", k["states"], da), da.sum((0, 1))
    dstates += da @ p["wa"].T
    dx = np.zeros_like(x)
    for name, part, trail in (("f", dstates[:, :, :H], k["ahead"]), ("b", dstates[:, :, H:], k["behind"])):
        u, down, du, dh = p["u" + name], np.zeros((n, index.shape[1], 3 * H), np.float32), np.zeros((H, 3 * H), np.float32), np.zeros((n, H), np.float32)
        for t, before, gates, c, hc in reversed(trail):
            dh = dh + part[:, t]
            if name == "b":
                dh *= mask[:, t, None]
            r, z = gates[:, :H], gates[:, H:]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            down[:, t] = np.concatenate([dr, dz, dc], 1)
            through = np.concatenate([dr, dz, dc * r], 1)
            du += before.T @ through
            dh = dh * z + through @ u.T
        dpre = _scatter(down.reshape(-1, 3 * H), index.ravel(), len(x))
        g["w" + name], g["b" + name], g["u" + name] = x.T @ dpre, dpre.sum(0), du
        dx += dpre @ p["w" + name].T
    loss = float(-np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)))
    return g, dx, loss


def _begin(rng: np.random.Generator) -> dict:
    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    d = DW + DC
    p = {"words": normal(WORDS, DW, scale=0.1), "grams": normal(GRAMS, DC, scale=0.3), "wa": normal(2 * H, A, scale=0.4), "ba": np.zeros(A, np.float32)}
    p |= {"va": normal(A, scale=0.4), "wo": normal(2 * H, scale=0.4), "bo": np.float32(-1)}
    for s in "fb":
        p |= {"w" + s: normal(d, 3 * H, scale=0.4), "b" + s: np.zeros(3 * H, np.float32), "u" + s: normal(H, 3 * H, scale=0.3)}
    return p


def _gather(t: Types, used: np.ndarray) -> Types:
    length = np.diff(t.gram_from)[used]
    start = np.concatenate([[0], np.cumsum(length)])
    at = np.repeat(t.gram_from[used] - start[:-1], length) + np.arange(start[-1])
    return Types(np.zeros(0, np.int64), t.bucket[used], t.gram[at], start)


def _associations(t: Types, bounds: np.ndarray, y: np.ndarray, block: int = 100) -> np.ndarray:
    """How strongly each type goes with the label: the largest smoothed log odds of its word and its n-grams."""
    word, gram = np.zeros((2, len(t.bucket))), np.zeros((2, GRAMS))
    for i in range(0, len(y), block):
        part = y[i : i + block]
        edge = bounds[i : i + len(part) + 1]
        doc = np.repeat(np.arange(len(part)), np.diff(edge))
        pair = np.unique(t.of_word[edge[0] : edge[-1]] * np.int64(block) + doc)
        kind, doc = pair // block, pair % block
        length = np.diff(t.gram_from)[kind]
        at = np.repeat(t.gram_from[kind] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        seen = np.unique(t.gram[at] * np.int64(block) + np.repeat(doc, length))
        for v in (0, 1):
            word[v] += np.bincount(kind[part[doc] == v], minlength=len(t.bucket))
            gram[v] += np.bincount(seen[part[seen % block] == v] // block, minlength=GRAMS)
    prior = np.log((y.sum() + 1) / ((1 - y).sum() + 1))
    of_word, of_gram = (np.log((n[1] + 0.5) / (n[0] + 0.5)) - prior for n in (word, gram))
    return np.maximum(of_word, np.maximum.reduceat(of_gram[t.gram], t.gram_from[:-1]))


def train(texts: list[str], labels: list[int], window: int = WINDOW, stride: int = TRAINING_STRIDE, steps: int = STEPS, seed: int = 7) -> Model | None:
    """Fits the network; the last fifth of the documents is held out. None if either part lacks a class."""
    y = np.array(labels, np.int64)
    cut = len(y) - len(y) // 5
    if not 0 < y[:cut].sum() < cut:
        return None
    rng = np.random.default_rng(seed)
    t, bounds = types_of(texts)
    if not len(t.of_word):
        return None
    strength = _associations(t, bounds, y[:cut])
    first, size, doc = windows(bounds, window, stride)
    mask = np.arange(window) < size[:, None]
    kinds = np.where(mask, t.of_word[np.minimum(first[:, None] + np.arange(window), len(t.of_word) - 1)], len(t.bucket)).astype(np.int32)
    mask = mask.astype(np.float32)
    evidence = np.append(strength, -99)[kinds].max(1) + rng.random(len(doc)) * 1e-6
    chosen = []
    order = np.lexsort((-evidence, doc))
    begin = np.searchsorted(doc[order], np.arange(len(y) + 1))
    for i in range(cut):
        own = order[begin[i] : begin[i + 1]]
        chosen += list(own[:2]) if y[i] else [*own[:1], *rng.choice(own, min(3, len(own)), replace=False)] if len(own) else []
    chosen = np.unique(np.array(chosen))
    target = y[doc[chosen]].astype(np.float32)

    p = _begin(rng)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    mixed, harder = np.zeros(0, np.int64), steps // 2
    for step in range(1, steps + 1):
        if step == harder:  # the clean windows that look worst so far, one or two a document
            clean = np.flatnonzero((doc < cut) & (y[doc] == 0))
            few = inputs(t, p)
            logits = np.concatenate([_score(np.concatenate([few, np.zeros((1, DW + DC), np.float32)]), kinds[clean[i : i + _BLOCK]], mask[clean[i : i + _BLOCK]], p) for i in range(0, len(clean), _BLOCK)])
            worst = clean[np.argsort(-logits, kind="stable")[: len(chosen) // 3]]
            chosen = np.concatenate([chosen, np.setdiff1d(worst, chosen)])
            target, mixed = y[doc[chosen]].astype(np.float32), mixed[:0]
        rate = 0.02 * (1 - step / (steps + 1))
        if not len(mixed):
            mixed = rng.permutation(len(chosen))
        rows, mixed = mixed[:BATCH], mixed[BATCH:]
        used, local = np.unique(kinds[chosen[rows]], return_inverse=True)
        local = local.reshape(len(rows), window)
        if used[-1] == len(t.bucket):
            used = used[:-1]
        few = _gather(t, used)
        x = inputs(few, p)
        hide = rng.random(len(x)) < 0.4  # the characters must do without the word
        x[hide, :DW] = 0
        x = np.concatenate([x, np.zeros((1, DW + DC), np.float32)])
        g, dx, _ = _slope(x, np.minimum(local, len(x) - 1), mask[chosen[rows]], target[rows], p)
        dx = dx[:-1]
        dx[hide, :DW] = 0
        count = np.diff(few.gram_from)
        g["words"] = _scatter(dx[:, :DW], few.bucket, WORDS)
        g["grams"] = _scatter(np.repeat(dx[:, DW:] / count[:, None], count, axis=0), few.gram, GRAMS)
        for k, v in g.items():
            m, s = state[k]
            m *= 0.9
            m += 0.1 * v
            s *= 0.99
            s += 0.01 * np.square(v)
            if k == "bo":
                state[k] = [m, s] = [np.float32(m), np.float32(s)]
            p[k] = (p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    model = Model(p, window=window, stride=max(1, window // 2))
    held = np.array(score(texts[cut:], model)["score"])
    truth = y[cut:]
    if 0 < truth.sum() < len(truth):
        logit = np.log((held + 1e-9) / (1 - held + 1e-9))
        values = np.unique(logit)
        best, at = -1.0, 0.0
        for a, b in zip(values[:-1], values[1:]):
            hit = logit > (a + b) / 2
            gain = (hit & (truth == 1)).sum() / truth.sum() - 2 * (hit & (truth == 0)).sum() / (truth == 0).sum() + 1e-6 * (b - a)
            if gain > best:
                best, at = gain, (a + b) / 2
        model.threshold = float(1 / (1 + np.exp(-at)))
        hit = held > model.threshold
        model.held_out = {"toxic": int(truth.sum()), "caught": int((hit & (truth == 1)).sum()), "clean": int((truth == 0).sum()), "rejected": int((hit & (truth == 0)).sum())}
    return model


def score(texts: list[str], model: Model, known: Known | None = None) -> dict[str, list]:
    """Each text's worst window: its score, and its first and last character's place (end exclusive)."""
    known = known or Known(model.p)
    out: dict[str, list] = {"score": [], "begin": [], "end": []}
    for a, b in runs(texts):
        c = textvec.codes(texts[a:b])
        w = textvec.words(c)
        worst, begin, end = np.zeros(b - a), np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
        if len(w.hash):
            x, of_word = known.inputs(c, w)
            x = np.concatenate([x, np.zeros((1, DW + DC), np.float32)])
            first, size, doc = windows(w.bounds, model.window, model.stride)
            kinds = np.append(of_word, np.full(model.window, len(x) - 1))
            logits = np.empty(len(doc), np.float32)
            for i in range(0, len(doc), _BLOCK):
                s = slice(i, i + _BLOCK)
                mask = np.arange(model.window) < size[s, None]
                logits[s] = _score(x, np.where(mask, kinds[first[s, None] + np.arange(model.window)], len(x) - 1), mask.astype(np.float32), model.p)
            order = np.lexsort((first, -logits, doc))
            top = order[np.searchsorted(doc[order], np.unique(doc))]
            at = doc[top]
            worst[at] = 1 / (1 + np.exp(-np.clip(logits[top].astype(float), -30, 30)))
            begin[at] = w.start[first[top]] - c.offsets[at]
            end[at] = w.end[first[top] + size[top] - 1] - c.offsets[at]
        out["score"] += worst.tolist()
        out["begin"] += begin.tolist()
        out["end"] += end.tolist()
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, **how) -> Model | None:
    """Trains on at most ``max_labelled`` labelled documents, at most half of them toxic."""
    label = F.col(label_col).cast("int")
    each = labels.filter(label.isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y"))
    each = each.withColumn("order", F.xxhash64("id"))
    half = max_labelled // 2
    picked = each.filter("y = 1").orderBy("order", "id").limit(half).unionByName(each.filter("y = 0").orderBy("order", "id").limit(max_labelled - half))
    # the sample is bounded by a parameter, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = rows.groupBy("id", "order", "y").agg(F.min("text").alias("text"))  # a repeated id is one document here
    rows = bounded(rows, "text", ["order", "id"])
    got = sorted({(r["order"], str(r["id"]), r["text"] or "", r["y"]) for r in rows.collect()})
    # the least hashes of the rarer class reach further up, so the order by hash would hold out one class alone
    got = [got[i] for i in np.random.default_rng(11).permutation(len(got))]
    return train([g[2] for g in got], [g[3] for g in got], **how) if got else None


def with_scores(docs: DataFrame, model: Model | None, text_col: str, score_col: str, begin_col: str, end_col: str) -> DataFrame:
    """``docs`` with three more columns: the worst window's score and place."""
    fields = [T.StructField(score_col, T.DoubleType()), T.StructField(begin_col, T.LongType()), T.StructField(end_col, T.LongType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        held = shared.value
        known = Known(held.p) if held else None

        def each(texts):
            got = score(texts, held, known) if held else {k: [0] * len(texts) for k in ("score", "begin", "end")}
            return {score_col: got["score"], begin_col: got["begin"], end_col: got["end"]}

        return each

    return map_texts(docs, text_col, make, fields)


def toxic_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, score, begin, end) of the documents that are rejected, with the worst window's place."""
    model = fit(docs, labels, id_col, text_col, **how)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_scores(narrow, model, "text", "score", "begin", "end").drop("text")
    return found.filter(F.col("score") > F.lit(model.threshold if model else 1.0))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rejected documents, in its own columns."""
    model = fit(docs, labels, id_col, text_col, **how)
    s, b, e = (fresh(docs, c) for c in ("worst_score", "worst_begin", "worst_end"))
    found = with_scores(docs, model, text_col, s, b, e)
    return found.filter(F.col(s) <= F.lit(model.threshold if model else 1.0)).drop(s, b, e)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
