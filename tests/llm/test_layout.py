import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partylens.llm import decontam as D
from partylens.llm import packing as K
from partylens.llm import sharding as S


def test_bounds_are_optimal():
    for seed in range(12):
        r = random.Random(seed)
        length = sorted(r.sample(range(0, 60), 9))
        count = [r.randint(1, 20) for _ in length]
        for k in (1, 2, 3, 9, 12):
            bounds, padding = K.best_bounds(np.array(length), np.array(count), k)
            waste = lambda bs: sum(c * (min(b for b in bs if b >= n) - n) for n, c in zip(length, count))
            want = min(waste((*c, length[-1])) for c in itertools.combinations(length[:-1], min(k, len(length)) - 1))
            assert padding == want == waste(bounds)


def test_packing(docs, prose):
    rows = [(i, prose(i, 5 + 37 * (i % 11))) for i in range(60)] + [(100, None), (101, ""), (None, "a b"), (0, "again"), (0, "again"), (102, prose(7, 4000))]
    got = K.pack(docs(rows), longest=256, buckets=4, budget=1024).collect()
    count = K.counts_of(K.VOCABULARY)
    assert sum(r["n_tokens"] for r in got) == sum(count([t or "" for _, t in rows]))
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    batches = {}
    for r in got:
        assert r["n_tokens"] <= r["bucket_length"] <= 256
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for rs in batches.values():
        assert len(rs) * max(1, rs[0]["bucket_length"]) <= 1024
    parts = sorted((r["part"], r["begin_token"], r["n_tokens"]) for r in got if r["doc_id"] == 102)
    assert all(b == p * 256 for p, b, _ in parts) and all(n == 256 for *_, n in parts[:-1])
    for b in {r["bucket"] for r in got}:  # only the last batch of a bucket may be open
        mine = sorted(k for k in batches if k[0] == b)
        assert [k[1] for k in mine] == list(range(len(mine)))
        assert len({len(batches[k]) for k in mine[:-1]}) <= 1
    assert K.pack(docs([])).count() == 0


def test_differencing_is_tight():
    r = random.Random(3)
    for k in (2, 3, 8):
        sizes = sorted((int(r.paretovariate(1.5) * 100) for _ in range(300)), reverse=True)
        slots = S.difference_sizes(sizes, k)
        sums = np.bincount(slots, weights=sizes, minlength=k)
        assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= max(0.02 * sums.mean(), sizes[0] - sums.mean())
        full = S.difference([[s] + [0] * (k - 1) for s in sizes])
        other = np.bincount([f[0] for f in full], weights=sizes, minlength=k)
        assert other.max() - other.min() <= max(0.02 * sums.mean(), sizes[0] - sums.mean()) and all(sorted(f) == list(range(k)) for f in full)
    assert S.difference([]) == [] and S.difference_sizes([5], 3) == [0]


def plain_differencing(sizes, k):
    """The sums of the shards, with lists that are searched through for the two largest spreads."""
    parts = [[s] + [0] * (k - 1) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[-1] - p[0])
        a, b = parts.pop(0), parts.pop(0)
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return parts[0]


@pytest.mark.parametrize("k", [2, 3, 5])
def test_differencing_agrees_with_plain_lists(k):
    for seed in range(40):
        r = random.Random(seed)
        sizes = sorted(r.sample(range(1, 100_000), r.randint(1, 40)), reverse=True)
        want = plain_differencing(sizes, k)
        for slots in (S.difference_sizes(sizes, k), [f[0] for f in S.difference([[s] + [0] * (k - 1) for s in sizes])]):
            got = sorted(np.bincount(slots, weights=sizes, minlength=k), reverse=True)
            assert got[0] - got[-1] <= max(1.0001 * (want[0] - want[-1]), 0.02 * sum(sizes) / k) and sum(got) == sum(sizes)
        if len(sizes) <= 9 and k == 2:  # never better than the best of all divisions
            best = min(abs(2 * sum(c) - sum(sizes)) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n))
            assert want[0] - want[-1] >= best


def test_cells_are_as_even_as_one(docs, prose):
    """The spread on both sides of the number of groups from which there are cells."""
    rows = [(i, prose(i, 3 + i % 40)) for i in range(400)]
    for per_cell in (500, 399, 40):
        got = S.assign_shards(docs(rows), F.col("text"), F.octet_length("text"), k=8, per_cell=per_cell).collect()
        sums = np.bincount([r["shard"] for r in got], weights=[r["bytes"] for r in got], minlength=8)
        assert sums.max() - sums.min() <= 0.01 * sums.mean()


def test_long_and_repeated_rows_are_sharded_and_packed(docs, prose):
    long = prose(3, 200_000)
    rows = [(1, long), (2, "x"), (2, "x"), (2, "x"), (3, None)]
    got = S.assign_shards(docs(rows), F.col("text"), F.octet_length("text"), k=2).collect()
    assert len(got) == 5 and len({r["shard"] for r in got if r["doc_id"] == 2}) == 1 and sum(r["bytes"] for r in got) == len(long) + 3
    packed = K.pack(docs([(1, long), *[(5, prose(k, 9)) for k in range(50)]])).collect()
    assert sum(r["n_tokens"] for r in packed if r["doc_id"] == 1) == K.counts_of(K.VOCABULARY)([long])[0] and sum(r["doc_id"] == 5 for r in packed) == 50


@pytest.mark.parametrize("per_cell,on_driver", [(1000, 5000), (20, 3)])
def test_shards(docs, prose, per_cell, on_driver):
    rows = [(i, prose(i % 150, 5 + (i % 150) * 2)) for i in range(220)] + [(300, None), (301, None), (302, ""), (None, "x"), (1, prose(1, 7))]
    got = S.assign_shards(docs(rows), F.col("text"), F.octet_length("text"), k=4, per_cell=per_cell, on_driver=on_driver).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r["group"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    sums = np.bincount([r["shard"] for r in got], weights=[r["bytes"] for r in got], minlength=4)
    assert sums.sum() == sum(len((t or "").encode()) for _, t in rows) and sums.max() - sums.min() <= 0.05 * sums.mean()
    assert S.assign_shards(docs([]), F.col("text"), F.octet_length("text")).count() == 0


def brute(rows, items, threshold):
    """Exact similarities of every window to every item from word tuples, without hashes or fingerprints."""
    import math
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    pairs = lambda w: [tuple(w[i : i + 2]) for i in range(len(w) - 1)] or [tuple(w)] * bool(w)
    texts = [(i, words(t)) for i, t in rows]
    frequency = {}
    for _, w in texts:
        for s in set(pairs(w)):
            frequency[s] = frequency.get(s, 0) + 1
    weight = lambda ss: sum(math.log((len(rows) + 1) / (frequency.get(s, 0) + 1)) + 0.01 for s in ss)
    found = {}
    for j, t in items:
        item = words(t)
        own = set(pairs(item))
        for i, w in texts:
            size = min(len(item), len(w))
            for a in range(len(w) - size + 1 if size and own else 0):
                score = weight(own & set(pairs(w[a : a + size]))) / weight(own)
                if score >= threshold - 1e-9:
                    found[(i, j)] = max(found.get((i, j), 0), score)
    return found


def test_contamination_agrees_with_brute_force(spark, docs, prose):
    items = [(k, prose(500 + k, 12 + 3 * k)) for k in range(8)]
    rows = [(i, prose(i, 80)) for i in range(40)]
    r = random.Random(1)
    for i in range(0, 32):
        item = items[i % 8][1].split()
        for _ in range(i // 8):
            item[r.randrange(len(item))] = "changed"
        words = rows[i][1].split(" ")
        at = r.randrange(len(words))
        rows[i] = (i, " ".join(words[:at] + item + words[at:]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in D.contaminated(docs(rows), bench).collect()}
    want = brute(rows, items, D.THRESHOLD)
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and len(want) >= 16
    assert all((i, i % 8) in got for i in range(8))
    for key, s in got.items():
        assert s <= want[key] + 1e-6


def test_hard_contamination(spark, docs, prose):
    item = prose(1, 20)
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, item, 0), (3, None, 0), (4, "", 0), (5, "single", 0)], "item_id long, text string, doc_id int")
    rows = [(1, item), (1, item), (2, None), (3, ""), (None, "x " + item), (4, prose(9, 30000) + " " + item), (5, " ".join(item.split()[:10])), (6, "clean words only")]
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in D.contaminated(docs(rows), bench).collect())
    assert got == sorted([("1", 1), ("1", 1), ("1", 2), ("1", 2), ("None", 1), ("None", 2), ("4", 1), ("4", 2)])
    kept = D.drop_contaminated(docs(rows), bench)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "5", "6"] and kept.columns == docs(rows).columns
    assert D.contaminated(docs(rows), bench.limit(0)).count() == 0 and D.contaminated(docs([]), bench).count() == 0


@pytest.mark.parametrize("radius", [2, 7, D.RADIUS])
@pytest.mark.parametrize("n", [1, 300, 5000])  # few values are compared, many looked up
def test_the_index_finds_all_within_the_radius(n, radius):
    rng = np.random.default_rng(n)
    prints = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    found = prints[rng.integers(0, n, 60)].copy()
    for k in range(len(found)):
        for bit in rng.choice(64, k % 24, replace=False):
            found[k] ^= np.uint64(1) << np.uint64(bit)
    distance = np.bitwise_count(found[:, None] ^ prints[None])
    row, item, near = D.MultiIndex(prints, radius).near(found)
    assert list(zip(row, item)) == list(zip(*np.nonzero(distance <= radius))) and (near == distance[row, item]).all()


def test_a_long_text_of_many_items(spark, docs, prose):
    items = [(k, prose(600 + k, 20)) for k in range(300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, " ".join(t for _, t in items * 20)), (2, prose(1, 50))]
    got = D.contaminated(docs(rows), bench, slice_items=40).collect()
    assert sorted(r["item_id"] for r in got) == list(range(300)) and {r["similarity"] for r in got} == {1.0}
