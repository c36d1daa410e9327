import itertools
import random
import re

import pytest

from partylens.llm import linededup as L
from partylens.llm import neardup as N
from partylens.llm.components import components
from partylens.llm.base import Scratch


def changed(text, share, seed):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else "zz" + str(r.randint(0, 999)) for w in text.split(" "))


def shingle_set(text, k=N.SHINGLE):
    """Word shingles as tuples, by a pattern of its own."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, threshold=N.THRESHOLD):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    groups = {i: top(i) for i in sets}
    size = {}
    for g in groups.values():
        size[g] = size.get(g, 0) + 1
    return {(i, g) for i, g in groups.items() if size[g] > 1}


def test_groups_agree_with_brute_force(spark, docs, prose):
    rows = []
    for k in range(25):
        base = prose(k, 60 + 15 * k)
        rows.append((len(rows), base))
        for c in range(k % 4):
            rows.append((len(rows), changed(base, 0.01 + 0.04 * c, k * 10 + c)))
    shared = prose(999, 70)
    rows += [(len(rows) + j, prose(2000 + j, 120) + " " + shared) for j in range(30)]  # a passage alone makes no group
    hot = prose(5000, 150)
    rows += [(len(rows) + j, changed(hot, 0.03, j)) for j in range(40)]
    got = {tuple(r) for r in N.near_duplicates(docs(rows)).collect()}
    want = brute(rows)
    assert len(got & want) >= 0.9 * len(want)
    assert not got - want


def test_members_meet_where_both_turns_have_one_centre(spark, docs):
    from pyspark.sql import functions as F

    rank = spark.range(60).select("id", F.xxhash64("id", F.lit("first")).alias("x"), F.xxhash64("id", F.lit("second")).alias("y")).collect()
    a = next(r for r in rank if sum(r["x"] < o["x"] and r["y"] < o["y"] for o in rank) >= 2)
    b, c = [o["id"] for o in rank if a["x"] < o["x"] and a["y"] < o["y"]][:2]
    common = " ".join(f"w{i}" for i in range(29))
    more = lambda p, n: common + "".join(f" {p}{i}" for i in range(n))
    rows = [(a["id"], more("a", 19)), (b, more("b", 18)), (c, common)]  # of these only b and c are near
    assert {tuple(r) for r in N.near_duplicates(docs(rows)).collect()} == brute(rows) == {(b, min(b, c)), (c, min(b, c))}


@pytest.mark.parametrize("share", [0.5, 0.68])
def test_pages_of_one_template(docs, prose, share):
    """Pages that share a template are apart, but for those whose own part is shared too."""
    template, rows = prose(7000, int(200 * share)), []
    for j in range(60):
        own = prose(8000 + j // 3 if j % 3 < 2 else 9000 + j, 200 - int(200 * share))
        rows.append((j, template + "\n" + (own if j % 3 != 1 else changed(own, 0.02, j))))
    got = {tuple(r) for r in N.near_duplicates(docs(rows), all_pairs=4).collect()}
    assert got == brute(rows) and len(got) >= 30


def test_few_pairs_of_a_template_with_many_pages(spark, docs, prose):
    """20,000 members of a list that are all apart: the pairs that meet grow with the pages, not their square."""
    template = prose(7001, 60)
    words = [prose(k, 400).split() for k in range(50)]
    rows = [(j, template + " " + " ".join(random.Random(j).choices(words[j % 50], k=34))) for j in range(20_000)]
    texts = docs(rows).selectExpr("doc_id node", "text")
    apart = spark.createDataFrame([(i, i) for i, _ in rows], "node long, label long")
    pairs = N.first_shingles(apart, texts, N.SHINGLE, N.THRESHOLD, Scratch(spark))
    assert pairs.count() < 20 * len(rows)


def test_hard_rows(spark, docs, prose):
    text = prose(1, 80)
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (5, "  \n"), (6, "one"), (7, "one"), (None, text), (None, None), (8, prose(2, 30000)), (9, prose(2, 30000) + " more")]
    got = {tuple(r) for r in N.near_duplicates(docs(rows)).collect()}
    assert got == {(1, 1), (2, 1), (6, 6), (7, 6), (8, 8), (9, 8)}
    kept = [r["doc_id"] for r in N.drop_near_duplicates(docs(rows)).collect()]
    assert sorted(kept, key=str) == sorted([1, 1, 3, 4, 5, 6, 8, None, None], key=str)


def test_an_id_with_two_texts_links_both(docs, prose):
    a, b = prose(1, 50), prose(2, 50)
    assert {tuple(r) for r in N.near_duplicates(docs([(1, a), (5, a), (5, b), (7, b)])).collect()} == {(1, 1), (5, 1), (7, 1)}


def test_empty(docs):
    assert N.near_duplicates(docs([])).count() == 0 and N.drop_near_duplicates(docs([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y", Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_components_in_one_task_and_by_rounds(spark):
    """Both ways give what depth-first search gives, and a small graph takes few jobs (its rounds took the driver's memory)."""
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(2**62, -5), (-5, 401)] + [(1000 - i, 1001 - i) for i in range(50)] + [(2000, i) for i in range(2001, 2300)]
    near, want = {}, {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    df = spark.createDataFrame(edges + [(None, 1), (2, None)], "x long, y long")
    jobs = {}
    for most in (0, 10_000):
        spark.sparkContext.setJobGroup(f"components {most}", "")
        got = {x["node"]: x["root"] for x in components(df, "x", "y", Scratch(spark), most).collect()}
        jobs[most] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {most}"))
        assert got == {k: v for k, v in want.items() if k != v}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert components(df.limit(0), "x", "y", Scratch(spark)).count() == 0
    strings = spark.createDataFrame([("b", "a"), ("c", "b")], "x string, y string")
    assert {x["node"]: x["root"] for x in components(strings, "x", "y", Scratch(spark)).collect()} == {"b": "a", "c": "a"}
    assert jobs[10_000] <= 8 < jobs[0], jobs


def lines(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_repeated_passages_go(docs, prose):
    passage = prose(77, 60)
    a, b = prose(1, 60), prose(2, 60)
    got = lines(L.dedup_lines(docs([(1, a + "\n" + passage), (2, b[:100] + " " + passage + "\n" + b[100:]), (3, passage)])))
    assert got[1] == a + "\n" + passage
    middle = passage[len(passage) // 4 : 3 * len(passage) // 4]
    assert middle not in got[2] and got[2].startswith(b[:100]) and got[2].endswith(b[150:])
    assert got[3] == ""


def split_lines(text):
    """Character by character: a line ends at a line feed, or with the white space after a punctuation mark."""
    out, begin, i = [], 0, 0
    while i < len(text):
        i += 1
        if text[i - 1] in ".,;:!?" and text[i : i + 1] and text[i] in " \t\r\n":
            while i < len(text) and text[i] in " \t\r\n":
                i += 1
        elif text[i - 1] != "\n":
            continue
        out.append(text[begin:i])
        begin = i
    return out + [text[begin:]]


def cut_by_hand(texts):
    seen, want = {}, {}
    for i, text in enumerate(texts):
        p = split_lines(text)
        assert "".join(p) == text
        solid = [(j, x.strip(" \t\r\n")) for j, x in enumerate(p) if x.strip(" \t\r\n")]
        cut = set()
        for k in range(len(solid) - 2):
            w = tuple(s for _, s in solid[k : k + 3])
            if seen.setdefault(w, (i, k)) != (i, k):
                cut |= set(range(solid[k][0], solid[k + 2][0] + 1))
        want[i] = "".join(x for j, x in enumerate(p) if j not in cut)
    return want


def test_brute_force_lines(docs, prose):
    texts = [prose(k % 7, 40) + "\n" + prose(k % 3, 30) + "\n" + prose(100 + k, 20) for k in range(12)]
    texts += ["\n".join(f"w{j}" for j in range(30)) + f"\nown {k}" for k in range(3)]  # a list of short lines
    texts += ["a.b.c, d  ,e\n\n. x! \r\n y...  z;w", "a.b.c, d  ,e\n\n. x! \r\n y...  z;w? q"]
    assert lines(L.dedup_lines(docs(list(enumerate(texts))))) == cut_by_hand(texts)


def test_control_characters_stay(docs, prose):
    text = "own start\x01mark. ... end\x01x\n\x02 and, \x00so on.\nlast"
    rows = [(1, text), (2, text + "\nmore\x01"), (3, prose(1, 30) + "\x01")]
    got = lines(L.dedup_lines(docs(rows)))
    assert got == {1: text, 2: "more\x01", 3: rows[2][1]}


def test_a_passage_that_many_hold_and_a_text_without_breaks(docs, prose):
    shared = "we use cookies.\nplease agree.\nread more here.\n"
    rows = [(i, shared + f"own {i}") for i in range(3000)]
    dots = "a.b" * 200_000
    got = lines(L.dedup_lines(docs(rows + [(5000, dots)])))
    assert got[0] == rows[0][1] and got[5000] == dots
    assert all(got[i] == f"own {i}" for i in range(1, 3000))


@pytest.mark.parametrize("text", [None, "", "one line", "a\nb"])
def test_small_texts_stay(docs, text):
    assert lines(L.dedup_lines(docs([(1, text), (2, text), (None, text)])))[2] == text


def test_hard_lines(docs, prose):
    text = prose(3, 60)
    df = L.dedup_lines(docs([(1, text), (1, text), (None, text), (2, text * 300)]))
    got = df.collect()
    assert df.columns[-1] == "lines_cut" and len(got) == 4
    assert [r["text"] for r in got if r["doc_id"] == 1] == [text, text]
    assert [r["text"] for r in got if r["doc_id"] is None] == [""]
    assert L.dedup_lines(docs([])).count() == 0
