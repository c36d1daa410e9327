import itertools
import random

import pytest
from pyspark.sql import functions as F

from partylens.functions import names as N
from partylens.operators import screening as S

LISTED = ["Zenith Precision Instruments", "Al Noor Trading Company", "Ivanov Export", "Golden River Shipping", "Acme", "Red Star", "Blue Star Lines"]
ASKED = ["Instruments Zenith Precision", "Noor Trade", "Ivanoff Export", "Golden Rivr Shiping", "ACME Inc.", "Blue Star", "Nobody Known", ""]


def frames(spark):
    none = F.array().cast("array<string>")
    parties = spark.createDataFrame([(f"L{i}", "SDN", n) for i, n in enumerate(LISTED)], "uid string, source string, name string").withColumn("aliases", none)
    subjects = spark.createDataFrame([(f"S{i}", n) for i, n in enumerate(ASKED)], "subject_id string, name string").withColumn("aliases", none)
    return subjects, parties


def test_bands(spark):
    got = {(r["subject_id"], r["uid"]): r["band"] for r in S.screen(*frames(spark)).collect()}
    assert got[("S0", "L0")] == "EXACT"
    assert got[("S4", "L4")] == "EXACT"
    assert got[("S2", "L2")] in ("EXACT", "STRONG", "WEAK")
    assert not [k for k in got if k[0] in ("S6", "S7")]


def test_blocking_and_ceiling_lose_nothing(spark):
    """The same as scoring the full cross product of pairs that share a key."""
    subjects, parties = frames(spark)
    names, queries = S.index(parties), S.subject_queries(subjects)
    pairs = S.cheap_signals(S.candidate_pairs(queries, names))
    full = S.score(pairs).withColumn("band", S.band()).filter("band <> 'NONE'").select("subject_id", "uid").distinct()
    quick = S.screen(subjects, parties).select("subject_id", "uid")
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, quick.collect()))
    met = {(r["query_id"], r["entry_id"]) for r in S.block(queries, names)[0].collect()}
    q = {r["query_id"]: set(r["toks"]) | {"~" + x for x in r["skel"].split()} for r in queries.collect()}
    e = {r["entry_id"]: set(r["toks"]) | {"~" + x for x in r["skel"].split()} for r in names.collect()}
    assert met == {(a, b) for a, b in itertools.product(q, e) if q[a] & e[b]}


@pytest.mark.parametrize("cap", [1, 25, 20_000])
def test_likely_pairs_are_all_that_can_reach_a_band(spark, cap):
    """Against all blocked pairs, at caps that cut keys, with hot words, single words, acronyms and repeated tokens."""
    r = random.Random(cap)
    words = ["trading", "global", "star", *["w" + c * (1 + k % 2) + d for k, c in enumerate("bcdfgklm") for d in "aeiou"], "ab", "x", "ivanov", "ivanoff", "shipping", "sipping"]
    name = lambda: " ".join(r.choice(words[:3] if r.random() < 0.4 else words) for _ in range(r.choice([1, 2, 2, 3, 3, 4, 6])))
    none = F.array().cast("array<string>")
    parties = spark.createDataFrame([(f"L{i}", "SDN", name()) for i in range(90)] + [("A1", "SDN", "alpha beta ab"), ("A2", "SDN", "a b")], "uid string, source string, name string").withColumn("aliases", none)
    subjects = spark.createDataFrame([(f"S{i}", name()) for i in range(70)] + [("T1", "aba"), ("T2", "ab a b"), ("T3", "ab")], "subject_id string, name string").withColumn("aliases", none)
    names, queries = S.index(parties), S.subject_queries(subjects)
    kept, cut = S.block(queries, names, cap)
    want = S.cheap_signals(S.with_both_forms(kept, queries, names)).filter(S.promising()).select("query_id", "entry_id")
    likely, cut2 = S.likely_pairs(queries, names, cap)
    got = S.cheap_signals(S.with_both_forms(likely, queries, names)).filter(S.promising()).select("query_id", "entry_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20
    assert likely.exceptAll(kept).count() == 0 and sorted(map(tuple, cut.collect())) == sorted(map(tuple, cut2.collect()))
    # the cap by hand: rarest keys first until the union is large enough
    entries = {}
    for e in names.collect():
        for k in {(0, t) for t in e["toks"]} | {(1, t) for t in e["skel"].split()}:
            entries.setdefault(k, set()).add(e["entry_id"])
    met = set()
    for q in queries.collect():
        union = set()
        for k in sorted({(0, t) for t in q["toks"]} | {(1, t) for t in q["skel"].split()}, key=lambda k: (len(entries.get(k, ())), k[1], k[0])):
            if len(union) < cap:
                union |= entries.get(k, set())
        met |= {(q["query_id"], e) for e in union}
    assert {tuple(x) for x in kept.collect()} == met


def test_no_posting_of_a_key_surely_left_out_is_joined(spark):
    subjects, parties = frames(spark)
    hot = spark.range(3000).select(F.concat(F.lit("H"), "id").alias("uid"), F.lit("SDN").alias("source"), F.concat(F.lit("trading w"), "id").alias("name"), F.array().cast("array<string>").alias("aliases"))
    asked = spark.range(3000).select(F.concat(F.lit("Q"), "id").alias("subject_id"), F.concat(F.lit("trading w"), F.col("id") + 1).alias("name"), F.array().cast("array<string>").alias("aliases"))
    likely, _ = S.likely_pairs(S.subject_queries(asked), S.index(hot))
    assert likely.count() < 5 * 3000  # all share the first word, which would be nine million pairs
    stand = S.standing(S.subject_queries(asked), S.keys(S.index(hot), "entry_id"), cap=100)
    kept = {r["kind"]: r["n"] for r in stand.filter("key in ('trade', 'trd') and kept").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kept.values()) == {3000} and len(kept) == 1  # of the two keys that all have one comes first, after the rare ones; the other is cut


def test_no_list_is_broadcast(spark):
    """Lists are far larger taken apart than their files tell: a broadcast of one goes through the driver."""
    subjects, parties = frames(spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    names, queries = S.index(parties), S.subject_queries(subjects)
    for df in (S.standing(queries, S.keys(names, "entry_id"), cap=2), S.block(queries, names)[0], S.bounded_searches(subjects, parties, cap=2), S.likely_pairs(queries, names)[0], S.likely_pairs(queries, names, 2)[0], S.screen(subjects, parties)):
        assert "BroadcastHashJoin" not in plan(df)


def test_names_that_are_alike_are_compared_once(spark):
    """Each in its own right in the result and in the cap's counts."""
    subjects, parties = frames(spark)
    four = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    many = parties.withColumn("i", four).withColumn("uid", F.concat_ws("/", "uid", "i")).drop("i")
    asked = S.subject_queries(subjects.withColumn("i", four).withColumn("subject_id", F.concat_ws("/", "subject_id", "i")))
    assert S.distinct_forms(asked, "query_id").count() == asked.select("norm").distinct().count() < asked.count()
    got = S.screen(subjects, many).select("subject_id", F.substring_index("uid", "/", 1).alias("uid"), "band", "score")
    want = S.screen(subjects, parties).select("subject_id", "uid", "band", "score")
    assert sorted(map(tuple, got.distinct().collect())) == sorted(map(tuple, want.collect())) and got.count() == 4 * want.count()
    told = {r["subject_id"]: r["left_out"] for r in S.bounded_searches(subjects, many, cap=4).collect()}
    kept, cut = S.block(S.subject_queries(subjects), S.index(many), cap=4)
    by_name = S.told(cut, S.subject_queries(subjects))
    assert told == {r["subject_id"]: r["left_out"] for r in by_name.collect()} and told


def test_what_was_left_out_stands_at_the_candidates(spark):
    subjects, parties = frames(spark)
    wide = parties.withColumn("name", F.concat("name", F.lit(" star")))
    found = S.screen(subjects.withColumn("name", F.concat("name", F.lit(" star"))), wide, cap=1).collect()
    assert found and all("star (df=" in (r["left_out"] or "") for r in found if r["subject_id"] not in ("S6", "S7"))


def test_order_explanation_and_country(spark):
    subjects, parties = frames(spark)
    rows = S.in_order(S.screen(subjects, parties, least="NONE"), most=2).collect()
    assert [(r["subject_id"], r["place"]) for r in rows] == sorted((r["subject_id"], r["place"]) for r in rows) and max(r["place"] for r in rows) <= 2
    told = S.explain("Golden Rivr Shiping", parties, 3).collect()
    assert told[0]["uid"] == "L3" and [r["place"] for r in told] == list(range(1, len(told) + 1)) and told[0]["jaro_winkler"] > 0.9
    geo = spark.createDataFrame([("China", ["Macau, China"]), ("in", ["China"]), ("", ["China"]), ("Iran", []), ("Iran", ["Iraq"]), (None, None), ("Côte", ["cote d'ivoire"])], "c string, l array<string>")
    assert [r[0] for r in geo.select(S.country_evidence(F.col("c"), F.col("l"))).collect()] == ["agrees", "agrees", "insufficient", "insufficient", "differs", "insufficient", "agrees"]
    shown = S.capped_profile(spark.createDataFrame([("u", "s", "n", ["a"] * 30, ["b"], None, "r" * 2000)], "uid string, source string, name string, aliases array<string>, addresses array<string>, ids array<string>, remarks string")).first()
    assert (len(shown["aliases"]), len(shown["addresses"]), len(shown["ids"]), len(shown["remarks"]), shown["hidden"]) == (25, 1, 0, 1500, 5)
    assert S.critic_view(subjects.withColumn("raw", F.lit("secret"))).columns == ["name", "aliases"]


def test_the_cap_is_told(spark):
    subjects, parties = frames(spark)
    wide = parties.withColumn("name", F.concat("name", F.lit(" star")))
    kept, cut = S.block(S.subject_queries(subjects), S.index(wide), cap=1)
    assert cut.count() > 0 and kept.count() > 0
    assert S.bounded_searches(subjects, wide, cap=1).filter("left_out like '%df=%'").count() > 0


def test_partitions_dont_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, S.screen(*frames(spark)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_index_drops_repeated_and_empty_names(spark):
    df = spark.createDataFrame([("a", "X", "Acme", ["ACME", " ", "Acme Two"]), ("b", "X", "!!!", None)], "uid string, source string, name string, aliases array<string>")
    assert sorted(r["listed_name"] for r in S.index(df).collect()) == ["Acme", "Acme Two"]


def test_digest_follows_the_lists(monkeypatch):
    before = S.tuning_digest()
    monkeypatch.setattr(N, "STOP_WORDS", (*N.STOP_WORDS, "zz"))
    assert S.tuning_digest() != before
