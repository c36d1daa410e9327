"""Blocked fuzzy screening of subjects against a party list.

index -> postings -> block (rarest keys first, bounded union, what was left out disclosed) -> pairs that can reach
a band -> cheap signals -> score ceiling -> Jaro-Winkler on what is left -> bands -> best candidate for each party.
Every step is a DataFrame operator; the only Python is the Arrow UDF behind the ceiling.

Which keys the cap leaves out is settled by their frequencies alone wherever these suffice; no posting of a key that
is surely left out is joined. Blocked pairs aren't listed in full: a pair reaches a band only if it shares so many
tokens that one of them is among the rarest of both names, so common words make no pairs (``likely_pairs``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partylens.functions import names as N
from partylens.operators.audit import canonical
from partylens.storage import cut

WEIGHTS = {"jaro_winkler": 0.35, "jaccard": 0.20, "containment": 0.20, "edit": 0.15, "skeleton": 0.10}
STRONG, WEAK, COMMON_SHARE, BLOCK_CAP, SHORT = 0.90, 0.78, 0.02, 20_000, 4
BAND_RANK = {name: i for i, name in enumerate("NONE WEAK STRONG EXACT".split())}


def index(parties: DataFrame) -> DataFrame:
    """One row for each distinct name (without regard to case) of (uid, source, name, aliases array)."""
    every = parties.select("uid", "source", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "listed_name"))
    every = every.withColumn("listed_name", F.trim("listed_name")).filter("listed_name <> ''")
    first = F.row_number().over(Window.partitionBy("uid", F.lower("listed_name")).orderBy("pos"))
    one = every.withColumn("rn", first).filter("rn = 1").drop("rn")
    return N.with_forms(one, "listed_name").filter(F.size("toks") > 0).withColumn("entry_id", F.concat_ws("#", "uid", "pos"))


def growing(df: DataFrame) -> DataFrame:
    """A side that grows with the lists, to be joined by merge.

    Sizes are guessed from the tables' files, which are far smaller than the names taken apart; by that guess whole
    lists would be broadcast, by way of the driver.
    """
    return df.hint("merge")


def distinct_forms(names: DataFrame, one: str) -> DataFrame:
    """The distinct forms of names, under their normalized name as the id, and how many names have each as weight.

    All forms follow from the tokens, which the normalized name tells; so names that are alike are compared once.
    """
    alike = names.groupBy("norm", "sorted_norm", "skel", "sorted_skel").agg(F.count("*").alias("weight"))
    return alike.withColumn("toks", F.split("norm", " ")).withColumn(one, F.col("norm"))


def _number(df: DataFrame) -> Column:
    """How many names the rows stand for."""
    return F.sum("weight") if "weight" in df.columns else F.count("*")


def keys(df: DataFrame, id_col: str) -> DataFrame:
    """(id, kind, key): distinct tokens (kind 0) and skeleton tokens (kind 1) of each entry; with its weight if it has one."""
    both = F.array_distinct(
        F.concat(F.transform("toks", lambda t: F.struct(F.lit(0).alias("kind"), t.alias("key"))), F.transform(F.filter(F.split("skel", " "), lambda t: t != ""), lambda t: F.struct(F.lit(1).alias("kind"), t.alias("key"))))
    )
    also = [c for c in ("weight",) if c in df.columns]
    return df.select(id_col, *also, F.explode(both).alias("k")).select(id_col, *also, "k.kind", "k.key")


def frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("kind", "key").agg(_number(postings).alias("df"))


def common_tokens(names: DataFrame) -> DataFrame:
    """Tokens of more than 2 % of the entries, and of more than 2."""
    n = names.agg(_number(names).alias("n"))
    df = frequencies(keys(names, "entry_id").filter("kind = 0"))
    return df.crossJoin(F.broadcast(n)).filter(F.col("df") > F.greatest(F.lit(2), F.floor(F.col("n") * COMMON_SHARE))).select(F.col("key").alias("token"), "df")


def inverse_frequency(df: Column, n: Column) -> Column:
    return F.round(1 + F.log(n + 1) - F.log(df + 1), 4)


def standing(queries: DataFrame, postings: DataFrame, cap: int = BLOCK_CAP) -> DataFrame:
    """(query_id, kind, key, df, rank, kept) of every query's keys: whether they are within the cap.

    Keys are taken rarest first until a query's union reaches ``cap`` entries. The union is at least its largest
    posting and at most the sum of them, so the frequencies tell but for the keys between these bounds; only for
    queries with such keys are postings joined and counted. A posting of ``cap`` entries or more isn't joined either: it
    settles all keys after it, and what comes before a key doesn't depend on its own posting.
    """
    by_query = Window.partitionBy("query_id").orderBy("df", "key", "kind")
    earlier = by_query.rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys(queries, "query_id").drop("weight").join(growing(frequencies(postings)), ["kind", "key"], "left").fillna(0, ["df"]).withColumn("rank", F.row_number().over(by_query))
    ranked = ranked.withColumn("most", F.coalesce(F.sum("df").over(earlier), F.lit(0))).withColumn("least", F.coalesce(F.max("df").over(earlier), F.lit(0)))
    unsure = ranked.filter((F.col("most") >= cap) & (F.col("least") < cap)).select("query_id").distinct()
    live = ranked.filter((F.col("least") < cap) & (F.col("df") > 0)).join(growing(unsure), "query_id", "left_semi")
    weight = F.first("weight") if "weight" in postings.columns else F.lit(1)
    met = live.filter(F.col("df") < cap).join(growing(postings), ["kind", "key"]).groupBy("query_id", "entry_id").agg(F.min("rank").alias("rank"), weight.alias("weight"))
    new = met.groupBy("query_id", "rank").agg(F.sum("weight").alias("n"))
    # ranks without a new entry take part, so that the sum runs on over them
    so_far = live.select("query_id", "rank").join(growing(new), ["query_id", "rank"], "left").withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    told = ranked.join(growing(so_far.select("query_id", "rank", "before")), ["query_id", "rank"], "left")
    kept = (F.col("least") < cap) & ((F.col("most") < cap) | (F.coalesce("before", F.lit(0)) < cap))
    return told.select("query_id", "kind", "key", "df", "rank", kept.alias("kept"))


def left_out(stand: DataFrame) -> DataFrame:
    """(query_id, key, df) of the keys that the cap left out."""
    return stand.filter(~F.col("kept") & (F.col("df") > 0)).select("query_id", "key", "df")


def block(queries: DataFrame, names: DataFrame, cap: int = BLOCK_CAP) -> tuple[DataFrame, DataFrame]:
    """All (query_id, entry_id) pairs that share a key within the cap, and the (query_id, key, df) that it left out."""
    postings = keys(names, "entry_id")
    stand = standing(queries, postings, cap)
    kept = stand.filter("kept and df > 0").join(growing(postings), ["kind", "key"]).select("query_id", "entry_id").distinct()
    return kept, left_out(stand)


def shared_at_least(a: Column, b: Column) -> Column:
    """How many of a and b distinct tokens two names must share to reach a band by their tokens, at the best skeleton."""
    w, fewer = WEIGHTS, F.least(a, b)
    rest = WEAK - w["jaro_winkler"] - w["edit"] - w["skeleton"] - 1e-9
    reached = lambda o: (o == fewer) | (w["jaccard"] * o / (a + b - o) + w["containment"] * o / fewer >= rest)
    return F.element_at(F.filter(F.sequence(F.lit(1), fewer), reached), 1)


def likely_pairs(queries: DataFrame, names: DataFrame, cap: int = BLOCK_CAP) -> tuple[DataFrame, DataFrame]:
    """(query_id, entry_id) of all blocked pairs that can be ``promising``, and what the cap left out.

    Tokens are ordered by their frequency in the list. Two names that share o of a and b tokens share one among the
    first a - o + 1 of one and b - o + 1 of the other; whether they share o is seen where they meet. A skeleton that is
    contained has its rarest token in the other one. Acronyms meet as such. A pair must share a key within the cap as well.
    """
    postings = keys(names, "entry_id")
    stand = cut(standing(queries, postings, cap))  # read six times below
    df = frequencies(postings)

    def placed(frame: DataFrame, one: str) -> DataFrame:
        """Keys with their place by rarity among those of their kind, all of these, and how many there are."""
        own = Window.partitionBy(one, "kind")
        out = frame.withColumn("place", F.row_number().over(own.orderBy("df", "key"))).withColumn("every", F.collect_list("key").over(own))
        return out.select(one, "kind", "key", "place", "every", F.size("every").alias("n"))

    q = placed(stand, "query_id")
    l = cut(placed(postings.join(growing(df), ["kind", "key"]), "entry_id"))
    # the numbers of tokens that occur are few
    sizes = lambda frame, name: F.broadcast(frame.filter("kind = 0").agg(F.collect_set("n").alias(name)))
    a, b = F.col("a"), F.col("b")
    first = lambda n: F.col("place") <= F.col(n) - shared_at_least(a, b) + 1
    q0 = q.filter("kind = 0").crossJoin(sizes(l, "others")).select("query_id", "key", "place", F.col("every").alias("t0"), F.col("n").alias("a"), F.explode("others").alias("b")).filter(first("a"))
    l0 = l.filter("kind = 0").crossJoin(sizes(q, "others")).select("entry_id", "key", "place", F.col("every").alias("e0"), F.col("n").alias("b"), F.explode("others").alias("a")).filter(first("b"))
    q0 = q0.withColumn("least", shared_at_least(a, b))
    by_tokens = q0.join(growing(l0), ["key", "a", "b"]).filter(F.size(F.array_intersect("t0", "e0")) >= F.col("least")).select("query_id", "entry_id")
    many_q = queries.filter(F.size("toks") >= 2).select("query_id")
    many_l = names.filter(F.size("toks") >= 2).select("entry_id")
    q1 = q.filter("kind = 1").join(growing(many_q), "query_id", "left_semi").select("query_id", "key", F.col("place").alias("qp"), F.col("n").alias("qn"))
    l1 = l.filter("kind = 1").join(growing(many_l), "entry_id", "left_semi").select("entry_id", "key", F.col("place").alias("lp"), F.col("n").alias("ln"))
    by_skeleton = q1.filter("qp = 1").join(growing(l1), "key").filter("qn <= ln").select("query_id", "entry_id").unionByName(q1.join(growing(l1.filter("lp = 1")), "key").filter("ln < qn").select("query_id", "entry_id"))
    plain = F.replace("norm", F.lit(" "), F.lit(""))
    initials = F.when(F.size("toks") >= 2, F.array_join(F.transform("toks", lambda t: F.substring(t, 1, 1)), ""))
    qa, la = queries.select("query_id", plain.alias("qp"), initials.alias("qi")), names.select("entry_id", plain.alias("lp"), initials.alias("li"))
    by_acronym = qa.join(growing(la), F.col("qp") == F.col("li")).select("query_id", "entry_id").unionByName(qa.join(growing(la), F.col("qi") == F.col("lp")).select("query_id", "entry_id"))
    pairs = by_tokens.unionByName(by_skeleton).unionByName(by_acronym).distinct()
    if stand.filter("not kept").isEmpty():
        # no key is left out. Tokens and skeletons share a key by their making; acronyms needn't
        apart = by_acronym.join(growing(queries.select("query_id", F.col("toks").alias("t0"), F.split("skel", " ").alias("t1"))), "query_id").join(growing(names.select("entry_id", F.col("toks").alias("e0"), F.split("skel", " ").alias("e1"))), "entry_id")
        met = apart.filter(F.arrays_overlap("t0", "e0") | F.arrays_overlap("t1", "e1")).select("query_id", "entry_id")
        return by_tokens.unionByName(by_skeleton).unionByName(met).distinct(), left_out(stand)
    # the keys within the cap, of queries that have others: a pair must share one of them
    bounded = stand.groupBy("query_id").agg(F.bool_and("kept").alias("all"), *[F.collect_set(F.when(F.col("kept") & (F.col("kind") == k), F.col("key"))).alias(n) for k, n in ((0, "within0"), (1, "within1"))])
    within = queries.select("query_id", F.col("toks").alias("t0"), F.split("skel", " ").alias("t1")).join(growing(bounded.filter("not all").drop("all")), "query_id", "left")
    within = within.select("query_id", F.coalesce("within0", "t0").alias("t0"), F.coalesce("within1", "t1").alias("t1"))
    entries = names.select("entry_id", F.col("toks").alias("e0"), F.split("skel", " ").alias("e1"))
    met = pairs.join(growing(within), "query_id").join(growing(entries), "entry_id").filter(F.arrays_overlap("t0", "e0") | F.arrays_overlap("t1", "e1"))
    return met.select("query_id", "entry_id"), left_out(stand)


def cheap_signals(pairs: DataFrame) -> DataFrame:
    """Set signals of (q_*, l_*) forms, native columns only."""
    q_skel, l_skel = F.split("q_skel", " "), F.split("l_skel", " ")
    multi = (F.size("q_toks") >= 2) & (F.size("l_toks") >= 2)
    equal = (F.col("q_skel") == F.col("l_skel")) | (F.col("q_sorted_skel") == F.col("l_sorted_skel"))
    return (
        pairs.withColumn("jaccard", N.jaccard(F.col("q_toks"), F.col("l_toks")))
        .withColumn("containment", N.containment(F.col("q_toks"), F.col("l_toks")))
        .withColumn("skeleton_equal", equal)
        .withColumn("skeleton_containment", N.containment(q_skel, l_skel))
        .withColumn("multi", multi)
        .withColumn("acronym", N.acronym_of(F.col("q_norm"), F.col("l_toks")) | N.acronym_of(F.col("l_norm"), F.col("q_toks")))
        .withColumn("skeleton", F.when(equal, 1.0).when(multi, F.col("skeleton_containment")).otherwise(0.0))
    )


def ceiling() -> Column:
    """The highest score that a pair can still reach."""
    w = WEIGHTS
    return w["jaro_winkler"] + w["edit"] + w["jaccard"] * F.col("jaccard") + w["containment"] * F.col("containment") + w["skeleton"] * F.greatest("skeleton", "skeleton_containment")


def promising() -> Column:
    bypass = F.col("acronym") | (F.col("containment") == 1) | ((F.col("skeleton_containment") == 1) & F.col("multi"))
    return bypass | (ceiling() >= WEAK)


def with_edit(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("edit", F.greatest(N.edit_ratio(F.col("q_norm"), F.col("l_norm")), N.edit_ratio(F.col("q_sorted_norm"), F.col("l_sorted_norm"))))


def reaching(pairs: DataFrame, least: str) -> DataFrame:
    """Pairs with their edit ratio that can be at or above a band at the best Jaro-Winkler, which is so spared for the others."""
    if least == "NONE":
        return pairs
    w = WEIGHTS
    most = w["jaro_winkler"] + sum((F.col(k) * w[k] for k in w if k != "jaro_winkler"), F.lit(0.0))
    # scores are rounded to four places
    return with_edit(pairs).filter((band(None) != "NONE") | (most >= (WEAK if least == "WEAK" else STRONG) - 1e-4))


def score(pairs: DataFrame) -> DataFrame:
    """Adds jaro_winkler, edit and the score, rounded before it is banded."""
    ready = pairs if "edit" in pairs.columns else with_edit(pairs)
    ready = ready.withColumn("jw1", N.jaro_winkler("q_norm", "l_norm")).withColumn("jw2", N.jaro_winkler("q_sorted_norm", "l_sorted_norm"))
    ready = ready.withColumn("jaro_winkler", F.greatest("jw1", "jw2")).drop("jw1", "jw2")
    return ready.withColumn("score", F.round(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)), 4))


def band(score_column: str | None = "score") -> Column:
    """The band ladder; without a score only the rules that need none."""
    short = F.least(F.length(F.replace("q_norm", F.lit(" "), F.lit(""))), F.length(F.replace("l_norm", F.lit(" "), F.lit("")))) < SHORT
    out = (
        F.when((F.col("q_norm") == F.col("l_norm")) | (F.col("q_sorted_norm") == F.col("l_sorted_norm")), "EXACT")
        .when(short, "NONE")
        .when(F.col("acronym"), "STRONG")
        .when((F.col("containment") == 1) & F.col("skeleton_equal"), "STRONG")
        .when((F.col("skeleton_containment") == 1) & F.col("multi"), "STRONG")
        .when((F.col("containment") == 1) & F.col("discriminating"), "STRONG")
    )
    if score_column:
        out = out.when(F.col(score_column) >= STRONG, "STRONG").when(F.col(score_column) >= WEAK, "WEAK")
    return out.otherwise("NONE")


def band_rank(column: str = "band") -> Column:
    return sum((F.when(F.col(column) == b, r).otherwise(0) for b, r in BAND_RANK.items()), F.lit(0))


def with_both_forms(pairs: DataFrame, queries: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs with both sides' forms (q_*, l_*) and whether they share an uncommon token."""
    parts = ("toks", "norm", "sorted_norm", "skel", "sorted_skel")
    # distinct forms stand for several names and have none of their own
    own = lambda frame, *columns: [c for c in columns if c in frame.columns]
    q = queries.select(*own(queries, "query_id", "subject_id", "query_name"), *[F.col(c).alias("q_" + c) for c in parts])
    l = names.select(*own(names, "entry_id", "uid", "source", "listed_name"), *[F.col(c).alias("l_" + c) for c in parts])
    common = common_tokens(names).agg(F.collect_set("token").alias("common"))  # at most 50 tokens pass 2 %, with ties in n
    joined = pairs.join(growing(q), "query_id").join(growing(l), "entry_id").crossJoin(F.broadcast(common))
    shared = F.array_intersect("q_toks", "l_toks")
    return joined.withColumn("discriminating", F.size(F.array_except(shared, F.col("common"))) > 0).drop("common")


def candidate_pairs(queries: DataFrame, names: DataFrame, cap: int = BLOCK_CAP) -> DataFrame:
    """All blocked pairs with both sides' forms."""
    return with_both_forms(block(queries, names, cap)[0], queries, names)


def subject_queries(subjects: DataFrame) -> DataFrame:
    """(query_id, subject_id, forms): each name and alias of (subject_id, name, aliases) is a query of its own."""
    every = subjects.select("subject_id", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "query_name"))
    every = every.repartition("subject_id")  # a table of few files is few partitions
    return N.with_forms(every.filter("trim(query_name) <> ''"), "query_name").filter(F.size("toks") > 0).withColumn("query_id", F.concat_ws("#", "subject_id", "pos"))


def told(cut_keys: DataFrame, queries: DataFrame) -> DataFrame:
    """(subject_id, left_out): the keys that the cap left out, as they are told."""
    text = F.concat(F.col("key"), F.lit(" (df="), F.col("df"), F.lit(")"))
    return cut_keys.join(growing(queries.select("query_id", "subject_id")), "query_id").groupBy("subject_id").agg(F.array_join(F.array_sort(F.collect_set(text)), "; ").alias("left_out"))


def screen(subjects: DataFrame, parties: DataFrame, least: str = "WEAK", cap: int = BLOCK_CAP) -> DataFrame:
    """The best candidate of each subject and party at or above a band, with its signals.

    ``left_out`` tells at each candidate what the cap left out of its subject's search; subjects without a candidate
    are told by ``bounded_searches``.
    """
    # each is read several times below: the forms are worked out once and kept as a snapshot
    names, queries = cut(index(parties)), cut(subject_queries(subjects))
    listed, asked = cut(distinct_forms(names, "entry_id")), cut(distinct_forms(queries, "query_id"))
    likely, cut_keys = likely_pairs(asked, listed, cap)
    pairs = cheap_signals(with_both_forms(likely, asked, listed)).filter(promising())
    scored = score(reaching(pairs, least)).withColumn("band", band()).withColumn("band_rank", band_rank()).filter(F.col("band_rank") >= BAND_RANK[least])
    alike = scored.select(F.col("query_id").alias("asked"), F.col("entry_id").alias("listed"), "band", "band_rank", "score", *WEIGHTS, "skeleton_equal", "acronym", "discriminating")
    of_subjects = queries.select(F.col("norm").alias("asked"), "query_id", "subject_id", "query_name")
    every = alike.join(growing(of_subjects), "asked").join(growing(names.select(F.col("norm").alias("listed"), "entry_id", "uid", "source", "listed_name")), "listed")
    best = Window.partitionBy("subject_id", "uid").orderBy(F.desc("band_rank"), F.desc("score"), "query_id", "entry_id")
    kept = every.withColumn("rn", F.row_number().over(best)).filter("rn = 1")
    bounded = not cut_keys.isEmpty()
    of_forms = of_subjects.select(F.col("asked").alias("query_id"), "subject_id")
    kept = kept.join(growing(told(cut_keys, of_forms)), "subject_id", "left") if bounded else kept.withColumn("left_out", F.lit(None).cast("string"))
    return kept.select("subject_id", "uid", "source", "listed_name", F.col("query_name").alias("matched_name"), "band", "band_rank", "score", *WEIGHTS, "skeleton_equal", "acronym", "discriminating", "left_out")


def in_order(candidates: DataFrame, most: int | None = None) -> DataFrame:
    """Candidates by subject, best band and score first, then by uid; at most so many of each subject."""
    order = Window.partitionBy("subject_id").orderBy(F.desc("band_rank"), F.desc("score"), "uid")
    ranked = candidates.withColumn("place", F.row_number().over(order))
    return (ranked if most is None else ranked.filter(F.col("place") <= most)).orderBy("subject_id", "place")


def explain(name: str, parties: DataFrame, most: int = 10) -> DataFrame:
    """The best candidates of one name with all their signals, in order; bands below WEAK are listed too."""
    spark = parties.sparkSession
    subject = spark.createDataFrame([("?", name, [])], "subject_id string, name string, aliases array<string>")
    names, queries = cut(index(parties)), cut(subject_queries(subject))
    scored = score(cheap_signals(candidate_pairs(queries, names))).withColumn("band", band()).withColumn("band_rank", band_rank())
    best = Window.partitionBy("uid").orderBy(F.desc("band_rank"), F.desc("score"), "entry_id")
    one = scored.withColumn("rn", F.row_number().over(best)).filter("rn = 1")
    return in_order(one, most).select("place", "uid", "source", "listed_name", "band", "score", *WEIGHTS, "skeleton_equal", "acronym", "discriminating")


def country_evidence(subject_country: Column, listed_countries: Column) -> Column:
    """insufficient where either side has no country; agrees if one is part of the other, as text; else differs. Bands don't follow it."""
    own = N.fold(F.coalesce(subject_country, F.lit("")))
    others = F.filter(F.transform(F.coalesce(listed_countries, F.array().cast("array<string>")), lambda c: N.fold(c)), lambda c: c != "")
    agrees = F.exists(others, lambda c: F.contains(own, c) | F.contains(c, own))
    return F.when((own == "") | (F.size(others) == 0), "insufficient").when(agrees, "agrees").otherwise("differs")


def capped_profile(parties: DataFrame, aliases: int = 25, addresses: int = 10, ids: int = 10, remarks: int = 1500) -> DataFrame:
    """What a reviewer is shown of a listed party: its lists and remarks cut to a length, and how much was cut."""
    cuts = {"aliases": aliases, "addresses": addresses, "ids": ids}
    lists = [F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n).alias(c) for c, n in cuts.items()]
    hidden = sum((F.greatest(F.size(F.coalesce(c, F.array().cast("array<string>"))) - n, F.lit(0)) for c, n in cuts.items()), F.lit(0))
    return parties.select("uid", "source", "name", *lists, F.substring("remarks", 1, remarks).alias("remarks"), hidden.alias("hidden"))


#: What a critic may see of a subject; raw fields never.
VISIBLE = ("ref", "name", "party_type", "country", "address", "role", "aliases", "destination_country", "eccn", "item_description", "end_use")


def critic_view(subjects: DataFrame) -> DataFrame:
    return subjects.select(*[c for c in VISIBLE if c in subjects.columns])


def bounded_searches(subjects: DataFrame, parties: DataFrame, cap: int = BLOCK_CAP) -> DataFrame:
    """(subject_id, left_out): subjects for which the cap left keys out, which are told."""
    queries, listed = cut(subject_queries(subjects)), cut(distinct_forms(index(parties), "entry_id"))
    by_form = left_out(standing(distinct_forms(queries, "query_id"), keys(listed, "entry_id"), cap))
    return told(by_form, queries.select(F.col("norm").alias("query_id"), "subject_id"))


def tuning_digest() -> str:
    """A hash over all that scoring depends on, word lists included."""
    what = {"weights": WEIGHTS, "limits": [STRONG, WEAK, COMMON_SHARE, BLOCK_CAP, SHORT], "forms": N.LEGAL_FORMS, "stop": N.STOP_WORDS, "same": N.SAME_WORD, "digraphs": N.DIGRAPHS}
    return hashlib.sha256(canonical(what).encode()).hexdigest()
