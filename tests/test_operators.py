import json

import pytest
from pyspark.sql import functions as F

from partylens.operators import audit as A
from partylens.operators import constraints as C
from partylens.operators import graph as G
from partylens.operators import process as P
from partylens.operators import rules as R
from partylens.operators import runs as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,day", [("2024-2-1", "2024-02-01"), ("2/1/2024", "2024-02-01"), ("28-Feb-99", "1999-02-28"), ("28-Feb-24", "2024-02-28"), ("2024/02/01", "2024-02-01"), ("soon", None), ("", None)])
def test_dates(spark, text, day):
    got = one(spark, R.parse_date(F.lit(text)))
    assert (got and str(got)) == day


def test_fields(spark):
    assert one(spark, R.clean(F.lit(" -0- "))) == "" and one(spark, R.clean(F.lit(None).cast("string"))) == ""
    assert one(spark, R.split_multi(F.lit("a; b|;c "))) == ["a", "b", "c"]
    assert [one(spark, R.party_type(F.lit(x))) for x in ("Individual", "vessel", "Company Ltd", "?")] == ["individual", "vessel", "entity", "unknown"]


def test_flags_keep_their_order(spark):
    df = spark.createDataFrame([(1, "x"), (2, "")], "id int, t string")
    got = R.flags(df, "id", R.text_rules(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(2, 0, "USE.MISSING", "diligence")]


def test_list_flags(spark):
    df = spark.createDataFrame([(1, "DPL", "entity", None, "2020-01-01"), (2, "DPL", "entity", None, None), (3, "SDN", "individual", None, None)], "subject_id int, source string, party_type string, begin string, end string")
    df = df.withColumn("begin", F.col("begin").cast("date")).withColumn("end", F.col("end").cast("date"))
    got = {(r["subject_id"], r["rule_id"], r["severity"]) for r in R.list_flags(df, "2026-01-15").collect()}
    assert got == {(1, "LIST.DPL", "informational"), (1, "LIST.BIS_AFFILIATE", "diligence"), (2, "LIST.DPL", "prohibitive"), (2, "LIST.BIS_AFFILIATE", "diligence"), (3, "LIST.SDN", "prohibitive")}


def test_unknown_country_is_never_cleared(spark):
    assert one(spark, R.resolve_country(F.lit("qq"), {"iran": "IR"}, ["IR"])) == ""
    assert one(spark, R.resolve_country(F.lit("Iran"), {"iran": "IR"}, ["IR"])) == "IR"


@pytest.mark.parametrize("floor,same,strange,worst,n,want", [("CONFIRMED_HIT", False, 0, 0, 1, "CONFIRMED_HIT"), ("REVIEW", True, 0, 3, 1, "BLOCKED"), ("CLEAR", False, 1, 0, 0, "ESCALATE"), ("CLEAR", False, 0, 0, 1, "REVIEW")])
def test_resolve(spark, floor, same, strange, worst, n, want):
    assert one(spark, U.resolve(F.lit(floor), F.lit(same), F.lit(strange), F.lit(worst), F.lit(n))) == want


def test_guardrails(spark):
    g = lambda b, v, c: one(spark, U.guardrail(F.lit(b), F.lit(v), F.lit(c)))
    assert g("EXACT", "DIFFERENT", 0.9) and g("EXACT", "UNCERTAIN", 0.9) and g("WEAK", "SAME_PARTY", 0.4) and g("WEAK", "DIFFERENT", 0.9) is None


def test_diff(spark):
    schema = "ref string, name string, disposition string"
    a = spark.createDataFrame([("1", "a", "CLEAR"), ("2", "b", "REVIEW"), ("3", "c", "REVIEW"), ("4", "d", "BLOCKED")], schema)
    b = spark.createDataFrame([("1", "a", "REVIEW"), ("2", "b", "CLEAR"), ("4", "d", "REVIEW"), ("5", "e", "CLEAR"), ("6", "f", "REVIEW")], schema)
    assert {r["ref"]: r["change"] for r in U.diff(a, b).collect()} == {"1": "NEW_HIT", "2": "RESOLVED", "3": "REMOVED", "4": "CHANGED", "5": "ADDED", "6": "NEW_HIT"}
    assert U.exit_code(a) == 3 and U.exit_code(a.filter("ref = '1'")) == 0 and U.exit_code(a.filter("ref = '2'")) == 2


def test_process(spark):
    log = spark.createDataFrame([("c", "a", "2024-01-01 00:00:00", 1), ("c", "b", "2024-01-01 00:00:10", 2), ("c", "a", "2024-01-01 00:00:10", 3), ("d", "a", "2024-01-01 00:00:00", 4)], "case_id string, activity string, t string, event_id int")
    log = log.withColumn("ts", F.col("t").cast("timestamp"))
    assert {tuple(r) for r in P.dfg_edges(log).collect()} == {("a", "b", 1), ("b", "a", 1)}
    assert {tuple(r) for r in P.rework_edges(log).collect()} == {("b", "a", 1)}
    assert {tuple(r) for r in P.variants(log).collect()} == {("a>b>a", 1), ("a", 1)}
    assert P.dfg_edges(log.limit(0)).count() == 0


def test_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 7)], "src long, dst long")
    assert {r["id"]: r["component"] for r in G.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6}
    assert {r["id"]: r["scc"] for r in G.strong_components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert {r["id"]: r["level"] for r in G.levels(nodes, edges).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 0, 7: 1}
    assert {r["id"] for r in G.cut_points(nodes, edges).collect()} == {3, 4}
    assert G.greedy_cover({1, 2, 3}, {"a": {1}, "b": {1, 2}, "c": {3}}) == ["b", "c"]


def test_constraints(spark):
    df = spark.createDataFrame([("a", "g", "train"), ("a", "g", "holdout"), ("b", "h", "train")], "id string, g string, role string")
    assert [r["entity_id"] for r in C.duplicates(df, "V", ["id"], "id").collect()] == ["a"]
    assert [r["message"] for r in C.leaks(df, "V", "g", "role").collect()] == ["holdout,train"]
    assert C.requires(df, "V", "id", F.col("role") == "train", F.lit(None).cast("boolean"), "m").count() == 2


def test_an_appended_log_verifies_and_tampering_is_found(spark, tmp_path):
    path = str(tmp_path / "log")
    entry = lambda k, **more: {"ts": f"2026-01-0{k}T00:00:00Z", "actor": "é \"q\"", "event": "case.screened", "payload": {"ref": k, "z": [1, None], "a": {"hash": "x"}}, **more}
    A.append(path, [entry(k) for k in (1, 2, 3)])
    rows = A.append(path, [entry(4), {"event": "run.end", "payload": {}}])
    assert [r["seq"] for r in rows] == [4, 5]
    problems = lambda: {(r["seq"], r["problem"]) for r in A.verify_log(spark, path).collect()}
    assert problems() == set() and A.head(path) == (5, rows[-1]["hash"])
    lines = open(path, encoding="utf-8").read().splitlines()

    def write(new):
        open(path, "w", encoding="utf-8").write("".join(x + "\n" for x in new))

    write([json.dumps(json.loads(x), indent=None, ensure_ascii=True) for x in lines])  # another layout of the same entries
    assert problems() == set()
    write([lines[0], lines[1].replace('"ref":2', '"ref":9'), *lines[2:]])
    assert problems() == {(2, "changed body")}
    write([lines[0], *lines[2:]])
    assert problems() == {(3, "gap"), (3, "broken link")}
    write(lines[:4])
    assert problems() == {(5, "the end differs from HEAD")}
    write([*lines[:2], "{broken", "[1]", "", *lines[2:]])
    assert problems() == {(None, "corrupt line 3"), (None, "corrupt line 4")}
    assert [r["corrupt"] for r in A.read_log(spark, path).filter("corrupt is not null").collect()] == ["{broken", "[1]"]
    forged = json.loads(lines[4])
    body = {k: v for k, v in {**forged, "payload": {"x": 1}}.items() if k != "hash"}
    write([*lines[:4], A.canonical({**body, "hash": A.digest(body)})])  # a replaced end whose own hash is right
    assert problems() == {(5, "the end differs from HEAD")}
    write([])
    assert problems() == {(None, "empty log"), (5, "the end differs from HEAD")}
    open(path + ".HEAD", "w").write("no json")
    assert A.head(path) is None and problems() == {(None, "empty log")}


def test_a_second_writer_is_refused(tmp_path):
    import fcntl

    path = str(tmp_path / "log")
    with open(path, "a+") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        with pytest.raises(TimeoutError):
            A.append(path, [{"event": "run.start"}], timeout=0.2)


def test_chains_of_any_length(spark):
    """One chain of 30,000 entries beside short ones, folded by hand."""
    rows = [(0 if i % 3 else i, f"t{i:06d}", "u", "case.screened", '{"b": 1, "a": "é"}') for i in range(45_000)]
    got = A.chained(spark.createDataFrame(rows, "chain long, ts string, actor string, event string, payload string"), ["ts"])
    got.cache()
    assert A.verify(A.rehashed(got)).count() == 0 and got.count() == len(rows)
    prev = A.GENESIS
    for n, (_, *parts, payload) in enumerate((r for r in rows if r[0] == 0), 1):
        prev = A.digest({"seq": n, **dict(zip(("ts", "actor", "event"), parts)), "payload": json.loads(payload), "prev_hash": prev})
    assert got.filter("chain = 0").agg(F.max_by("hash", "seq")).first()[0] == prev
    late = got.withColumn("actor", F.when((F.col("chain") == 0) & (F.col("seq") == 29_000), "x").otherwise(F.col("actor")))
    assert [tuple(r) for r in A.verify(A.rehashed(late)).collect()] == [(0, 29_000, "changed body")]


def test_loops_go_on_to_the_end_of_long_paths(spark):
    chain = [(i, i + 1) for i in range(1, 140)]
    edges, nodes = spark.createDataFrame(chain + [(140, 135)], "src long, dst long"), spark.range(1, 141).select("id")
    assert {r["hops"] for r in G.reachable(edges).filter("src = 1").collect()} == set(range(1, 140))
    assert G.levels(nodes, edges).agg(F.max("level")).first()[0] == 134 and G.components(nodes, edges).filter("component <> 1").count() == 0
    up = spark.createDataFrame([(1, None), *[(i + 1, i) for i in range(1, 140)], (500, 501), (501, 500), (600, 999)], "id long, parent long")
    got = {r["id"]: r["root"] for r in G.roots(up).collect()}
    assert got == {**{i: 1 for i in range(1, 141)}, 600: 999}
