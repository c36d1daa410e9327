import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partylens.functions import names as N


def rows(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_fold(spark):
    got = rows(spark, ["Société  Générale, S.A.", "Łódź ØRE", "Straße_1", "ﬁn", "ＡＢ", "", None, "ét"], N.fold)
    assert got == ["societe generale s a", "lodz ore", "strasse_1", "fin", "ab", "", None, "et"]


def test_fold_agrees_with_the_full_decomposition(spark):
    names = ["Crème Brûlée & Söhne", "Ægir Þór", "Dvořák-Novák", "İstanbul", "Ñandú"]
    assert rows(spark, names, N.fold) == rows(spark, names, N.fold_any)


def test_tokens(spark):
    core = lambda c: N.core_tokens(N.tokens(N.fold(c)))
    assert rows(spark, ["The Acme Trading Company, Ltd.", "Holding Group", "", "Smith and Sons"], core) == [["acme", "trade"], ["holding", "group"], [], ["smith", "sons"]]


def test_skeleton(spark):
    skel = lambda c: N.skeleton(N.core_tokens(N.tokens(N.fold(c))))
    a, b, c, d = rows(spark, ["Mohammed", "Muhamad", "Ivanov", "Ivanoff"], skel)
    assert a == b == "mhmd" and c == d


@pytest.mark.parametrize("a,b,value", [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("", "", 1.0), ("", "x", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler_values(a, b, value):
    assert round(N.jaro_winkler_value(a, b), 4) == value


@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_winkler_bounds(a, b):
    assert 0 <= N.jaro_winkler_value(a, b) <= 1
    assert N.jaro_winkler_value(a, a) == 1


def test_the_udf_runs_once(spark):
    df = spark.createDataFrame([("abc", "abd")], "a string, b string").withColumn("s", N.jaro_winkler("a", "b")).filter("s > 0.5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert df.count() == 1


def test_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], ["a"])], "x array<string>, y array<string>")
    got = df.select(N.jaccard(F.col("x"), F.col("y")), N.containment(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [(0.25, 0.5), (0.0, 0.0)]


def test_word_lists_are_folded():
    for w in (*N.LEGAL_FORMS, *N.STOP_WORDS, *N.SAME_WORD):
        assert w == unicodedata.normalize("NFKD", w).lower()
