"""Rules evaluated as a whole over customers as subjects, with a policy of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partylens.operators import policy as Y
from partylens.operators import rules as R
from partylens.operators.runs import lookup
from partylens.plans.registry import query, t
from partylens.plans.screen_sql import FOLD, words

POLICY = {
    "$note": "made up for queries", "as_of": "2026-01-01", "verified_by": "", "verified_on": "",
    "countries": [{"iso2": "IR", "name": "Iran", "tiers": ["comprehensive", "itar_proscribed"]}, {"iso2": "CU", "name": "Cuba", "tiers": ["comprehensive"]}, {"iso2": "RU", "name": "Russia", "tiers": ["extensive", "targeted"]}, {"iso2": "VE", "name": "Venezuela", "tiers": ["targeted"]}],
    "regions": [{"name": "Crimea", "match_terms": ["crimea", "sevastopol"]}, {"name": "Donetsk", "match_terms": ["donetsk"]}],
    "transshipment_watch": {"countries": ["TR", "AE"]}, "aliases": {"Iran": "IR", "Türkiye": "TR", "Germany": "DE"}, "known_iso2": ["DE", "FR", "UA"],
}
_RAW = ["Iran", "CU", "Türkiye", "zz", "", "DE", "ru", "VE", "AE", "UA"]
_ADDRESS = ["1 Main St", "Sevastopol, Crimea", "Donetsk obl."]
_ROLE = ["end user", "Freight Forwarder", "", "Trading agent"]
_ITEM = ["valves", "a nuclear centrifuge", "", "wafer fab tools, cash in advance"]
_CLASS = ["", "ear99", "3A001.b.1", "3A0011"]
_pick = lambda values, k, n: f"{words(values)}[CAST({k} % {n} AS INTEGER) + 1]"
_SUBJECTS_SQL = f"""x AS (SELECT c_custkey AS id, {_pick(_RAW, 'c_custkey', 10)} AS raw, {_pick(_ADDRESS, '(c_custkey // 10)', 3)} AS address, {_pick(_ROLE, '(c_custkey // 3)', 4)} AS role, {_pick(_ITEM, '(c_custkey // 7)', 4)} AS item, {_pick(_CLASS, '(c_custkey // 5)', 4)} AS eccn FROM customer),
s AS (SELECT *, CASE lower(strip_accents(raw)) WHEN 'iran' THEN 'IR' WHEN 'turkiye' THEN 'TR' WHEN 'cu' THEN 'CU' WHEN 'de' THEN 'DE' WHEN 'ru' THEN 'RU' WHEN 've' THEN 'VE' WHEN 'ae' THEN 'AE' WHEN 'ua' THEN 'UA' ELSE '' END AS iso, lower(address) AS place, {FOLD.format(x="item || ' ' || role")} AS used, lower(role) AS r FROM x)"""


def _subjects(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda values, at: lookup(dict(enumerate(values)), (at % len(values)).cast("int"))
    by = lambda n: F.floor(k / n)
    return t(spark, d, "customer").select(
        k.alias("subject_id"), pick(_RAW, k).alias("destination_country"), F.lit("").alias("country"), pick(_ADDRESS, by(10)).alias("address"), pick(_ROLE, by(3)).alias("role"), pick(_ITEM, by(7)).alias("item_description"), F.lit(None).cast("string").alias("end_use"), pick(_CLASS, by(5)).alias("eccn"),
    )


_DEST = """SELECT id, 'DEST.REGION' AS rule_id, 'prohibitive' AS severity, unnest(list_filter([CASE WHEN contains(place, 'crimea') OR contains(place, 'sevastopol') THEN 'Crimea' END, CASE WHEN contains(place, 'donetsk') THEN 'Donetsk' END], lambda v: v IS NOT NULL)) AS detail FROM s
UNION ALL SELECT id, split_part(f, ':', 1), split_part(f, ':', 2), CASE WHEN iso <> '' THEN iso ELSE raw END FROM (SELECT *, unnest(CASE WHEN raw = '' THEN ['DEST.MISSING:diligence'] WHEN iso = '' THEN ['DEST.UNRESOLVED:diligence'] WHEN iso = 'IR' THEN ['DEST.COMPREHENSIVE:prohibitive', 'DEST.ITAR126:prohibitive']
WHEN iso = 'CU' THEN ['DEST.COMPREHENSIVE:prohibitive'] WHEN iso = 'RU' THEN ['DEST.EXTENSIVE:license'] WHEN iso = 'VE' THEN ['DEST.TARGETED:diligence'] WHEN iso IN ('TR', 'AE') THEN ['DEST.TRANSSHIP:diligence'] ELSE ['DEST.NO_POLICY_ENTRY:diligence'] END) AS f FROM s)"""
_any = lambda terms, x: f"len(list_filter({words(sorted(terms.split('|')))}, lambda p: contains({x}, p))) > 0"
_USE = f"""SELECT id, unnest(CASE WHEN used = '' THEN ['USE.MISSING'] ELSE list_filter([{", ".join(f"CASE WHEN {_any(v, 'used')} THEN '{p}.{k}' END" for p, m in (("USE", R.END_USE), ("KYC", R.KNOW_CUSTOMER)) for k, v in m.items())}, CASE WHEN {_any(R.INTERMEDIARY, 'r')} THEN 'KYC.INTERMEDIARY' END], lambda v: v IS NOT NULL) END) AS rule_id, 'diligence' AS severity, '' AS detail FROM s"""
_CLASSES = """SELECT id, CASE eccn WHEN '' THEN 'CLASS.MISSING' WHEN 'ear99' THEN 'CLASS.EAR99' ELSE 'CLASS.MALFORMED' END AS rule_id, CASE eccn WHEN 'ear99' THEN 'informational' ELSE 'diligence' END AS severity, eccn AS detail FROM s WHERE eccn <> '3A001.b.1'"""
_HITS = """SELECT id, unnest(CASE WHEN id % 3 = 0 THEN ['LIST.SDN', 'LIST.SDN50'] WHEN id % 3 = 1 THEN ['LIST.ENTITY', 'LIST.BIS_AFFILIATE'] ELSE ['LIST.DPL', 'LIST.BIS_AFFILIATE'] END) AS rule_id, unnest(CASE WHEN id % 3 = 0 THEN ['prohibitive', 'diligence'] WHEN id % 3 = 1 THEN ['license', 'diligence'] ELSE [CASE WHEN id % 2 = 0 THEN 'prohibitive' ELSE 'informational' END, 'diligence'] END) AS severity, 'L:' || id AS detail FROM s WHERE id % 5 = 0"""


@query(f"WITH {_SUBJECTS_SQL} SELECT id AS subject_id, rule_id, severity, detail, true AS unverified FROM ({_DEST})")
def destination_rules(spark, d):
    """All destination rules by a policy that nobody has verified."""
    return Y.destination_flags(_subjects(spark, d), Y.from_dict(spark, POLICY)).drop("ord")


@query(f"WITH {_SUBJECTS_SQL} SELECT id AS subject_id, rule_id, severity, detail, false AS unverified FROM ({_DEST}) WHERE rule_id <> 'DEST.NO_POLICY_ENTRY'")
def destination_rules_verified(spark, d):
    """The same policy once attested: what has no entry is no longer flagged."""
    return Y.destination_flags(_subjects(spark, d), Y.from_dict(spark, POLICY).attest("A. Person", "2026-01-02")).drop("ord")


@query(f"WITH {_SUBJECTS_SQL} SELECT id AS subject_id, rule_id, severity, detail FROM ({_USE})")
def use_rules(spark, d):
    return Y.use_flags(_subjects(spark, d)).select("subject_id", "rule_id", "severity", "detail")


@query(f"""WITH {_SUBJECTS_SQL}, a AS (SELECT * FROM ({_HITS}) UNION ALL SELECT * FROM ({_DEST}) UNION ALL SELECT * FROM ({_USE}) UNION ALL SELECT * FROM ({_CLASSES}) UNION ALL SELECT id, 'MATCH.SEARCH_BOUNDED', 'diligence', 'trade (df=9)' FROM s WHERE id % 11 = 0),
m AS (SELECT *, CASE severity WHEN 'prohibitive' THEN 3 WHEN 'license' THEN 2 WHEN 'diligence' THEN 1 ELSE 0 END AS k FROM a) SELECT id AS subject_id, count(*) AS flags, CAST(max(k) AS INTEGER) AS worst, array_to_string(list_sort(list(rule_id || ' ' || detail)), ';') AS rules FROM m GROUP BY id""")
def evaluate_rules(spark, d):
    """All families together: every subject's flags, their number and the worst."""
    subjects = _subjects(spark, d)
    k = F.col("subject_id")
    candidates = subjects.filter(k % 5 == 0).select(
        "subject_id", F.concat(F.lit("L:"), k).alias("uid"), F.when(k % 3 == 0, "SDN").when(k % 3 == 1, "EL").otherwise("DPL").alias("source"), F.lit("entity").alias("party_type"),
        F.lit(None).cast("date").alias("begin"), F.when(k % 2 == 1, F.lit("2020-01-01").cast("date")).alias("end"),
    )
    bounded = subjects.filter(k % 11 == 0).select("subject_id", F.lit("trade (df=9)").alias("left_out"))
    table = Y.evaluate(subjects, candidates, Y.from_dict(spark, POLICY), "2026-01-15", bounded)
    told = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "rule_id", "detail"))), ";")
    return table.groupBy("subject_id").agg(F.count("*").alias("flags"), F.max(lookup(Y.SEVERITY, "severity")).alias("worst"), told.alias("rules"))
