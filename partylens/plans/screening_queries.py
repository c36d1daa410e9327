"""Name functions, blocking, scoring, rules and dispositions over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partylens.functions import names as N
from partylens.operators import rules as R
from partylens.operators import runs as U
from partylens.operators import screening as S
from partylens.plans import screen_sql as Q
from partylens.plans.registry import query, t

_FOLD, _TOKS, _CORE, _list, _skeleton = Q.FOLD, Q.TOKENS, Q.CORE, Q.words, Q.skeleton


def _stages(source: str, x: str) -> str:
    """CTEs f, t, c: a source's folded names, tokens and core tokens."""
    return f"""f AS (SELECT *, {_FOLD.format(x=x)} AS folded FROM {source}), t AS (SELECT *, {_TOKS.format(f="folded")} AS words FROM f),
c AS (SELECT *, {_CORE.format(t="words")} AS toks FROM t)"""


#: Part names with legal forms, accents and punctuation put around them by key: a list with variety.
_PARTS = """p AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' Co., Ltd.' WHEN 1 THEN ' Société & Trading' WHEN 2 THEN '' ELSE ' Technologies GmbH' END AS name FROM part)"""


def parts(spark, d) -> DataFrame:
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, " Co., Ltd.").when(k == 1, " Société & Trading").when(k == 2, "").otherwise(" Technologies GmbH")
    return t(spark, d, "part").select("p_partkey", F.concat("p_name", tail).alias("name"))


@query(f"SELECT doc_id, {_FOLD.format(x='text')} AS folded FROM documents")
def name_fold_docs(spark, d):
    return t(spark, d, "documents").select("doc_id", N.fold(F.col("text")).alias("folded"))


@query(f"WITH {_PARTS}, {_stages('p', 'name')} SELECT p_partkey, array_to_string(words, ' ') AS tokens, array_to_string(toks, ' ') AS core, array_to_string(list_sort(toks), ' ') AS sorted_core FROM c")
def name_core_tokens(spark, d):
    f = N.with_forms(parts(spark, d), "name")
    return f.select("p_partkey", F.array_join(N.tokens(N.fold(F.col("name"))), " ").alias("tokens"), F.col("norm").alias("core"), F.col("sorted_norm").alias("sorted_core"))


@query(f"WITH {_PARTS}, {_stages('p', 'name')}, s AS (SELECT *, {_skeleton('toks')} AS skeleton FROM c) SELECT p_partkey, skeleton, array_to_string(list_sort(string_split(skeleton, ' ')), ' ') AS sorted_skeleton FROM s")
def name_skeleton(spark, d):
    return N.with_forms(parts(spark, d), "name").select("p_partkey", F.col("skel").alias("skeleton"), F.col("sorted_skel").alias("sorted_skeleton"))


@query(f"""WITH {_PARTS}, {_stages('p', 'name')}, s AS (SELECT *, array_to_string(toks, ' ') AS norm, {_skeleton('toks')} AS skel FROM c)
SELECT p_partkey, array_to_string(list_sort(list_distinct([norm, array_to_string(list_reverse(toks), ' '), array_to_string(list_sort(toks), ' '), skel])), '|') AS variants FROM s""")
def name_variants(spark, d):
    f = N.with_forms(parts(spark, d), "name")
    return f.select("p_partkey", F.array_join(F.array_sort(N.variants(F.col("toks"), F.col("norm"), F.col("skel"))), "|").alias("variants"))


_DF = f"WITH {_PARTS}, {_stages('p', 'name')}, e AS (SELECT p_partkey, unnest(list_distinct(toks)) AS token FROM c), df AS (SELECT token, count(*) AS df FROM e GROUP BY token), n AS (SELECT count(*) AS n FROM c)"


def _party_list(spark, d) -> DataFrame:
    return parts(spark, d).select(F.concat(F.lit("PART:"), "p_partkey").alias("uid"), F.lit("PART").alias("source"), "name", F.array().cast("array<string>").alias("aliases"))


@query(f"{_DF} SELECT token, df FROM df")
def token_df(spark, d):
    return S.frequencies(S.keys(S.index(_party_list(spark, d)), "entry_id").filter("kind = 0")).select(F.col("key").alias("token"), "df")


@query(f"{_DF} SELECT token, df FROM df, n WHERE df > greatest(2, floor(n * 0.02))")
def common_tokens(spark, d):
    return S.common_tokens(S.index(_party_list(spark, d)))


@query(f"{_DF} SELECT token, round(ln((n + 1) / (df + 1)) + 1, 4) AS idf FROM df, n")
def token_idf(spark, d):
    names = S.index(_party_list(spark, d))
    n = names.agg(F.count("*").alias("n"))
    df = S.frequencies(S.keys(names, "entry_id").filter("kind = 0"))
    return df.crossJoin(F.broadcast(n)).select(F.col("key").alias("token"), S.inverse_frequency(F.col("df"), F.col("n")).alias("idf"))


#: The list: parts by a name of their own (a common word, one that fifty parts share, one of each part); the subjects: the same parts in other order, spelling
#: and legal form. All parts take part, so there are as many names as parts.
_OWN_NAME = "split_part(p_name, ' ', 1) || ' ' || substr(md5('a' || p_partkey // 50), 1, 7) || ' ' || substr(md5('b' || p_partkey), 1, 7)"
_PARTIES_SQL = f"SELECT 'P:' || p_partkey AS uid, CASE p_partkey % 3 WHEN 0 THEN 'SDN' WHEN 1 THEN 'EL' ELSE 'DPL' END AS source, {_OWN_NAME} || ' Limited' AS name, ['the ' || {_OWN_NAME}] AS aliases FROM part"
_SUBJECTS_SQL = f"""SELECT 'S:' || p_partkey AS subject_id, CASE p_partkey % 4 WHEN 0 THEN upper({_OWN_NAME}) || ', Inc.' WHEN 1 THEN array_to_string(list_reverse(string_split({_OWN_NAME}, ' ')), ' ')
WHEN 2 THEN regexp_replace({_OWN_NAME}, '([bcdfglmnprst])([aeiou])', '\\1\\1\\2', 'g') ELSE split_part(p_name, ' ', 1) || ' ' || substr(md5('b' || p_partkey), 1, 7) || ' GmbH' END AS name, CAST([] AS VARCHAR[]) AS aliases FROM part"""


def _own_name():
    return F.concat_ws(" ", F.split("p_name", " ")[0], F.substring(F.md5(F.concat(F.lit("a"), F.floor(F.col("p_partkey") / 50))), 1, 7), F.substring(F.md5(F.concat(F.lit("b"), "p_partkey")), 1, 7))


def _spread_parts(spark, d) -> DataFrame:
    """Parts over all cores before their names are made: the table is small, so its file is one partition."""
    return t(spark, d, "part").select("p_partkey", "p_name").repartition("p_partkey")


def _distinct_list(spark, d) -> DataFrame:
    k = F.col("p_partkey") % 3
    return _spread_parts(spark, d).select(F.concat(F.lit("P:"), "p_partkey").alias("uid"), F.when(k == 0, "SDN").when(k == 1, "EL").otherwise("DPL").alias("source"), F.concat(_own_name(), F.lit(" Limited")).alias("name"), F.array(F.concat(F.lit("the "), _own_name())).alias("aliases"))


def _subjects(spark, d) -> DataFrame:
    k, own = F.col("p_partkey") % 4, _own_name()
    name = F.when(k == 0, F.concat(F.upper(own), F.lit(", Inc."))).when(k == 1, F.array_join(F.reverse(F.split(own, " ")), " ")).when(k == 2, F.regexp_replace(own, "([bcdfglmnprst])([aeiou])", "$1$1$2")).otherwise(F.concat(F.split("p_name", " ")[0], F.lit(" "), F.split(own, " ")[2], F.lit(" GmbH")))
    return _spread_parts(spark, d).select(F.concat(F.lit("S:"), "p_partkey").alias("subject_id"), name.alias("name"), F.array().cast("array<string>").alias("aliases"))


_SCREEN_SQL = f"WITH {Q.screening(_SUBJECTS_SQL, _PARTIES_SQL)}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in S.WEIGHTS else c for c in df.columns])


_COLUMNS = ", ".join(f"round({c}, 6) AS {c}" if c in S.WEIGHTS else c for c in Q.COLUMNS.split(", "))


@query(f"{_SCREEN_SQL} SELECT {_COLUMNS} FROM found WHERE band_rank >= 1")
def screen_parts(spark, d):
    """Part names' variants against part names, full ladder."""
    return _rounded(S.screen(_subjects(spark, d), _distinct_list(spark, d)))


_CUSTOMERS_SQL = "SELECT CAST(c_custkey AS VARCHAR) AS subject_id, replace(c_name, 'Customer', 'Supplier') AS name, CAST([] AS VARCHAR[]) AS aliases FROM customer"
_SUPPLIERS_SQL = "SELECT 'SUP:' || s_suppkey AS uid, 'SUP' AS source, s_name AS name, CAST([] AS VARCHAR[]) AS aliases FROM supplier"


@query(f"WITH {Q.screening(_CUSTOMERS_SQL, _SUPPLIERS_SQL)} SELECT {_COLUMNS} FROM found WHERE band_rank >= 2")
def customer_supplier_screen(spark, d):
    """Every customer against every supplier, blocked."""
    suppliers = t(spark, d, "supplier").select(F.concat(F.lit("SUP:"), "s_suppkey").alias("uid"), F.lit("SUP").alias("source"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    customers = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("subject_id"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name"), F.array().cast("array<string>").alias("aliases"))
    return _rounded(S.screen(customers, suppliers, least="STRONG"))


@query(f"""{_SCREEN_SQL} SELECT s.subject_id, ['NONE', 'WEAK', 'STRONG', 'EXACT'][coalesce(max(band_rank), 0) + 1] AS top_band, count(uid) AS candidates
FROM subs s LEFT JOIN (SELECT * FROM found WHERE band_rank >= 1) f ON f.subject_id = s.subject_id GROUP BY s.subject_id""")
def top_band(spark, d):
    """Each subject's best band, NONE if it has no candidate."""
    subjects = _subjects(spark, d)
    best = S.screen(subjects, _distinct_list(spark, d)).groupBy("subject_id").agg(F.max("band_rank").alias("rank"), F.count("*").alias("candidates"))
    names = {v: k for k, v in S.BAND_RANK.items()}
    return subjects.select("subject_id").join(S.growing(best), "subject_id", "left").select("subject_id", U.lookup(names, F.coalesce("rank", F.lit(0))).alias("top_band"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


@query(f"""{_SCREEN_SQL}, hits AS (SELECT subject_id, source, band_rank FROM found WHERE band_rank >= 1), fl AS (SELECT subject_id, unnest(CASE source WHEN 'SDN' THEN [3, 1] WHEN 'EL' THEN [2, 1] ELSE [3, 1] END) AS severity FROM hits),
w AS (SELECT subject_id, max(severity) AS worst, count(*) AS flags FROM fl GROUP BY subject_id), top AS (SELECT subject_id, max(band_rank) AS rank FROM hits GROUP BY subject_id),
o AS (SELECT s.subject_id, coalesce(rank, 0) AS rank, CAST(coalesce(worst, 0) AS INTEGER) AS worst, coalesce(flags, 0) AS flags FROM subs s LEFT JOIN top USING (subject_id) LEFT JOIN w USING (subject_id))
SELECT subject_id, ['NONE', 'WEAK', 'STRONG', 'EXACT'][rank + 1] AS top_band, worst, flags, CASE WHEN rank = 3 THEN 'CONFIRMED_HIT' WHEN rank >= 1 OR worst >= 1 THEN 'REVIEW' ELSE 'CLEAR' END AS disposition, rank >= 1 OR worst >= 1 AS requires_human FROM o""")
def screen_disposition(spark, d):
    """The main path: screen, list flags, worst severity, provisional disposition."""
    subjects, parties = _subjects(spark, d), _distinct_list(spark, d)
    found = S.screen(subjects, parties)
    flagged = R.list_flags(found.withColumn("party_type", F.lit("entity")).withColumn("begin", F.lit(None).cast("date")).withColumn("end", F.lit(None).cast("date")), "2026-01-15")
    top = found.groupBy("subject_id").agg(F.max("band_rank").alias("rank"))
    names = {v: k for k, v in S.BAND_RANK.items()}
    out = subjects.select("subject_id").join(S.growing(top), "subject_id", "left").join(S.growing(R.worst(flagged, "subject_id")), "subject_id", "left")
    out = out.select("subject_id", U.lookup(names, F.coalesce("rank", F.lit(0))).alias("top_band"), F.coalesce("worst", F.lit(0)).alias("worst"), F.coalesce("flags", F.lit(0)).alias("flags"))
    return out.withColumn("disposition", U.provisional(F.col("top_band"), F.col("worst"))).withColumn("requires_human", F.col("disposition") != "CLEAR")


_PAIR_FORMS = f"""WITH d AS (SELECT p_name AS name, min(p_partkey) AS k FROM part GROUP BY p_name), {_stages('d', 'name')},
s AS (SELECT k, toks, array_to_string(toks, ' ') AS norm, {_skeleton('toks')} AS skel FROM c), pairs AS (SELECT a.k AS a, b.k AS b, a.toks AS ta, b.toks AS tb, a.norm AS na, b.norm AS nb, a.skel AS sa, b.skel AS sb
FROM s a JOIN s b ON a.k < b.k AND len(list_intersect(a.toks, b.toks)) > 0)"""


def _pairs(spark, d) -> DataFrame:
    one = N.with_forms(t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k")), "name")
    keyed = one.select("k", F.explode(F.array_distinct("toks")).alias("token"))
    other = keyed.select(F.col("k").alias("b"), "token")
    met = keyed.withColumnRenamed("k", "a").join(other, "token").filter("a < b").select("a", "b").distinct()
    left = one.select(F.col("k").alias("a"), F.col("toks").alias("ta"), F.col("norm").alias("na"), F.col("skel").alias("sa"))
    right = one.select(F.col("k").alias("b"), F.col("toks").alias("tb"), F.col("norm").alias("nb"), F.col("skel").alias("sb"))
    return met.join(left, "a").join(right, "b")


@query(f"{_PAIR_FORMS} SELECT a, b FROM pairs")
def block_pairs(spark, d):
    one = t(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    f = N.with_forms(one, "name").withColumn("skel", F.lit(""))
    pairs, _ = S.block(f.withColumn("query_id", F.col("k")), f.withColumn("entry_id", F.col("k")))
    return pairs.filter("query_id < entry_id").select(F.col("query_id").alias("a"), F.col("entry_id").alias("b"))


@query(f"{_PAIR_FORMS} SELECT a, b, round(len(list_intersect(list_distinct(ta), list_distinct(tb))) / len(list_distinct(list_concat(ta, tb))), 6) AS jaccard, round(len(list_intersect(list_distinct(ta), list_distinct(tb))) / least(len(list_distinct(ta)), len(list_distinct(tb))), 6) AS containment FROM pairs")
def pair_token_sets(spark, d):
    p = _pairs(spark, d)
    return p.select("a", "b", F.round(N.jaccard(F.col("ta"), F.col("tb")), 6).alias("jaccard"), F.round(N.containment(F.col("ta"), F.col("tb")), 6).alias("containment"))


@query(f"{_PAIR_FORMS} SELECT a, b, CAST(levenshtein(na, nb) AS BIGINT) AS distance, round(greatest(0, 1 - levenshtein(na, nb) / greatest(length(na), length(nb))), 6) AS ratio FROM pairs")
def pair_levenshtein(spark, d):
    return _pairs(spark, d).select("a", "b", F.levenshtein("na", "nb").cast("long").alias("distance"), F.round(N.edit_ratio(F.col("na"), F.col("nb")), 6).alias("ratio"))


@query(f"{_PAIR_FORMS}, {Q.jaro_winkler('SELECT na AS a, nb AS b FROM pairs')} SELECT p.a, p.b, round(value, 6) AS jaro_winkler FROM pairs p JOIN jw ON jw.a = na AND jw.b = nb")
def pair_jaro_winkler(spark, d):
    return _pairs(spark, d).select("a", "b", F.round(N.jaro_winkler("na", "nb"), 6).alias("jaro_winkler"))


@query(f"{_PAIR_FORMS} SELECT a, b, sa = sb AS skeleton_equal, left(ta[1], 1) || left(tb[1], 1) = 'rr' AS both_r FROM pairs")
def pair_skeletons(spark, d):
    return _pairs(spark, d).select("a", "b", (F.col("sa") == F.col("sb")).alias("skeleton_equal"), (F.concat(F.substring(F.element_at("ta", 1), 1, 1), F.substring(F.element_at("tb", 1), 1, 1)) == "rr").alias("both_r"))


@query(f"""WITH {_PARTS}, {_stages('p', 'name')} SELECT p_partkey, array_to_string(list_transform(toks, lambda w: left(w, 1)), '') AS initials,
left(name, 2) = array_to_string(list_transform(toks, lambda w: left(w, 1)), '') AND len(toks) >= 2 AS acronym FROM c""")
def name_initials(spark, d):
    f = N.with_forms(parts(spark, d), "name")
    return f.select("p_partkey", F.array_join(F.transform("toks", lambda w: F.substring(w, 1, 1)), "").alias("initials"), N.acronym_of(F.substring("name", 1, 2), F.col("toks")).alias("acronym"))


@query(f"WITH {Q.screening(_SUBJECTS_SQL, _PARTIES_SQL, 30)} SELECT subject_id, left_out FROM told")
def block_truncated(spark, d):
    """Keys left out at a cap of 30 entries, as they are told."""
    return S.bounded_searches(_subjects(spark, d), _distinct_list(spark, d), cap=30)


# rules

_COUNTRY_SQL = """WITH x AS (SELECT c_custkey, CASE n_nationkey % 6 WHEN 0 THEN 'Iran' WHEN 1 THEN 'CU' WHEN 2 THEN 'Türkiye' WHEN 3 THEN 'zz' WHEN 4 THEN '' ELSE 'DE' END AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT c_custkey, raw, CASE lower(strip_accents(raw)) WHEN 'iran' THEN 'IR' WHEN 'cu' THEN 'CU' WHEN 'turkiye' THEN 'TR' WHEN 'de' THEN 'DE' ELSE '' END AS iso FROM x)"""


def _destinations(spark, d) -> DataFrame:
    c = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = U.lookup({0: "Iran", 1: "CU", 2: "Türkiye", 3: "zz", 4: "", 5: "DE"}, F.col("n_nationkey") % 6)
    return c.select("c_custkey", raw.alias("raw")).withColumn("iso", R.resolve_country(F.col("raw"), {"iran": "IR", "turkiye": "TR"}, ["IR", "CU", "TR", "DE"]))


@query(f"{_COUNTRY_SQL} SELECT c_custkey, raw, iso FROM r")
def resolve_country(spark, d):
    return _destinations(spark, d)


@query(f"""{_COUNTRY_SQL} SELECT c_custkey, unnest(CASE WHEN raw = '' THEN ['DEST.MISSING'] WHEN iso = '' THEN ['DEST.UNRESOLVED'] WHEN iso IN ('IR', 'CU') THEN ['DEST.COMPREHENSIVE', 'DEST.ITAR126'] WHEN iso = 'TR' THEN ['DEST.TRANSSHIP'] ELSE ['DEST.NO_POLICY_ENTRY'] END) AS rule_id FROM r""")
def dest_flags(spark, d):
    iso, raw = F.col("iso"), F.col("raw")
    barred = iso.isin("IR", "CU")
    rules = [
        ("DEST.MISSING", "diligence", raw == ""), ("DEST.UNRESOLVED", "diligence", (raw != "") & (iso == "")), ("DEST.COMPREHENSIVE", "prohibitive", barred),
        ("DEST.ITAR126", "prohibitive", barred), ("DEST.TRANSSHIP", "diligence", iso == "TR"), ("DEST.NO_POLICY_ENTRY", "diligence", iso == "DE"),
    ]
    return R.flags(_destinations(spark, d), "c_custkey", rules).select("c_custkey", "rule_id")


def _any(terms: str) -> str:
    return "len(list_filter(" + _list(sorted(terms.split("|"))) + ", lambda p: contains(x, p))) > 0"


_TEXT_SQL = "WITH f AS (SELECT doc_id, " + _FOLD.format(x="text") + " AS x FROM documents), r AS (SELECT doc_id, list_filter([CASE WHEN x = '' THEN 'USE.MISSING' END, " + ", ".join(f"CASE WHEN {_any(v)} THEN 'USE.{k}' END" for k, v in R.END_USE.items()) + ", " + ", ".join(f"CASE WHEN {_any(v)} THEN 'KYC.{k}' END" for k, v in R.KNOW_CUSTOMER.items()) + "], lambda v: v IS NOT NULL) AS rules FROM f)"


@query(f"{_TEXT_SQL} SELECT doc_id, unnest(rules) AS rule_id FROM r")
def keyword_flags(spark, d):
    folded = t(spark, d, "documents").select("doc_id", N.fold(F.col("text")).alias("x"))
    return R.flags(folded, "doc_id", R.text_rules(F.col("x"))).select("doc_id", "rule_id")


_CLASS_SQL = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'ear99' WHEN 2 THEN '3A001.b.' || p_size WHEN 3 THEN p_brand ELSE '5d002' END"


@query(rf"""WITH x AS (SELECT p_partkey, upper({_CLASS_SQL}) AS c FROM part) SELECT p_partkey, CASE WHEN c = '' THEN 'CLASS.MISSING' WHEN c = 'EAR99' THEN 'CLASS.EAR99' ELSE 'CLASS.MALFORMED' END AS rule_id,
CASE WHEN c = 'EAR99' THEN 'informational' ELSE 'diligence' END AS severity FROM x WHERE c = '' OR c = 'EAR99' OR NOT regexp_full_match(c, '(?i)\d[A-E]\d{{3}}(\.[a-z0-9]+)*')""")
def class_format(spark, d):
    k = F.col("p_partkey") % 5
    code = F.when(k == 0, "").when(k == 1, "ear99").when(k == 2, F.concat(F.lit("3A001.b."), "p_size")).when(k == 3, F.col("p_brand")).otherwise("5d002")
    return R.flags(t(spark, d, "part").withColumn("code", code), "p_partkey", R.class_rules(F.col("code"))).select("p_partkey", "rule_id", "severity")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderdate + INTERVAL 2 YEAR < TIMESTAMP '1999-06-01' THEN 'expired' WHEN o_orderdate > TIMESTAMP '1999-06-01' THEN 'pending' ELSE 'active' END AS state FROM orders""")
def order_in_force(spark, d):
    o = t(spark, d, "orders").withColumn("begin", F.col("o_orderdate").cast("date"))
    end = F.when(F.col("o_orderkey") % 7 != 0, F.add_months("begin", 24))
    return o.select("o_orderkey", R.in_force(F.col("begin"), end, F.lit("1999-06-01").cast("date")).alias("state"))


_DATE_SQL = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%b-%y') ELSE strftime(o_orderdate, '%Y/%m/%d') END"


@query(f"SELECT o_orderkey, {_DATE_SQL} AS written, strftime(o_orderdate, '%Y-%m-%d') AS parsed FROM orders")
def date_formats(spark, d):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    written = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "M/d/yyyy")).when(k == 2, F.date_format(day, "dd-MMM-yy")).otherwise(F.date_format(day, "yyyy/MM/dd"))
    return t(spark, d, "orders").select("o_orderkey", written.alias("written")).withColumn("parsed", R.parse_date(F.col("written")).cast("string"))


_FLAG_SQL = """cand AS (SELECT c_custkey AS subject_id, CASE c_custkey % 9 WHEN 0 THEN 'SDN' WHEN 1 THEN 'NONSDN' WHEN 2 THEN 'EL' WHEN 3 THEN 'UVL' WHEN 4 THEN 'MEU' WHEN 5 THEN 'DTC' WHEN 6 THEN 'ISN' WHEN 7 THEN 'DPL' ELSE 'UNKNOWN' END AS source, c_custkey % 2 AS odd FROM customer),
fl AS (SELECT subject_id, unnest(CASE source WHEN 'SDN' THEN CASE WHEN odd = 0 THEN ['LIST.SDN:3', 'LIST.SDN50:1'] ELSE ['LIST.SDN:3'] END WHEN 'NONSDN' THEN ['LIST.NONSDN:2'] WHEN 'EL' THEN ['LIST.ENTITY:2', 'LIST.BIS_AFFILIATE:1'] WHEN 'UVL' THEN ['LIST.UVL:1']
WHEN 'MEU' THEN ['LIST.MEU:2', 'LIST.BIS_AFFILIATE:1'] WHEN 'DTC' THEN ['LIST.DDTC:3'] WHEN 'ISN' THEN ['LIST.ISN:2'] WHEN 'DPL' THEN [CASE WHEN odd = 0 THEN 'LIST.DPL:3' ELSE 'LIST.DPL:0' END, 'LIST.BIS_AFFILIATE:1'] ELSE ['LIST.UNKNOWN_SOURCE:1'] END) AS f FROM cand)"""


def _list_flags(spark, d) -> DataFrame:
    codes = ["SDN", "NONSDN", "EL", "UVL", "MEU", "DTC", "ISN", "DPL", "UNKNOWN"]
    odd = F.col("c_custkey") % 2 == 1
    c = t(spark, d, "customer").select(
        F.col("c_custkey").alias("subject_id"), U.lookup(dict(enumerate(codes)), F.col("c_custkey") % 9).alias("source"), F.when(odd, "individual").otherwise("entity").alias("party_type"),
        F.lit(None).cast("date").alias("begin"), F.when(odd, F.lit("2020-01-01").cast("date")).alias("end"),
    )
    return R.list_flags(c, "2026-01-15")


@query(f"WITH {_FLAG_SQL} SELECT subject_id, split_part(f, ':', 1) AS rule_id, CASE split_part(f, ':', 2) WHEN '3' THEN 'prohibitive' WHEN '2' THEN 'license' WHEN '1' THEN 'diligence' ELSE 'informational' END AS severity FROM fl")
def list_flags(spark, d):
    return _list_flags(spark, d).select("subject_id", "rule_id", "severity")


@query(f"WITH {_FLAG_SQL} SELECT subject_id, CAST(max(split_part(f, ':', 2)) AS INTEGER) AS worst, count(*) AS flags FROM fl GROUP BY subject_id")
def flag_rollup(spark, d):
    return R.worst(_list_flags(spark, d), "subject_id")


_PROV_SQL = f"""WITH {_FLAG_SQL}, w AS (SELECT subject_id, CAST(max(split_part(f, ':', 2)) AS INTEGER) AS worst FROM fl GROUP BY subject_id),
b AS (SELECT subject_id, worst, CASE subject_id % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'WEAK' ELSE 'NONE' END AS band FROM w),
p AS (SELECT subject_id, worst, band, CASE WHEN band = 'EXACT' THEN 'CONFIRMED_HIT' WHEN band = 'WEAK' OR worst >= 1 THEN 'REVIEW' ELSE 'CLEAR' END AS disposition FROM b)"""


def _provisional(spark, d) -> DataFrame:
    band = U.lookup({0: "EXACT", 1: "WEAK", 2: "NONE", 3: "NONE"}, F.col("subject_id") % 4)
    return R.worst(_list_flags(spark, d), "subject_id").withColumn("band", band).withColumn("disposition", U.provisional(F.col("band"), F.col("worst")))


@query(f"{_PROV_SQL} SELECT subject_id, band, worst, disposition FROM p")
def provisional_disposition(spark, d):
    return _provisional(spark, d).select("subject_id", "band", "worst", "disposition")


@query(f"{_PROV_SQL} SELECT disposition, count(*) AS n, count(*) FILTER (disposition <> 'CLEAR') AS requires_human FROM p GROUP BY disposition")
def disposition_histogram(spark, d):
    return _provisional(spark, d).groupBy("disposition").agg(F.count("*").alias("n"), F.count_if(F.col("disposition") != "CLEAR").alias("requires_human"))


@query(f"""{_PROV_SQL}, r AS (SELECT *, CASE disposition WHEN 'CLEAR' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END AS k, subject_id % 5 = 0 AS same, CASE WHEN subject_id % 11 = 0 THEN 1 ELSE 0 END AS strange FROM p),
z AS (SELECT *, greatest(k, CASE WHEN strange > 0 THEN 4 WHEN same AND worst >= 3 THEN 3 WHEN same THEN 2 ELSE 0 END, CASE WHEN k = 0 THEN 1 ELSE 0 END) AS m FROM r)
SELECT subject_id, ['CLEAR', 'REVIEW', 'CONFIRMED_HIT', 'BLOCKED', 'ESCALATE'][m + 1] AS resolved FROM z""")
def resolve_disposition(spark, d):
    p = _provisional(spark, d)
    strange = F.when(F.col("subject_id") % 11 == 0, 1).otherwise(0)
    return p.select("subject_id", U.resolve(F.col("disposition"), F.col("subject_id") % 5 == 0, strange, F.col("worst"), F.lit(1)).alias("resolved"))


_REVIEW_SQL = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'CONDITIONAL' ELSE 'FAIL' END AS verdict, (event_id % 10) / 10 AS risk, event_id % 13 = 0 AS critical, event_id % 17 = 0 AS failed, event_id % 5 AS retries FROM events"


@query(f"""WITH r AS ({_REVIEW_SQL}) SELECT event_id, CASE WHEN failed AND retries >= 3 THEN 'ESCALATE' WHEN failed THEN 'RETRY' WHEN verdict = 'PASS' AND risk < 0.3 AND NOT critical THEN 'COMMIT'
WHEN verdict = 'CONDITIONAL' AND risk < 0.5 AND NOT critical THEN 'COMMIT' WHEN retries >= 3 THEN 'ESCALATE' ELSE 'RETRY' END AS route FROM r""")
def critic_route(spark, d):
    e = F.col("event_id")
    verdict = U.lookup({0: "PASS", 1: "CONDITIONAL", 2: "FAIL"}, e % 3)
    return t(spark, d, "events").select("event_id", U.critic_route(verdict, (e % 10) / 10, e % 13 == 0, e % 17 == 0, e % 5).alias("route"))


@query("""WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS k FROM events),
f AS (SELECT user_id || '/' || n // 4 AS case_id, n % 4 AS attempt, k FROM r), m AS (SELECT *, max(k) OVER (PARTITION BY case_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f)
SELECT case_id, ['CLEAR', 'REVIEW', 'CONFIRMED_HIT', 'BLOCKED', 'ESCALATE'][max(k) + 1] AS disposition, bool_or(coalesce(k < before, false)) AS reversed, CASE WHEN bool_or(coalesce(k < before, false)) THEN 'ESCALATE' ELSE 'COMMIT' END AS route FROM m GROUP BY case_id""")
def retry_high_water(spark, d):
    """A case has at most four attempts, so a user's events make consecutive cases of four."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kind = U.lookup({"view": "CLEAR", "click": "REVIEW", "signup": "CONFIRMED_HIT", "purchase": "BLOCKED", "error": "ESCALATE"}, "event_type")
    e = t(spark, d, "events").withColumn("n", n)
    case = F.concat(F.col("user_id"), F.lit("/"), F.floor(F.col("n") / 4))
    return U.high_water(e.select(case.alias("case_id"), (F.col("n") % 4).alias("attempt"), kind.alias("disposition")))


_RUN_SQL = "SELECT CAST(o_custkey AS VARCHAR) AS ref, o_orderpriority AS name, o_orderkey AS row, CASE o_orderstatus WHEN 'F' THEN 'CLEAR' WHEN 'O' THEN 'REVIEW' ELSE 'CONFIRMED_HIT' END AS disposition, o_orderdate FROM orders"
_LATEST_SQL = "SELECT ref, name, arg_max(disposition, row) AS disposition FROM runs WHERE {w} GROUP BY ref, name"


def _run(spark, d) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "CLEAR").when(F.col("o_orderstatus") == "O", "REVIEW").otherwise("CONFIRMED_HIT")
    return t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("ref"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("row"), kind.alias("disposition"), F.year("o_orderdate").alias("year"))


_DIFF_SQL = f"""WITH runs AS ({_RUN_SQL}), b AS ({_LATEST_SQL.format(w="year(o_orderdate) <= 1997")}), a AS ({_LATEST_SQL.format(w="year(o_orderdate) > 1997")}),
j AS (SELECT coalesce(b.ref, a.ref) AS ref, coalesce(b.name, a.name) AS name, b.disposition AS before, a.disposition AS after FROM b FULL JOIN a ON a.ref = b.ref AND a.name = b.name),
k AS (SELECT *, CASE before WHEN 'CLEAR' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END AS x, CASE after WHEN 'CLEAR' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END AS y FROM j),
diff AS (SELECT ref, name, before, after, CASE WHEN before IS NULL AND after = 'CLEAR' THEN 'ADDED' WHEN before IS NULL THEN 'NEW_HIT' WHEN after IS NULL THEN 'REMOVED' WHEN before = after THEN 'UNCHANGED' WHEN before = 'CLEAR' THEN 'NEW_HIT' WHEN after = 'CLEAR' THEN 'RESOLVED' WHEN y > x THEN 'NEW_HIT' ELSE 'CHANGED' END AS change FROM k)"""


def _diff(spark, d) -> DataFrame:
    run = _run(spark, d)
    sides = [U.latest(run.filter(c)).select("ref", "name", "disposition") for c in ("year <= 1997", "year > 1997")]
    return U.diff(*sides)


@query(f"{_DIFF_SQL} SELECT * FROM diff")
def run_diff(spark, d):
    return _diff(spark, d)


@query(f"{_DIFF_SQL} SELECT change, count(*) AS n FROM diff GROUP BY change")
def run_diff_counts(spark, d):
    return _diff(spark, d).groupBy("change").agg(F.count("*").alias("n"))


@query(f"""WITH runs AS ({_RUN_SQL}), r AS (SELECT ref, name, CAST(year(o_orderdate) AS VARCHAR) AS label, disposition, row_number() OVER (PARTITION BY ref, name ORDER BY CAST(year(o_orderdate) AS VARCHAR) DESC, row DESC) AS rn FROM runs)
SELECT ref, name, label, disposition, CASE disposition WHEN 'CONFIRMED_HIT' THEN 2 ELSE 3 END AS display_order FROM r WHERE rn = 1 AND disposition <> 'CLEAR'""")
def open_cases(spark, d):
    return U.open_cases(_run(spark, d).withColumn("label", F.col("year").cast("string")))
