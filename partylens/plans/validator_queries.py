"""Artifact checks and outside verdicts, on records derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partylens.operators import adjudication as J
from partylens.operators import artifacts as A
from partylens.operators.runs import lookup
from partylens.plans.registry import query, t

# citations and the graph: orders are citations, customers features, nations processes

_CITED = """cit AS (SELECT 'f' || o_custkey AS feature, 'e' || (o_orderkey - o_orderkey % 2 * (CASE WHEN o_orderkey % 40 = 1 THEN 1 ELSE 0 END)) AS evidence_id, CASE WHEN o_orderkey % 3 = 0 THEN ['e' || (o_orderkey // 3), 'e' || (o_orderkey * 2)] ELSE [] END AS derived_from, CASE WHEN o_orderkey % 2 = 0 THEN ['usage'] ELSE ['dependency', 'usage'] END AS supports FROM orders)"""


def _citations(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.array().cast("array<string>")
    return t(spark, d, "orders").select(
        F.concat(F.lit("f"), "o_custkey").alias("feature"), F.concat(F.lit("e"), F.when(k % 40 == 1, k - k % 2).otherwise(k)).alias("evidence_id"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("e"), F.floor(k / 3)), F.concat(F.lit("e"), k * 2))).otherwise(none).alias("derived_from"), F.when(k % 2 == 0, F.array(F.lit("usage"))).otherwise(F.array(F.lit("dependency"), F.lit("usage"))).alias("supports"),
    )


@query(f"""WITH {_CITED}, p AS (SELECT evidence_id, unnest(derived_from) AS parent FROM cit) SELECT 'V-08' AS check_id, evidence_id AS entity_id, 'duplicate evidence: ' || count(*) AS message FROM cit GROUP BY evidence_id HAVING count(*) > 1
UNION ALL SELECT 'V-09', evidence_id || '>' || parent, 'unknown parent' FROM p WHERE parent NOT IN (SELECT evidence_id FROM cit)""")
def citation_constraints(spark, d):
    return A.citation_rules(_citations(spark, d))


_NODES = """nodes AS (SELECT 'f' || c_custkey AS id, CASE WHEN c_custkey % 23 = 0 THEN 'entity' ELSE 'feature' END AS type, CASE WHEN c_custkey % 2 = 0 THEN 'KEEP' END AS verdict FROM customer WHERE c_custkey % 17 > 0 UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN 'entity' ELSE 'business-process' END, NULL FROM nation UNION ALL SELECT 'n3', 'business-process', NULL),
edges AS (SELECT 'f' || c_custkey AS from_id, 'n' || c_nationkey AS to_id, 'supports' AS type, ['e' || c_custkey, 'e' || (c_custkey + 1)] AS evidence_ids FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT 'f' || c_custkey, 'n' || c_nationkey, 'supports', ['e2'] FROM customer WHERE c_custkey % 100 = 1)"""


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    k, null = F.col("c_custkey"), F.lit(None).cast("string")
    feature = c.filter(k % 17 > 0).select(F.concat(F.lit("f"), k).alias("id"), F.when(k % 23 == 0, "entity").otherwise("feature").alias("type"), F.when(k % 2 == 0, "KEEP").alias("verdict"))
    process = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 7 == 0, "entity").otherwise("business-process").alias("type"), null.alias("verdict"))
    nodes = feature.unionByName(process).unionByName(spark.createDataFrame([("n3", "business-process", None)], "id string, type string, verdict string"))
    ends = (F.concat(F.lit("f"), k).alias("from_id"), F.concat(F.lit("n"), "c_nationkey").alias("to_id"), F.lit("supports").alias("type"))
    edges = c.filter(k % 5 > 0).select(*ends, F.array(F.concat(F.lit("e"), k), F.concat(F.lit("e"), k + 1)).alias("evidence_ids"))
    return nodes, edges.unionByName(c.filter(k % 100 == 1).select(*ends, F.array(F.lit("e2")).alias("evidence_ids")))


@query(f"""WITH {_CITED}, {_NODES}, one AS (SELECT evidence_id, any_value(supports) AS supports FROM cit GROUP BY evidence_id), x AS (SELECT from_id, to_id, type, unnest(evidence_ids) AS e FROM edges), j AS (SELECT x.*, one.evidence_id IS NOT NULL AS known, coalesce(list_contains(supports, 'dependency'), false) AS dep FROM x LEFT JOIN one ON one.evidence_id = e),
w AS (SELECT from_id || '>' || to_id || '>' || type AS name, bool_and(known) AS k, bool_or(dep) AS s FROM j GROUP BY 1)
SELECT 'V-13' AS check_id, id AS entity_id, 'duplicate node: ' || count(*) AS message FROM nodes GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'V-14', from_id || '/' || to_id || '/' || type, 'duplicate edge: ' || count(*) FROM edges GROUP BY from_id, to_id, type HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'V-16', from_id || '>' || to_id || '>' || type, 'unknown evidence ' || e FROM j WHERE NOT known UNION ALL SELECT 'V-17', name, 'no evidence of dependency' FROM w WHERE k AND NOT s""")
def graph_constraints(spark, d):
    # a repeated evidence id has one meaning here: both copies support the same
    c = _citations(spark, d).groupBy("evidence_id").agg(F.any_value("supports").alias("supports"))
    return A.graph_rules(*_graph(spark, d), c)


@query(f"""WITH {_NODES}, f AS (SELECT 'f' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'DROP' WHEN c_custkey % 2 = 0 THEN 'KEEP' END AS verdict, ['n' || c_nationkey, 'n' || (c_nationkey + 20)] AS bp FROM customer), m AS (SELECT f.*, n.id AS nid, n.type AS nt, n.verdict AS nv FROM f LEFT JOIN nodes n ON n.id = f.id), p AS (SELECT id, unnest(bp) AS p FROM m WHERE nid IS NOT NULL)
SELECT 'V-23' AS check_id, id AS entity_id, 'no node' AS message FROM m WHERE nid IS NULL UNION ALL SELECT 'V-24', id, 'node of the wrong type' FROM m WHERE nt <> 'feature' UNION ALL SELECT 'V-25', id, 'verdicts differ' FROM m WHERE nid IS NOT NULL AND verdict IS NOT NULL AND nv IS DISTINCT FROM verdict
UNION ALL SELECT 'V-26', id || '>' || p, 'no process node' FROM p WHERE p NOT IN (SELECT id FROM nodes WHERE type = 'business-process') UNION ALL SELECT 'V-27', id || '>' || p, 'no supports edge' FROM p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.from_id = p.id AND e.to_id = p.p AND e.type = 'supports')""")
def feature_constraints(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    features = t(spark, d, "customer").select(F.concat(F.lit("f"), k).alias("id"), F.when(k % 3 == 0, "DROP").when(k % 2 == 0, "KEEP").alias("verdict"), F.array(F.concat(F.lit("n"), n), F.concat(F.lit("n"), n + 20)).alias("business_processes"))
    return A.feature_node_rules(features, *_graph(spark, d))


_STATE = """p AS (SELECT 'p' || (o_orderkey - CASE WHEN o_orderkey % 60 = 1 THEN 1 ELSE 0 END) AS pair_id, CASE WHEN o_orderkey % 90 = 2 THEN 'other' ELSE 'td' END AS teardown_id FROM orders),
a AS (SELECT 'a' || (s_suppkey // 2) AS id, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'td' END AS teardown_id, CASE WHEN s_suppkey % 3 = 0 THEN 'replay-corpus' ELSE 'media' END AS category, s_suppkey % 2 = 0 AS lists_pairs, s_suppkey AS record_count FROM supplier)"""


@query(f"""WITH {_STATE} SELECT 'V-28' AS check_id, pair_id AS entity_id, 'duplicate pair: ' || count(*) AS message FROM p GROUP BY pair_id HAVING count(*) > 1 UNION ALL SELECT 'V-29', pair_id, 'of another teardown' FROM p WHERE teardown_id <> 'td' UNION ALL SELECT 'V-34', id, 'of another teardown' FROM a WHERE teardown_id IS NULL
UNION ALL SELECT 'V-35', id, 'duplicate artifact: ' || count(*) FROM a GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'V-40', id, record_count || ' of ' || (SELECT count(*) FROM p) || ' pairs' FROM a WHERE category = 'replay-corpus' AND lists_pairs AND record_count <> (SELECT count(*) FROM p)""")
def state_constraints(spark, d):
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    pairs = t(spark, d, "orders").select(F.concat(F.lit("p"), F.when(k % 60 == 1, k - 1).otherwise(k)).alias("pair_id"), F.when(k % 90 == 2, "other").otherwise("td").alias("teardown_id"))
    kept = t(spark, d, "supplier").select(F.concat(F.lit("a"), F.floor(s / 2)).alias("id"), F.when(s % 11 != 0, "td").alias("teardown_id"), F.when(s % 3 == 0, "replay-corpus").otherwise("media").alias("category"), F.when(s % 2 == 0, F.array(F.lit("pairs.jsonl"))).otherwise(F.array(F.lit("x"))).alias("files"), s.alias("record_count"))
    return A.state_rules(spark.createDataFrame([("td", "pairs.jsonl")], "teardown_id string, pairs_file string"), pairs, kept)


@query("""WITH told AS (SELECT 's' || s_suppkey AS name, CASE s_suppkey % 5 WHEN 0 THEN '/etc/x' WHEN 1 THEN 'a/../../b' WHEN 2 THEN 'd/./' || s_suppkey WHEN 3 THEN 'd/x/../' || s_suppkey ELSE 'd/' || s_suppkey END AS path FROM supplier)
SELECT 'V-32' AS check_id, name AS entity_id, 'path leaves the folder' AS message FROM told WHERE path LIKE '/%' OR path = 'a/../../b' UNION ALL SELECT 'V-33', name, 'file is missing' FROM told WHERE path NOT LIKE '/%' AND path <> 'a/../../b' AND path NOT IN (SELECT 'd/' || c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def path_constraints(spark, d):
    s = F.col("s_suppkey")
    path = F.when(s % 5 == 0, "/etc/x").when(s % 5 == 1, "a/../../b").when(s % 5 == 2, F.concat(F.lit("d/./"), s)).when(s % 5 == 3, F.concat(F.lit("d/x/../"), s)).otherwise(F.concat(F.lit("d/"), s))
    told = t(spark, d, "supplier").select(F.concat(F.lit("s"), s).alias("name"), path.alias("path"))
    found = t(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("d/"), "c_custkey").alias("path"))
    return A.named_paths(told, found)


@query("""WITH s AS (SELECT 't' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'complete' ELSE 'open' END AS status, c_custkey % 6 AS phase, c_custkey % 8 AS n FROM customer) SELECT 'C-13' AS check_id, id AS entity_id, 'complete without phase 5 or its artifacts' AS message FROM s WHERE status = 'complete' AND NOT (phase = 5 AND n >= 5)
UNION ALL SELECT 'V-31', 'c' || c_nationkey, 'duplicate preflight: ' || count(*) FROM customer GROUP BY c_nationkey HAVING count(*) > 1 UNION ALL SELECT 'V-01', n_name, 'required file is missing' FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'V-03', 't' || c_custkey, 'segment is missing' FROM customer WHERE c_custkey % 13 = 0 UNION ALL SELECT 'V-03', 't' || c_custkey, 'segment is ' || c_mktsegment FROM customer WHERE c_custkey % 13 > 0 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT 'V-03', 't' || c_custkey, 'tags repeats' FROM customer WHERE c_custkey % 9 = 0""")
def record_constraints(spark, d):
    k, c, n = F.col("c_custkey"), t(spark, d, "customer"), t(spark, d, "nation")
    states = c.select(F.concat(F.lit("t"), k).alias("teardown_id"), F.when(k % 2 == 0, "complete").otherwise("open").alias("status"), (k % 6).alias("phase"), F.sequence(F.lit(0), k % 8).alias("s")).withColumn("artifacts", F.slice("s", 2, 9))
    checks = c.select(F.concat(F.lit("c"), "c_nationkey").alias("id"))
    rows = c.select(F.concat(F.lit("t"), k).alias("id"), F.when(k % 13 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 9 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"))).alias("tags"))
    files = n.select(F.col("n_name").alias("path"), "n_nationkey")
    return A.complete_state(states).unionByName(A.state_ids(checks, checks.limit(0))).unionByName(A.required_files(files, files.filter("n_nationkey % 2 = 1"))).unionByName(A.shape(rows, "V-03", "id", ["segment"], {"segment": ["BUILDING", "MACHINERY"]}, ["tags"]))


_RECIPES = """r AS (SELECT s_suppkey AS k, 'app' || s_suppkey AS app, 'app' || (s_suppkey + CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 0 END) || '.json' AS file, CASE WHEN s_suppkey % 4 = 0 THEN 'crm' ELSE 'erp' END AS category, CASE WHEN s_suppkey % 6 = 0 THEN 'https://b' ELSE 'https://a' END AS tos, s_suppkey % 7 = 0 AS plain, s_suppkey % 10 = 0 AS twice, CASE WHEN s_suppkey % 8 = 0 THEN '2030-01-01' ELSE '2025-01-01' END AS reviewed FROM supplier)"""


def _recipes(spark, d) -> DataFrame:
    s = F.col("s_suppkey")
    sources = F.concat(F.array(F.lit("https://a")), F.when(s % 7 == 0, F.array(F.lit("http://c"))).otherwise(F.array()), F.when(s % 10 == 0, F.array(F.lit("https://a"))).otherwise(F.array()))
    routes = F.when(s % 3 == 0, F.array(F.lit("api"), F.lit("export"))).otherwise(F.array(F.lit("export")))
    return t(spark, d, "supplier").select(F.concat(F.lit("app"), s).alias("app"), F.concat(F.lit("app"), F.when(s % 9 == 0, s + 1).otherwise(s), F.lit(".json")).alias("file"), F.when(s % 4 == 0, "crm").otherwise("erp").alias("category"), F.when(s % 6 == 0, "https://b").otherwise("https://a").alias("tos_url"), sources.alias("sources"), F.when(s % 8 == 0, "2030-01-01").otherwise("2025-01-01").alias("last_reviewed"), routes.alias("routes"))


@query(f"""WITH {_RECIPES}, apps AS (SELECT p_partkey AS rank, 'app' || p_partkey AS app, 'erp' AS category FROM part) SELECT 'C-15' AS check_id, 'apps' AS entity_id, 'ranks: ' || count(DISTINCT rank) || ' of 100' AS message FROM apps HAVING count(*) <> 100 OR min(rank) <> 1 OR max(rank) <> 100 UNION ALL SELECT 'C-15', app, 'recipe of no listed app' FROM r WHERE app NOT IN (SELECT app FROM apps)
UNION ALL SELECT 'C-15', r.app, 'category differs' FROM r JOIN apps USING (app) WHERE r.category <> apps.category UNION ALL SELECT 'C-15', app, 'file isn''t named after the app' FROM r WHERE k % 9 = 0 UNION ALL SELECT 'C-15', app, 'source is no https' FROM r WHERE plain UNION ALL SELECT 'C-15', app, 'source repeats' FROM r WHERE twice
UNION ALL SELECT 'C-15', app, 'terms aren''t among the sources' FROM r WHERE tos = 'https://b' UNION ALL SELECT 'C-15', app, 'reviewed in the future' FROM r WHERE reviewed > '2026-01-01'""")
def corpus_constraints(spark, d):
    apps = t(spark, d, "part").select(F.col("p_partkey").alias("rank"), F.concat(F.lit("app"), "p_partkey").alias("app"), F.lit("erp").alias("category"))
    return A.corpus_rules(apps, _recipes(spark, d), "2026-01-01")


@query("SELECT 'export' AS route_type, count(*) AS routes, count(*) AS recipes FROM supplier UNION ALL SELECT 'api', count(*), count(*) FROM supplier WHERE s_suppkey % 3 = 0")
def route_counts(spark, d):
    return A.route_counts(_recipes(spark, d))


# outside verdicts: orders are candidates, line items answers

_ANSWERS = """ans AS (SELECT o_custkey AS s, 'u' || (o_orderkey + CASE WHEN o_orderkey % 10 = 0 THEN 100000000 ELSE 0 END) AS u, ['same_party', ' Different', 'UNCERTAIN', 'perhaps'][o_orderkey % 4 + 1] AS v, ['0.9', '0.3', '7', 'high', NULL][o_orderkey % 5 + 1] AS c FROM orders WHERE o_orderkey % 7 > 0),
co AS (SELECT s, u, CASE upper(trim(v)) WHEN 'SAME_PARTY' THEN 'SAME_PARTY' WHEN 'DIFFERENT' THEN 'DIFFERENT' ELSE 'UNCERTAIN' END AS verdict, coalesce(round(least(1, greatest(0, try_cast(c AS DOUBLE))), 3), 0) AS confidence FROM ans)"""


def _answers(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda values, n: lookup(dict(enumerate(values)), (k % n).cast("int"))
    return t(spark, d, "orders").filter(k % 7 > 0).select(
        F.col("o_custkey").alias("subject_id"), F.concat(F.lit("u"), F.when(k % 10 == 0, k + 100_000_000).otherwise(k)).alias("listed_uid"), pick(["same_party", " Different", "UNCERTAIN", "perhaps"], 4).alias("verdict"),
        F.nullif(pick(["0.9", "0.3", "7", "high", ""], 5), F.lit("")).alias("confidence"), F.lit("because").alias("rationale"), F.array(F.lit("dob")).alias("evidence"), k.alias("place"),
    )


@query(f"WITH {_ANSWERS} SELECT s AS subject_id, u AS listed_uid, verdict, confidence FROM co")
def coerced_verdicts(spark, d):
    return J.coerced(_answers(spark, d)).select("subject_id", "listed_uid", "verdict", "confidence")


@query(f"""WITH {_ANSWERS}, k AS (SELECT o_custkey AS s, 'u' || o_orderkey AS u, ['EXACT', 'STRONG', 'WEAK'][o_orderkey % 3 + 1] AS band FROM orders)
SELECT k.s AS subject_id, k.u AS listed_uid, coalesce(verdict, 'UNCERTAIN') AS verdict, coalesce(confidence, 0) AS confidence, CASE WHEN verdict IS NULL THEN 'no answer: left to a person' WHEN verdict = 'SAME_PARTY' AND confidence < 0.5 THEN 'low confidence' WHEN band = 'EXACT' AND verdict = 'UNCERTAIN' THEN 'exact match left uncertain' WHEN band = 'EXACT' AND verdict = 'DIFFERENT' THEN 'exact match called different' END AS override
FROM k LEFT JOIN co ON co.s = k.s AND co.u = k.u UNION ALL SELECT s, '__discarded__', 'UNCERTAIN', 0, 'outside of the candidates: ' || count(*) FROM co WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.s = co.s AND k.u = co.u) GROUP BY s""")
def closed_candidates(spark, d):
    k = F.col("o_orderkey")
    candidates = t(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"), F.concat(F.lit("u"), k).alias("listed_uid"), lookup({0: "EXACT", 1: "STRONG", 2: "WEAK"}, (k % 3).cast("int")).alias("band"))
    return J.adjudicated(candidates, J.coerced(_answers(spark, d)))


@query("""WITH r AS (SELECT event_id, ['pass', 'CONDITIONAL_PASS ', 'fail', 'maybe'][event_id % 4 + 1] AS v, ['0.25', '2', 'x', NULL][event_id // 4 % 4 + 1] AS k FROM events), x AS (SELECT event_id, upper(trim(v)) AS v, CASE WHEN k IS NULL THEN 1.0 ELSE round(least(1, greatest(0, try_cast(k AS DOUBLE))), 3) END AS risk FROM r),
y AS (SELECT *, CASE WHEN v NOT IN ('PASS', 'CONDITIONAL_PASS', 'FAIL') THEN 'unknown verdict' WHEN try_cast(risk AS DOUBLE) IS NULL THEN 'unreadable risk' END AS error FROM (SELECT x.event_id, v, CASE WHEN k = 'x' THEN NULL ELSE risk END AS risk FROM x JOIN r USING (event_id, v) UNION ALL SELECT x.event_id, x.v, CASE WHEN r.k = 'x' THEN NULL ELSE risk END FROM x JOIN r ON r.event_id = x.event_id AND r.v <> x.v))
SELECT event_id AS case_id, CASE WHEN error IS NULL THEN v ELSE 'FAIL' END AS verdict, CASE WHEN error IS NULL THEN CAST(risk AS DOUBLE) ELSE 1.0 END AS risk, error FROM y""")
def critic_reviews(spark, d):
    k = F.col("event_id")
    verdict = lookup(dict(enumerate(["pass", "CONDITIONAL_PASS ", "fail", "maybe"])), (k % 4).cast("int"))
    risk = F.nullif(lookup(dict(enumerate(["0.25", "2", "x", ""])), (F.floor(k / 4) % 4).cast("int")), F.lit(""))
    return J.reviewed(t(spark, d, "events").select(k.alias("case_id"), verdict.alias("verdict"), risk.alias("risk")))


@query("""WITH f AS (SELECT o_custkey AS c, o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'minor' ELSE 'major' END AS s FROM orders), l AS (SELECT c, CASE s WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END AS r, '[' || s || '] u' || k || ': finding ' || k || ' -> look' AS line FROM f)
SELECT c AS case_id, string_agg(line, chr(10) ORDER BY r, line) AS brief FROM l GROUP BY c""")
def retry_briefs(spark, d):
    k = F.col("o_orderkey")
    raw = t(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("u"), k).alias("listed_uid"), lookup({0: "Critical", 1: "minor", 2: "major", 3: "dire"}, (k % 4).cast("int")).alias("severity"), F.concat(F.lit("finding "), k).alias("finding"), F.lit("look").alias("action"))
    return J.retry_brief(J.findings(raw))


@query("""SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN '{"id": ' || event_id || '}' END AS found, '(b) ' || event_type AS safe FROM events""")
def answer_objects(spark, d):
    """The object in an answer: plain, fenced, broken, or a list; and text from outside without tags."""
    k = F.col("event_id")
    plain = F.concat(F.lit('{"id": '), k, F.lit("}"))
    answer = F.when(k % 4 == 0, plain).when(k % 4 == 1, F.concat(F.lit("So:\\n```json\\n"), plain, F.lit("\\n```\\nDone."))).when(k % 4 == 2, F.lit("{broken}")).otherwise("[1]")
    return t(spark, d, "events").select("event_id", J.extract_object(answer).alias("found"), J.fenced_off(F.concat(F.lit("<b> "), "event_type")).alias("safe"))
