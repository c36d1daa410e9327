"""Contracts of artifacts and list labels, on records derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partylens.operators import constraints as C
from partylens.operators.runs import lookup
from partylens.plans.registry import query, t
from partylens.sources import delimited as D

_PAIRS = """SELECT CAST(o_orderkey AS VARCHAR) AS id, ['replay', 'perception', 'judgment', 'design'][o_orderkey % 4 + 1] AS kind, ['system-of-record', 'observed-ui', 'analyst', 'validated-design', 'analyst'][o_orderkey % 5 + 1] AS auth,
CASE WHEN o_custkey % 3 = 0 THEN 'holdout-eval' ELSE 'train' END AS role, o_custkey % 4 AS evidence, CASE WHEN o_custkey % 2 = 0 THEN 'c' END AS ctx, CASE WHEN o_custkey % 7 = 0 THEN 'sanitized-shareable' ELSE 'raw' END AS tier, CASE WHEN o_orderkey % 2 = 0 THEN 'r' END AS reviewer FROM orders"""


@query(f"""WITH p AS ({_PAIRS}) SELECT 'C-06' AS check_id, id AS entity_id, 'replay without context or record' AS message FROM p WHERE kind = 'replay' AND NOT (ctx IS NOT NULL AND auth = 'system-of-record')
UNION ALL SELECT 'C-07', id, 'perception not from the interface' FROM p WHERE kind = 'perception' AND auth <> 'observed-ui'
UNION ALL SELECT 'C-08', id, 'judgment without analyst or evidence' FROM p WHERE kind = 'judgment' AND NOT (auth = 'analyst' AND evidence > 0)
UNION ALL SELECT 'C-09', id, 'design without authority or evidence' FROM p WHERE kind = 'design' AND NOT (auth IN ('analyst', 'validated-design') AND evidence > 0)
UNION ALL SELECT 'C-10', id, 'shared without review' FROM p WHERE tier = 'sanitized-shareable' AND reviewer IS NULL
UNION ALL SELECT 'C-11', id, 'held-out label by an analyst' FROM p WHERE role = 'holdout-eval' AND auth = 'analyst'""")
def pair_constraints(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    authorities = dict(enumerate("system-of-record observed-ui analyst validated-design analyst".split()))
    p = t(spark, d, "orders").select(
        k.alias("pair_id"), lookup(dict(enumerate(["replay", "perception", "judgment", "design"])), k % 4).alias("pair_type"), lookup(authorities, k % 5).alias("label_authority"), F.when(c % 3 == 0, "holdout-eval").otherwise("train").alias("dataset_role"),
        (c % 4).alias("evidence"), F.when(c % 2 == 0, "c").alias("replay_context"), F.when(c % 7 == 0, "sanitized-shareable").otherwise("raw").alias("tier"), F.when(k % 2 == 0, "r").alias("reviewer"),
    )
    return C.pair_rules(p)


_ARTIFACTS = """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'gap' ELSE 'exported' END AS status, c_custkey % 4 AS files, CASE WHEN c_custkey % 5 > 0 THEN 1 END AS verified, CASE WHEN c_custkey % 6 = 0 THEN 'why' END AS gap,
['public', 'internal', 'confidential', 'restricted'][c_nationkey % 4 + 1] AS sens, c_custkey % 2 = 0 AS enc, c_custkey % 7 > 0 AS bak FROM customer"""


@query(f"""WITH a AS ({_ARTIFACTS}) SELECT 'C-12a' AS check_id, id AS entity_id, 'exported without files or check' AS message FROM a WHERE status = 'exported' AND NOT (files > 0 AND verified IS NOT NULL)
UNION ALL SELECT 'C-12b', id, 'not exported, without a gap told' FROM a WHERE status <> 'exported' AND gap IS NULL
UNION ALL SELECT 'C-12c', id, 'secret export not protected' FROM a WHERE status = 'exported' AND sens IN ('confidential', 'restricted') AND NOT (enc AND bak)""")
def preservation_constraints(spark, d):
    k = F.col("c_custkey")
    a = t(spark, d, "customer").select(
        k.alias("id"), F.when(k % 3 == 0, "gap").otherwise("exported").alias("status"), (k % 4).alias("files"), F.when(k % 5 > 0, 1).alias("verified_at"), F.when(k % 6 == 0, "why").alias("gap"),
        lookup(dict(enumerate("public internal confidential restricted".split())), F.col("c_nationkey") % 4).alias("sensitivity"), (k % 2 == 0).alias("encrypted"), (k % 7 > 0).alias("backed_up"),
    )
    return C.preservation_rules(a)


_TOLD = """told AS (SELECT 'a' || doc_id % 40 AS artifact, CASE WHEN doc_id % 50 = 0 THEN '../' ELSE 'd/' END || (doc_id - doc_id % 2 * (CASE WHEN doc_id % 30 = 1 THEN 1 ELSE 0 END)) AS path, n_chars AS bytes, sha256(CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE text END) AS sha256 FROM documents),
found AS (SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 17 = 0 THEN n_chars + 1 ELSE n_chars END AS rb, sha256(text) AS rs FROM documents WHERE doc_id % 19 > 0), j AS (SELECT * FROM told LEFT JOIN found USING (path) WHERE path NOT LIKE '../%')"""


@query(f"""WITH {_TOLD} SELECT 'V-36' AS check_id, path AS entity_id, 'path leaves the folder' AS message FROM told WHERE path LIKE '../%' UNION ALL SELECT 'V-37', path, 'file is missing' FROM j WHERE rb IS NULL
UNION ALL SELECT 'V-38', path, 'size differs' FROM j WHERE rb <> bytes UNION ALL SELECT 'V-39', path, 'digest differs' FROM j WHERE rs <> sha256
UNION ALL SELECT 'V-41', path, 'file of several artifacts' FROM told GROUP BY path HAVING count(DISTINCT artifact) > 1""")
def file_constraints(spark, d):
    k, docs = F.col("doc_id"), t(spark, d, "documents")
    number = F.when(k % 30 == 1, k - k % 2).otherwise(k)
    told = docs.select(F.concat(F.lit("a"), k % 40).alias("artifact"), F.concat(F.when(k % 50 == 0, "../").otherwise("d/"), number).alias("path"), F.col("n_chars").alias("bytes"), F.sha2(F.when(k % 13 == 0, "x").otherwise(F.col("text")), 256).alias("sha256"))
    found = docs.filter("doc_id % 19 > 0").select(F.concat(F.lit("d/"), k).alias("path"), F.when(k % 17 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("bytes"), F.sha2("text", 256).alias("sha256"))
    return C.file_rules(told, found)


@query(r"SELECT 'C-14' AS check_id, CAST(page_id AS VARCHAR) AS entity_id, 'url is no https' AS message FROM pages WHERE NOT regexp_matches(url, '^https://[^ ]+$')")
def url_patterns(spark, d):
    return C.pattern(t(spark, d, "pages"), "C-14", "page_id", "url", "https")


@query("""WITH l AS (SELECT s_suppkey, ['Denied Persons List', ' entity  LIST ', 'Entity List (EL) - BIS', 'Specially Designated Nationals (SDN) - Treasury Department', 'x'][s_suppkey % 5 + 1] AS label FROM supplier),
c AS (SELECT *, ['DPL', 'EL', 'UNKNOWN', 'SDN', 'UNKNOWN'][s_suppkey % 5 + 1] AS code FROM l) SELECT s_suppkey, label, code, CASE code WHEN 'DPL' THEN 'no participation' WHEN 'EL' THEN 'license needed' WHEN 'SDN' THEN 'blocked' ELSE 'unknown list: treat as restricted until told' END AS effect FROM c""")
def list_labels(spark, d):
    labels = dict(enumerate(["Denied Persons List", " entity  LIST ", "Entity List (EL) - BIS", "Specially Designated Nationals (SDN) - Treasury Department", "x"]))
    return t(spark, d, "supplier").select("s_suppkey", lookup(labels, F.col("s_suppkey") % 5).alias("label")).withColumn("code", D.list_code(F.col("label"))).withColumn("effect", D.effect(F.col("code")))
