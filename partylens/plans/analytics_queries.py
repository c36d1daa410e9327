"""Constraints, audit, graph, profiling, verdict and replay queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partylens.operators import audit as A
from partylens.operators import constraints as C
from partylens.operators import graph as G
from partylens.operators import profile as P
from partylens.operators.runs import lookup
from partylens.plans.registry import query, t

# constraints


@query("SELECT 'V-07' AS check_id, c_mktsegment || '/' || c_nationkey AS entity_id, 'duplicate segment: ' || count(*) AS message FROM customer GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 1")
def dup_keys(spark, d):
    return C.duplicates(t(spark, d, "customer"), "V-07", ["c_mktsegment", "c_nationkey"], "segment")


@query("SELECT 'V-15' AS check_id, CAST(doc_id AS VARCHAR) AS entity_id, 'unknown document' AS message FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en'))")
def fk_violations(spark, d):
    """Labels against the English documents only, so that there are violations."""
    docs = t(spark, d, "documents").filter("lang = 'en'")
    return C.missing(t(spark, d, "labels"), "V-15", "doc_id", docs, "doc_id", "document")


@query("SELECT 'C-14' AS check_id, conv_id || '/' || turn AS entity_id, 'role is ' || coalesce(role, 'null') AS message FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')")
def enum_violations(spark, d):
    c = t(spark, d, "conversations").withColumn("id", F.concat_ws("/", "conv_id", "turn"))
    return C.outside(c, "C-14", "id", "role", ["user", "assistant"])


@query("""WITH r AS (SELECT source, CASE WHEN n_chars % 10 = 0 THEN 'holdout-eval' WHEN n_chars % 10 < 8 THEN 'train' ELSE 'validation' END AS role FROM documents)
SELECT 'V-30' AS check_id, source AS entity_id, string_agg(DISTINCT role, ',' ORDER BY role) AS message FROM r GROUP BY source HAVING count(DISTINCT role) > 1""")
def role_leak(spark, d):
    m = F.col("n_chars") % 10
    docs = t(spark, d, "documents").withColumn("role", F.when(m == 0, "holdout-eval").when(m < 8, "train").otherwise("validation"))
    return C.leaks(docs, "V-30", "source", "role")


@query("SELECT 'C-05' AS check_id, CAST(o_orderkey AS VARCHAR) AS entity_id, 'window without an end' AS message FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")
def window_requires_end(spark, d):
    o = t(spark, d, "orders").withColumn("end", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")))
    return C.requires(o, "C-05", "o_orderkey", F.col("o_orderpriority") == "1-URGENT", F.col("end").isNotNull(), "window without an end")


_NODES_SQL = """nodes AS (SELECT 'c' || n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'report' WHEN 2 THEN 'script' ELSE 'integration' END AS type FROM nation),
edges AS (SELECT DISTINCT 'c' || c_nationkey AS from_id, 'c' || ((c_nationkey * 7 + c_custkey % 3) % 28) AS to_id, CASE c_custkey % 6 WHEN 0 THEN 'reads' WHEN 1 THEN 'writes' WHEN 2 THEN 'joins-on' WHEN 3 THEN 'triggers' WHEN 4 THEN 'exports-to' ELSE 'supports' END AS type FROM customer)"""
_TYPES = ["reads", "writes", "joins-on", "triggers", "exports-to", "supports"]


def nodes(spark, d) -> DataFrame:
    kind = lookup({0: "entity", 1: "report", 2: "script", 3: "integration"}, F.col("n_nationkey") % 4)
    return t(spark, d, "nation").select(F.concat(F.lit("c"), "n_nationkey").alias("id"), kind.alias("type"))


def edges(spark, d) -> DataFrame:
    to = (F.col("c_nationkey") * 7 + F.col("c_custkey") % 3) % 28
    kind = lookup(dict(enumerate(_TYPES)), F.col("c_custkey") % 6)
    return t(spark, d, "customer").select(F.concat(F.lit("c"), "c_nationkey").alias("from_id"), F.concat(F.lit("c"), to.cast("string")).alias("to_id"), kind.alias("type")).distinct()


@query(f"""WITH {_NODES_SQL}, b AS (SELECT e.*, concat_ws('>', from_id, to_id, e.type) AS name, a.type AS ft, z.type AS tt FROM edges e LEFT JOIN nodes a ON a.id = from_id LEFT JOIN nodes z ON z.id = to_id)
SELECT 'V-15' AS check_id, name AS entity_id, 'from is missing' AS message FROM b WHERE ft IS NULL UNION ALL SELECT 'V-15', name, 'to is missing' FROM b WHERE tt IS NULL
UNION ALL SELECT 'V-18', name, type || ' to ' || tt FROM b WHERE tt IS NOT NULL AND (tt <> CASE WHEN type IN ('reads', 'writes', 'joins-on') THEN 'entity' WHEN type = 'triggers' THEN 'script' WHEN type = 'exports-to' THEN 'integration' ELSE 'business-process' END OR (type = 'joins-on' AND ft <> 'report'))""")
def typed_edges(spark, d):
    return C.typed_edges(edges(spark, d), nodes(spark, d))


_FEATURES = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'never' WHEN 1 THEN 'unknown' WHEN 2 THEN 'weekly' END AS usage, CASE p_partkey % 3 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'DEFER' END AS verdict, CASE WHEN p_size > 5 THEN 'because' ELSE '' END AS why,
CASE WHEN p_size % 4 = 0 THEN 'duplicate' WHEN p_size % 2 = 0 THEN 'superseded' END AS reason, CASE WHEN p_size > 40 THEN 'critical' ELSE 'normal' END AS crit, p_size % 7 AS procs, p_size % 5 = 0 AS runtime, p_size % 10 = 0 AS all_time, p_partkey % 2 = 0 AS sv, p_size % 5 <= 1 AS su, p_size % 4 = 0 AS sc FROM part"""


@query(f"""WITH f AS ({_FEATURES}) SELECT 'V-10' AS check_id, CAST(id AS VARCHAR) AS entity_id, 'usage without runtime evidence' AS message FROM f WHERE usage <> 'unknown' AND NOT (runtime AND su)
UNION ALL SELECT 'V-11', CAST(id AS VARCHAR), 'never used, without evidence of all time' FROM f WHERE usage = 'never' AND NOT (runtime AND all_time)
UNION ALL SELECT 'V-12', CAST(id AS VARCHAR), 'unknown usage with a verdict' FROM f WHERE usage = 'unknown' AND verdict IS NOT NULL AND verdict <> 'DEFER'
UNION ALL SELECT 'C-01', CAST(id AS VARCHAR), 'verdict without reason or evidence' FROM f WHERE verdict IS NOT NULL AND NOT (why <> '' AND sv)
UNION ALL SELECT 'C-02', CAST(id AS VARCHAR), 'usage without evidence' FROM f WHERE usage <> 'unknown' AND NOT su
UNION ALL SELECT 'C-03', CAST(id AS VARCHAR), 'never used, without reason' FROM f WHERE usage = 'never' AND coalesce(reason, '') NOT IN ('never-needed', 'too-complex', 'duplicate', 'wrong-fit', 'configured-never-enabled', 'unknown')
UNION ALL SELECT 'C-04', CAST(id AS VARCHAR), 'critical without process or evidence' FROM f WHERE crit = 'critical' AND NOT (procs > 0 AND sc)""")
def usage_constraints(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")
    supports = F.filter(F.array(F.when(k % 2 == 0, "verdict"), F.when(s % 5 <= 1, "usage"), F.when(s % 4 == 0, "criticality")), lambda x: x.isNotNull())
    evidence = F.array(F.struct(F.when(s % 5 == 0, "runtime").otherwise("structural").alias("evidence_class"), supports.alias("supports"), F.when(s % 10 == 0, "all-time").otherwise("window").alias("coverage")))
    f = t(spark, d, "part").select(
        k.alias("id"), F.when(k % 4 == 0, "never").when(k % 4 == 1, "unknown").when(k % 4 == 2, "weekly").otherwise(none).alias("usage"), F.when(k % 3 == 0, "KEEP").when(k % 3 == 1, "DEFER").alias("verdict"),
        F.when(s > 5, "because").otherwise("").alias("why"), F.when(s % 4 == 0, "duplicate").when(s % 2 == 0, "superseded").alias("unused_reason"), F.when(s > 40, "critical").otherwise("normal").alias("criticality"),
        F.array_repeat(F.lit("p"), (s % 7).cast("int")).alias("business_processes"), evidence.alias("evidence"),
    )
    return C.usage_rules(f)


# lists: merges and duplicates


@query("""WITH r AS (SELECT c_mktsegment || '/' || c_nationkey AS uid, c_custkey AS ord, c_name AS name, c_mktsegment AS program FROM customer)
SELECT uid, arg_min(name, ord) AS name, arg_min(program, ord) AS program, string_agg(DISTINCT lower(name), ';' ORDER BY lower(name)) AS aliases, count(*) AS merged FROM r GROUP BY uid""")
def dedupe_merge(spark, d):
    """First row wins, aliases are merged without regard to case."""
    r = t(spark, d, "customer").select(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("uid"), "c_custkey", "c_name", "c_mktsegment")
    return r.groupBy("uid").agg(F.min_by("c_name", "c_custkey").alias("name"), F.min_by("c_mktsegment", "c_custkey").alias("program"), F.array_join(F.array_sort(F.collect_set(F.lower("c_name"))), ";").alias("aliases"), F.count("*").alias("merged"))


@query("""WITH a AS (SELECT l_partkey AS ent, string_agg(l_orderkey || '-' || l_linenumber, ';' ORDER BY l_orderkey, l_linenumber, l_suppkey) AS aliases FROM lineitem GROUP BY l_partkey)
SELECT p_partkey, p_name, coalesce(aliases, '') AS aliases FROM part LEFT JOIN a ON ent = p_partkey""")
def alias_merge(spark, d):
    li = t(spark, d, "lineitem")
    rows = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey")))
    a = li.groupBy("l_partkey").agg(F.array_join(F.transform(rows, lambda x: F.concat_ws("-", x["l_orderkey"], x["l_linenumber"])), ";").alias("aliases"))
    return t(spark, d, "part").join(a, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_name", F.coalesce("aliases", F.lit("")).alias("aliases"))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def alias_orphans(spark, d):
    return t(spark, d, "lineitem").join(t(spark, d, "part").filter("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("l_partkey").distinct()


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def holdout_contamination(spark, d):
    """Items that stand in documents to the letter."""
    return P.containing(t(spark, d, "documents"), "doc_id", "text", t(spark, d, "benchmark"), "item_id", "text")


@query("""WITH x AS (SELECT o_orderkey, o_orderpriority || ' ; ' || o_orderstatus || '|-0-' AS raw FROM orders) SELECT o_orderkey, array_to_string(list_filter(list_transform(string_split_regex(raw, '[;|]'), lambda v: trim(v)), lambda v: v <> ''), ',') AS parts, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE trim(raw) END AS cleaned FROM x""")
def field_cleaning(spark, d):
    from partylens.operators import rules as R

    raw = F.concat(F.col("o_orderpriority"), F.lit(" ; "), F.col("o_orderstatus"), F.lit("|-0-"))
    x = t(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    return x.select("o_orderkey", F.array_join(R.split_multi(F.col("raw")), ",").alias("parts"), R.clean(F.when(F.col("o_orderkey") % 2 == 0, " -0- ").otherwise(F.col("raw"))).alias("cleaned"))


# audit

def _body_sql(row: str, prev: str) -> str:
    """The canonical JSON of an entry of ``row``."""
    return f"""'{{"actor":"u' || {row}.chain || '","event":"' || {row}.event_type || '","payload":{{"event_id":' || {row}.event_id || '}},"prev_hash":"' || {prev} || '","seq":' || {row}.seq || ',"ts":"' || {row}.ts || '"}}'"""


_LINKS_SQL = f"""WITH RECURSIVE b AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY events.ts, event_id) AS seq, event_id, event_type, strftime(events.ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events),
chain AS (SELECT chain, seq, event_id, event_type, ts, repeat('0', 64) AS prev_hash, sha256({_body_sql("b", "repeat('0', 64)")}) AS hash FROM b WHERE seq = 1
UNION ALL SELECT b.chain, b.seq, b.event_id, b.event_type, b.ts, c.hash, sha256({_body_sql("b", "c.hash")}) FROM chain c JOIN b ON b.chain = c.chain AND b.seq = c.seq + 1)"""


def _check_sql(table: str) -> str:
    return f""", v AS (SELECT x.*, sha256({_body_sql("x", "x.prev_hash")}) AS computed, lag(seq) OVER o AS before, lag(hash) OVER o AS before_hash FROM {table} x WINDOW o AS (PARTITION BY chain ORDER BY seq))
SELECT chain, seq, unnest(list_filter([CASE WHEN seq <> coalesce(before + 1, 1) THEN 'gap' END, CASE WHEN prev_hash <> coalesce(before_hash, repeat('0', 64)) THEN 'broken link' END, CASE WHEN hash <> computed THEN 'changed body' END], lambda p: p IS NOT NULL)) AS problem FROM v"""


def _chain(spark, d) -> DataFrame:
    """All events, each user's as a chain of its own."""
    e = t(spark, d, "events")
    payload = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit("}"))
    entries = e.select(F.col("user_id").alias("chain"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.concat(F.lit("u"), "user_id").alias("actor"), F.col("event_type").alias("event"), payload.alias("payload"), F.col("ts").alias("at"), "event_id")
    return A.chained(entries, ["at", "event_id"])


@query(f"{_LINKS_SQL} SELECT chain, seq, prev_hash, hash FROM chain")
def audit_chain(spark, d):
    return _chain(spark, d).select("chain", "seq", "prev_hash", "hash")


@query(f"{_LINKS_SQL}, bad AS (SELECT * REPLACE (CASE WHEN seq = 5 THEN 'forged' ELSE event_type END AS event_type) FROM chain WHERE seq <> 2){_check_sql('bad')}")
def audit_tamper(spark, d):
    """Of each chain an entry is removed and one is changed; both are found."""
    bad = _chain(spark, d).filter("seq <> 2").withColumn("event", F.when(F.col("seq") == 5, "forged").otherwise(F.col("event")))
    return A.verify(A.rehashed(bad))


@query(f"{_LINKS_SQL}{_check_sql('chain')}")
def audit_verify(spark, d):
    """Every hash of every chain is computed again; a sound trail gives no row."""
    return A.verify(A.rehashed(_chain(spark, d)))


@query("SELECT event_id, ts < DATE '2029-03-01' - INTERVAL 5 YEAR AS may_go FROM events")
def retention(spark, d):
    """Entries before the floor, five years back, may go."""
    return t(spark, d, "events").select("event_id", (F.col("ts") < A.retention_floor(F.lit("2029-03-01").cast("date"))).alias("may_go"))


# graph

#: Nations point on to others; five islands by residue, with one cycle each way where keys wrap.
_G = "g AS (SELECT n_nationkey AS src, n_nationkey + 5 AS dst FROM nation WHERE n_nationkey < 20 AND n_nationkey % 5 <> 3 UNION ALL SELECT 20, 10 UNION ALL SELECT 11, 2 UNION ALL SELECT 2, 12)"


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    e = n.filter("id < 20 and id % 5 <> 3").select(F.col("id").alias("src"), (F.col("id") + 5).alias("dst"))
    return n, e.unionByName(spark.createDataFrame([(20, 10), (11, 2), (2, 12)], "src long, dst long"))


_REACH_SQL = f"WITH RECURSIVE {_G}, r(src, dst, hops) AS (SELECT DISTINCT src, dst, 1 FROM g UNION ALL SELECT r.src, g.dst, r.hops + 1 FROM r JOIN g ON g.src = r.dst WHERE r.hops < 12)"


@query(f"{_REACH_SQL} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1, 2")
def reachability(spark, d):
    return G.reachable(_graph(spark, d)[1])


@query(f"""WITH RECURSIVE {_G}, u AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), r(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b)
SELECT CAST(a AS BIGINT) AS id, CAST(min(b) AS BIGINT) AS component FROM r GROUP BY a""")
def graph_components(spark, d):
    return G.components(*_graph(spark, d))


_SCC_SQL = f"{_REACH_SQL}, p AS (SELECT DISTINCT src, dst FROM r), m AS (SELECT p.src AS id, min(p.dst) AS m FROM p JOIN p q ON p.src = q.dst AND p.dst = q.src GROUP BY p.src), scc AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(least(n_nationkey, coalesce(m, n_nationkey)) AS BIGINT) AS scc FROM nation LEFT JOIN m ON id = n_nationkey)"


@query(f"{_SCC_SQL} SELECT id, scc FROM scc")
def scc(spark, d):
    return G.strong_components(*_graph(spark, d))


@query(f"""{_SCC_SQL}, dag AS (SELECT DISTINCT a.scc AS a, b.scc AS b FROM g JOIN scc a ON a.id = src JOIN scc b ON b.id = dst WHERE a.scc <> b.scc),
lv(a, l) AS (SELECT DISTINCT scc, 0 FROM scc UNION SELECT dag.b, lv.l + 1 FROM lv JOIN dag ON dag.a = lv.a) SELECT id, CAST(max(l) AS INTEGER) AS level FROM scc JOIN lv ON lv.a = scc GROUP BY id""")
def topo_levels(spark, d):
    return G.levels(*_graph(spark, d))


@query(f"""WITH RECURSIVE {_G}, u AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), r(x, a, b) AS (SELECT m.n_nationkey, n.n_nationkey, n.n_nationkey FROM nation m, nation n WHERE m.n_nationkey <> n.n_nationkey UNION SELECT r.x, r.a, u.b FROM r JOIN u ON u.a = r.b WHERE u.b <> r.x),
c AS (SELECT x, a, min(b) AS c FROM r GROUP BY x, a), l AS (SELECT x, count(DISTINCT c) AS n FROM c GROUP BY x), w(a, b) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT w.a, u.b FROM w JOIN u ON u.a = w.b), k AS (SELECT count(DISTINCT c) AS n FROM (SELECT a, min(b) AS c FROM w GROUP BY a))
SELECT CAST(x AS BIGINT) AS id, l.n - k.n + 1 AS parts FROM l, k WHERE l.n > k.n - CASE WHEN x NOT IN (SELECT a FROM u) THEN 1 ELSE 0 END""")
def articulation(spark, d):
    return G.cut_points(*_graph(spark, d))


@query(f"""WITH RECURSIVE {_G}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g WHERE src <> dst), u AS (SELECT a AS p, b AS q, a, b FROM e UNION SELECT b, a, a, b FROM e),
r(a, b, n) AS (SELECT a, b, a FROM e UNION SELECT r.a, r.b, u.q FROM r JOIN u ON u.p = r.n WHERE u.a <> r.a OR u.b <> r.b) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = e.a AND r.b = e.b AND r.n = e.b)""")
def graph_bridges(spark, d):
    return G.bridges(*_graph(spark, d))


_VERDICTS = f"v AS (SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'DROP' WHEN 2 THEN 'DEFER' END AS verdict, n_nationkey % 6 = 0 AS critical FROM nation), p AS (SELECT DISTINCT src, dst FROM r), needed AS (SELECT DISTINCT dst AS id FROM p JOIN v ON v.id = src AND verdict = 'KEEP'), paths AS (SELECT dst AS id FROM p JOIN v ON v.id = src AND critical UNION SELECT src FROM p JOIN v ON v.id = dst AND critical UNION SELECT id FROM v WHERE critical)"


@query(f"""{_REACH_SQL}, {_VERDICTS} SELECT CAST(id AS BIGINT) AS id, 'dropped, yet needed by what is kept' AS problem FROM v WHERE verdict = 'DROP' AND id IN (SELECT id FROM needed) UNION ALL SELECT id, 'kept without a path to anything critical' FROM v WHERE verdict = 'KEEP' AND id NOT IN (SELECT id FROM paths) UNION ALL SELECT id, 'deferred, yet needed by what is kept' FROM v WHERE verdict = 'DEFER' AND id IN (SELECT id FROM needed)""")
def verdict_mismatches(spark, d):
    n, e = _graph(spark, d)
    verdict = F.when(F.col("id") % 4 == 0, "KEEP").when(F.col("id") % 4 == 1, "DROP").when(F.col("id") % 4 == 2, "DEFER")
    return G.verdict_mismatches(n.select("id", verdict.alias("verdict"), (F.col("id") % 6 == 0).alias("critical")), e)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey + 5 AS b, n_nationkey % 3 = 0 AS seen FROM nation WHERE n_nationkey < 20), lo(id, l) AS (SELECT n_nationkey, 0 FROM nation UNION SELECT b, l + 1 FROM lo JOIN e ON a = id WHERE seen), hi(id, l) AS (SELECT n_nationkey, 0 FROM nation UNION SELECT b, l + 1 FROM hi JOIN e ON a = id)
SELECT CAST(x.id AS BIGINT) AS id, CAST(x.l AS INTEGER) AS observed, CAST(y.l AS INTEGER) AS conservative, x.l <> y.l AS moved FROM (SELECT id, max(l) AS l FROM lo GROUP BY id) x JOIN (SELECT id, max(l) AS l FROM hi GROUP BY id) y USING (id)""")
def order_sensitivity(spark, d):
    """How far the order of work depends on edges that were only seen in the structure."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    e = n.filter("id < 20").select(F.col("id").alias("src"), (F.col("id") + 5).alias("dst"), F.when(F.col("id") % 3 == 0, "observed").otherwise("structural").alias("runtime_status"))
    return G.order_sensitivity(n, e)


@query(f"WITH {_NODES_SQL} SELECT CASE WHEN type IN ('reads', 'writes', 'joins-on') THEN to_id ELSE from_id END AS src, CASE WHEN type IN ('reads', 'writes', 'joins-on') THEN from_id ELSE to_id END AS dst, type FROM edges")
def dependency_projection(spark, d):
    return G.dependencies(edges(spark, d))


@query(f"""WITH {_NODES_SQL}, s AS (SELECT to_id AS id, sum(CASE type WHEN 'writes' THEN 3 WHEN 'joins-on' THEN 2 WHEN 'reads' THEN 1 ELSE 0 END) AS score, sum(CASE type WHEN 'writes' THEN 2 WHEN 'joins-on' THEN 1 WHEN 'reads' THEN 1 ELSE 0 END) AS other FROM edges GROUP BY to_id),
r AS (SELECT id, score, rank() OVER (ORDER BY score DESC) AS rank, rank() OVER (ORDER BY other DESC) AS o FROM s) SELECT id, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank, rank = o AS stable FROM r""")
def load_bearing(spark, d):
    return G.load_bearing(edges(spark, d))


@query(f"WITH {_NODES_SQL} SELECT id FROM nodes WHERE type = 'integration' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.type = 'exports-to' AND (from_id = id OR to_id = id) AND length(from_id) = 2)")
def unverified_nodes(spark, d):
    """Integrations without a verified edge; edges out of one-digit nations count as verified."""
    good = edges(spark, d).filter("type = 'exports-to' and length(from_id) = 2")
    ends = good.select(F.col("from_id").alias("id")).union(good.select("to_id"))
    return nodes(spark, d).filter("type = 'integration'").join(ends, "id", "left_anti").select("id")


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - 1 - (p_partkey % 3) END AS parent FROM part), k AS (SELECT c.id, p.p_partkey AS parent FROM c LEFT JOIN part p ON p.p_partkey = c.parent),
r(id, root) AS (SELECT id, id FROM k WHERE parent IS NULL UNION ALL SELECT k.id, r.root FROM r JOIN k ON k.parent = r.id) SELECT root, count(*) AS citations FROM r GROUP BY root""")
def corroboration_roots(spark, d):
    """Citations derived from one another count as one, that of their root."""
    k = F.col("p_partkey")
    parent = F.when(k % 10 != 0, k - 1 - k % 3)
    part = t(spark, d, "part")
    c = part.select(k.alias("id"), parent.alias("parent")).join(part.select(k.alias("parent")), "parent", "left_semi")
    c = part.select(k.alias("id")).join(c, "id", "left")
    return G.roots(c).groupBy("root").agg(F.count("*").alias("citations"))


@query()
def set_cover(spark, d):
    """Suppliers that together offer every part size, greedily."""
    offers = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("key"), F.col("p_size").alias("item"))
    return G.cover(offers).withColumnRenamed("key", "l_suppkey")


@query("""SELECT o_orderkey, ['transactional', 'ui-walk', 'interview', 'export', 'dreams'][o_orderkey % 5 + 1] AS plane, CASE o_orderkey % 5 WHEN 0 THEN 'runtime' WHEN 1 THEN 'structure' WHEN 2 THEN 'human' WHEN 3 THEN 'runtime' END AS class, CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE (o_custkey % 10 - 1) * 50 + 1 END AS least, (o_custkey % 10) * 50 AS most FROM orders""")
def evidence_classes(spark, d):
    """Planes to classes of evidence, and the range of rows that a number of pages can hold."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 10
    plane = lookup(dict(enumerate(["transactional", "ui-walk", "interview", "export", "dreams"])), (k % 5).cast("int"))
    shown = F.when(k % 5 == 1, "config-census").otherwise("telemetry")
    rows = t(spark, d, "orders").select("o_orderkey", plane.alias("plane"), P.evidence_class(plane, shown).alias("class"), P.segment_range(c, F.lit(50)).alias("r"))
    return rows.select("o_orderkey", "plane", "class", "r.least", "r.most")


# profiling

_TABLES = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderpriority", "documents": "doc_id lang source n_chars", "region": "r_regionkey r_name"}


@query(" UNION ALL ".join(f"""SELECT '{n}' AS "table", '{c}' AS "column", count(*) AS rows, count({c}) AS filled, round(count({c}) / count(*), 6) AS fill_rate, count(DISTINCT {c}) AS "distinct", count(DISTINCT {c}) <= 1 AS constant FROM {n}""" for n, cs in _TABLES.items() for c in cs.split()))
def fill_rates(spark, d):
    return C.together([P.columns(t(spark, d, n).select(cs.split()), n) for n, cs in _TABLES.items()])


_DATED = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


@query(" UNION ALL ".join(f"""SELECT '{n}' AS "table", count(*) AS rows, strftime(min({c}), '%Y-%m-%d') AS oldest, strftime(max({c}), '%Y-%m-%d') AS newest FROM {n}""" for n, c in _DATED.items()))
def row_archaeology(spark, d):
    return P.archaeology({n: (t(spark, d, n), c) for n, c in _DATED.items()})


@query("SELECT count(*) AS rows, count(*) FILTER (p_partkey IS NULL) AS orphans, round(count(*) FILTER (p_partkey IS NULL) / count(*), 6) AS orphan_rate, count(DISTINCT p_partkey) AS parents_used, round(count(DISTINCT p_partkey) / (SELECT count(*) FROM part WHERE p_size > 10), 6) AS density FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def referential_orphans(spark, d):
    return P.orphans(t(spark, d, "lineitem"), "l_partkey", t(spark, d, "part").filter("p_size > 10"), "p_partkey")


@query("SELECT o_orderpriority AS kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def type_freq(spark, d):
    o = t(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n")).crossJoin(o.agg(F.count("*").alias("all"))).select("kind", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def volume_series(spark, d):
    return t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(20,2)")), 2).cast("double").alias("value"))


@query("SELECT CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') / 365) AS BIGINT) AS age_years, count(*) AS n FROM orders GROUP BY 1")
def age_histogram(spark, d):
    years = F.floor(F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")) / 365)
    return t(spark, d, "orders").groupBy(years.alias("age_years")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def grants_vs_use(spark, d):
    """Grants (a high balance) without use (a finished order)."""
    return t(spark, d, "customer").filter("c_acctbal > 5000").join(t(spark, d, "orders").filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT c_mktsegment AS module, count(DISTINCT c_custkey) AS purchased, count(DISTINCT o_custkey) AS used, round(count(DISTINCT o_custkey) / count(DISTINCT c_custkey), 6) AS share
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ON o_custkey = c_custkey GROUP BY 1""")
def purchased_vs_used(spark, d):
    used = t(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    both = t(spark, d, "customer").join(used, F.col("c_custkey") == F.col("o_custkey"), "left")
    out = both.groupBy(F.col("c_mktsegment").alias("module")).agg(F.countDistinct("c_custkey").alias("purchased"), F.countDistinct("o_custkey").alias("used"))
    return out.withColumn("share", F.round(F.col("used") / F.col("purchased"), 6))


@query("""WITH x AS (SELECT l_returnflag AS entity, count(*) AS exported FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), y AS (SELECT l_returnflag AS entity, count(*) AS held FROM lineitem WHERE l_quantity > 1 GROUP BY 1)
SELECT coalesce(x.entity, y.entity) AS entity, coalesce(exported, 0) AS exported, coalesce(held, 0) AS held, coalesce(held, 0) - coalesce(exported, 0) AS gap FROM x FULL JOIN y USING (entity)""")
def export_completeness(spark, d):
    li = t(spark, d, "lineitem")
    x = li.filter("l_linestatus = 'O'").groupBy(F.col("l_returnflag").alias("entity")).agg(F.count("*").alias("exported"))
    y = li.filter("l_quantity > 1").groupBy(F.col("l_returnflag").alias("entity")).agg(F.count("*").alias("held"))
    z = F.lit(0)
    return x.join(y, "entity", "full_outer").select("entity", F.coalesce("exported", z).alias("exported"), F.coalesce("held", z).alias("held"), (F.coalesce("held", z) - F.coalesce("exported", z)).alias("gap"))


# verdicts and replay

_USE_SQL = """u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE count(o_orderkey) END AS events, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2002-01-01') AS days, CASE WHEN c_custkey % 2 = 0 THEN 3650 ELSE 90 END AS horizon,
CASE c_custkey % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'normal' ELSE 'important' END AS crit, c_custkey % 7 AS cites FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey),
v AS (SELECT *, CASE WHEN events IS NULL THEN 'unknown' WHEN events = 0 AND horizon >= 3650 THEN 'never' WHEN events = 0 THEN 'unknown' WHEN days <= 7 THEN 'daily-weekly' WHEN days <= 31 THEN 'monthly' WHEN days <= 366 THEN 'yearly' ELSE 'dormant' END AS usage FROM u),
w AS (SELECT *, CASE WHEN crit = 'critical' AND cites = 0 THEN 'important' ELSE crit END AS criticality FROM v)"""


def _use(spark, d) -> DataFrame:
    o = t(spark, d, "orders").filter("o_orderstatus = 'P'")
    j = t(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.max(F.col("o_orderdate").cast("date")).alias("last"))
    k = F.col("c_custkey")
    u = j.select(k.alias("id"), F.when(k % 50 != 0, F.col("n")).alias("events"), F.datediff(F.lit("2002-01-01").cast("date"), F.col("last")).alias("days"), F.when(k % 2 == 0, 3650).otherwise(90).alias("horizon"), lookup({0: "critical", 1: "normal", 2: "important"}, k % 3).alias("crit"), (k % 7).alias("cites"))
    u = u.withColumn("usage", P.usage(F.col("days"), F.col("events"), F.col("horizon")))
    return u.withColumn("criticality", P.downgraded(F.col("crit"), F.col("cites")))


@query(f"WITH {_USE_SQL} SELECT id, usage FROM w")
def usage_horizon(spark, d):
    return _use(spark, d).select("id", "usage")


@query(f"""WITH {_USE_SQL} SELECT id, criticality, CASE WHEN cites = 0 OR usage = 'unknown' THEN 'DEFER' WHEN usage = 'never' THEN CASE WHEN criticality = 'critical' THEN 'DEFER' ELSE 'DROP' END
WHEN criticality IN ('critical', 'important') THEN 'KEEP' WHEN usage = 'dormant' THEN 'DROP' ELSE 'SIMPLIFY' END AS verdict FROM w""")
def verdict_matrix(spark, d):
    return _use(spark, d).select("id", "criticality", P.verdict(F.col("usage"), F.col("criticality"), F.col("cites")).alias("verdict"))


@query("""WITH a AS (SELECT l_orderkey AS k, round(sum(CAST(l_extendedprice AS DECIMAL(20, 2))), 2) AS ours FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, o_totalprice AS theirs FROM orders),
j AS (SELECT coalesce(a.k, b.k) AS k, CAST(ours AS DOUBLE) AS ours, theirs FROM a FULL JOIN b ON a.k = b.k) SELECT k AS o_orderkey, ours, theirs,
CASE WHEN abs(ours - theirs) <= 20000 THEN 'equal' WHEN k % 10 = 0 THEN 'legacy defect' WHEN k % 10 = 1 THEN 'registered' ELSE 'unexplained' END AS outcome FROM j""")
def replay_diff(spark, d):
    ours = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(20,2)")).cast("double").alias("ours"))
    theirs = t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("theirs"))
    register = theirs.filter("o_orderkey % 10 < 2").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "legacy").otherwise("agreed").alias("reason"))
    return P.replay(ours, theirs, register, "o_orderkey", 20000)


@query("""WITH ch(scope, begin, regime) AS (SELECT r_regionkey, TIMESTAMP '1996-01-01' + INTERVAL 1 YEAR * (r_regionkey + y), 'R' || y FROM region, (VALUES (0), (2)) v(y)),
f AS (SELECT o_orderkey, o_custkey % 5 AS scope, o_orderdate FROM orders) SELECT o_orderkey, (SELECT arg_max(regime, begin) FROM ch WHERE ch.scope = f.scope AND ch.begin <= f.o_orderdate) AS regime FROM f""")
def regime_in_force(spark, d):
    """Which configuration was in force at an order's time."""
    years = spark.createDataFrame([(0,), (2,)], "y int")
    ch = t(spark, d, "region").crossJoin(years).select(F.col("r_regionkey").cast("long").alias("scope"), F.make_timestamp_ntz(1996 + F.col("r_regionkey") + F.col("y"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("begin"), F.concat(F.lit("R"), "y").alias("regime"))
    facts = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("long").alias("scope"), F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    return P.regimes(facts, ch, "o_orderdate", "begin").select("o_orderkey", "regime")


@query("""SELECT user_id, event_type, ts_day, n FROM (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS ts_day, count(*) AS n, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY count(*) DESC, user_id, event_type) AS k FROM events GROUP BY 1, 2, 3) WHERE k <= 3""")
def top_per_day(spark, d):
    """Top k by group, ties by key."""
    n = t(spark, d, "events").groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("ts_day")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("ts_day").orderBy(F.desc("n"), "user_id", "event_type")
    return n.withColumn("k", F.row_number().over(order)).filter("k <= 3").drop("k")
