"""Scans, sinks and gates, on files that are written from the tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partylens.operators import screening as S
from partylens.operators.runs import lookup
from partylens.plans.registry import query, t
from partylens.plans.screen_sql import words
from partylens.sources import delimited as D
from partylens.sources import sinks as K
from partylens.sources import snapshot as N
from partylens.storage import fresh

_LABELS = {"Entity List": "EL", "SDN": "SDN", "CAPTA List": "NONSDN", "Some List": "UNKNOWN"}


def _written(df: DataFrame, sep: str = ",", header: bool = True) -> str:
    path = fresh(df.sparkSession)
    df.write.option("header", header).option("sep", sep).option("escape", '"').option("emptyValue", "").csv(path)
    return path


def _in_order(df: DataFrame, by: str) -> DataFrame:
    """One file, as ordinals run through a file."""
    return df.repartition(1).sortWithinPartitions(by)


def _joined(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_join(f.name, "; ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields])


_CSL = f"""WITH x AS (SELECT c_custkey AS k, c_custkey % 4 AS m, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_name || ', "Ltd"' END AS name FROM customer),
p AS (SELECT *, {words(_LABELS.values())}[CAST(m AS INTEGER) + 1] AS source FROM x WHERE name <> '')"""


def _csl(spark, d) -> str:
    k = F.col("c_custkey")
    return _written(t(spark, d, "customer").select(
        k.alias("Entity Number"), lookup(dict(enumerate(_LABELS)), (k % 4).cast("int")).alias("Source"), F.when(k % 3 == 0, "Individual").otherwise("Company X").alias("Type"), F.when(k % 10 == 0, " -0- ").otherwise(F.concat("c_name", F.lit(', "Ltd"'))).alias("Name"),
        F.concat(F.lit("a"), k, F.lit("; b|; c")).alias("Alt Names"), F.concat(F.lit("Street "), k).alias("Addresses"), F.when(k % 2 == 0, "DE; FR").alias("Countries"), F.when(k % 5 == 0, "1970").alias("DOB"), F.lit("denial").alias("License_Policy"), F.lit("z").alias("Unknown Column"),
    ))


@query(f"""{_CSL} SELECT source || ':' || k AS uid, source, name, CASE WHEN k % 3 = 0 THEN 'individual' ELSE 'entity' END AS party_type, 'a' || k || '; b; c' AS aliases, 'Street ' || k AS addresses, CASE WHEN k % 2 = 0 THEN 'DE; FR' ELSE '' END AS countries, CASE WHEN k % 5 = 0 THEN 'DOB: 1970' ELSE '' END AS ids, 'license policy: denial' AS remarks FROM p""")
def scan_consolidated(spark, d):
    """A consolidated list: headers by alias, lists by exact label, blank names rejected, discriminators among the ids."""
    return _joined(D.headed_list(spark, _csl(spark, d))[0].select("uid", "source", "name", "party_type", "aliases", "addresses", "countries", "ids", "remarks"))


@query(f"{_CSL} SELECT 'EL:' || k AS uid FROM p WHERE source = 'EL'")
def scan_one_list(spark, d):
    return D.headed_list(spark, _csl(spark, d), only="EL")[0].select("uid")


@query(f"""{_CSL} SELECT 'rejected' AS what, CAST(NULL AS VARCHAR) AS told, count(*) AS n FROM x WHERE name = '' UNION ALL SELECT 'label', 'Some List', count(*) FROM x WHERE m = 3 UNION ALL SELECT 'header', 'unknown_column', 1""")
def scan_reports(spark, d):
    """What a scan tells: blank names, labels without a list, headers that nothing takes."""
    path = _csl(spark, d)
    rejects = D.headed_list(spark, path)[1].agg(F.lit("rejected").alias("what"), F.lit(None).cast("string").alias("told"), F.count("*").alias("n"))
    labels = D.unknown_labels(spark, path).select(F.lit("label").alias("what"), F.col("label").alias("told"), "n")
    headers = D.unmapped(D.records(spark, path), D.LIST_FIELDS).select(F.lit("header").alias("what"), F.col("header").alias("told")).distinct().withColumn("n", F.lit(1).cast("long"))
    return rejects.unionByName(labels).unionByName(headers)


@query("""WITH o AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS ord FROM supplier) SELECT 'DPL:' || ord AS uid, s_name AS name, '1 A St, Town, ' || s_suppkey || ', US' AS addresses, 'denied' AS remarks, '2/1/2024' AS begins FROM o WHERE s_suppkey % 9 <> 0""")
def scan_orders_list(spark, d):
    """The tab-delimited list: ordinals as ids, which count the rejected rows too, and an address in parts."""
    k = F.col("s_suppkey")
    rows = t(spark, d, "supplier").select(k, F.when(k % 9 != 0, F.col("s_name")).alias("Name"), F.lit("1 A St").alias("Street_Address"), F.lit("Town").alias("City"), k.alias("Postal_Code"), F.lit("US").alias("Country"), F.lit("denied").alias("Action"), F.lit("2/1/2024").alias("Effective_Date"))
    path = _written(_in_order(rows, "s_suppkey").drop("s_suppkey"), "\t")
    return _joined(D.headed_list(spark, path, "\t", code="DPL", ordinal_ids=True)[0].select("uid", "name", "addresses", "remarks", F.col("begin").alias("begins")))


def _positional(spark, d) -> tuple[str, str, str]:
    k, none = F.col("s_suppkey"), F.lit("-0-")
    main = t(spark, d, "supplier").select(k, F.col("s_name").alias("n"), F.when(k % 2 == 0, "individual").otherwise(none).alias("t"), F.lit("X] [Y").alias("p"), *[none.alias(f"e{i}") for i in range(7)], F.when(k % 3 == 0, "noted").otherwise(none).alias("r"))
    c = F.col("c_custkey")
    other = _in_order(t(spark, d, "customer").select(c), "c_custkey")
    alt = other.select((c % 200).alias("a"), c.alias("b"), F.lit("aka").alias("k"), F.concat(F.lit("alias "), c).alias("n"), none.alias("r"))
    add = other.select((c % 70).alias("a"), c.alias("b"), F.concat(c, F.lit(" Main, St")).alias("s"), none.alias("z"), F.when(c % 2 == 0, "Land").otherwise("Isle").alias("l"))
    return tuple(_written(x, header=False) for x in (main, alt, add))


@query("""WITH alt AS (SELECT c_custkey % 200 AS k, string_agg('alias ' || c_custkey, '; ' ORDER BY c_custkey) AS aliases FROM customer GROUP BY 1), pl AS (SELECT c_custkey, c_custkey % 70 AS k, CASE WHEN c_custkey % 2 = 0 THEN 'Land' ELSE 'Isle' END AS land FROM customer),
ad AS (SELECT k, string_agg(c_custkey || ' Main, St, ' || land, '; ' ORDER BY c_custkey) AS addresses FROM pl GROUP BY k), f AS (SELECT k, land, min(c_custkey) AS pos FROM pl GROUP BY ALL), ct AS (SELECT k, string_agg(land, '; ' ORDER BY pos) AS countries FROM f GROUP BY k)
SELECT 'SDN:' || s_suppkey AS uid, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'individual' ELSE 'unknown' END AS party_type, 'X; Y' AS programs, CASE WHEN s_suppkey % 3 = 0 THEN 'noted' ELSE '' END AS remarks, coalesce(aliases, '') AS aliases, coalesce(addresses, '') AS addresses, coalesce(countries, '') AS countries
FROM supplier LEFT JOIN alt ON alt.k = s_suppkey LEFT JOIN ad ON ad.k = s_suppkey LEFT JOIN ct ON ct.k = s_suppkey""")
def scan_positional(spark, d):
    """The headerless list with its side files of aliases and addresses."""
    main, alt, add = _positional(spark, d)
    return _joined(D.with_side_files(D.sdn(spark, main), spark, alt, add).select("uid", "name", "party_type", "programs", "remarks", "aliases", "addresses", "countries"))


@query("SELECT DISTINCT CAST(c_custkey % 200 AS VARCHAR) AS native_id FROM customer WHERE c_custkey % 200 NOT IN (SELECT s_suppkey FROM supplier)")
def scan_orphans(spark, d):
    """Aliases of entities that the main file lacks: the files are out of step."""
    main, alt, _ = _positional(spark, d)
    return D.orphan_aliases(D.sdn(spark, main), spark, alt)


@query("SELECT count(*) AS rows, count(*) AS known, false AS drifted FROM supplier UNION ALL SELECT count(*), 0, count(*) >= 5 FROM customer")
def scan_drift(spark, d):
    """The type column of the list holds types; that of the file of addresses, read as the list, doesn't."""
    main, _, add = _positional(spark, d)
    return D.drift(spark, main).unionByName(D.drift(spark, add))


_BOOK = """WITH b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE o_clerk END AS name, o_orderkey % 3 AS m FROM (SELECT o_orderkey, 'Clerk ' || o_custkey || CASE WHEN o_orderkey % 50 = 1 THEN repeat('é', 300) ELSE '' END AS o_clerk FROM orders))"""


def _book(spark, d) -> str:
    k = F.col("o_orderkey")
    clerk = F.concat(F.lit("Clerk "), "o_custkey", F.when(k % 50 == 1, F.repeat(F.lit("é"), 300)).otherwise(""))
    many = F.when(k % 100 == 3, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("n"), i)), "; ")).otherwise("x|y ;")
    return _written(t(spark, d, "orders").select(k.alias("Customer ID"), F.when(k % 8 != 0, clerk).alias("Company"), F.when(k % 3 == 0, "vessel").when(k % 3 == 1, "Vessel").alias("Type"), F.lit("DE").alias("Country"), F.when(k % 5 == 0, "FR").alias("Destination"), many.alias("AKA")))


@query(f"""{_BOOK} SELECT CAST(k AS VARCHAR) AS ref, left(name, 256) AS name, CASE WHEN m = 0 THEN 'vessel' ELSE 'unknown' END AS party_type, CASE WHEN k % 5 = 0 THEN 'FR' ELSE 'DE' END AS destination_country, CASE WHEN k % 100 = 3 THEN array_to_string(list_transform(range(1, 51), lambda i: 'n' || i), '; ') ELSE 'x; y' END AS aliases FROM b WHERE name <> ''""")
def scan_party_file(spark, d):
    """An operator's own file: refs, the case of types, destinations, bounded names and aliases."""
    return _joined(D.party_file(spark, _book(spark, d))[0].select("ref", "name", "party_type", "destination_country", "aliases"))


@query(f"{_BOOK} SELECT 'blank name' AS warning, count(*) AS n FROM b WHERE name = '' UNION ALL SELECT 'name cut', count(*) FROM b WHERE length(name) > 256 UNION ALL SELECT 'aliases cut', count(*) FROM b WHERE k % 100 = 3")
def scan_party_warnings(spark, d):
    return D.party_file(spark, _book(spark, d))[1].groupBy("warning").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT c_nationkey AS uid, c_custkey AS ord, c_name AS name, c_mktsegment AS a FROM customer), one AS (SELECT uid, arg_min(name, ord) AS name FROM p GROUP BY uid), al AS (SELECT uid, lower(a) AS a, min(ord) AS pos FROM p GROUP BY ALL), ag AS (SELECT uid, string_agg(a, '; ' ORDER BY pos) AS aliases FROM al GROUP BY uid)
SELECT CAST(uid AS VARCHAR) AS uid, name, aliases FROM one JOIN ag USING (uid)""")
def scan_dedupe(spark, d):
    """Parties of one uid: the first row stays, aliases of all are merged without regard to case."""
    k = F.col("c_custkey")
    alias = F.when(k % 2 == 0, F.lower("c_mktsegment")).otherwise(F.upper("c_mktsegment"))
    none = F.array().cast("array<string>")
    p = t(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("uid"), k.alias("ord"), F.col("c_name").alias("name"), F.array(alias).alias("aliases"), none.alias("addresses"), none.alias("countries"), F.lit("").alias("remarks"))
    return D.dedupe(p).select("uid", "name", F.lower(F.array_join("aliases", "; ")).alias("aliases"))


_LINES = "WITH l AS (SELECT event_id, event_id % 4 AS m FROM events)"


@query(f"{_LINES} SELECT CASE m WHEN 0 THEN 'no JSON' WHEN 1 THEN 'no object' ELSE 'row' END AS what, count(*) AS n, CAST(coalesce(sum(CASE WHEN m >= 2 THEN event_id END), 0) AS BIGINT) AS ids FROM l GROUP BY 1")
def scan_json_lines(spark, d):
    """A JSON-lines file with broken lines and lines that are no object, which are told by number."""
    k = F.col("event_id")
    line = F.when(k % 4 == 0, "{broken").when(k % 4 == 1, "[1]").otherwise(F.to_json(F.struct(k.alias("id"))))
    path = fresh(spark)
    t(spark, d, "events").select(line.alias("value")).write.text(path)
    rows, errors = N.json_lines(spark, path, "id long")
    told = errors.groupBy(F.col("error").alias("what")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("ids"))
    return rows.agg(F.lit("row").alias("what"), F.count("*").alias("n"), F.sum("id").alias("ids")).unionByName(told)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS ref, o_orderpriority || ', "q"' AS name, CASE o_orderstatus WHEN 'F' THEN 'CLEAR' WHEN 'O' THEN 'REVIEW' ELSE 'BLOCKED' END AS disposition, 'A.B;C' AS rule_flags FROM orders""")
def sink_csv(spark, d):
    """Dispositions written as CSV, arrays joined, and read back."""
    kind = F.when(F.col("o_orderstatus") == "F", "CLEAR").when(F.col("o_orderstatus") == "O", "REVIEW").otherwise("BLOCKED")
    results = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("ref"), F.concat("o_orderpriority", F.lit(', "q"')).alias("name"), kind.alias("disposition"), F.array(F.lit("A.B"), F.lit("C")).alias("rule_flags"))
    path = fresh(spark)
    K.write_csv(results, path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE '' END || '/' || c_name AS parts, c_acctbal AS score FROM customer")
def sink_json(spark, d):
    """Nested results written as JSON lines and read back."""
    k = F.col("c_custkey")
    path = fresh(spark)
    K.write_json(t(spark, d, "customer").select(k.alias("subject_id"), F.struct(F.when(k % 2 == 0, "X").alias("a"), F.col("c_name").alias("b")).alias("parts"), F.col("c_acctbal").alias("score")), path)
    back = N.read_corpus(spark, path, "subject_id long, parts struct<a: string, b: string>, score double")
    return back.select("subject_id", F.concat_ws("/", F.coalesce("parts.a", F.lit("")), "parts.b").alias("parts"), "score")


@query(r"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '|', '\|'), '`', '\`'), '[', '\['), ']', '\]'), '<', '&lt;'), '>', '&gt;'), '[\r\n]+', ' ', 'g')) AS escaped FROM documents""")
def sink_escape(spark, d):
    return t(spark, d, "documents").select("doc_id", K.escaped(F.col("text")).alias("escaped"))


@query("""WITH f AS (SELECT ['CSL', 'DPL', 'NONSDN', 'SDN', 'SDN_ALT'][r_regionkey + 1] AS code, count(n_nationkey) FILTER (n_nationkey % 2 = 0) AS parties, CASE WHEN r_regionkey = 1 THEN 'timeout' END AS error FROM region LEFT JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 GROUP BY r_regionkey)
SELECT code, CASE WHEN error IS NOT NULL OR (parties = 0 AND code <> 'SDN_ALT') THEN 'degraded' ELSE 'ok' END AS state FROM f UNION ALL SELECT 'NONSDN', 'missing'""")
def gate_coverage(spark, d):
    """The lists that are missing or degraded; a region stands for a list, its even nations for parties."""
    r, n = t(spark, d, "region"), t(spark, d, "nation")
    files = r.filter("r_regionkey <> 2").join(n.filter("n_nationkey % 2 = 0"), F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_regionkey").agg(F.count("n_nationkey").alias("parties"))
    files = files.select(lookup(dict(enumerate(N.EXPECTED)), F.col("r_regionkey").cast("int")).alias("code"), "parties", F.when(F.col("r_regionkey") == 1, "timeout").alias("error"))
    missing, degraded = N.coverage(files)
    return spark.createDataFrame([(c, "missing" if c in missing else "degraded" if c in degraded else "ok") for c in N.EXPECTED], "code string, state string")


@query("SELECT round(epoch(TIMESTAMP '2030-01-01 00:00:00' - min(ts)) / 86400.0, 6) AS age, true AS stale FROM events WHERE event_type <> 'error'")
def gate_age(spark, d):
    """How old the oldest good fetch is; an event stands for a fetch."""
    files = t(spark, d, "events").select(F.col("ts").cast("string").alias("fetched_at"), F.when(F.col("event_type") == "error", "x").alias("error"))
    age = N.age_days(files, "2030-01-01 00:00:00")
    return spark.createDataFrame([(round(age, 6), age > N.STALE_DAYS)], "age double, stale boolean")


@query("""WITH x AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(left(n_name, 3)) ELSE '' END AS country, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), y AS (SELECT c_custkey, lower(country) AS own, lower(CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'Nowhere' END) AS other FROM x)
SELECT c_custkey, CASE WHEN own = '' THEN 'insufficient' WHEN contains(own, other) OR contains(other, own) THEN 'agrees' ELSE 'differs' END AS evidence FROM (SELECT c_custkey, trim(regexp_replace(own, '[^a-z0-9_ ]', ' ', 'g')) AS own, trim(regexp_replace(other, '[^a-z0-9_ ]', ' ', 'g')) AS other FROM y)""")
def country_evidence(spark, d):
    """Whether a subject's country agrees with the listed ones, as text either way."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 1, F.lower(F.substring("n_name", 1, 3))).otherwise("")
    return c.select("c_custkey", S.country_evidence(own, F.array(F.when(k % 2 == 0, F.col("n_name")).otherwise("Nowhere"))).alias("evidence"))


_CANDIDATES = "WITH c AS (SELECT o_custkey AS subject_id, CAST(o_orderkey AS VARCHAR) AS uid, CAST(o_orderkey % 4 AS INTEGER) AS band_rank, round(o_totalprice, 2) AS score FROM orders)"


@query(f"{_CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY band_rank DESC, score DESC, uid) AS place FROM c) SELECT subject_id, uid, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10")
def candidate_order(spark, d):
    """A report's ten best candidates of each subject, in their total order."""
    k = F.col("o_orderkey")
    c = t(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"), k.cast("string").alias("uid"), (k % 4).cast("int").alias("band_rank"), F.round("o_totalprice", 2).alias("score"))
    return S.in_order(c, 10).select("subject_id", "uid", "place")


@query("""WITH a AS (SELECT o_custkey, list('o' || o_orderkey ORDER BY o_orderkey) AS l, string_agg(o_orderpriority, ' ' ORDER BY o_orderkey) AS r FROM orders GROUP BY o_custkey)
SELECT o_custkey AS uid, array_to_string(l[1:25], ',') AS aliases, array_to_string(l[1:10], ',') AS ids, left(r, 1500) AS remarks, CAST(greatest(0, len(l) - 25) + greatest(0, len(l) - 10) AS INTEGER) AS hidden FROM a""")
def reviewer_profile(spark, d):
    """What a reviewer is shown of a party: lists cut to their length, which is told."""
    inner = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", c.alias("v")))), lambda x: x["v"])
    a = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(inner(F.concat(F.lit("o"), "o_orderkey")).alias("aliases"), F.array_join(inner(F.col("o_orderpriority")), " ").alias("remarks"))
    a = a.withColumn("ids", F.col("aliases")).withColumn("addresses", F.lit(None).cast("array<string>")).withColumn("source", F.lit("S")).withColumn("name", F.lit("n"))
    return S.capped_profile(a).select("uid", F.array_join("aliases", ",").alias("aliases"), F.array_join("ids", ",").alias("ids"), "remarks", "hidden")
