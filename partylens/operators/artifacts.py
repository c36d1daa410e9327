"""Checks across a teardown's artifacts: required files, identities, citations, graph, pairs, state and recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partylens.operators.constraints import duplicates, outside, requires, together, violations

def required_files(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """V-01: required files (path) that aren't there."""
    return violations(wanted.join(found.select("path").distinct(), "path", "left_anti"), "V-01", "path", "required file is missing")


def shape(rows: DataFrame, check: str, entity: str, needed: list[str], enums: dict[str, list[str]], lists: list[str] = ()) -> DataFrame:
    """V-02 to V-06: what a record must have: columns that aren't null, values of a set where there are any, lists without repeats."""
    parts = [requires(rows, check, entity, F.lit(True), F.col(c).isNotNull(), f"{c} is missing") for c in needed]
    parts += [outside(rows.filter(F.col(c).isNotNull()), check, entity, c, allowed) for c, allowed in enums.items()]
    parts += [requires(rows, check, entity, F.col(c).isNotNull(), F.size(F.array_distinct(c)) == F.size(c), f"{c} repeats") for c in lists]
    return together(parts)


def citation_rules(citations: DataFrame) -> DataFrame:
    """V-08 and V-09 over (feature, evidence_id, derived_from): repeated ids, parents that don't exist."""
    parents = citations.select("evidence_id", F.explode("derived_from").alias("parent"))
    lost = parents.join(citations.select(F.col("evidence_id").alias("parent")).distinct(), "parent", "left_anti")
    return together([duplicates(citations, "V-08", ["evidence_id"], "evidence"), violations(lost, "V-09", F.concat_ws(">", "evidence_id", "parent"), "unknown parent")])


def graph_rules(nodes: DataFrame, edges: DataFrame, citations: DataFrame) -> DataFrame:
    """V-13, V-14, V-16 and V-17: repeated nodes and edges, edges on unknown evidence or on none that supports dependency."""
    name = F.concat_ws(">", "from_id", "to_id", "type")
    cited = edges.select("from_id", "to_id", "type", F.explode("evidence_ids").alias("evidence_id")).join(citations.select("evidence_id", "supports", F.lit(True).alias("known")).dropDuplicates(["evidence_id"]), "evidence_id", "left")
    unknown = cited.filter("known is null").select("from_id", "to_id", "type", "evidence_id").distinct()
    whole = cited.groupBy("from_id", "to_id", "type").agg(F.bool_and(F.col("known").isNotNull()).alias("all_known"), F.bool_or(F.coalesce(F.array_contains("supports", "dependency"), F.lit(False))).alias("supported"))
    return together([
        duplicates(nodes, "V-13", ["id"], "node"), duplicates(edges, "V-14", ["from_id", "to_id", "type"], "edge"),
        violations(unknown, "V-16", name, F.concat(F.lit("unknown evidence "), "evidence_id")), violations(whole.filter("all_known and not supported"), "V-17", name, "no evidence of dependency"),
    ])


def feature_node_rules(features: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """V-23 to V-27 over features (id, verdict, business_processes): their nodes, their processes' nodes and supports edges."""
    n = nodes.select(F.col("id"), F.col("type").alias("node_type"), F.col("verdict").alias("node_verdict"), F.lit(True).alias("there"))
    met = features.join(n, "id", "left")
    there = met.filter("there")
    processes = there.select("id", F.explode("business_processes").alias("process"))
    typed = nodes.filter("type = 'business-process'").select(F.col("id").alias("process")).distinct()
    supports = edges.filter("type = 'supports'").select(F.col("from_id").alias("id"), F.col("to_id").alias("process")).distinct()
    both = F.concat_ws(">", "id", "process")
    return together([
        violations(met.filter("there is null"), "V-23", "id", "no node"), violations(there.filter("node_type is distinct from 'feature'"), "V-24", "id", "node of the wrong type"),
        violations(there.filter("coalesce(verdict, '') <> '' and node_verdict is distinct from verdict"), "V-25", "id", "verdicts differ"),
        violations(processes.join(typed, "process", "left_anti"), "V-26", both, "no process node"), violations(processes.join(supports, ["id", "process"], "left_anti"), "V-27", both, "no supports edge"),
    ])


def state_rules(state: DataFrame, pairs: DataFrame, preserved: DataFrame) -> DataFrame:
    """V-28, V-29, V-34, V-35 and V-40 of one state (teardown_id, pairs_file) and its pairs and preserved artifacts."""
    own = F.broadcast(state.select(F.col("teardown_id").alias("own"), "pairs_file"))
    p, a = pairs.crossJoin(own), preserved.crossJoin(own)
    held = a.filter((F.col("category") == "replay-corpus") & F.array_contains("files", F.col("pairs_file"))).crossJoin(pairs.agg(F.count("*").alias("n")))
    return together([
        duplicates(pairs, "V-28", ["pair_id"], "pair"), violations(p.filter("teardown_id is distinct from own"), "V-29", "pair_id", "of another teardown"),
        violations(a.filter("teardown_id is distinct from own"), "V-34", "id", "of another teardown"), duplicates(preserved, "V-35", ["id"], "artifact"),
        violations(held.filter("record_count is distinct from n"), "V-40", "id", F.concat(F.coalesce(F.col("record_count").cast("string"), F.lit("null")), F.lit(" of "), "n", F.lit(" pairs"))),
    ])


def named_paths(told: DataFrame, found: DataFrame) -> DataFrame:
    """V-32 and V-33 over a state's artifact paths (name, path): outside of the folder, or missing.

    A path is resolved part by part: . is passed over, .. goes up, and what goes above the root is outside.
    """
    deep = F.aggregate(F.split("path", "/"), F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out")), lambda s, x: F.struct(
        F.when(x.isin("", "."), s["depth"]).when(x == "..", s["depth"] - 1).otherwise(s["depth"] + 1).alias("depth"), (s["out"] | ((x == "..") & (s["depth"] <= 0))).alias("out")))
    marked = told.withColumn("outside", F.startswith("path", F.lit("/")) | deep["out"])
    lost = marked.filter("not outside").join(found.select("path").distinct(), "path", "left_anti")
    return together([violations(marked.filter("outside"), "V-32", "name", "path leaves the folder"), violations(lost, "V-33", "name", "file is missing")])


def state_ids(preflight: DataFrame, decisions: DataFrame) -> DataFrame:
    """V-31: repeated ids of preflight checks and of decisions."""
    return together([duplicates(preflight, "V-31", ["id"], "preflight"), duplicates(decisions, "V-31", ["id"], "decision")])


def complete_state(states: DataFrame, artifacts: int = 5) -> DataFrame:
    """C-13: a complete teardown has reached phase 5 and names five artifacts."""
    return requires(states, "C-13", "teardown_id", F.col("status") == "complete", (F.col("phase") == 5) & (F.size("artifacts") >= artifacts), "complete without phase 5 or its artifacts")


def corpus_rules(apps: DataFrame, recipes: DataFrame, today: str, wanted: int = 100) -> DataFrame:
    """C-15 over apps (rank, app, category) and recipes (app, file, category, tos_url, sources, last_reviewed)."""
    ranks = apps.agg(F.count("*").alias("n"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    wrong = ranks.filter((F.col("n") != wanted) | (F.col("ranks") != wanted) | (F.col("lo") != 1) | (F.col("hi") != wanted))
    index = apps.select("app", F.col("category").alias("of_app"))
    met = recipes.join(index, "app", "left")
    urls = recipes.withColumn("bad", F.size(F.filter("sources", lambda u: ~u.rlike("^https://"))))
    return together([
        violations(wrong, "C-15", F.lit("apps"), F.concat(F.lit("ranks: "), "ranks", F.lit(" of "), F.lit(wanted))), duplicates(apps, "C-15", ["app"], "app"),
        violations(met.filter("of_app is null"), "C-15", "app", "recipe of no listed app"), violations(met.filter("of_app <> category"), "C-15", "app", "category differs"),
        violations(recipes.filter("file <> concat(app, '.json')"), "C-15", "app", "file isn't named after the app"), violations(urls.filter("bad > 0"), "C-15", "app", "source is no https"),
        violations(recipes.filter(F.size(F.array_distinct("sources")) < F.size("sources")), "C-15", "app", "source repeats"), violations(recipes.filter(~F.array_contains("sources", F.col("tos_url"))), "C-15", "app", "terms aren't among the sources"),
        violations(recipes.filter(F.col("last_reviewed") > today), "C-15", "app", "reviewed in the future"),
    ])


def route_counts(recipes: DataFrame) -> DataFrame:
    """(route_type, routes, recipes): how often each way of extraction is told."""
    return recipes.select("app", F.explode("routes").alias("route_type")).groupBy("route_type").agg(F.count("*").alias("routes"), F.countDistinct("app").alias("recipes"))
