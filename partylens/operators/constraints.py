"""Integrity constraints as queries: each gives its violations (check_id, entity_id, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, check: str, entity: Column | str, message: Column | str) -> DataFrame:
    told = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(check).alias("check_id"), (F.col(entity) if isinstance(entity, str) else entity).cast("string").alias("entity_id"), told.alias("message"))


def duplicates(df: DataFrame, check: str, keys: list[str], what: str) -> DataFrame:
    """Keys that stand more than once."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return violations(twice, check, F.concat_ws("/", *keys), F.concat(F.lit(f"duplicate {what}: "), F.col("n").cast("string")))


def missing(df: DataFrame, check: str, column: str, known: DataFrame, key: str, what: str) -> DataFrame:
    """Values of a column that ``known`` lacks."""
    return violations(df.join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(column).distinct(), check, column, f"unknown {what}")


def outside(df: DataFrame, check: str, entity: str, column: str, allowed: list[str]) -> DataFrame:
    bad = df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
    return violations(bad, check, entity, F.concat(F.lit(f"{column} is "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))


def requires(df: DataFrame, check: str, entity: str, when: Column, then: Column, message: str) -> DataFrame:
    """A conditional: rows where ``when`` holds and ``then`` doesn't, null counting as not."""
    return violations(df.filter(when & ~F.coalesce(then, F.lit(False))), check, entity, message)


def leaks(df: DataFrame, check: str, group: str, role: str) -> DataFrame:
    """Groups with more than one role: held-out data that training has seen."""
    roles = df.groupBy(group).agg(F.array_sort(F.collect_set(role)).alias("roles")).filter(F.size("roles") > 1)
    return violations(roles, check, group, F.array_join("roles", ","))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def typed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are missing or of the wrong type (V-15, V-18 to V-22)."""
    wanted = {"reads": "entity", "writes": "entity", "joins-on": "entity", "triggers": "script", "exports-to": "integration", "supports": "business-process"}
    a = nodes.select(F.col("id").alias("from_id"), F.col("type").alias("from_type"))
    b = nodes.select(F.col("id").alias("to_id"), F.col("type").alias("to_type"))
    both = edges.join(a, "from_id", "left").join(b, "to_id", "left")
    name = F.concat_ws(">", "from_id", "to_id", "type")
    need = F.element_at(F.create_map(*[F.lit(x) for p in wanted.items() for x in p]), F.col("type"))
    wrong = F.col("to_type").isNotNull() & ((F.col("to_type") != need) | ((F.col("type") == "joins-on") & (F.col("from_type") != "report")))
    return together([
        violations(both.filter("from_type is null"), "V-15", name, "from is missing"),
        violations(both.filter("to_type is null"), "V-15", name, "to is missing"),
        violations(both.filter(wrong), "V-18", name, F.concat(F.col("type"), F.lit(" to "), F.col("to_type"))),
    ])


#: Why a feature was never used.
UNUSED_REASONS = ("never-needed", "too-complex", "duplicate", "wrong-fit", "configured-never-enabled", "unknown")


def usage_rules(features: DataFrame) -> DataFrame:
    """V-10 to V-12 and C-01 to C-04 over features with evidence ARRAY<STRUCT<evidence_class, supports, coverage>>."""
    def any_of(f):
        return F.exists("evidence", f)

    supports = lambda what: any_of(lambda e: F.array_contains(e["supports"], what))
    usage, verdict = F.col("usage"), F.col("verdict")
    runtime = any_of(lambda e: (e["evidence_class"] == "runtime") & F.array_contains(e["supports"], "usage"))
    all_time = any_of(lambda e: (e["evidence_class"] == "runtime") & (e["coverage"] == "all-time"))
    return together([
        requires(features, "V-10", "id", usage.isNotNull() & (usage != "unknown"), runtime, "usage without runtime evidence"),
        requires(features, "V-11", "id", usage == "never", all_time, "never used, without evidence of all time"),
        requires(features, "V-12", "id", usage == "unknown", verdict.isNull() | (verdict == "DEFER"), "unknown usage with a verdict"),
        requires(features, "C-01", "id", verdict.isNotNull(), (F.col("why") != "") & supports("verdict"), "verdict without reason or evidence"),
        requires(features, "C-02", "id", usage != "unknown", supports("usage"), "usage without evidence"),
        requires(features, "C-03", "id", usage == "never", F.col("unused_reason").isin(*UNUSED_REASONS), "never used, without reason"),
        requires(features, "C-04", "id", F.col("criticality") == "critical", (F.size("business_processes") > 0) & supports("criticality"), "critical without process or evidence"),
    ])


def pair_rules(pairs: DataFrame) -> DataFrame:
    """C-06 to C-11 over pairs (pair_id, pair_type, label_authority, dataset_role, evidence count, replay_context, tier, reviewer)."""
    kind, authority = F.col("pair_type"), F.col("label_authority")
    held = F.col("evidence") > 0
    return together([
        requires(pairs, "C-06", "pair_id", kind == "replay", F.col("replay_context").isNotNull() & (authority == "system-of-record"), "replay without context or record"),
        requires(pairs, "C-07", "pair_id", kind == "perception", authority == "observed-ui", "perception not from the interface"),
        requires(pairs, "C-08", "pair_id", kind == "judgment", (authority == "analyst") & held, "judgment without analyst or evidence"),
        requires(pairs, "C-09", "pair_id", kind == "design", authority.isin("analyst", "validated-design") & held, "design without authority or evidence"),
        requires(pairs, "C-10", "pair_id", F.col("tier") == "sanitized-shareable", F.col("reviewer").isNotNull(), "shared without review"),
        requires(pairs, "C-11", "pair_id", F.col("dataset_role") == "holdout-eval", authority != "analyst", "held-out label by an analyst"),
    ])


def preservation_rules(artifacts: DataFrame) -> DataFrame:
    """C-12 over artifacts (id, status, files count, verified_at, gap, sensitivity, encrypted, backed_up)."""
    exported, secret = F.col("status") == "exported", F.col("sensitivity").isin("confidential", "restricted")
    return together([
        requires(artifacts, "C-12a", "id", exported, (F.col("files") > 0) & F.col("verified_at").isNotNull(), "exported without files or check"),
        requires(artifacts, "C-12b", "id", F.col("status") != "exported", F.col("gap").isNotNull(), "not exported, without a gap told"),
        requires(artifacts, "C-12c", "id", exported & secret, F.col("encrypted") & F.col("backed_up"), "secret export not protected"),
    ])


PATTERNS = {"kebab": "^[a-z0-9]+(-[a-z0-9]+)*$", "sha256": "^[0-9a-f]{64}$", "https": "^https://[^ ]+$", "timestamp": "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"}


def pattern(df: DataFrame, check: str, entity: str, column: str, kind: str) -> DataFrame:
    """C-14: values that aren't of a kind."""
    return requires(df, check, entity, F.col(column).isNotNull(), F.col(column).rlike(PATTERNS[kind]), f"{column} is no {kind}")


def file_rules(told: DataFrame, found: DataFrame) -> DataFrame:
    """V-36 to V-41: told files (artifact, path, bytes, sha256) against those found (path, bytes, sha256)."""
    outside_root = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    there = found.select("path", F.col("bytes").alias("real_bytes"), F.col("sha256").alias("real_sha256"))
    both = told.filter(~outside_root).join(there, "path", "left")
    twice = told.groupBy("path").agg(F.countDistinct("artifact").alias("n")).filter("n > 1")
    return together([
        violations(told.filter(outside_root), "V-36", "path", "path leaves the folder"),
        violations(both.filter("real_bytes is null"), "V-37", "path", "file is missing"),
        violations(both.filter("real_bytes <> bytes"), "V-38", "path", "size differs"),
        violations(both.filter("real_sha256 <> sha256"), "V-39", "path", "digest differs"),
        violations(twice, "V-41", "path", "file of several artifacts"),
    ])
