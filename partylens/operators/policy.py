"""Destination policy as small tables, and the evaluation of all rule families into one long table of flags.

A policy has countries with tiers, regions with terms, transshipment places, aliases and known codes; all are
broadcast, as their size is that of the world's countries. A policy counts as verified once someone's name and a
day stand in it; until then its flags say so, and a country without an entry is flagged.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partylens.functions.names import fold, fold_any
from partylens.operators.audit import digest
from partylens.operators.rules import INTERMEDIARY, class_rules, flags, list_flags, phrases, text_rules
from partylens.operators.runs import SEVERITY, lookup

#: Tier of a country to its rule and severity; targeted counts only where no stronger tier does.
TIERS = {"comprehensive": ("DEST.COMPREHENSIVE", "prohibitive"), "extensive": ("DEST.EXTENSIVE", "license"), "itar_proscribed": ("DEST.ITAR126", "prohibitive"), "targeted": ("DEST.TARGETED", "diligence")}
#: Where each family's flags stand in order.
LIST, DESTINATION, USE, CLASS, SEARCH = range(0, 500, 100)


@dataclass
class Policy:
    countries: DataFrame  # iso, name, tiers
    regions: DataFrame  # region, terms
    transshipment: DataFrame  # iso
    aliases: DataFrame  # alias (folded), iso
    known: DataFrame  # iso
    as_of: str
    verified_by: str
    verified_on: str
    digest: str

    @property
    def verified(self) -> bool:
        return bool(self.verified_by and self.verified_on)

    def attest(self, by: str, on: str) -> Policy:
        """The same policy, verified by someone on a day."""
        return replace(self, verified_by=by, verified_on=on)


def from_dict(spark: SparkSession, raw: dict) -> Policy:
    """Tables of a policy; keys that begin with $ are remarks. Known codes are all that the policy names."""
    raw = {k: v for k, v in raw.items() if not k.startswith("$")}
    countries = spark.createDataFrame([(c["iso2"], c.get("name", ""), list(c.get("tiers", []))) for c in raw.get("countries", [])], "iso string, name string, tiers array<string>")
    regions = spark.createDataFrame([(r["name"], list(r.get("match_terms", []))) for r in raw.get("regions", [])], "region string, terms array<string>")
    watched = spark.createDataFrame([(c,) for c in raw.get("transshipment_watch", {}).get("countries", [])], "iso string")
    aliases = spark.createDataFrame([(k, v) for k, v in raw.get("aliases", {}).items() if not k.startswith("$")], "alias string, iso string").select(fold_any("alias").alias("alias"), "iso")
    listed = spark.createDataFrame([(c,) for c in raw.get("known_iso2", [])], "iso string")
    known = listed.union(countries.select("iso")).union(watched).union(aliases.select("iso")).distinct()
    return Policy(countries, regions, watched, aliases, known, raw.get("as_of", ""), raw.get("verified_by", ""), raw.get("verified_on", ""), digest(raw))


def load(spark: SparkSession, path: str) -> Policy:
    with open(path, encoding="utf-8") as f:
        return from_dict(spark, json.load(f))


def resolved(subjects: DataFrame, policy: Policy, raw: str = "raw_destination") -> DataFrame:
    """``subjects`` with iso: by alias, or a two-letter code that the policy knows; '' else, so that nothing is cleared by mistake."""
    folded = subjects.withColumn("__folded", fold(F.col(raw)))
    by_alias = policy.aliases.select(F.col("alias").alias("__folded"), F.col("iso").alias("__alias")).dropDuplicates(["__folded"])
    by_code = policy.known.select(F.lower("iso").alias("__folded"), F.col("iso").alias("__code")).filter(F.length("__folded") == 2)
    out = folded.join(F.broadcast(by_alias), "__folded", "left").join(F.broadcast(by_code), "__folded", "left")
    return out.withColumn("iso", F.coalesce("__alias", "__code", F.lit(""))).drop("__folded", "__alias", "__code")


def _with_texts(subjects: DataFrame) -> DataFrame:
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    raw = F.when(c("destination_country") != "", c("destination_country")).otherwise(c("country"))
    out = subjects.withColumn("raw_destination", raw)
    out = out.withColumn("place_text", fold(F.concat_ws(" ", c("address"), raw))).withColumn("role_text", fold(c("role")))
    return out.withColumn("use_text", fold(F.concat_ws(" ", c("item_description"), c("end_use"), c("role"))))


def destination_flags(subjects: DataFrame, policy: Policy) -> DataFrame:
    """(subject_id, ord, rule_id, severity, detail, unverified) by destination; a region counts whatever the country field says."""
    s = _with_texts(subjects) if "raw_destination" not in subjects.columns else subjects
    unsure = F.lit(not policy.verified)
    terms = policy.regions.select("region", F.explode("terms").alias("term"))
    # regions have a handful of terms, so each subject meets them all
    in_region = s.join(F.broadcast(terms), F.contains("place_text", "term")).select("subject_id", "region").distinct()
    regions = in_region.select("subject_id", F.lit(DESTINATION).alias("ord"), F.lit("DEST.REGION").alias("rule_id"), F.lit("prohibitive").alias("severity"), F.col("region").alias("detail"))
    of_country = policy.countries.select("iso", "tiers")
    at = resolved(s, policy).join(F.broadcast(of_country), "iso", "left").join(F.broadcast(policy.transshipment.distinct().withColumn("watched", F.lit(True))), "iso", "left")
    raw, iso, tiers = F.col("raw_destination"), F.col("iso"), F.coalesce("tiers", F.array().cast("array<string>"))
    has = lambda t: F.array_contains(tiers, t)
    watched, entry = F.coalesce("watched", F.lit(False)), F.col("tiers").isNotNull()
    rules = [("DEST.UNRESOLVED", "diligence", (iso == "") & (F.trim(raw) != "")), ("DEST.MISSING", "diligence", (iso == "") & (F.trim(raw) == ""))]
    for tier, (rule, severity) in TIERS.items():
        rules.append((rule, severity, has(tier) & ~(has("comprehensive") | has("extensive")) if tier == "targeted" else has(tier)))
    rules += [("DEST.NO_POLICY_ENTRY", "diligence", (iso != "") & ~entry & ~watched & unsure), ("DEST.TRANSSHIP", "diligence", watched)]
    told = F.when(iso != "", iso).otherwise(raw)
    by_rule = flags(at.withColumn("__id", F.struct("subject_id", told.alias("detail"))), "__id", rules)
    rest = by_rule.select("__id.subject_id", (F.col("ord") + DESTINATION + 1).alias("ord"), "rule_id", "severity", "__id.detail")
    return regions.unionByName(rest).withColumn("unverified", unsure)


def use_flags(subjects: DataFrame) -> DataFrame:
    """End use, what to know of a customer, and intermediaries; without any text only that it is missing."""
    s = _with_texts(subjects) if "use_text" not in subjects.columns else subjects
    text = F.col("use_text")
    intermediary = ("KYC.INTERMEDIARY", "diligence", (text != "") & (F.size(phrases(F.col("role_text"), INTERMEDIARY)) > 0))
    found = flags(s, "subject_id", [*text_rules(text), intermediary])
    return found.select("subject_id", (F.col("ord") + USE).alias("ord"), "rule_id", "severity", F.lit("").alias("detail"), F.lit(False).alias("unverified"))


def evaluate(subjects: DataFrame, candidates: DataFrame, policy: Policy, as_of: str, bounded: DataFrame | None = None) -> DataFrame:
    """All flags of all subjects, in the families' order: list hits, destination, use, classification, a bounded search.

    ``subjects`` has subject_id and the fields of a party file; ``candidates`` (subject_id, uid, source, party_type,
    begin, end); ``bounded`` (subject_id, left_out) of ``screening.bounded_searches``.
    """
    s = _with_texts(subjects)
    by_list = list_flags(candidates.withColumn("subject_id", F.struct("subject_id", "uid")), as_of)
    hits = by_list.select("subject_id.subject_id", (F.col("ord") + LIST).alias("ord"), "rule_id", "severity", F.col("subject_id.uid").alias("detail"), F.lit(False).alias("unverified"))
    classes = flags(s.withColumn("__id", F.struct("subject_id", F.coalesce("eccn", F.lit("")).alias("detail"))), "__id", class_rules(F.col("eccn")))
    classes = classes.select("__id.subject_id", (F.col("ord") + CLASS).alias("ord"), "rule_id", "severity", "__id.detail", F.lit(False).alias("unverified"))
    out = hits.unionByName(destination_flags(s, policy)).unionByName(use_flags(s)).unionByName(classes)
    if bounded is not None:
        out = out.unionByName(bounded.select("subject_id", F.lit(SEARCH).alias("ord"), F.lit("MATCH.SEARCH_BOUNDED").alias("rule_id"), F.lit("diligence").alias("severity"), F.col("left_out").alias("detail"), F.lit(False).alias("unverified")))
    return out


def by_severity(flag_table: DataFrame) -> DataFrame:
    """Flags by subject, the severest first, then in their families' order."""
    return flag_table.orderBy("subject_id", F.desc(lookup(SEVERITY, "severity")), "ord", "detail")
