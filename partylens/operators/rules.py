"""Rules as data: conditions in columns, one long table of flags, severities by rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partylens.functions.names import fold
from partylens.operators.runs import SEVERITY, lookup

#: Phrases by topic, alphabetically; a phrase counts anywhere in the folded text.
END_USE = {
    "CHEM_BIO": "aerosol dispersal|biological agent|chemical weapon|fermenter|nerve agent|precursor chemical|select agent|toxin",
    "MILITARY": "air force|armed forces|armor|armour|army|defence|defense|military|munition|navy|warhead|weapon",
    "MISSILE": "ballistic|drone|guidance set|launch vehicle|missile|reentry|rocket motor|uav|unmanned aerial",
    "NUCLEAR": "centrifuge|enrich|heavy water|isotope separation|nuclear|plutonium|reactor|uranium|yellowcake",
    "SEMICONDUCTOR": "advanced node|deposition tool|etch tool|euv|lithography|semiconductor manufacturing equipment|wafer fab",
    "SURVEILLANCE": "deep packet|facial recognition|interception|lawful intercept|sigint|signals intelligence|surveillance",
}
KNOW_CUSTOMER = {
    "CAPABILITY_MISMATCH": "capability mismatch|first order|no prior experience|unrelated industry",
    "DECLINED_SERVICE": "declines installation|no maintenance contract|no training required|refused warranty",
    "RELUCTANT_END_USE": "declined to provide|end use unknown|not disclosed|prefers not to say|unknown end user|will not disclose",
    "UNUSUAL_PAYMENT": "cash in advance|cryptocurrency|third party payer|unusual payment|wire from third country",
    "UNUSUAL_SHIPPING": "address is a freight|freight forwarder is final|hold for pickup|onward shipment|reship|transship",
}
INTERMEDIARY = "agent|broker|forwarder|intermediary|trading"
#: List code to (rule, severity); orders of DPL count only while in force.
LIST_RULES = {"SDN": ("LIST.SDN", "prohibitive"), "NONSDN": ("LIST.NONSDN", "license"), "EL": ("LIST.ENTITY", "license"), "UVL": ("LIST.UVL", "diligence"), "MEU": ("LIST.MEU", "license"), "DTC": ("LIST.DDTC", "prohibitive"), "ISN": ("LIST.ISN", "license"), "UNKNOWN": ("LIST.UNKNOWN_SOURCE", "diligence")}
AFFILIATES = ("DPL", "EL", "MEU")
CLASS_FORMAT = r"(?i)^[0-9][A-E][0-9]{3}(?:[.][a-z0-9]+)*$"
SENTINEL = "-0-"


def clean(x: Column) -> Column:
    """Trimmed; null and the lists' mark for nothing become ''."""
    return F.coalesce(F.nullif(F.trim(x), F.lit(SENTINEL)), F.lit(""))


def split_multi(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "[;|]"), lambda v: F.trim(v)), lambda v: v != "")


def party_type(x: Column) -> Column:
    low = F.lower(F.trim(x))
    out = reduce(lambda w, p: w.when(low.startswith(p), p), ("vessel", "aircraft"), F.when(low.startswith("individual"), "individual"))
    for p in ("entity", "company", "organization"):
        out = out.when(low.startswith(p), "entity")
    return out.otherwise("unknown")


def parse_date(x: Column) -> Column:
    """The first of four formats that fits; two-digit years from 69 on are of the last century."""
    short = F.regexp_extract(x, r"^(\d{1,2}-[A-Za-z]{3}-)(\d{2})$", 1)
    year = F.regexp_extract(x, r"^(\d{1,2}-[A-Za-z]{3}-)(\d{2})$", 2)
    full = F.when(short != "", F.concat(short, F.when(year >= "69", "19").otherwise("20"), year))
    tries = [F.try_to_timestamp(x, F.lit("yyyy-M-d")), F.try_to_timestamp(x, F.lit("M/d/yyyy")), F.try_to_timestamp(full, F.lit("d-MMM-yyyy")), F.try_to_timestamp(x, F.lit("yyyy/M/d"))]
    return F.coalesce(*tries).cast("date")


def in_force(begin: Column, end: Column, as_of: Column) -> Column:
    """expired, pending or active; an undated order is active."""
    return F.when(end < as_of, "expired").when(begin > as_of, "pending").otherwise("active")


def phrases(text: Column, terms: str) -> Column:
    """The sorted phrases that stand in a text."""
    return F.filter(F.array(*[F.lit(x) for x in sorted(terms.split("|"))]), lambda p: F.contains(text, p))


def resolve_country(x: Column, aliases: dict[str, str], known: list[str]) -> Column:
    """ISO code by alias or as it stands; '' where unknown, so that nothing is cleared by mistake."""
    folded = fold(x)
    code = F.upper(F.coalesce(lookup(aliases, folded), folded))
    return F.when(code.isin(known), code).otherwise("")


def flags(df: DataFrame, id_col: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(id, ord, rule_id, severity) for each rule (rule_id, severity, condition) that holds, in rule order."""
    each = F.array(*[F.when(c, F.struct(F.lit(i).alias("ord"), F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for i, (r, s, c) in enumerate(rules)])
    return df.select(F.col(id_col), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select(id_col, "f.ord", "f.rule_id", "f.severity")


def list_flags(candidates: DataFrame, as_of: str) -> DataFrame:
    """Flags of (subject_id, source, party_type, begin, end) candidates by list."""
    source, active = F.col("source"), in_force(F.col("begin"), F.col("end"), F.lit(as_of).cast("date")) == "active"
    rules = [(r, s, source == code) for code, (r, s) in LIST_RULES.items()]
    rules += [("LIST.DPL", "prohibitive", (source == "DPL") & active), ("LIST.DPL", "informational", (source == "DPL") & ~active)]
    rules += [("LIST.SDN50", "diligence", (source == "SDN") & F.col("party_type").isin("entity", "unknown")), ("LIST.BIS_AFFILIATE", "diligence", source.isin(*AFFILIATES))]
    return flags(candidates, "subject_id", rules)


def text_rules(text: Column) -> list[tuple[str, str, Column]]:
    out = [(f"USE.{k}", "diligence", F.size(phrases(text, v)) > 0) for k, v in END_USE.items()]
    out += [(f"KYC.{k}", "diligence", F.size(phrases(text, v)) > 0) for k, v in KNOW_CUSTOMER.items()]
    return [("USE.MISSING", "diligence", text == ""), *[(r, s, (text != "") & c) for r, s, c in out]]


def class_rules(code: Column) -> list[tuple[str, str, Column]]:
    plain = F.coalesce(F.upper(F.trim(code)), F.lit(""))
    return [("CLASS.MISSING", "diligence", plain == ""), ("CLASS.EAR99", "informational", plain == "EAR99"), ("CLASS.MALFORMED", "diligence", (plain != "") & (plain != "EAR99") & ~plain.rlike(CLASS_FORMAT))]


def worst(flag_table: DataFrame, id_col: str) -> DataFrame:
    return flag_table.groupBy(id_col).agg(F.max(lookup(SEVERITY, "severity")).alias("worst"), F.count("*").alias("flags"))
