"""Verdicts and reviews that come from outside: coerced, held to the candidates that were asked about, never lost.

What fails to parse or to answer ends in UNCERTAIN or FAIL, never in a clear case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partylens.operators.runs import guardrail

VERDICTS = ("SAME_PARTY", "DIFFERENT", "UNCERTAIN")
FINDING = {name: i for i, name in enumerate("critical major minor".split())}
DISCARDED = "__discarded__"


def _share(x: Column) -> Column:
    """A number between 0 and 1 with three places; null where it is none."""
    value = F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))
    # least and greatest pass nulls over
    return F.when(value.isNotNull(), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 3))


def extract_object(text: Column) -> Column:
    """The JSON object in an answer, also within fences or prose, as text; null where there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    kind = F.schema_of_variant(F.try_parse_json(found))
    return F.when(F.startswith(kind, F.lit("OBJECT")), found)


def coerced(answers: DataFrame) -> DataFrame:
    """(subject_id, listed_uid, verdict, confidence, rationale, evidence) of raw answers in text columns; the last of an id counts.

    An unknown verdict is UNCERTAIN, a confidence that is no number 0; texts are cut as the record allows.
    """
    plain = F.upper(F.trim(F.coalesce("verdict", F.lit(""))))
    got = answers.filter("trim(coalesce(listed_uid, '')) <> ''").select(
        "subject_id", F.trim("listed_uid").alias("listed_uid"), F.when(plain.isin(*VERDICTS), plain).otherwise("UNCERTAIN").alias("verdict"), F.coalesce(_share(F.col("confidence")), F.lit(0.0)).alias("confidence"),
        F.substring(F.coalesce("rationale", F.lit("")), 1, 2000).alias("rationale"), F.transform(F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, 10), lambda e: F.substring(e, 1, 400)).alias("evidence"), "place",
    )
    last = Window.partitionBy("subject_id", "listed_uid").orderBy(F.desc("place"))
    return got.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn", "place")


def adjudicated(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """(subject_id, listed_uid, verdict, confidence, override) of candidates (subject_id, listed_uid, band) and ``coerced`` answers.

    The candidates are a closed set: one without an answer is UNCERTAIN, and answers about others become one row a
    subject under DISCARDED, with their number as confidence's place is empty.
    """
    both = candidates.select("subject_id", "listed_uid", "band").join(answers.select("subject_id", "listed_uid", "verdict", "confidence"), ["subject_id", "listed_uid"], "full_outer")
    known = both.filter("band is not null")
    verdict, missing = F.coalesce("verdict", F.lit("UNCERTAIN")), F.col("verdict").isNull()
    override = F.when(missing, "no answer: left to a person").otherwise(guardrail(F.col("band"), F.col("verdict"), F.col("confidence")))
    rows = known.select("subject_id", "listed_uid", verdict.alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), override.alias("override"))
    strange = both.filter("band is null").groupBy("subject_id").agg(F.count("*").alias("n"))
    told = strange.select("subject_id", F.lit(DISCARDED).alias("listed_uid"), F.lit("UNCERTAIN").alias("verdict"), F.lit(0.0).alias("confidence"), F.concat(F.lit("outside of the candidates: "), "n").alias("override"))
    return rows.unionByName(told)


def disabled(candidates: DataFrame) -> DataFrame:
    """Without a model every candidate is UNCERTAIN and left to a person."""
    return candidates.select("subject_id", "listed_uid", F.lit("UNCERTAIN").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit("no model: left to a person").alias("override"))


def reviewed(raw: DataFrame) -> DataFrame:
    """(case_id, verdict, risk, error) of critics' raw verdicts and risks: what can't be read fails at full risk."""
    plain = F.upper(F.trim(F.coalesce("verdict", F.lit(""))))
    good, risk = plain.isin("PASS", "CONDITIONAL_PASS", "FAIL"), F.coalesce("risk", F.lit("1.0"))
    share = _share(risk)
    error = F.when(~good, "unknown verdict").when(share.isNull(), "unreadable risk")
    return raw.select("case_id", F.when(error.isNull(), plain).otherwise("FAIL").alias("verdict"), F.when(error.isNull(), share).otherwise(1.0).alias("risk"), error.alias("error"))


def findings(raw: DataFrame) -> DataFrame:
    """Critics' findings (case_id, listed_uid, severity, finding, action) with known severities and bounded texts."""
    severity = F.lower(F.coalesce("severity", F.lit("minor")))
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    return raw.select("case_id", F.coalesce("listed_uid", F.lit("case")).alias("listed_uid"), F.when(severity.isin(*FINDING), severity).otherwise("major").alias("severity"), cut("finding", 1500), cut("action", 600))


def retry_brief(found: DataFrame) -> DataFrame:
    """(case_id, brief): a case's findings in one text, critical ones first."""
    rank = F.element_at(F.create_map(*[F.lit(x) for p in FINDING.items() for x in p]), F.col("severity"))
    line = F.concat(F.lit("["), "severity", F.lit("] "), "listed_uid", F.lit(": "), "finding", F.lit(" -> "), "action")
    return found.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), line.alias("line")))), lambda x: x["line"]), "\n").alias("brief"))


def fenced_off(text: Column) -> Column:
    """Text from outside that can't open or close a tag."""
    return F.translate(text, "<>", "()")
