"""Rules to dispositions, and comparing runs. Dispositions have two orders: rank (severity) and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = {name: i for i, name in enumerate("CLEAR REVIEW CONFIRMED_HIT BLOCKED ESCALATE".split())}
DISPLAY = {name: i for i, name in enumerate("BLOCKED ESCALATE CONFIRMED_HIT REVIEW CLEAR".split())}
SEVERITY = {name: i for i, name in enumerate("informational diligence license prohibitive".split())}


def lookup(values: dict, column: Column | str, default=None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), F.col(column) if isinstance(column, str) else column)
    return found if default is None else F.coalesce(found, F.lit(default))


def provisional(band: Column, worst: Column) -> Column:
    """The floor: EXACT is a confirmed hit, a weaker match or a flag of diligence and up is for review."""
    return F.when(band == "EXACT", "CONFIRMED_HIT").when(band.isin("STRONG", "WEAK"), "REVIEW").when(worst >= 1, "REVIEW").otherwise("CLEAR")


def resolve(floor: Column, same: Column, strange: Column, worst: Column, candidates: Column) -> Column:
    """The floor is never lowered: an unknown id escalates, a confirmed identity blocks or confirms."""
    ranks = lookup(RANK, floor)
    raised = F.when(strange > 0, 4).when(same & (worst >= 3), 3).when(same, 2).otherwise(0)
    raised = F.greatest(raised, F.when((floor == "CLEAR") & (candidates > 0), 1).otherwise(0))
    return lookup({v: k for k, v in RANK.items()}, F.greatest(ranks, raised))


def guardrail(band: Column, verdict: Column, confidence: Column) -> Column:
    """Why a model's verdict isn't taken; null where it is."""
    return F.when((verdict == "SAME_PARTY") & (confidence < 0.5), "low confidence").when((band == "EXACT") & (verdict == "UNCERTAIN"), "exact match left uncertain").when((band == "EXACT") & (verdict == "DIFFERENT"), "exact match called different")


def critic_route(verdict: Column, risk: Column, critical: Column, failed: Column, retries: Column, most: int = 3) -> Column:
    """Where a reviewed case goes next."""
    tired = retries >= most
    return (
        F.when(failed & tired, "ESCALATE").when(failed, "RETRY")
        .when((verdict == "PASS") & (risk < 0.3) & ~critical, "COMMIT")
        .when((verdict == "CONDITIONAL") & (risk < 0.5) & ~critical, "COMMIT")
        .when(tired, "ESCALATE").otherwise("RETRY")
    )


def high_water(attempts: DataFrame) -> DataFrame:
    """(case_id, disposition, reversed, route): the severest of a case's attempts, and whether one fell behind it, which escalates."""
    before = F.max("rank").over(Window.partitionBy("case_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1))
    marked = attempts.withColumn("rank", lookup(RANK, "disposition")).withColumn("reversed", F.coalesce(F.col("rank") < before, F.lit(False)))
    out = marked.groupBy("case_id").agg(F.max("rank").alias("rank"), F.max("reversed").alias("reversed"))
    return out.select("case_id", lookup({v: k for k, v in RANK.items()}, "rank").alias("disposition"), "reversed", F.when(F.col("reversed"), "ESCALATE").otherwise("COMMIT").alias("route"))


def latest(run: DataFrame) -> DataFrame:
    """The last row of each (ref, name); blank refs are left out."""
    order = Window.partitionBy("ref", "name").orderBy(F.desc("row"))
    return run.filter("trim(ref) <> ''").withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(ref, name, before, after, change) of two runs of (ref, name, disposition)."""
    both = before.withColumnRenamed("disposition", "before").join(after.withColumnRenamed("disposition", "after"), ["ref", "name"], "full_outer")
    b, a = F.col("before"), F.col("after")
    change = (
        F.when(b.isNull() & (a == "CLEAR"), "ADDED").when(b.isNull(), "NEW_HIT").when(a.isNull(), "REMOVED").when(a == b, "UNCHANGED")
        .when(b == "CLEAR", "NEW_HIT").when(a == "CLEAR", "RESOLVED").when(lookup(RANK, a) > lookup(RANK, b), "NEW_HIT").otherwise("CHANGED")
    )
    return both.select("ref", "name", "before", "after", change.alias("change"))


def open_cases(runs: DataFrame) -> DataFrame:
    """What is still open by the latest of several labelled runs."""
    order = Window.partitionBy("ref", "name").orderBy(F.desc("label"), F.desc("row"))
    last = runs.filter("trim(ref) <> ''").withColumn("rn", F.row_number().over(order)).filter("rn = 1 and disposition <> 'CLEAR'")
    return last.select("ref", "name", "label", "disposition", lookup(DISPLAY, "disposition").alias("display_order"))


def exit_code(results: DataFrame) -> int:
    """3 if anything is blocked, 2 if a person must look, else 0."""
    row = results.agg(F.max(lookup(RANK, "disposition")).alias("worst"), F.max((F.col("disposition") == "BLOCKED").cast("int")).alias("blocked")).first()
    return 3 if row["blocked"] else 2 if row["worst"] else 0


def diff_exit_code(changes: DataFrame) -> int:
    """3 if a run has new hits, 2 if a case changed, else 0."""
    kinds = {r["change"] for r in changes.filter(F.col("change").isin("NEW_HIT", "CHANGED")).select("change").distinct().collect()}
    return 3 if "NEW_HIT" in kinds else 2 if kinds else 0
