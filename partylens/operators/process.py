"""Process mining over an event log (case_id, activity, ts, event_id); ties in time go by event id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_case():
    return Window.partitionBy("case_id").orderBy("ts", "event_id")


def _seconds(a, b):
    return (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1e6


def with_next(log: DataFrame) -> DataFrame:
    """Each event with the one that follows in its case: one window, no self-join."""
    return log.withColumn("next_activity", F.lead("activity").over(in_case())).withColumn("next_ts", F.lead("ts").over(in_case()))


def dfg_edges(log: DataFrame) -> DataFrame:
    return with_next(log).filter("next_activity is not null").groupBy(F.col("activity").alias("from_activity"), F.col("next_activity").alias("to_activity")).agg(F.count("*").alias("n"))


def dfg_waits(log: DataFrame) -> DataFrame:
    """Count, median and 95th percentile of the wait, and exposure (median times count) of each edge."""
    waits = with_next(log).filter("next_activity is not null").withColumn("wait", _seconds("ts", "next_ts"))
    out = waits.groupBy(F.col("activity").alias("from_activity"), F.col("next_activity").alias("to_activity")).agg(
        F.count("*").alias("n"), F.percentile("wait", F.lit(0.5)).alias("median"), F.percentile("wait", F.lit(0.95)).alias("p95")
    )
    return out.select("from_activity", "to_activity", "n", F.round("median", 3).alias("median_wait"), F.round("p95", 3).alias("p95_wait"), F.round(F.col("median") * F.col("n"), 2).alias("exposure"))


def start_end(log: DataFrame) -> DataFrame:
    key = F.struct("ts", "event_id")
    cases = log.groupBy("case_id").agg(F.min_by("activity", key).alias("first"), F.max_by("activity", key).alias("last"))
    starts = cases.groupBy(F.col("first").alias("activity")).agg(F.count("*").alias("starts"))
    ends = cases.groupBy(F.col("last").alias("activity")).agg(F.count("*").alias("ends"))
    return starts.join(ends, "activity", "full_outer").select("activity", F.coalesce("starts", F.lit(0)).alias("starts"), F.coalesce("ends", F.lit(0)).alias("ends"))


def rework_edges(log: DataFrame) -> DataFrame:
    """Edges whose target the case has been in before; a self-loop is one."""
    before = F.collect_set("activity").over(in_case().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    again = with_next(log).withColumn("seen", before).filter("next_activity is not null and array_contains(seen, next_activity)")
    return again.groupBy(F.col("activity").alias("from_activity"), F.col("next_activity").alias("to_activity")).agg(F.count("*").alias("n"))


def traces(log: DataFrame) -> DataFrame:
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "activity")))
    return log.groupBy("case_id").agg(F.array_join(F.transform(steps, lambda x: x["activity"]), ">").alias("variant"), F.count("*").alias("steps"))


def variants(log: DataFrame) -> DataFrame:
    return traces(log).groupBy("variant").agg(F.count("*").alias("cases"))


def variant_coverage(log: DataFrame) -> DataFrame:
    """The running share of cases that the most frequent variants cover."""
    order = Window.orderBy(F.desc("cases"), "variant")
    v = variants(log)
    total = v.agg(F.sum("cases").alias("total"))
    ranked = v.withColumn("rank", F.row_number().over(order)).withColumn("covered", F.sum("cases").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.crossJoin(F.broadcast(total)).select("rank", "variant", "cases", F.round(F.col("covered") / F.col("total"), 6).alias("coverage"))


def trace_stats(log: DataFrame, reject: float = 2, few: int = 5, many: int = 15) -> DataFrame:
    """Whether the case notion makes sense: trace length and number of activities."""
    kinds = log.agg(F.countDistinct("activity").alias("activities"))
    lengths = traces(log).agg(F.count("*").alias("cases"), F.percentile("steps", F.lit(0.5)).alias("median_steps"), F.max("steps").alias("most_steps"))
    return lengths.crossJoin(kinds).withColumn("case_notion", F.when(F.col("median_steps") <= reject, "reject").otherwise("ok")).withColumn(
        "granularity", F.when(F.col("activities") < few, "coarse").when(F.col("activities") > many, "fine").otherwise("healthy")
    )


def censoring(log: DataFrame, begin: str, end: str) -> DataFrame:
    """Cases wholly inside a window, and the share that isn't."""
    span = log.groupBy("case_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    inside = (F.col("a") >= F.lit(begin).cast("timestamp_ntz")) & (F.col("b") < F.lit(end).cast("timestamp_ntz"))
    return span.agg(F.count("*").alias("cases"), F.count_if(inside).alias("complete")).withColumn("excluded", F.round(1 - F.col("complete") / F.col("cases"), 6))


def stalled(log: DataFrame, terminal: list[str]) -> DataFrame:
    """Where cases without a terminal activity stand."""
    cases = log.groupBy("case_id").agg(F.max_by("activity", F.struct("ts", "event_id")).alias("last"), F.max(F.col("activity").isin(terminal)).alias("done"))
    return cases.filter("not done").groupBy(F.col("last").alias("activity")).agg(F.count("*").alias("cases"))


def conformance(log: DataFrame, configured: DataFrame) -> DataFrame:
    """Configured transitions that never occur and observed ones that aren't configured."""
    both = configured.select("from_activity", "to_activity", F.lit(True).alias("configured")).join(dfg_edges(log), ["from_activity", "to_activity"], "full_outer")
    kind = F.when(F.col("n").isNull(), "unused").when(F.col("configured").isNull(), "undefined").otherwise("conforming")
    return both.select("from_activity", "to_activity", kind.alias("kind"), F.coalesce("n", F.lit(0)).alias("n"))


def sessions(log: DataFrame, gap_seconds: int) -> DataFrame:
    """(case_id, session, begin, end, events): a gap of more than so many seconds begins a session."""
    new = F.coalesce((_seconds("before", "ts") > gap_seconds).cast("int"), F.lit(0))
    numbered = log.withColumn("before", F.lag("ts").over(in_case())).withColumn("new", new).withColumn("session", F.sum("new").over(in_case().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("case_id", "session").agg(F.count("*").alias("events"), F.max("ts").alias("b"), F.min("ts").alias("a")).withColumn("seconds", F.round(_seconds("a", "b"), 3)).drop("a", "b")


def collapse(log: DataFrame, rename: dict[str, str], gap_seconds: int) -> DataFrame:
    """Activities under their group's name; runs of one group within the gap become one event."""
    named = log.withColumn("activity", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in rename.items() for x in p]), F.col("activity")), F.col("activity")))
    same = (F.lag("activity").over(in_case()) == F.col("activity")) & (_seconds("before", "ts") <= gap_seconds)
    return named.withColumn("before", F.lag("ts").over(in_case())).withColumn("again", F.coalesce(same, F.lit(False))).filter("not again").drop("before", "again")


def bursts(log: DataFrame, least: int) -> DataFrame:
    """Minutes with so many events or more: the mark of a bulk backfill."""
    return log.groupBy(F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm").alias("minute")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def clock_mix(log: DataFrame) -> DataFrame:
    """Steps back in time against the order of ingest, by case: clocks of several zones."""
    back = F.col("ts") < F.lag("ts").over(Window.partitionBy("case_id").orderBy("event_id"))
    return log.withColumn("back", F.coalesce(back, F.lit(False))).groupBy("case_id").agg(F.count_if("back").alias("back"), F.count("*").alias("events")).filter("back > 0")


def eligibility(log: DataFrame, actor: str) -> DataFrame:
    """Null shares of what a log must have, and whether it has it."""
    share = [F.round(F.count_if(F.col(c).isNull()) / F.count("*"), 6).alias(f"{n}_null") for n, c in (("actor", actor), ("time", "ts"), ("activity", "activity"), ("case", "case_id"))]
    return log.agg(F.count("*").alias("events"), *share).withColumn("eligible", (F.col("events") > 0) & (F.col("actor_null") + F.col("time_null") + F.col("activity_null") + F.col("case_null") == 0))


def window_check(log: DataFrame, factor: float = 3) -> DataFrame:
    """Whether the log's window is so many times the median case duration."""
    cases = log.groupBy("case_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).withColumn("d", _seconds("a", "b"))
    out = cases.agg(F.percentile("d", F.lit(0.5)).alias("median"), F.min("a").alias("a"), F.max("b").alias("b"))
    return out.select(F.round("median", 3).alias("median_seconds"), F.round(_seconds("a", "b"), 3).alias("window_seconds"), (_seconds("a", "b") >= factor * F.col("median")).alias("sufficient"))


def settled(log: DataFrame, go_live: str, burst: int) -> DataFrame:
    """The log without cases that began before go-live and without minutes of ``burst`` events or more, which are backfill."""
    began = log.groupBy("case_id").agg(F.min("ts").alias("began")).filter(F.col("began") >= F.lit(go_live).cast("timestamp_ntz")).select("case_id")
    minute = F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd HH:mm")
    kept = log.join(began, "case_id", "left_semi").withColumn("minute", minute)
    return kept.join(bursts(log, burst).select("minute"), "minute", "left_anti").drop("minute")


def variant_health(log: DataFrame, top: int = 5, share: float = 0.6) -> DataFrame:
    """The share of cases that the most frequent variants cover, and whether it is too small for a process."""
    v = variants(log)
    best = v.orderBy(F.desc("cases"), "variant").limit(top).agg(F.sum("cases").alias("covered"))
    return best.crossJoin(v.agg(F.sum("cases").alias("total"), F.count("*").alias("variants"))).select("variants", F.round(F.col("covered") / F.col("total"), 6).alias("coverage"), (F.col("covered") / F.col("total") < share).alias("scattered"))
