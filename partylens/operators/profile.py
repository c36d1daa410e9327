"""Profiling, verdicts and replay comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns(df: DataFrame, table: str) -> DataFrame:
    """(table, column, rows, filled, fill_rate, distinct, constant): one aggregation over the table, then unpivoted."""
    aggs = [F.count("*").alias("rows")]
    for c in df.columns:
        aggs += [F.count(c).alias(f"f_{c}"), F.countDistinct(c).alias(f"d_{c}")]
    one = df.agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f_{c}").alias("filled"), F.col(f"d_{c}").alias("distinct")) for c in df.columns])
    out = one.select("rows", F.explode(each).alias("x"))
    return out.select(F.lit(table).alias("table"), "x.column", "rows", "x.filled", F.round(F.col("x.filled") / F.col("rows"), 6).alias("fill_rate"), "x.distinct", (F.col("x.distinct") <= 1).alias("constant"))


def archaeology(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, rows, oldest, newest) by each table's date column."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows"), day(F.min(c)).alias("oldest"), day(F.max(c)).alias("newest")).select(F.lit(n).alias("table"), "rows", "oldest", "newest") for n, (df, c) in tables.items()])


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows, rows without a parent and their share, parents in use and their share."""
    known = parent.select(F.col(parent_key).alias("k"), F.lit(1).alias("there")).distinct()
    use = child.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).join(known, "k", "full_outer")
    n = F.coalesce("n", F.lit(0))
    out = use.agg(F.sum(n).alias("rows"), F.sum(F.when(F.col("there").isNull(), n).otherwise(0)).alias("orphans"), F.count_if(F.col("there").isNotNull() & (n > 0)).alias("parents_used"), F.count_if(F.col("there").isNotNull()).alias("parents"))
    return out.select("rows", "orphans", F.round(F.col("orphans") / F.col("rows"), 6).alias("orphan_rate"), "parents_used", F.round(F.col("parents_used") / F.col("parents"), 6).alias("density"))


def usage(last_seen_days: Column, events: Column, horizon_days: Column) -> Column:
    """Usage by what the evidence can say: no events in a short window isn't 'never'."""
    return (
        F.when(events.isNull(), "unknown").when((events == 0) & (horizon_days >= 3650), "never").when(events == 0, "unknown")
        .when(last_seen_days <= 7, "daily-weekly").when(last_seen_days <= 31, "monthly").when(last_seen_days <= 366, "yearly").otherwise("dormant")
    )


def verdict(used: Column, criticality: Column, evidence: Column) -> Column:
    """KEEP what is used and critical, SIMPLIFY what is used, DROP what never was; without evidence DEFER."""
    return (
        F.when((evidence == 0) | (used == "unknown"), "DEFER").when(used == "never", F.when(criticality == "critical", "DEFER").otherwise("DROP"))
        .when(criticality.isin("critical", "important"), "KEEP").when(used == "dormant", "DROP").otherwise("SIMPLIFY")
    )


def downgraded(criticality: Column, citations: Column) -> Column:
    return F.when((criticality == "critical") & (citations == 0), "important").otherwise(criticality)


def replay(ours: DataFrame, theirs: DataFrame, register: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, ours, theirs, outcome): equal, registered divergence, defect of the old system, or unexplained."""
    both = ours.join(theirs, key, "full_outer").join(register, key, "left")
    same = F.coalesce(F.abs(F.col("ours") - F.col("theirs")) <= tolerance, F.lit(False))
    outcome = F.when(same, "equal").when(F.col("reason") == "legacy", "legacy defect").when(F.col("reason").isNotNull(), "registered").otherwise("unexplained")
    return both.select(key, "ours", "theirs", outcome.alias("outcome"))


def regimes(facts: DataFrame, changes: DataFrame, at: str, begin: str) -> DataFrame:
    """Each fact with the change in force at its time: the last before it, by one union and a window, no range join."""
    from pyspark.sql import Window

    both = facts.withColumn("_t", F.col(at)).unionByName(changes.withColumn("_t", F.col(begin)), allowMissingColumns=True)
    order = Window.partitionBy("scope").orderBy(F.col("_t"), F.col(begin).isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("regime", F.last("regime", ignorenulls=True).over(order)).filter(F.col(begin).isNull()).drop("_t", begin)


#: The class of evidence that a plane gives. Walks through the interface and exports have the class of what they show.
PLANE_CLASS = {
    **{p: "runtime" for p in ("transactional", "telemetry", "integration-inventory")},
    **{p: "structure" for p in ("config-census", "master-data", "setup-census", "code-analysis")}, **{p: "human" for p in ("interview", "contract", "document")},
}


def evidence_class(plane: Column, shown: Column) -> Column:
    """A plane's class; of a route (ui-walk, export) that of the plane it shows; null where unknown."""
    table = F.create_map(*[F.lit(x) for p in PLANE_CLASS.items() for x in p])
    return F.element_at(table, F.when(plane.isin("ui-walk", "export"), shown).otherwise(plane))


def segment_range(pages: Column, page_size: Column) -> Column:
    """How many rows a list of so many pages can have: a range, as the last page is full or holds one row."""
    return F.when(pages <= 0, F.struct(F.lit(0).cast("long").alias("least"), F.lit(0).cast("long").alias("most"))).otherwise(F.struct(((pages - 1) * page_size + 1).cast("long").alias("least"), (pages * page_size).cast("long").alias("most")))


def containing(texts: DataFrame, text_id: str, text: str, items: DataFrame, item_id: str, item: str, words: int = 4) -> DataFrame:
    """(text id, item id) of the texts that hold an item to the letter.

    Words inside of an item are words of the text, too, so both meet by a hash of ``words`` consecutive ones behind the
    item's first; only what meets is compared as a whole. Items of too few words are compared with every text.
    """
    split = lambda c: F.split(c, " ")
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.xxhash64(*[F.element_at("w", i + k) for k in range(words)]))
    own = items.select(item_id, F.col(item).alias("__item"), split(F.col(item)).alias("w"))
    long, short = own.filter(F.size("w") >= words + 2), own.filter(F.size("w") < words + 2)
    keys = long.select(item_id, "__item", F.xxhash64(*[F.element_at("w", 2 + k) for k in range(words)]).alias("__key"))
    places = texts.select(text_id, split(F.col(text)).alias("w")).filter(F.size("w") >= words).select(text_id, F.explode(F.array_distinct(runs)).alias("__key"))
    pairs = places.join(keys.select("__key", item_id, "__item"), "__key").select(text_id, item_id, "__item").distinct()
    met = pairs.join(texts.select(text_id, F.col(text).alias("__text")), text_id).filter(F.contains("__text", "__item")).select(text_id, item_id)
    rest = texts.select(text_id, F.col(text).alias("__text")).join(short, F.contains("__text", "__item")).select(text_id, item_id)
    return met.unionByName(rest)
