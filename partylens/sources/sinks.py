"""Sinks: dispositions as CSV, nested results as JSON lines, a Markdown worklist of what needs a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partylens.operators.runs import DISPLAY, lookup


def escaped(x: Column) -> Column:
    """Text that can't break a Markdown table: backslashes first, then the marks, line feeds to blanks."""
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for mark in "|`[]":
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    out = F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.trim(F.regexp_replace(out, r"[\r\n]+", " "))


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy(lookup(DISPLAY, "disposition"), "ref")


def flat(results: DataFrame) -> DataFrame:
    """Arrays joined by semicolons, ready for CSV."""
    return results.select(*[F.array_join(F.transform(f.name, lambda x: x.cast("string")), ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in results.schema.fields])


def write_csv(results: DataFrame, path: str) -> None:
    ordered(flat(results)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def worklist(results: DataFrame, most: int = 1000) -> str:
    """A Markdown table of the cases that aren't clear, most urgent first; the table is for people and says if it was cut."""
    rows = ordered(results.filter("disposition <> 'CLEAR'")).select(*[escaped(F.col(c).cast("string")).alias(c) for c in ("ref", "name", "disposition")]).limit(most + 1).collect()
    lines = ["| ref | name | disposition |", "|---|---|---|", *(f"| {r['ref']} | {r['name']} | {r['disposition']} |" for r in rows[:most])]
    return "\n".join(lines + (["", f"Only the first {most} cases are shown."] if len(rows) > most else []))
