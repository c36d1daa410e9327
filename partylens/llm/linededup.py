"""Operator 7: removal of repeated passages by overlapping three-line windows.

A line ends at a line feed, or after a punctuation mark before white space, so that a passage that was
pasted into running text falls into the same lines as where it stands alone. Every three consecutive
lines (blank ones skipped) are hashed, however short they are; windows with equal hash anywhere in the
corpus are one passage. Its first occurrence, by document id and place, stays. The positions that later
occurrences cover are merged and cut out; the rest of the text is kept to the letter, control characters
included. No line's first occurrence can be cut: the window over it would have an earlier copy.

The first occurrences of repeated hashes are an aggregate with partial results on the map side, written
to the shared folder; the windows are joined to it. So a passage that a third of all documents hold is one
row of the aggregate, and the join may split its partition as it is skewed.

Defined results: null stays null, '' stays ''; texts of under three lines stay. A document is identified
by its id and text, so a repeated row gets the same result as the first, and rows of one id with other
texts are documents of their own, ordered by their hashes. A null id comes after all others. All other
columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partylens.llm.base import Scratch, fresh, table

#: Production parameter: lines a window.
LINES = 3
#: A line with what ends it. All repetition is possessive, so the scan is linear and doesn't recurse.
_LINE = "[^.,;:!?\\n]*+(?:[.,;:!?](?![ \\t\\r\\n])[^.,;:!?\\n]*+)*+(?:[.,;:!?][ \\t\\r\\n]++|\\n)?"


def _lines(text: Column) -> Column:
    """Lines with what ends them; joined, they give the text."""
    return F.regexp_extract_all(text, F.lit(_LINE), F.lit(0))


def _windows(docs: DataFrame, id_col: str, key: str, text_col: str, lines: int) -> DataFrame:
    """(id, key, hash, span) of every window; span holds the first line's place in its upper and the last one's in its lower half."""
    blank = F.xxhash64(F.lit(""))
    hashed = F.transform(_lines(F.col(text_col)), lambda x, i: F.struct(i.cast("long").alias("at"), F.xxhash64(F.btrim(x, F.lit(" \t\r\n"))).alias("h")))
    solid = docs.select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.filter(hashed, lambda x: x["h"] != blank).alias("l"))
    n = F.greatest(F.size("l") - (lines - 1), F.lit(0))
    shifted = [F.slice("l", F.lit(k + 1), n).alias(f"l{k}") for k in range(lines)]
    each = solid.select("id", "key", F.explode(F.arrays_zip(*shifted)).alias("w"))
    span = F.shiftleft("w.l0.at", 31).bitwiseOR(F.col(f"w.l{lines - 1}.at"))
    return each.select("id", "key", F.xxhash64(*[f"w.l{k}.h" for k in range(lines)]).alias("hash"), span.alias("span"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """``docs`` with repeated passages cut from the text, and a last column lines_cut."""
    key, cut = fresh(docs, "text_key"), fresh(docs, "lines_cut")
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    windows = _windows(keyed, id_col, key, text_col, lines)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", "span")
    repeated = windows.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("earliest")).filter("n > 1").select("hash", "earliest")
    repeated = Scratch(docs.sparkSession).save(repeated)
    # the same plan at every size: both sides are shuffled, and AQE may split a hash that many windows share
    later = windows.hint("merge").join(repeated, "hash").filter(place != F.col("earliest"))
    covered = later.groupBy("id", "key").agg(F.collect_set("span").alias("spans"))
    inside = F.transform("spans", lambda s: F.sequence(F.shiftright(s, 31).cast("int"), s.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")))
    covered = covered.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.array_sort(F.array_distinct(F.flatten(inside))).alias("__places"))
    joined = keyed.join(covered, keyed[id_col].eqNullSafe(covered["__id"]) & (keyed[key] == covered["__key"]), "left")
    pieces, places = fresh(docs, "pieces"), covered["__places"]
    joined = joined.withColumn(pieces, F.when(places.isNotNull(), _lines(F.col(text_col))))
    # what stays lies between two neighbours among the cut places
    gaps = F.zip_with(
        F.concat(F.array(F.lit(-1)), places),
        F.concat(places, F.array(F.size(pieces))),
        lambda a, b: F.struct((a + 2).alias("at"), (b - a - 1).alias("n")),
    )
    kept = F.flatten(F.transform(F.filter(gaps, lambda g: g["n"] > 0), lambda g: F.slice(pieces, g["at"], g["n"])))
    text = F.when(places.isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))
    out = [text.alias(c) if c == text_col else keyed[c] for c in docs.columns]
    return joined.select(*out, F.coalesce(F.size(places), F.lit(0)).cast("long").alias(cut))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


QUERIES = {"op7_line_dedup": op7_line_dedup}
SQL = {
    "op7_line_dedup": r"""
WITH pieces AS (
  SELECT doc_id, CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '(?s).*?(?:[.,;:!?][ \t\r\n]+|\n)|.+', 0) END AS parts
  FROM documents),
placed AS (
  SELECT doc_id, unnest(parts) AS piece, unnest(range(len(parts))) AS pos FROM pieces),
solid AS (
  SELECT doc_id, pos, trim(piece, ' ' || chr(9) || chr(13) || chr(10)) AS s FROM placed
  WHERE trim(piece, ' ' || chr(9) || chr(13) || chr(10)) <> ''),
windows AS (
  SELECT doc_id, pos AS begins, lead(pos, 2) OVER o AS ends, s || chr(2) || lead(s, 1) OVER o || chr(2) || lead(s, 2) OVER o AS w
  FROM solid WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, begins) AS k
  FROM windows WHERE ends IS NOT NULL),
covered AS (
  SELECT DISTINCT p.doc_id, p.pos FROM ranked r JOIN placed p ON p.doc_id = r.doc_id AND p.pos BETWEEN r.begins AND r.ends
  WHERE r.k > 1),
kept AS (
  SELECT p.doc_id, coalesce(string_agg(CASE WHEN c.pos IS NULL THEN p.piece END, '' ORDER BY p.pos), '') AS text, count(c.pos) AS lines_cut
  FROM placed p LEFT JOIN covered c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT d.doc_id, k.text, d.lang, d.source, d.n_chars, CAST(k.lines_cut AS BIGINT) AS lines_cut
FROM documents d JOIN kept k USING (doc_id)
"""
}
