"""A corpus pipeline: each stage takes what the one before it kept, written as Parquet and reread.

Toxic documents go; repeated passages are cut; one document of each near-duplicate group stays;
documents that hold benchmark items go; the rest is packed into batches. SQL can't express the first
stage, so ORACLE_SQL is None; tests run the stages after it against brute-force versions, row by row.

Defined results: a document without a text, or with an empty one, is kept by every filter and packed as one
part of length 0. A row without an id is judged by its own text, like others, but is never a near duplicate. Rows
that repeat an id and text share every decision; of an id with several texts each text is judged by
itself but for near duplicates, where the id is one document. All other columns than those of documents are
dropped, whatever their names. An empty corpus gives an empty result; without labels no document is toxic,
without benchmark items none is contaminated. Texts of any length are read as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partylens.llm.base import Scratch, table
from partylens.llm.decontam import drop_contaminated
from partylens.llm.linededup import dedup_lines
from partylens.llm.neardup import drop_near_duplicates
from partylens.llm.packing import pack
from partylens.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores above the threshold go; the model learns from the labels of this corpus."""
    return drop_toxic(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages are cut, no document goes; n_chars follows the text, null for a null one."""
    from pyspark.sql import functions as F

    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the least id stays; texts without words are in no group."""
    return drop_near_duplicates(docs).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go as a whole."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in parts of bounded length, each in a batch of its length bucket."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, with what each keeps written to the shared folder."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        kept = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
