"""List snapshots: manifest, coverage and staleness gates. They fail closed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXPECTED = tuple("CSL DPL NONSDN SDN SDN_ALT".split())
STALE_DAYS = 7.0


class GateError(RuntimeError):
    """A snapshot that must not be screened against."""


def file_digests(spark, path: str) -> DataFrame:
    """(path, bytes, sha256, modified) of the files under a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def manifest_digest(files: list[tuple[str, str]], total: int) -> str:
    return hashlib.sha256(json.dumps([sorted(files), total], separators=(",", ":")).encode()).hexdigest()


def coverage(files: DataFrame) -> tuple[list[str], list[str]]:
    """(missing, degraded) expected codes of (code, parties, error)."""
    rows = {r["code"]: r for r in files.filter(F.col("code").isin(*EXPECTED)).collect()}
    missing = [c for c in EXPECTED if c not in rows]
    degraded = [c for c in EXPECTED if c in rows and (rows[c]["error"] or (not rows[c]["parties"] and c != "SDN_ALT"))]
    return missing, degraded


def age_days(files: DataFrame, now: str) -> float:
    """Days since the oldest good fetch; infinite without one."""
    seconds = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.min(F.col("fetched_at").cast("timestamp")))
    got = files.filter("error is null").agg((seconds / 86_400e6).alias("age")).first()["age"]
    return float("inf") if got is None else got


def check(files: DataFrame, now: str, allow_stale: bool = False) -> None:
    """Raises unless all lists are there, whole and fresh; only staleness may be waived."""
    missing, degraded = coverage(files)
    if missing or degraded:
        raise GateError(f"missing lists: {missing}; degraded lists: {degraded}")
    age = age_days(files, now)
    if age < 0 or (age > STALE_DAYS and not allow_stale) or age == float("inf"):
        raise GateError(f"lists are {age:.1f} days old; at most {STALE_DAYS:g} days are allowed")


def write_corpus(parties: DataFrame, path: str) -> None:
    """One JSON object a line and party."""
    parties.write.mode("overwrite").json(path)


def read_corpus(spark: SparkSession, path: str, schema) -> DataFrame:
    """The corpus as written; keys that the schema lacks are passed over, blank lines too."""
    return spark.read.schema(schema).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a JSON-lines file: each line must be an object; errors tell the line's number and why."""
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), "value")
    text = text.withColumn("line", F.row_number().over(Window.orderBy("place"))).filter("trim(value) <> ''")
    got = text.withColumn("kind", F.schema_of_variant(F.try_parse_json("value")))
    good = F.coalesce(F.startswith("kind", F.lit("OBJECT")), F.lit(False))
    rows = got.filter(good).select("line", F.from_json("value", schema).alias("r")).select("line", "r.*")
    return rows, got.filter(~good).select("line", F.when(F.col("kind").isNull(), "no JSON").otherwise("no object").alias("error"))


def write_manifest(manifest: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(manifest, f, ensure_ascii=False, sort_keys=True, indent=1)


def read_manifest(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def refresh_offline(files: DataFrame, prior: DataFrame) -> DataFrame:
    """(code, sha256, fetched_at, warning) of cached files (code, sha256, modified) beside a prior manifest (code, sha256, fetched_at).

    The fetch time is carried forward for the same content only, so touching a file doesn't make it younger; a file
    without an entry counts from its own time, and one dated in the future is told.
    """
    met = files.join(prior.select("code", "sha256", F.col("fetched_at").alias("carried")).dropDuplicates(["code", "sha256"]), ["code", "sha256"], "left")
    told = F.when(F.col("carried").isNull() & (F.col("modified") > F.current_timestamp()), "dated in the future").when(F.col("carried").isNull(), "no prior entry: the file's own time")
    return met.select("code", "sha256", F.coalesce("carried", F.col("modified").cast("string")).alias("fetched_at"), told.alias("warning"))
