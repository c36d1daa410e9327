"""Hash-chained audit trails: appended under a lock, read back with what is corrupt, verified by recomputing every hash.

An entry's hash is that of its canonical JSON without the hash itself; the same function serves the file's writer,
chains kept as tables, and verification. A chain is one sequence, so it is folded and checked in order; many chains
(one a case) are folded and checked side by side.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The kinds of events that are logged.
EVENTS = ("lists.refresh", "run.start", "case.screened", "run.end", "run.diff", "policy.verified")
GENESIS = "0" * 64
_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def canonical(body: dict) -> str:
    """Sorted keys, no blanks, non-ASCII as it is."""
    return _ENCODER.encode(body)


def digest(body: dict) -> str:
    return hashlib.sha256(canonical(body).encode()).hexdigest()


def head(path: str) -> tuple[int, str] | None:
    """What the HEAD file beside a log says; None if there is none that can be read."""
    try:
        with open(f"{path}.HEAD", encoding="utf-8") as f:
            told = json.load(f)
        return int(told["seq"]), str(told["hash"])
    except (OSError, ValueError, KeyError, TypeError):
        return None


def append(path: str, entries: list[dict], timeout: float = 30.0) -> list[dict]:
    """Appends entries (ts, actor, event, payload) under a lock, with seq, prev_hash and hash; keeps a HEAD file.

    Refuses with a TimeoutError where another writer holds the lock for longer than ``timeout`` seconds.
    """
    with open(path, "a+", encoding="utf-8") as f:
        until = time.monotonic() + timeout
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except OSError:
                if time.monotonic() > until:
                    raise TimeoutError(f"{path} is locked by another writer") from None
                time.sleep(0.05)
        f.seek(0)
        seq, last = 0, GENESIS
        for line in f:
            try:
                row = json.loads(line)
                seq, last = row["seq"], row["hash"]
            except (ValueError, KeyError, TypeError):
                continue
        out = []
        for entry in entries:
            seq += 1
            body = {**entry, "seq": seq, "prev_hash": last}
            last = digest(body)
            out.append({**body, "hash": last})
        f.write("".join(canonical(x) + "\n" for x in out))
        f.flush()
        os.fsync(f.fileno())
        with open(f"{path}.HEAD", "w", encoding="utf-8") as marker:
            marker.write(canonical({"seq": seq, "hash": last}))
    return out


def _body(seq, ts, actor, event, payload, prev_hash) -> dict:
    return {"seq": seq, "ts": ts, "actor": actor, "event": event, "payload": json.loads(payload), "prev_hash": prev_hash}


_PARTS = ["ts", "actor", "event", "payload"]


def chained(entries: DataFrame, order: list[str]) -> DataFrame:
    """(chain, seq, ts, actor, event, payload, prev_hash, hash) of (chain, ts, actor, event, payload as JSON), in order.

    Chains are sorted within partitions and folded batch by batch, so none is held as a whole.
    """

    def fold(batches):
        chain, seq, prev = object(), 0, GENESIS
        for batch in batches:
            out = []
            for own, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                if own != chain:
                    chain, seq, prev = own, 0, GENESIS
                seq += 1
                h = digest(_body(seq, *parts, prev))
                out.append((own, seq, *parts, prev, h))
                prev = h
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), (batch.schema.field(0).type, pa.int64(), *[pa.string()] * 6))], ["chain", "seq", *_PARTS, "prev_hash", "hash"])

    kind = entries.schema["chain"].dataType.simpleString()
    rows = entries.repartition("chain").sortWithinPartitions("chain", *order).select("chain", *_PARTS)
    return rows.mapInArrow(fold, f"chain {kind}, seq long, ts string, actor string, event string, payload string, prev_hash string, hash string")


def rehashed(log: DataFrame) -> DataFrame:
    """A log with what its entries' hashes should be in ``computed``; null where the payload is no JSON."""

    def run(batches):
        for batch in batches:
            found = []
            for values in zip(*(batch.column(c).to_pylist() for c in ("seq", *_PARTS, "prev_hash"))):
                try:
                    found.append(digest(_body(*values)))
                except (ValueError, TypeError):
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "computed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields) + ", computed string"
    return log.mapInArrow(run, schema)


def verify(log: DataFrame) -> DataFrame:
    """(chain, seq, problem) of a log with ``computed``: gaps, broken links, changed bodies, each chain by itself."""
    order = Window.partitionBy("chain").orderBy("seq")
    seen = log.withColumn("before", F.lag("seq").over(order)).withColumn("before_hash", F.lag("hash").over(order))
    found = F.array(
        F.when(F.col("seq") != F.coalesce(F.col("before") + 1, F.lit(1)), F.lit("gap")),
        F.when(F.col("prev_hash") != F.coalesce("before_hash", F.lit(GENESIS)), F.lit("broken link")),
        F.when(~F.col("hash").eqNullSafe(F.col("computed")), F.lit("changed body")),
    )
    return seen.select("chain", "seq", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log file's lines as (line, chain 0, seq, ts, actor, event, payload, prev_hash, hash, computed, corrupt).

    A line that is no JSON object with a seq and a hash is kept as it is in ``corrupt``; blank lines are left out.
    """

    def run(batches):
        for batch in batches:
            out = []
            for place, line in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    row = json.loads(line)
                    body = {k: v for k, v in row.items() if k != "hash"}
                    out.append((place, int(row["seq"]), *[None if row.get(c) is None else str(row[c]) for c in ("ts", "actor", "event")], canonical(row.get("payload")), row.get("prev_hash"), str(row["hash"]), digest(body), None))
                except (ValueError, KeyError, TypeError, AttributeError):
                    out.append((place, None, None, None, None, None, None, None, None, line))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64() if i < 2 else pa.string()) for i, c in enumerate(zip(*out))], names)

    names = ["place", "seq", *_PARTS, "prev_hash", "hash", "computed", "corrupt"]
    text = spark.read.text("file://" + path if path.startswith("/") else path).filter("trim(value) <> ''").select(F.monotonically_increasing_id().alias("place"), "value")
    rows = text.mapInArrow(run, ", ".join(f"{n} {'long' if i < 2 else 'string'}" for i, n in enumerate(names)))
    return rows.withColumn("line", F.row_number().over(Window.orderBy("place"))).withColumn("chain", F.lit(0)).drop("place")


def verify_log(spark: SparkSession, path: str) -> DataFrame:
    """(seq, problem) of a log file: what ``verify`` finds, corrupt lines, an empty log, an end other than HEAD's."""
    log = read_log(spark, path)
    good = log.filter("corrupt is null")
    rows = verify(good).select("seq", "problem").unionByName(log.filter("corrupt is not null").select(F.lit(None).cast("long").alias("seq"), F.concat(F.lit("corrupt line "), F.col("line")).alias("problem")))
    end = good.agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
    rows = rows.unionByName(end.filter("seq is null").select("seq", F.lit("empty log").alias("problem")))
    marker = head(path)
    if marker is not None:
        rows = rows.unionByName(end.filter(~F.col("seq").eqNullSafe(F.lit(marker[0])) | ~F.col("hash").eqNullSafe(F.lit(marker[1]))).select(F.lit(marker[0]).cast("long").alias("seq"), F.lit("the end differs from HEAD").alias("problem")))
    return rows


def retention_floor(as_of: Column, years: int = 5) -> Column:
    """The day from which entries must be kept; the 28th of February stands for the 29th."""
    return F.add_months(as_of, -12 * years)
