"""Structured Streaming: screening at transaction time, windowed counts with watermarks, first-seen filters, state by case."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partylens.functions import names as N
from partylens.storage import fresh


def events(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    """A folder's events.parquet as a stream, with a zoned event time."""
    static = spark.read.parquet(f"{folder}/events.parquet")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def exact_screen(stream: DataFrame, name: str, parties: DataFrame) -> DataFrame:
    """Stateless stream-static screening on the sorted normal form: no watermark, no state, one broadcast or shuffle of the list."""
    listed = N.with_forms(parties, "name").select("uid", F.col("sorted_norm").alias("key"))
    return N.with_forms(stream, name).withColumnRenamed("sorted_norm", "key").join(listed, "key").drop("toks", "norm", "skel", "sorted_skel", "key")


def windowed_counts(stream: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events by window and type; later ones than the watermark are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def first_of(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Repeats within the watermark are dropped; the state holds keys for that long only."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def case_progress(stream: DataFrame) -> DataFrame:
    """(user_id, events, edges, last_type): a case's state carried across triggers: its events, directly-follows edges and last activity."""

    def step(key, frames, state):
        events, last, stamp = state.get if state.exists else (0, "", 0)
        for frame in frames:
            ordered = frame.sort_values(["ts", "event_id"])
            events += len(ordered)
            at = int(ordered["ts"].iloc[-1].value)
            if at >= stamp:
                last, stamp = str(ordered["event_type"].iloc[-1]), at
        state.update((events, last, stamp))
        yield pd.DataFrame({"user_id": [key[0]], "events": [events], "edges": [events - 1], "last_type": [last]})

    out = "user_id long, events long, edges long, last_type string"
    narrow = stream.select("user_id", "event_id", "event_type", "ts")
    return narrow.groupBy("user_id").applyInPandasWithState(step, out, "events long, last string, stamp long", "update", "NoTimeout")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and gives the result as a table in the shared folder.

    Its checkpoints stand in the shared folder as well, so a restarted run goes on where the last one ended. In
    complete mode the table holds the last batch's result, else what all batches added, under the batch's number.
    """
    spark, path = stream.sparkSession, fresh(stream.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own rows
        batch.write.mode("overwrite").parquet(f"{path}/data" if mode == "complete" else f"{path}/data/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/data").select(*stream.columns)
