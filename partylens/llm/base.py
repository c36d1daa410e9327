"""Shared plumbing of the corpus operators: table access, Arrow mapping, intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are taken in runs of about so many characters, so that a worker's arrays stay small.
RUN_CHARS = 1_000_000
#: Samples of labelled texts that train a model hold at most so many characters.
SAMPLE_CHARS = 100_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="partylens-"))
    return context.getCheckpointDir()


class Scratch:
    """Tables written to the shared folder to cut lineage; they outlive a lost executor.

    ``save`` writes and rereads a frame; ``drop`` deletes tables that no later result reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.kept: list[tuple[DataFrame, str]] = []  # the frames themselves, as the id of one that is gone may come again

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the tables of these frames; others and None are passed over."""
        for path in [p for f, p in self.kept if any(f is x for x in frames)]:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        self.kept = [(f, p) for f, p in self.kept if not any(f is x for x in frames)]

    def keep(self, *frames: DataFrame) -> None:
        """Deletes all tables but these frames'."""
        self.drop(*[f for f, _ in self.kept if not any(f is x for x in frames)])


def bounded(rows: DataFrame, text: str, order: list[str], most: int = SAMPLE_CHARS) -> DataFrame:
    """Of a sample of a bounded number of rows the first by ``order`` that hold at most ``most`` characters together.

    Texts of over a hundredth of that are left out of the sample.
    """
    size, so_far = fresh(rows, "size"), fresh(rows, "so_far")
    sized = rows.withColumn(size, F.coalesce(F.length(text), F.lit(0))).filter(F.col(size) <= most // 100)
    return sized.withColumn(so_far, F.sum(size).over(Window.orderBy(*order))).filter(F.col(so_far) <= most).drop(size, so_far)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def runs(texts: list[str], most: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) of texts with at most about ``most`` characters together; a longer text is a run of its own."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], dict]], fields: list[T.StructField]) -> DataFrame:
    """Adds columns computed from one text column to all of ``df``'s own, batch by batch through Arrow.

    ``make`` runs once a task and returns a function from a list of texts (null becomes '') to
    {field name: values}, one value a text. The function sees runs of whole texts, never parts.
    """
    at, schema = df.columns.index(text), T.StructType(list(df.schema.fields) + fields)
    names, kinds = [f.name for f in fields], [arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [x or "" for x in batch.column(at).to_pylist()]
            for a, b in runs(texts):
                got = each(texts[a:b])
                columns = batch.slice(a, b - a).columns + [pa.array(got[n], type=k) for n, k in zip(names, kinds)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def find_texts(df: DataFrame, key: str, text: str, make: Callable[[], Callable[[list[str]], tuple]], fields: list[T.StructField]) -> DataFrame:
    """Zero or more rows a text: the key, then ``fields``.

    The function that ``make`` returns gives (row indices into its texts, {field name: values}).
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *fields])
    names, kinds = [f.name for f in fields], [arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in runs(texts):
                rows, got = each(texts[a:b])
                if len(rows):
                    keys = batch.column(0).slice(a, b - a).take(pa.array(rows, type=pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys] + [pa.array(got[n], type=k) for n, k in zip(names, kinds)], [key, *names])

    return df.select(key, text).mapInArrow(run, schema)
