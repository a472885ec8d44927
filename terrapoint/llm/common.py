"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapoint.staging import discard, hadoop_path, read_text, scratch, shared_dir, staged, write_once

__all__ = ["IdFilter", "discard", "fold", "fresh", "hadoop_path", "read_text", "scratch", "shared_dir", "ship", "staged", "table", "trim", "trimmed", "without_ids", "write_once"]


#: Rows and bytes of a batch between the JVM and Python; a Python worker then needs some tens of MB for its batches.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ship(spark: SparkSession) -> None:
    """Once a session: keeps the batches that go to the executors' Python small, whatever the texts' length, and hands
    them the package where neither PYTHONPATH nor the working folder has it."""
    for name, most in BATCH.items():
        spark.conf.set(name, most)
    context, root = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if getattr(context, "_terrapoint_shipped", False):
        return
    context._terrapoint_shipped = True
    if root not in {os.path.abspath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]}:
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="terrapoint-"), "terrapoint"), "zip", root, "terrapoint"))


def trim() -> None:
    """Gives what this Python worker has freed back to the system: workers live on idle beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's alone
        release(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with trim() at the end of each task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: Column | str, of: int) -> Column:
    """crc32 of the value as text, modulo `of`."""
    return F.pmod(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")), F.lit(of))


def fresh(names: list[str], wanted: str) -> str:
    """A column name that clashes with none of names."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


class IdFilter:
    """A bit map of fixed size over the hashes of ids: it holds all of them, and others by chance. It decides which
    rows need to be shuffled at all; an exact join decides the rest, so a full map costs time and no rows."""

    BITS = 1 << 25

    def __init__(self, ids: DataFrame, column: str):
        bit = self.place(F.col(column))
        words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))).alias("bits"))
        found = words.toArrow()  # BITS / 64 rows at most
        self.words = np.zeros(self.BITS // 64, dtype=np.int64)
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy()

    @classmethod
    def place(cls, column: Column) -> Column:
        return F.pmod(F.xxhash64(column.cast("long")), F.lit(cls.BITS))

    def has(self, places: np.ndarray) -> np.ndarray:
        return (self.words[places >> 6] >> (places & 63)) & 1 == 1

    def test(self, spark: SparkSession, column: Column) -> Column:
        """Whether the map may hold the column's value; rows without one aren't held."""
        words = spark.sparkContext.broadcast(self.words)  # BITS / 8 bytes

        @F.pandas_udf("boolean")
        def maybe(places: pd.Series) -> pd.Series:
            at = places.to_numpy(dtype=np.int64)
            return pd.Series((words.value[at >> 6] >> (at & 63)) & 1 == 1)

        return F.coalesce(column.isNotNull() & maybe(F.coalesce(self.place(column), F.lit(0).cast("long"))), F.lit(False))


def without_ids(docs: DataFrame, id_column: str, ids: DataFrame) -> DataFrame:
    """docs without the rows whose id is in ids (column id). Only rows that the bit map holds are shuffled."""
    flag, key = fresh(docs.columns, "maybe_id"), fresh(docs.columns, "gone_id")
    held = IdFilter(ids, "id")
    marked = docs.withColumn(flag, held.test(docs.sparkSession, F.col(id_column)))
    rest = marked.where(F.col(flag)).join(ids.select(F.col("id").alias(key)).hint("merge"), F.col(id_column).cast("long") == F.col(key), "left_anti")
    return marked.where(~F.col(flag)).unionByName(rest).select(*docs.columns)
