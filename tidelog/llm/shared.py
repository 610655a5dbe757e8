"""Tables and folders in the shared folder that the cluster names, and small frame helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import staged, work_dir

__all__ = ["staged", "work_dir", "texts", "portable", "portable_pair", "releasing", "Marks", "Scratch"]


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, so that other columns of the input cannot clash with an operator's own."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


class Scratch:
    """Written tables that are deleted together, once what was made of them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = work_dir(self.spark, name)
        df.write.mode("error").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = []


class Marks:
    """A bitmap of 64-bit keys that never misses one; its size is bounded whatever their number.

    It has 8 positions for each key up to 2**``bits`` in all; beyond, it lets more strangers pass.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = 26):
        self.bits = min(bits, max(10, (8 * keys.count()).bit_length()))
        slot = F.col(column).bitwiseAND(F.lit((1 << self.bits) - 1))
        words = (
            keys.groupBy(F.shiftright(slot, 6).alias("w"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({column} & 63 AS INT))")).alias("v"))
            .toPandas()
        )
        self.words = np.zeros((1 << self.bits) // 64, np.uint64)
        self.words[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def releasing(batches: Iterator, *caches) -> Iterator:
    """Pass batches on and empty the caches after the last one: workers, and what they keep, outlive their tasks."""
    try:
        yield from batches
    finally:
        for cache in caches:
            cache.clear()


def _shipped(fn: Callable) -> tuple[Callable, Callable]:
    """Two functions that travel by value, so that workers need not find this package: one opens ``fn``, one gives memory back."""
    payload, root = cloudpickle.dumps(fn), str(Path(__file__).parents[2])

    def opened():
        import pickle
        import sys

        if root not in sys.path:
            sys.path.append(root)
        return pickle.loads(payload)

    def release():
        # What a task leaves in a worker would add to the memory of the stages after it.
        import ctypes

        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return opened, release


def portable(fn: Callable) -> Callable:
    """``fn`` for mapInArrow, also where workers start outside the folder that holds this package."""
    opened, release = _shipped(fn)

    def run(batches):
        try:
            yield from opened()(batches)
        finally:
            release()

    return run


def portable_pair(fn: Callable) -> Callable:
    """The same for a cogrouped ``fn`` of two tables."""
    opened, release = _shipped(fn)

    def run(left, right):
        try:
            return opened()(left, right)
        finally:
            release()

    return run
