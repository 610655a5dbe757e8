"""Vectors inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import text as tx


def vector_column(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("array<double>")


def finite(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are lists of finite numbers only: their positions, their lengths, and all their entries in a row."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    entries = pc.fill_null(entries, float("nan")).to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(valid & (bad[offsets[1:]] == bad[offsets[:-1]]))
    lengths = np.diff(offsets)[rows]
    return rows, lengths, entries[tx.ranges(offsets[rows], lengths)]


def scaled(entries: np.ndarray, scale: float, limit: int) -> np.ndarray:
    """floor(scale * entry) as integers, held within ``limit`` on both sides."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(entries * scale), -limit, limit).astype(np.int64)


def matrix(lengths: np.ndarray, entries: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` entries; shorter ones are filled up with 0."""
    out = np.zeros((len(lengths), width), entries.dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = entries
    return out
