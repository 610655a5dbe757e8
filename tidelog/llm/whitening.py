"""Whitening of embeddings by the covariance of their distinct vectors (operator 13).

Entries are quantised to integers, ``floor(scale * entry)``. Identical vectors are grouped; the fit takes
each distinct vector with weight 1 (``weights="distinct"``) or with its number of rows (``weights="rows"``).

1. Sums per dimension and the total weight are exact integers, summed over partitions.
2. Vectors are centred first (an exact integer difference, less one fraction below 1) and then multiplied:
   each task adds up weighted products of blocks, Spark adds up the entries of the matrices, and the driver
   solves the eigenproblem of one matrix of dimension by dimension, whatever the number of rows.
3. Each distinct vector is whitened once and joined back to its rows. At most ``HOT`` vectors can hold more than a
   share of 1 / ``HOT`` of the rows; these are broadcast, so that no task gets all rows of one vector.

Defined results: rows whose vector is null, or holds null, nan or infinity, are left out; so is nothing else, a null
id stays an id. Shorter vectors count as filled up with entries 0, the empty one too. Scaled entries are held within
plus and minus 2**52. A direction in which the vectors do not differ (its eigenvalue is 0 to double precision) has
``whitened`` null and no part in ``identity_error``; ``explained`` is null where nothing differs at all.
``deviation`` is null where it has more than 38 digits. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import Scratch, portable
from tidelog.llm.vectors import finite, matrix, scaled, vector_column

HOT = 1000
LIMIT = 1 << 52
BLOCK = 1 << 19  # entries of the vectors that a task multiplies at once
HALF = 26  # bits of the lower part of an entry; sums of either part fit 64 bits for 2**36 vectors
WIDTHS = (1, 2, 4, 8)


def _packed(rows: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes: their width, then the entries up to the last that is not 0."""
    lengths = rows.shape[1] - np.argmax(np.concatenate((rows[:, ::-1] != 0, np.ones((len(rows), 1), bool)), axis=1), axis=1)
    low, high = rows.min(axis=1, initial=0), rows.max(axis=1, initial=0)
    out = [b""] * len(rows)
    kind = sum(((low < -(1 << (8 * w - 1))) | (high >= 1 << (8 * w - 1))).astype(int) for w in WIDTHS[:3])
    for k, width in enumerate(WIDTHS):
        some = np.flatnonzero(kind == k)
        raw, size = rows[some].astype(f"<i{width}").tobytes(), rows.shape[1] * width
        for at, (row, n) in enumerate(zip(some.tolist(), lengths[some].tolist())):
            out[row] = bytes([width]) + raw[at * size : at * size + n * width]
    return out


def _unpacked(blobs: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(blobs), dims), np.int64)
    widths = np.array([b[0] for b in blobs])
    for width in WIDTHS:
        some = np.flatnonzero(widths == width)
        if len(some):
            lengths = np.array([(len(blobs[k]) - 1) // width for k in some.tolist()])
            out[some] = matrix(lengths, np.frombuffer(b"".join(blobs[k][1:] for k in some.tolist()), f"<i{width}").astype(np.int64), dims)
    return out


def quantised(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """id, length, 128-bit key and packed integers of every row with a finite vector."""
    base = vectors.select(F.col(id_col).alias("id"), vector_column(vectors, vector_col).alias("v"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widest = max(1, int(np.diff(batch.column(1).offsets.to_numpy(zero_copy_only=False)).max(initial=1)))
            step = max(1, BLOCK // widest)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows, lengths, entries = finite(part.column(1))
                blobs = _packed(matrix(lengths, scaled(entries, scale, LIMIT), int(lengths.max(initial=0)))) if len(rows) else []
                keys = [hashlib.blake2b(b, digest_size=16).digest() for b in blobs]
                columns = [part.column(0).take(pa.array(rows)), pa.array(lengths.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "key", "x"])

    return base.mapInArrow(portable(run), f"id {kind}, size int, key binary, x binary")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of (key, x, weight) batches with their integers and weights."""
    step = max(1, BLOCK // max(1, dims))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, _unpacked(part.column(1).to_pylist(), dims), part.column(2).to_numpy(zero_copy_only=False)


class Fit:
    """Mean and principal directions of the weighted distinct vectors of a frame (key, x, weight)."""

    def __init__(self, distinct: DataFrame, dims: int, components: int):
        self.n, self.dims = distinct.agg(F.sum("weight")).first()[0] or 0, dims
        if not self.n or not dims:
            return
        self._centre(distinct)
        self._directions(distinct, components)

    def _centre(self, distinct: DataFrame) -> None:
        dims = self.dims

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, top = np.zeros(dims, np.int64), np.zeros(dims, np.int64), 0
            for _, x, weight in _blocks(batches, dims):
                low += weight @ (x & ((1 << HALF) - 1))
                high += weight @ (x >> HALF)
                top = max(top, int(np.abs(x).max(initial=0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(low), pa.array(high), pa.array(np.full(dims, top))], names=["d", "low", "high", "top"])

        exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
        rows = distinct.mapInArrow(portable(sums), "d int, low bigint, high bigint, top bigint").groupBy("d").agg(exact("low"), exact("high"), F.max("top")).collect()
        total = {r[0]: int(r[1]) + (int(r[2]) << HALF) for r in rows}
        self.whole = np.array([total[d] // self.n for d in range(dims)], np.int64)  # of the mean
        self.rest = np.array([total[d] % self.n for d in range(dims)], np.int64)  # the mean's fraction, times n
        self.top = max((r[3] for r in rows), default=0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - sum)**2, exactly."""
        n, y, kind = self.n, x - self.whole, pa.decimal128(38, 0)
        if self.dims * (n * (2 * self.top + 2)) ** 2 < 1 << 62:
            return pa.array(((n * y - self.rest) ** 2).sum(axis=1)).cast(kind)
        y, rest = y.astype(object), self.rest.astype(object)
        found = ((n * y - rest) ** 2).sum(axis=1).tolist()
        return pa.array([Decimal(v) if v < 10**38 else None for v in found], kind)

    def _directions(self, distinct: DataFrame, components: int) -> None:
        dims, centred = self.dims, self.centred

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((dims, dims))
            for _, x, weight in _blocks(batches, dims):
                y = centred(x)
                total += (y * weight[:, None]).T @ y
            yield _triangle(total)

        square = _square(distinct.mapInArrow(portable(products), "i int, j int, v double"), dims) / self.n
        values, vectors = np.linalg.eigh(square)
        order = np.argsort(-values, kind="stable")[:components]
        self.trace = float(np.trace(square))
        self.values, self.vectors = np.maximum(values[order], 0), vectors[:, order]
        self.flat = self.values <= dims * np.finfo(float).eps * max(float(values.max(initial=0)), 0.0)
        self.scale = np.where(self.flat, np.nan, 1 / np.sqrt(np.where(self.flat, 1, self.values)))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors * self.scale


def _triangle(total: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(total))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])


def _square(parts: DataFrame, dims: int) -> np.ndarray:
    """The symmetric matrix whose upper triangle is the sum of the parts' entries (i, j, v)."""
    out = np.zeros((dims, dims))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def _identity_error(white: DataFrame, fit: Fit) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance, centred by its measured mean, minus the identity."""
    used = np.flatnonzero(~fit.flat)
    if not len(used):
        return None

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(fit.values))[:, used]
            yield w, batch.column(1).to_numpy(zero_copy_only=False).astype(float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(used))
        for w, weight in values(batches):
            total += weight @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(used)), pa.int32()), pa.array(total)], names=["i", "v"])

    rows = white.select("whitened", "weight")
    found = rows.mapInArrow(portable(sums), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    mean = np.zeros(len(used))
    for r in found:
        mean[r.i] = r.v / fit.n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(used), len(used)))
        for w, weight in values(batches):
            total += ((w - mean) * weight[:, None]).T @ (w - mean)
        yield _triangle(total)

    square = _square(rows.mapInArrow(portable(products), "i int, j int, v double"), len(used)) / fit.n
    return float(np.abs(square - np.eye(len(used))).max())


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64, components: int = 16, weights: str = "distinct"
) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n (total weight), deviation decimal(38,0), whitened, explained, identity_error.

    One row for each row of a finite vector and each of its first ``components`` directions.
    """
    if weights not in ("distinct", "rows"):
        raise ValueError("weights are 'distinct' or 'rows'")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = Scratch(spark).stage(quantised(vectors, scale, id_col, vector_col), "whitening-rows")
    counted = rows.groupBy("key", "x").agg(F.count("*").alias("copies"))
    distinct = scratch.stage(counted.withColumn("weight", F.lit(1).cast("bigint") if weights == "distinct" else F.col("copies")), "whitening-distinct")
    fit = Fit(distinct.select("key", "x", "weight"), rows.agg(F.max("size")).first()[0] or 0, components)
    if not fit.n or not fit.dims:
        kind = rows.schema["id"].dataType.simpleString()
        schema = f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        scratch.clear()
        return spark.createDataFrame([], schema)

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, _ in _blocks(batches, fit.dims):
            w = fit.whitened(x)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel(), from_pandas=True), w.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), fit.deviation(x), lists], names=["key", "weight", "copies", "deviation", "whitened"])

    found = Scratch(spark).stage(
        distinct.select("key", "x", "weight", "copies").mapInArrow(portable(white), "key binary, weight bigint, copies bigint, deviation decimal(38,0), whitened array<double>"),
        "whitening-white",
    )
    error = _identity_error(found, fit)
    total = found.agg(F.sum("copies")).first()[0]
    scratch.clear()
    rows, white_rows = rows.select(F.col("id").alias("vec_id"), "key"), found.select("key", "deviation", "whitened", "copies")
    # Fewer than HOT vectors: a bounded side.
    hot = F.broadcast(white_rows.where(F.col("copies") * HOT > total))
    rare = rows.join(hot.select("key"), "key", "left_anti").join(white_rows.where(F.col("copies") * HOT <= total), "key")
    joined = rows.join(hot, "key").unionByName(rare)
    shares = F.array(*(F.lit(float(v) / fit.trace if fit.trace else None).cast("double") for v in fit.values))
    return joined.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
