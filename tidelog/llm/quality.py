"""Quality scores by random Fourier features, ridge regression and isotonic calibration (operator 3).

Statistics of a text (lengths, shares of characters, repetition of words and lines) are computed once
and written. Random Fourier features of the standardised statistics approximate a Gaussian kernel;
each partition of labelled rows sums its part of the normal equations, and the parts are added by
matrix row in the cluster. The driver receives the finished matrix (FEATURES squared), never rows.
Ridge scores are counted in ``BINS`` bins, made monotone (pool adjacent violators) and interpolated.

All labelled rows outside the held-out fold train. Inputs are statistics of the text alone.

Defined results: null or empty text has statistics of zero and gets the score these give; a document
with several labels counts as their mean, rounded half up; without any label every score is 0.5;
rows that repeat get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import text as tx
from tidelog.llm.shared import portable, staged, texts

FEATURES = 256
BANDWIDTH = 3.0
RIDGE = 1e-3
BINS = 1000
SEED = 7
STATISTICS = 23


def document_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS numbers for each text."""
    n = len(offsets) - 1

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets]).astype(float)

    size = np.diff(offsets).astype(float)
    share = lambda mask, of: count(mask) / np.maximum(of, 1)
    starts, ends, first = tx.words(data, offsets, ~tx.SPACE)
    n_words = np.diff(first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    codes = tx.RangeHash(data).of(starts, ends)
    upper, lower = (data >= 0x41) & (data <= 0x5A), (data >= 0x61) & (data <= 0x7A)
    digit, wide = (data >= 0x30) & (data <= 0x39), data >= 0x80
    letters = np.maximum(count(upper | lower), 1)
    lengths = (ends - starts).astype(float)
    mean_length = np.bincount(doc, lengths, n) / np.maximum(n_words, 1)
    spread = np.sqrt(np.maximum(np.bincount(doc, lengths**2, n) / np.maximum(n_words, 1) - mean_length**2, 0))
    unique, top = _variety(codes, doc, n)
    pairs = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    pair_codes = codes[pairs] * np.uint64(3) + codes[pairs + 1] if len(pairs) else codes[:0]
    unique_pairs, top_pair = _variety(tx.mix(pair_codes), doc[pairs], n)
    same = np.bincount(doc[pairs], codes[pairs] == codes[pairs + 1], n) if len(pairs) else np.zeros(n)
    line_starts, line_ends, line_first = tx.words(data, offsets, np.arange(256) != 0x0A)
    n_lines = np.diff(line_first).astype(float)
    line_doc = np.repeat(np.arange(n), np.diff(line_first))
    unique_lines, _ = _variety(tx.RangeHash(data).of(line_starts, line_ends), line_doc, n)
    last = data[ends - 1] if len(ends) else data[:0]
    odd_end = ~(tx.ALNUM[last] | np.isin(last, [0x2E, 0x2C]))
    n_pairs = np.maximum(n_words - 1, 1)
    columns = [
        np.log1p(size),
        np.log1p(n_words),
        mean_length,
        spread,
        count(upper) / letters,
        share(digit, size),
        share(wide, size),
        share(tx.SPACE[data], size),
        share(data == 0x2E, n_words),
        share(data == 0x2C, n_words),
        share(data == 0x21, n_words),
        share(data == 0x7C, n_words),
        share(~(upper | lower | digit | wide | tx.SPACE[data] | np.isin(data, [0x2E, 0x2C])), size),
        np.bincount(doc, odd_end, n) / np.maximum(n_words, 1),
        unique / np.maximum(n_words, 1),
        top / np.maximum(n_words, 1),
        unique_pairs / n_pairs,
        top_pair / n_pairs,
        same / n_pairs,
        np.log1p(n_lines),
        unique_lines / np.maximum(n_lines, 1),
        np.log1p(n_words / np.maximum(n_lines, 1)),
        share(np.isin(data, [0x3C, 0x3E, 0x7B, 0x7D, 0x40, 0x2F, 0x5C]), size),
    ]
    return np.stack(columns, 1)


def _variety(codes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each row and the count of its most frequent one."""
    if not len(codes):
        return np.zeros(n), np.zeros(n)
    packed = np.sort(doc.astype(np.uint64) << np.uint64(40) | codes >> np.uint64(24))
    head = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    of = (packed[head] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, of, np.diff(np.append(head, len(packed))))
    return np.bincount(of, minlength=n).astype(float), top


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    base = texts(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tx.text_chunks(batches):
            values = document_statistics(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * STATISTICS), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["doc_id", "x"])

    return base.mapInArrow(portable(run), f"doc_id {kind}, x array<double>")


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(column))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _summed(frame: DataFrame, part, width: int) -> np.ndarray:
    """Sum over partitions of the matrices that ``part`` makes of batches: rows of ``width`` numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), _matrix(batch, "v")):
                sums[i] = sums[i] + row if i in sums else row
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "v"])

    shape = "i int, v array<double>"
    rows = frame.mapInArrow(portable(partial), shape).repartition("i").mapInArrow(portable(add), shape).collect()
    out = np.zeros((len(rows), width))
    for row in rows:
        out[row.i] = row.v
    return out


class QualityModel:
    """Scores statistics: standardise, random Fourier features, ridge weights, monotone curve."""

    def __init__(self, features: int = FEATURES, bandwidth: float = BANDWIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(STATISTICS, features)) / bandwidth
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.mean, self.scale = np.zeros(STATISTICS), np.ones(STATISTICS)
        self.weights, self.curve = None, None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.concatenate((np.ones((len(x), 1)), z, waves), 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.round(np.clip(np.interp(self.raw(x), *self.curve), 0, 1), 9)


def monotone(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Closest non-decreasing sequence (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(n, v) for v, _, n in blocks])


def fit(train: DataFrame, ridge: float = RIDGE) -> QualityModel:
    """Fit on (x, y)."""
    model = QualityModel()
    moments = _summed(train, lambda b: np.stack((np.full(STATISTICS, float(b.num_rows)), _matrix(b).sum(0), (_matrix(b) ** 2).sum(0))), STATISTICS)
    if not len(moments):
        return model
    model.mean = moments[1] / moments[0]
    model.scale = np.sqrt(np.maximum(moments[2] / moments[0] - model.mean**2, 1e-12)) + 1e-6

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.features(_matrix(batch))
        y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
        return np.concatenate((z, y[:, None]), 1).T @ z

    width = 1 + STATISTICS + len(model.phases)
    sums = _summed(train, equations, width)
    n = moments[0][0]
    model.weights = np.linalg.solve(sums[:-1] / n + ridge * np.diag(np.r_[0, np.ones(width - 1)]), sums[-1] / n)

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        raw = np.clip(np.floor((model.raw(_matrix(batch)) + 0.5) / 2 * BINS), 0, BINS - 1).astype(int)
        y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
        return np.stack((np.bincount(raw, minlength=BINS).astype(float), np.bincount(raw, y, BINS)))

    counts, ones = _summed(train, binned, BINS)
    used = np.flatnonzero(counts)
    centre = (used + 0.5) / BINS * 2 - 0.5
    model.curve = (centre, monotone(ones[used] / counts[used], counts[used]))
    return model


def quality_scores(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out and score of every document; rows with crc32(doc_id) mod 5 = 0 never train."""
    x = staged(statistics(docs, id_col, text_col).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))), "statistics")
    marks = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("mark"))
        .where("doc_id IS NOT NULL AND mark IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.floor(F.avg("mark") + 0.5).cast("double").alias("y"))
    )
    model = fit(x.where("NOT held_out").join(marks, "doc_id").select("x", "y"))
    kind = x.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(model.score(_matrix(batch)))], names=["doc_id", "held_out", "score"])

    return x.mapInArrow(portable(run), f"doc_id {kind}, held_out boolean, score double")
