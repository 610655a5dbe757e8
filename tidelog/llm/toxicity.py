"""Severity of toxic language by cumulative-link ordinal regression (operator 10).

Features are counts of words and word beginnings that the labels set apart. Labels say toxic or not; the grades above 0
are thirds of the toxic training rows by weight of such features in a hundred words. One weight for each
feature is shared by all thresholds: P(grade >= k) = logistic(w x - t_k), t_1 < t_2 < t_3. The output is the
expected grade, and whether the chance of grade 1 or more exceeds the one that separates the sample best.

The model is fitted on a bounded sample of the labelled documents: up to half of ``SAMPLE`` toxic ones and clean ones
for the rest, those with the smallest hash of doc_id. Each class counts in the likelihood and the decision as
often as among all labelled documents, so that a rare class is learnt and stays rare. Feature counts of the sample are made
in the cluster; the driver gets at most ``VOCABULARY`` features and the sample's counts of these. Scoring takes
every word of every text.

Defined results: null or empty text has no words and is as severe as the thresholds say; a document
with several labels is toxic if any says so; unless documents of both classes are there nobody is toxic (severity 0);
an id on many rows gives the sample no more rows than its class may have, equal rows count once in it; rows that
repeat get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import text as tx
from tidelog.llm.encoding import HashIndex
from tidelog.llm.shared import Scratch, portable, texts

SAMPLE = 8_000
VOCABULARY = 1024
GRADES = 4
MIN_DOCS = 5
STEPS = 400
PREFIXES = (4, 5, 6)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature code and row of each word and word beginning (in bytes), and the number of words of each row."""
    low = tx.LOWER[data]
    starts, ends, first = tx.words(data, offsets, tx.ALNUM)
    sizes = np.diff(first)
    doc, hashes = np.repeat(np.arange(len(sizes)), sizes), tx.RangeHash(low)
    codes, rows = [hashes.of(starts, ends)], [doc]
    for k in PREFIXES:
        longer = ends - starts > k
        codes.append(tx.mix(hashes.of(starts[longer], starts[longer] + k) + np.uint64(k)))
        rows.append(doc[longer])
    return np.concatenate(codes), np.concatenate(rows), sizes


def _distinct(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) with their counts."""
    order = np.lexsort((codes, rows))
    codes, rows = codes[order], rows[order]
    head = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])))) if len(codes) else order
    return codes[head], rows[head], np.diff(np.append(head, len(codes)))


def _feature_counts(sample: DataFrame) -> DataFrame:
    """feature, a (toxic documents with it), d (documents with it), summed by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tx.text_chunks(batches):
            codes, doc, _ = _distinct(*_features(data, offsets)[:2])
            y = rows.column(2).to_numpy()
            found, at = np.unique(codes, return_inverse=True)
            toxic = np.bincount(at, y[doc], len(found)).astype(np.int64) if len(found) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(found)))], names=["feature", "a", "d"])

    return sample.mapInArrow(portable(run), "feature bigint, a bigint, d bigint").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("d").alias("d"))


def _cells(sample: DataFrame, features: np.ndarray) -> DataFrame:
    """For each sample document: y, number of words, and positions and counts of the chosen features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(features, 12)
        for rows, data, offsets in tx.text_chunks(batches):
            codes, doc, n = _features(data, offsets)
            at = index.find(codes)
            hit = at >= 0
            cols, doc, counts = _distinct(at[hit], doc[hit])
            cuts = np.searchsorted(doc, np.arange(1, len(n)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(n), pa.array(np.split(cols, cuts), pa.list_(pa.int64())), pa.array(np.split(counts, cuts), pa.list_(pa.int64()))],
                names=["doc_id", "y", "n", "cols", "counts"],
            )

    kind = sample.schema["doc_id"].dataType.simpleString()
    return sample.mapInArrow(portable(run), f"doc_id {kind}, y int, n bigint, cols array<bigint>, counts array<bigint>")


class OrdinalModel:
    """Shared weights, ordered thresholds and the chance of grade 1 or more from which a text counts as toxic."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, decision: float):
        self.index, self.weights, self.thresholds, self.decision = HashIndex(features, 12), weights, thresholds, decision

    def linear(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """w x and the number of words of each row; x is the logarithm of 1 + count of a feature."""
        codes, doc, n = _features(data, offsets)
        at = self.index.find(codes)
        hit = at >= 0
        cols, doc, counts = _distinct(at[hit], doc[hit])
        return np.bincount(doc, np.log1p(counts) * self.weights[cols], len(n)), n

    def at_least(self, linear: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds, -50, 50)))


def fit_ordinal(
    rows: np.ndarray, cols: np.ndarray, x: np.ndarray, grade: np.ndarray, width: int, steps: int = STEPS, ridge: float = 2e-4, weight: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the mean log likelihood (rows weighted by ``weight``) less ``ridge`` / 2 times the squared weights."""
    n, cuts = len(grade), GRADES - 1
    part = np.full(n, 1 / n) if weight is None else weight / weight.sum()
    share = np.clip([part[grade >= k].sum() for k in range(1, GRADES)], 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(cuts) * 1e-3)
    # Thresholds are a first one and positive steps, so that they stay in order.
    p = np.concatenate((np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        jumps = np.exp(p[width + 1 :])
        t = np.concatenate((p[width : width + 1], p[width] + np.cumsum(jumps)))
        z = np.bincount(rows, x * p[cols], n)
        up = 1 / (1 + np.exp(-np.clip(z[:, None] - t, -30, 30)))
        full = np.concatenate((np.ones((n, 1)), up, np.zeros((n, 1))), 1)
        slope = np.concatenate((np.zeros((n, 1)), up * (1 - up), np.zeros((n, 1))), 1)
        at = np.arange(n)
        chance = np.maximum(full[at, grade] - full[at, grade + 1], 1e-9)
        low, high = slope[at, grade] / chance, slope[at, grade + 1] / chance
        low, high = low * part, high * part
        dz = high - low
        dt = np.array([low[grade == k].sum() - high[grade == k - 1].sum() for k in range(1, GRADES)])
        g = np.concatenate((np.bincount(cols, x * dz[rows], width) + ridge * p[:width], [dt.sum()], jumps * np.cumsum(dt[::-1])[::-1][1:]))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:width], np.concatenate((p[width : width + 1], p[width] + np.cumsum(np.exp(p[width + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> OrdinalModel | None:
    """Fit on the bounded sample of labelled documents; docs has doc_id and text."""
    marks = (
        labels.select(F.col(id_col).alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("y"))
        .where("doc_id IS NOT NULL AND y IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    scratch = Scratch(docs.sparkSession)
    marks = scratch.stage(marks, "toxic-marks")
    every = {r.y: r.d for r in marks.groupBy("y").agg(F.count("*").alias("d")).collect()}
    if len(every) < 2:
        scratch.clear()
        return None
    most = {1: min(every[1], sample // 2)}
    most[0] = min(every[0], sample - most[1])
    first = lambda df, k, *by: df.where(F.col("y") == k).orderBy(*by).limit(most[k])
    chosen = first(marks, 1, F.xxhash64("doc_id"), "doc_id").unionByName(first(marks, 0, F.xxhash64("doc_id"), "doc_id"))
    # At most ``sample`` rows of an id, a number and a hash: both broadcasts are bounded.
    rows_of = docs.withColumn("h", F.xxhash64("doc_id", "text"))
    found = rows_of.join(F.broadcast(chosen), "doc_id").select("doc_id", "h", "y").distinct()
    found = scratch.stage(found, "toxic-rows")
    kept = first(found, 1, "h", "doc_id").unionByName(first(found, 0, "h", "doc_id"))
    taken = rows_of.join(F.broadcast(kept), ["doc_id", "h"]).groupBy("doc_id", "h", "y").agg(F.any_value("text").alias("text"))
    taken = scratch.stage(taken.select("doc_id", "text", "y"), "toxic-sample")
    sizes = {r.y: r.d for r in taken.groupBy("y").agg(F.count("*").alias("d")).collect()}
    toxic, clean = sizes[1], sizes[0]
    a, b = F.col("a") + 0.5, F.col("d") - F.col("a") + 0.5
    odds = F.log(a / (toxic + 1.0 - a)) - F.log(b / (clean + 1.0 - b))
    top = (
        _feature_counts(taken)
        .where(F.col("d") >= MIN_DOCS)
        .select("feature", odds.alias("odds"), F.abs(odds / F.sqrt(1 / a + 1 / b)).alias("z"))
        .orderBy(F.desc("z"), "feature")
        .limit(vocabulary)
        .collect()
    )
    features = np.array([r.feature for r in top], np.int64).view(np.uint64)
    odds_of = np.array([r.odds for r in top])
    rows = sorted(_cells(taken, features).collect(), key=lambda r: (r.doc_id, r.n))
    scratch.clear()
    y, n = np.array([r.y for r in rows]), np.array([r.n for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r.cols) for r in rows])
    cols = np.array([c for r in rows for c in r.cols], np.int64)
    k = np.array([c for r in rows for c in r.counts], float)
    weight = np.bincount(at, k * np.maximum(odds_of[cols], 0), len(y)) / np.maximum(n, 1) * 100
    edges = np.quantile(weight[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + np.searchsorted(edges, weight, "left"), 0)
    part = np.where(y == 1, every[1] / toxic, every[0] / clean)
    weights, thresholds = fit_ordinal(at, cols, np.log1p(k), grade, len(features), weight=part)
    p = 1 / (1 + np.exp(-np.clip(np.bincount(at, np.log1p(k) * weights[cols], len(y)) - thresholds[0], -50, 50)))
    return OrdinalModel(features, weights, thresholds, _decision(p, y, part))


def _decision(p: np.ndarray, y: np.ndarray, part: np.ndarray) -> float:
    """The chance at which the weighted F measure on the sample is highest (midway to the next lower one)."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum((part * y)[order])
    score = 2 * right / (np.cumsum(part[order]) + (part * y).sum())
    score[:-1][p[order][:-1] == p[order][1:]] = -1  # equal chances fall on one side
    best = int(score.argmax())
    return float((p[order[best]] + p[order[min(best + 1, len(y) - 1)]]) / 2)


def severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, expected_severity (0 to 3), grade (the likeliest), p_toxic and toxic of every document."""
    base = texts(docs, id_col, text_col)
    model = fit(base, labels, sample=sample)
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tx.text_chunks(batches):
            if model:
                linear, n = model.linear(data, offsets)
                up, limit = model.at_least(linear), model.decision
            else:
                n = np.diff(tx.words(data, offsets, tx.ALNUM)[2])
                up, limit = np.zeros((len(n), GRADES - 1)), 1.0
            chance = -np.diff(np.concatenate((np.ones((len(up), 1)), up, np.zeros((len(up), 1))), 1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n), pa.array(np.round(up.sum(1), 9)), pa.array(chance.argmax(1).astype(np.int32)), pa.array(np.round(up[:, 0], 9)), pa.array(up[:, 0] > limit)],
                names=["doc_id", "n_words", "expected_severity", "grade", "p_toxic", "toxic"],
            )

    return base.mapInArrow(portable(run), f"doc_id {kind}, n_words bigint, expected_severity double, grade int, p_toxic double, toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, that are not toxic."""
    model = fit(texts(docs, id_col, text_col), labels, sample=sample)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tx.text_chunks(batches, text_col):
            linear, _ = model.linear(data, offsets)
            yield rows.filter(pa.array(model.at_least(linear)[:, 0] <= model.decision))

    return docs.mapInArrow(portable(run), docs.schema)
