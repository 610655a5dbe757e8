"""The ordinal model: rare classes, hot ids, the optimum of its likelihood."""

import random

import numpy as np

from tidelog.llm import toxicity


def prose(rng, n=30):
    return " ".join(rng.choice(["river", "stone", "walks", "under", "seven", "lamps", "green", "paper"]) + rng.choice(["", "s", "ed"]) for _ in range(n))


def test_six_toxic_among_twelve_thousand_are_learnt(spark):
    rng = random.Random(1)
    bad = set(rng.sample(range(12000), 6))
    docs = [(k, prose(rng, 12) + (" vilescum wretchhound" * 3 if k in bad else "")) for k in range(12000)]
    docs += [(20000, "plain " + prose(rng)), (20001, "a new text: " + "vilescum wretchhound " * 3), (20002, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k in bad)) for k in range(12000)], "doc_id bigint, toxic int")
    marked = {r.doc_id for r in toxicity.severity(frame, labels, sample=8000).where("toxic").collect()}
    assert marked == bad | {20001}


def test_a_hot_id_stays_within_the_sample(spark):
    rng = random.Random(2)
    rows = [(1, prose(rng)) for _ in range(3000)] + [(1, "the same text")] * 500
    rows += [(k, "vilescum " * 5 + prose(rng, 5)) for k in range(2, 40)] + [(k, prose(rng)) for k in range(40, 200)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(2 <= k < 40)) for k in range(1, 200)], "doc_id int, toxic int")
    seen = []
    cells = toxicity._cells

    def counted(sample, features):
        seen.append(sample.count())
        return cells(sample, features)

    toxicity._cells = counted
    try:
        out = toxicity.severity(docs, labels, sample=100)
        assert {r.doc_id for r in out.where("toxic").collect()} == set(range(2, 40)) and out.count() == len(rows)
    finally:
        toxicity._cells = cells
    assert seen and seen[0] <= 100


def test_no_model_unless_both_classes_are_there(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    for marks in ([(1, 0), (2, 0)], [(1, 1), (2, 1)], [(1, 0), (9, 1)], [(None, 1), (1, None)]):
        labels = spark.createDataFrame(marks, "doc_id int, toxic int")
        assert toxicity.severity(docs, labels).where("toxic").count() == 0
        assert toxicity.without_toxic(docs, labels).count() == 2


def objective(p, width, dense, grade, part, ridge):
    t = np.concatenate((p[width : width + 1], p[width] + np.cumsum(np.exp(p[width + 1 :]))))
    up = 1 / (1 + np.exp(-(dense @ p[:width])[:, None] + t))
    full = np.concatenate((np.ones((len(grade), 1)), up, np.zeros((len(grade), 1))), 1)
    at = np.arange(len(grade))
    return (part * np.log(full[at, grade] - full[at, grade + 1])).sum() - ridge / 2 * (p[:width] ** 2).sum()


def test_the_fit_is_the_optimum_of_the_weighted_likelihood():
    rng = np.random.default_rng(3)
    width, n, ridge = 4, 400, 0.01
    dense = rng.poisson(0.7, (n, width)).astype(float)
    grade = np.clip(np.digitize(dense @ [1.0, -0.5, 0.8, 0.0] + rng.logistic(size=n), [0.5, 1.5, 2.5]), 0, 3)
    part = np.where(grade > 0, 2.0, 1.0)
    rows, cols = np.nonzero(dense)
    weights, t = toxicity.fit_ordinal(rows, cols, dense[rows, cols], grade, width, steps=4000, ridge=ridge, weight=part)
    p = np.concatenate((weights, t[:1], np.log(np.diff(t))))
    args = (width, dense, grade, part / part.sum(), ridge)
    best = objective(p, *args)
    slope = [(objective(p + d, *args) - objective(p - d, *args)) / 2e-5 for d in np.eye(len(p)) * 1e-5]
    assert np.abs(slope).max() < 1e-3
    assert all(objective(p + rng.normal(0, 0.05, len(p)), *args) < best for _ in range(200))
