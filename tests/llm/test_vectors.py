"""Hard negatives and whitening against brute force, with nulls, odd entries, ties, repeats and empty tables."""

import math
from decimal import Decimal

import numpy as np
import pytest

from tidelog.llm import hard_negatives, queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, place string, n string, key string, anchor string, x string, score string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in rows], SCHEMA).repartition(parts)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [
        (None, [1.0, 2.0, 3.0], 1), (100, [1.0, 0.5, None], 1), (101, None, 1), (102, [nan, 1.0, 1.0], 2), (103, [1.0, inf, 1.0], 2), (104, [], 1),
        (200, [0.5, -0.25, 1.0], None), (300, [0.5], 1), (301, [3e38, -3e38, 1.0], 2), (302, [-0.001, 0.0, 0.0], 1), (303, [0.0, 0.0, 0.0], 2),
    ]


def plain_rows(n, dims, seed, grid=8):
    rng = np.random.default_rng(seed)
    v = rng.integers(-grid, grid + 1, (n, dims)) / grid  # a coarse grid: many ties
    return [(int(k * 10), [float(c) for c in v[k]], int(rng.integers(0, 3))) for k in range(n)]


def mined(rows, every=100, n_pos=5, n_neg=10, least=30, most=90):
    limit = 1 << 26
    e = [(i, label, [max(-limit, min(limit, math.floor(256 * float(np.float32(c))))) for c in v]) for i, v, label in rows if i is not None and label is not None and usable(v)]
    out, seen = [], set()
    for a, la, va in e:
        if a % every or (a, la, tuple(va)) in seen:
            continue
        seen.add((a, la, tuple(va)))
        scored = [(-sum(p * q for p, q in zip(va, v)), i, label) for i, label, v in e]
        pos = sorted(((s, i) for s, i, label in scored if label == la and i != a))[:n_pos]
        for s, i in pos:
            fits = sorted((t, j) for t, j, label in scored if label != la and least * -s <= 100 * -t <= most * -s)[:n_neg]
            out += [(a, i, k, j, -s, -t) for k, (t, j) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("dims,cell", [(3, 1 << 21), (16, 1 << 21), (16, 200), (70, 1 << 21)])
def test_hard_negatives(spark, dims, cell, monkeypatch):
    rows = plain_rows(150, dims, dims) + odd_rows()
    rows += [rows[20], rows[20], rows[21], (250, [1.0] * dims, 2)]
    want = mined(rows)
    assert len(want) > 100
    monkeypatch.setattr(hard_negatives, "CELL", cell)
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", cell // 4)
    assert sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows)).collect()) == want


def test_hard_negatives_of_one_hot_label_and_equal_vectors(spark):
    rows = [(k * 50, [1.0, 1.0], 0) for k in range(40)] + [(k * 50 + 1, [0.5, 0.5], 1) for k in range(40)]
    assert sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows)).collect()) == mined(rows)


def test_hard_negatives_without_rows_or_partners(spark):
    assert hard_negatives.mine(frame(spark, [(100, [1.0], 1)]).limit(0)).count() == 0
    assert hard_negatives.mine(frame(spark, [(100, [1.0], 1), (101, [0.5], 2)])).count() == 0  # no positive
    assert hard_negatives.mine(frame(spark, [(100, [1.0], 1), (101, [1.0], 1), (102, [-1.0], 2)])).count() == 0  # no negative
    assert hard_negatives.mine(frame(spark, [(None, None, None)])).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**17
    rows = [(100, [big, 1.0, big], 1), (101, [big, 1.0, big], 1), (102, [big, 3.0, big], 1), (103, [big * 0.5, 1.0, big * 0.5], 2), (104, [big * 0.5, 2.0, big * 0.5], 2)]
    assert sorted(tuple(r) for r in hard_negatives.mine(frame(spark, rows)).collect()) == mined(rows)


def test_the_bitmap_shrinks():
    """Rows that cannot reach a place are not read to the end."""
    rng = np.random.default_rng(0)
    import pyarrow as pa

    x = np.zeros((64, 4000), "<i4")
    x[0], x[1:] = rng.integers(-500, 500, 4000), rng.integers(-3, 4, (63, 4000))
    ids = np.arange(4000)
    table = pa.table({"n": pa.array([4000], pa.int32()), "dims": pa.array([64], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "labels": [np.zeros(4000, "<i8").tobytes()], "entries": [x.tobytes()]})
    anchor = np.full(64, 1)
    anchor[0] = 100
    cell = hard_negatives.Cell(table, [anchor])
    sizes = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            if isinstance(key, tuple) and len(key) == 2 and getattr(key[1], "ndim", 0) == 2:
                sizes.append(key[1].size)
            return out

    cell.x = cell.x.view(Counted)
    ((found, scores),) = cell.scan(anchor, slice(None), np.zeros(4000, bool), [(-np.inf, np.inf)], 5)
    exact = anchor @ x
    want = np.lexsort((ids, -exact))[:5]
    assert found.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
    assert sizes and max(sizes) < 200


def white(rows, components=16, weights="distinct"):
    """{row: ...} in exact and double arithmetic."""
    used = [(i, v) for i, v, _ in rows if usable(v)]
    dims = max(len(v) for _, v in used)
    limit = 1 << 52
    x = [tuple(max(-limit, min(limit, math.floor(64 * float(np.float32(c))))) for c in v) + (0,) * (dims - len(v)) for _, v in used]
    fit = sorted(set(x)) if weights == "distinct" else x
    n, total = len(fit), [sum(v[d] for v in fit) for d in range(dims)]
    c = np.array([[(n * v[d] - total[d]) / n for d in range(dims)] for v in fit])
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    centred = np.array([[(n * v[d] - total[d]) / n for d in range(dims)] for v in x])
    deviation = [sum((n * v[d] - total[d]) ** 2 for d in range(dims)) for v in x]
    return [i for i, _ in used], n, deviation, centred @ vectors, values, np.trace(cov)


@pytest.mark.parametrize("weights", ["distinct", "rows"])
def test_whitening(spark, weights):
    rows = plain_rows(200, 6, 3) + [r for r in odd_rows() if r[0] != 301]
    rows += [(5, [0.25] * 6, 1)] * 150 + [(7000 + k, rows[3][1], 1) for k in range(3)]
    ids, n, deviation, projected, values, trace = white(rows, 4, weights)
    got = whitening.whiten(frame(spark, rows), components=4, weights=weights).collect()
    assert len(got) == 4 * len(ids) and {r.n for r in got} == {n}
    assert {round(r.identity_error, 9) for r in got} == {0}
    by = {}
    for r in got:
        by.setdefault((r.deviation, r.component), []).append(r)
    for k in range(4):
        assert all(abs(r.explained - values[k] / trace) < 1e-12 for r in got if r.component == k + 1)
    names = lambda keys: sorted(map(str, keys))
    assert names((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == names(zip(ids, deviation))
    first = {r.vec_id: r for r in got if r.component == 2}
    signs = {np.sign(first[i].whitened * p[1]) for i, p in zip(ids, projected) if ids.count(i) == 1 and abs(p[1]) > 1e-9}
    assert len(signs) == 1
    sign = signs.pop()
    assert all(abs(first[i].whitened * sign - p[1] / math.sqrt(values[1])) < 1e-9 for i, p in zip(ids, projected) if ids.count(i) == 1)


def test_whitening_of_extreme_entries(spark):
    rows = odd_rows() + plain_rows(20, 3, 5)
    ids, n, deviation, _, _, _ = white(rows)
    got = whitening.whiten(frame(spark, rows)).where("component = 1").collect()
    fits = lambda v: v if v < 10**38 else None
    assert sorted(map(str, ((r.vec_id, r.deviation) for r in got))) == sorted(map(str, ((i, None if fits(d) is None else Decimal(d)) for i, d in zip(ids, deviation))))


def test_whitening_without_spread_or_rows(spark):
    same = whitening.whiten(frame(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, None, 1)])).collect()
    assert sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in same) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    flat = whitening.whiten(frame(spark, [(1, [0.0, 1.0], 1), (2, [0.0, -1.0], 1), (3, [], 2)])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and all(abs(r.identity_error) < 1e-12 for r in flat)
    assert whitening.whiten(frame(spark, [(1, [0.0, 0.0], 1)])).count() == 2
    none = frame(spark, [(1, [1.0], 1)]).limit(0)
    assert whitening.whiten(none).count() == 0 and whitening.whiten(frame(spark, [(1, [], 1), (2, None, 2)])).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(none, weights="none")


def test_whitening_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    ids, n, deviation, projected, values, trace = white(rows)
    got = sorted(queries.op13_whitening(spark, sf_dir).collect(), key=lambda r: (r.vec_id, r.component))
    order = np.argsort(ids)
    found = np.array([r.whitened for r in got]).reshape(len(ids), 16)
    want = (projected / np.sqrt(values))[order]
    assert np.abs(found * np.sign((found * want).sum(axis=0)) - want).max() < 1e-8
    assert [r.deviation for r in got][::16] == [deviation[k] for k in order] and {r.n for r in got} == {n}
    assert np.abs(np.array([r.explained for r in got[:16]]) - values / trace).max() < 1e-12
    assert {r.identity_error < 1e-9 for r in got} == {True}
