"""Exact numbers of links against brute force, in small regions and in regions cut into blocks."""

import random

import brute
import pytest

from tidelog.llm import jaccard_join


def _rows():
    rng = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(40):
        ws = list(base)
        for k in rng.sample(range(120), rng.randint(0, 4)):
            ws[k] = f"v{rng.randint(0, 9)}"
        rows.append((d, " ".join(ws)))
    rows += [(100 + d, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(40)) + " " + " ".join(base[:30])) for d in range(10)]
    return rows + [rows[0], (200, rows[0][1]), (7, rows[3][1]), (None, rows[0][1]), (201, None), (202, ""), (203, "a b"), (204, "A  b")]


def _links(docs):
    sets, out = brute.shingle_sets(docs), []
    for i, (d, _) in enumerate(docs):
        others = (sets[j] for j, (e, _) in enumerate(docs) if j != i and d is not None and e is not None and sets[i] and sets[j])
        out.append((d, sum(100 * len(sets[i] & b) >= 80 * len(sets[i] | b) for b in others)))
    return out


@pytest.mark.parametrize("region_size", [1000, 7])
def test_links(spark, region_size):
    rows = _rows()
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), region_size=region_size, links=True)
    assert sorted(((r.doc_id, r.n_links) for r in got.collect()), key=str) == sorted(_links(rows), key=str)
