"""Segments of the positional index with equal content."""

import random

from tidelog.llm import decontamination


def _prose(rng, n):
    return " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))


def test_equal_segments_keep_all_their_rows(spark, monkeypatch):
    rng = random.Random(10)
    leak = _prose(rng, 30)
    row = (None, f"{_prose(rng, 5)} {leak}")
    items = spark.createDataFrame([("q", leak)], "item_id string, text string")
    docs = spark.createDataFrame([row, (1, "one two")] * 3, "doc_id bigint, text string").repartition(2)
    monkeypatch.setattr(decontamination, "SEGMENT", 1)  # each row is a segment, three equal ones of each text
    monkeypatch.setattr(decontamination, "BLOCK", 3)
    got = [(r.doc_id, r.n_words, r.n_hit) for r in decontamination.contamination(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(None, 35, 30), (1, 2, 0)] * 3, key=str)
