"""Rows that share a doc_id, or have none, keep verdicts of their own."""

import random
import sys
from pathlib import Path

import brute

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from tidelog.llm import jaccard_join  # noqa: E402


def _prose(rng, n):
    return " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))


def _rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_contaminated_rows_take_no_other_row_along(spark, tmp_path):
    rng = random.Random(7)
    leak = _prose(rng, 12)
    bad = f"{_prose(rng, 5)} {leak}"
    clean = [(None, _prose(rng, 20)), (None, None), (None, ""), (4, _prose(rng, 20)), (4, None), (5, _prose(rng, 20))]
    spark.createDataFrame([("q", leak)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, bad), (4, bad), (4, bad), (6, bad), *clean], "doc_id bigint, text string").repartition(3)
    assert _rows(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))) == _sorted(clean)


def test_copies_take_no_other_row_along(spark, tmp_path):
    rng = random.Random(8)
    words = _prose(rng, 80).split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    copy, own, other = " ".join(words), _prose(rng, 30), _prose(rng, 30)
    stay = [(3, copy), (5, own), (5, None), (7, other), (None, copy), (None, copy), (None, None), (8, own + " " + other)]
    docs = spark.createDataFrame([*stay, (5, copy), (5, near), (7, own), (7, other), (9, other)], "doc_id bigint, text string").repartition(3)
    assert _rows(corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path))) == _sorted(stay)


def test_texts_of_one_id_do_not_connect_each_other(spark):
    rng = random.Random(9)
    copy, own = _prose(rng, 40), _prose(rng, 40)
    rows = [(3, copy), (5, copy + " end"), (5, own), (8, own + " end")]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute.components(rows))
