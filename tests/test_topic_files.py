"""Topics in as many files as keep each of bounded size, however many orders there are."""

import os

from tidelog import registry
from tidelog.fixtures import load
from tidelog.plans import queries_sources as qs


def test_files_of_a_topic_stay_of_bounded_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(qs, "ORDERS_PER_FILE", 100)
    path = qs.topic_files(spark, sf_dir)
    files = [f for f in os.listdir(path) if f.endswith(".json")]
    messages = [r["count"] for r in spark.read.json(path).groupBy("_metadata.file_path").count().collect()]
    assert len(files) == len(messages) == 4 * 4  # 1,500 orders
    assert max(messages) <= 250 and sum(messages) == load(spark, sf_dir, "envelopes").count()


def test_many_files_make_the_same_batches(spark, sf_dir, monkeypatch):
    few = sorted(map(str, registry.QUERIES["a06_append_versions"](spark, sf_dir).collect()))
    monkeypatch.setattr(qs, "ORDERS_PER_FILE", 100)
    assert tuple(registry.QUERIES["a08_micro_batches"](spark, sf_dir).first()) == (4, load(spark, sf_dir, "envelopes").count())
    assert sorted(map(str, registry.QUERIES["a06_append_versions"](spark, sf_dir).collect())) == few
