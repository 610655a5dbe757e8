"""Inputs that used to lose rows, to bring back old ones or to fail."""

import os
import uuid

from pyspark.sql import functions as F

from tidelog.functions.columns import row_hash64
from tidelog.operators import bi, dead_letters, metrics, quality
from tidelog.operators.state import merge_upsert
from tidelog.sources import write


def test_a_late_batch_does_not_replace_newer_rows(spark):
    target = spark.createDataFrame([(1, "new", 10), (2, "old", 1)], "k int, v string, _version bigint")
    batch = spark.createDataFrame([(1, "late", 5, 0), (2, "next", 2, 0), (3, "gone", 3, 1)], "k int, v string, _version bigint, _is_deleted int")
    merged = merge_upsert(target, batch, ["k"], ["_version"])
    assert sorted(tuple(r) for r in merged.collect()) == [(1, "new", 10), (2, "next", 2)]


def test_partition_names_are_escaped_and_stay_inside_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    write.write_table(spark.createDataFrame([(1, "EU:1"), (2, "US"), (3, None)], "k int, p string"), path, ["p"])
    write.drop_partitions(spark, path, "p", ["EU:1", None, "../../elsewhere"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [2]
    assert os.path.isdir(path)


def test_wide_rows_differ_in_any_column(spark):
    row = lambda at: [1 if i == at else None for i in range(61)]
    names = [f"c{i}" for i in range(61)]
    df = spark.createDataFrame([row(0), row(60)], ", ".join(f"{n} int" for n in names))
    assert df.select(row_hash64(names).alias("h")).distinct().count() == 2


def test_records_without_a_topic_are_replayed(spark):
    value = '{"before":null,"after":{"id":1},"source":{"file":"bin.000001","pos":4},"op":"c"}'
    schema = "topic string, part int, off bigint, msg_key string, value string, attempt int"
    dlq = spark.createDataFrame([("x.y.a", 0, 1, "k", value, 0), ("x.y.b", 0, 2, "k", value, 0), (None, 0, 3, "k", value, 0)], schema)
    ok, failed = dead_letters.replay(dlq, {"id": "int"}, exclude=["b"])
    assert ok.count() + failed.count() == 2


def test_rows_without_a_date_survive_a_refresh(spark, tmp_path):
    path = str(tmp_path / f"r-{uuid.uuid4().hex}")
    old = spark.createDataFrame([(1, None, 7), (2, None, 5)], "k int, d string, amount int").withColumn("d", F.to_date("d"))
    bi.write_rollup(bi.rollup_daily(old, "d", F.col("amount")), path)
    new = spark.createDataFrame([(1, None, 7), (2, "2024-01-05", 5)], "k int, d string, amount int").withColumn("d", F.to_date("d"))
    bi.refresh_rollup(path, old.where("k = 2"), new, "d", F.col("amount"), ["k"])
    assert sorted((str(r.day), r.total) for r in spark.read.parquet(path).collect()) == [("2024-01-05", 5), ("None", 7)]


def test_nothing_divides_by_zero(spark):
    idle = spark.createDataFrame([(5, 0)], "lag bigint, rate bigint")
    assert metrics.eta(idle, rate=F.col("rate")).first().eta_seconds is None
    none = spark.createDataFrame([], "status string")
    assert quality.accuracy_grade(none).first().grade == "FAILED"
    sample = spark.createDataFrame([("a",)], "table_name string")
    assert dead_letters.extrapolate(sample, F.lit(0)).first().n_sample == 1


def test_state_is_kept_in_rocksdb(spark):
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
