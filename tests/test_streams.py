"""Restart, repeated and late input leave the same result."""

from pyspark.sql import functions as F

from tidelog.fixtures import load
from tidelog.model import MESSAGE_SCHEMA, ORDER_TYPES
from tidelog.operators import state as st
from tidelog.plans.queries_events import messages
from tidelog.sources import read, write
from tidelog.streaming import jobs

PATTERN = r"mysql\.shop\..*"


def put(df, path):
    df.select(*MESSAGE_SCHEMA.names).coalesce(1).write.mode("append").json(path)


def run(spark, topic, tmp_path):
    stream = read.read_changes(spark, PATTERN, path=topic, max_files=1)
    jobs.replicate(
        stream, ORDER_TYPES, str(tmp_path / "table"), str(tmp_path / "dlq"), str(tmp_path / "cp"),
        required=["o_orderkey"], available_now=True,
    ).awaitTermination()


def test_restart_duplicates_and_late_files(spark, sf_dir, tmp_path):
    msgs = messages(spark, sf_dir).cache()
    topic = str(tmp_path / "topic")
    slice_ = F.pmod(F.xxhash64("off"), F.lit(5))
    put(msgs.where(slice_ == 4), topic)  # the newest slice first
    put(msgs.where(slice_ == 0), topic)
    run(spark, topic, tmp_path)
    put(msgs.where(slice_ == 1), topic)
    put(msgs.where(slice_ == 1), topic)  # delivered twice
    run(spark, topic, tmp_path)          # restarted from the checkpoint
    put(msgs.where(slice_.isin(2, 3)), topic)
    run(spark, topic, tmp_path)
    run(spark, topic, tmp_path)          # nothing new

    log = spark.read.parquet(str(tmp_path / "table"))
    twice = msgs.where((slice_ == 1) & F.col("value").isNotNull()).count()
    dlq = spark.read.parquet(str(tmp_path / "dlq"))
    assert log.count() + dlq.count() == msgs.where("value IS NOT NULL").count() + twice
    live = st.current_state(log, ["o_orderkey"], ["_version", "part", "off"])
    good = load(spark, sf_dir, "order_log").where("arrival % 97 <> 5 AND arrival % 89 <> 7")
    want = st.current_state(good, ["o_orderkey"])
    cols = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    assert sorted(map(tuple, live.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_a_batch_run_again_leaves_one_copy(spark, tmp_path):
    sink = write.idempotent_sink(str(tmp_path / "t"))
    for _ in range(3):
        sink(spark.range(10), 0)
    sink(spark.range(5), 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 15


def test_a_new_checkpoint_leaves_old_rows(spark, tmp_path):
    for k, n in ((0, 10), (1, 5)):
        spark.range(n).write.parquet(str(tmp_path / f"in{k}"))
        stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / f"in{k}"))
        jobs.append_to(stream, str(tmp_path / "t"), str(tmp_path / f"cp{k}"), available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 15


def test_state_stream_uses_a_state_store_that_spills(spark, sf_dir, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        changes = load(spark, sf_dir, "user_changes").select("user_id", "ts", "event_id", "value", "_is_deleted")
        src = str(tmp_path / "in")
        changes.repartition(3).write.parquet(src)
        stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(src)
        out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
        jobs.stream_state(stream, ["user_id"], ["ts", "event_id"], out, cp, available_now=True).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.user_id, r.event_id) for r in jobs.read_state(spark, out, ["user_id"]).collect())
    want = st.latest_by_key(changes, ["user_id"], ["ts", "event_id"])
    assert got == sorted((r.user_id, r.event_id) for r in want.collect())


def test_triggers():
    assert jobs.trigger(available_now=True) == {"availableNow": True}
    assert jobs.trigger(30) == {"processingTime": "30 seconds"}
