"""The plans keep the shape that makes them scale."""

from pyspark.sql import functions as F

from tidelog import registry
from tidelog.fixtures import load
from tidelog.functions.skew import previous_reading, salted_join
from tidelog.operators import dead_letters as dl
from tidelog.operators import events as ev
from tidelog.operators import state as st
from tidelog.model import ORDER_TYPES
from tidelog.plans.queries_dead_letters import letters
from tidelog.plans.queries_events import messages
from tidelog.sources import write


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_current_state_shuffles_once_after_a_partial_merge(spark, sf_dir):
    plan = physical(st.current_state(load(spark, sf_dir, "order_log"), ["o_orderkey"]))
    assert plan.count("Exchange") == 1
    assert "partial_max_by" in plan


def test_key_filter_goes_below_the_merge_and_value_filter_does_not(spark, sf_dir):
    state = st.current_state(load(spark, sf_dir, "orders").withColumns(
        {"_version": F.lit(0), "arrival": F.lit(0), "_is_deleted": F.lit(0)}), ["o_orderkey"])
    by_key = physical(state.where("o_orderkey = 5"))
    assert "EqualTo(o_orderkey,5)" in by_key
    by_value = physical(state.where("o_orderstatus = 'F'"))
    assert "EqualTo(o_orderstatus,F)" not in by_value


def test_scans_read_only_needed_columns_and_push_filters(spark, sf_dir):
    plan = physical(registry.QUERIES["h02_recent"](spark, sf_dir))
    schema = plan[plan.index("ReadSchema"):]
    assert "o_custkey" not in schema and "o_orderpriority" not in schema
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EqualTo(o_orderstatus,F)" in plan


def test_no_python_workers_and_no_pair_joins_anywhere(spark, sf_dir):
    writes = ("a03", "a06", "a07_upsert", "a08", "a10", "a15", "a16", "c04", "c05", "c11", "c12", "f24", "f25",
              "h09", "h11", "h20", "h29", "h31_drop", "h34", "h35", "h36")
    for name, fn in registry.QUERIES.items():
        if name.startswith(writes):
            continue
        plan = physical(fn(spark, sf_dir))
        assert "EvalPython" not in plan and "InPandas" not in plan, name
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_filters_stay_above_parsing_and_classifying(spark, sf_dir):
    parsed = ev.unwrap(ev.parse_envelope(messages(spark, sf_dir), ORDER_TYPES)).where("op = 'u'")
    assert optimized(parsed).count("from_json") <= 2
    named = dl.analyse(letters(spark, sf_dir)).where("category = 'MISSING_TABLE'")
    assert len(optimized(named)) < 60000


def test_time_partitions_are_pruned(spark, sf_dir, tmp_path):
    path = str(tmp_path / "by_month")
    write.write_partitioned(load(spark, sf_dir, "orders"), path, "o_orderdate")
    read = spark.read.parquet(path).where("p_month = 199801")
    assert "PartitionFilters: [isnotnull(p_month" in physical(read)
    assert read.count() == load(spark, sf_dir, "orders").where("date_format(o_orderdate, 'yyyyMM') = '199801'").count()


def test_entity_filter_reads_one_bucket(spark, sf_dir, tmp_path):
    path = str(tmp_path / "buckets")
    events = load(spark, sf_dir, "events")
    write.bucket_by_entity(events, path, "user_id", 8)
    user = events.first()["user_id"]
    key = F.lit(user).cast("bigint")
    one = spark.read.parquet(path).where((F.col("entity_bucket") == write.entity_bucket(key, 8)) & (F.col("user_id") == user))
    assert "PartitionFilters: [isnotnull(entity_bucket" in physical(one)
    assert one.count() == events.where(F.col("user_id") == user).count()


def test_salted_join_equals_plain_join_with_a_hot_key(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(tuple(r) for r in salted_join(many, one, ["k"], how).collect())
        b = sorted(tuple(r) for r in many.join(one, ["k"], how).collect())
        assert [str(x) for x in a] == [str(x) for x in b]


def test_salt_spreads_a_hot_key_over_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = spark.range(8000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
        one = spark.createDataFrame([(1, 2)], "k int, w int")
        sizes = [r[1] for r in salted_join(many, one, ["k"]).groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 3 and max(sizes) < 8000 * 0.6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_previous_reading_equals_lag_across_empty_days(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-01 12:00:00", 4), ("a", "2024-01-05 00:00:00", 9), ("b", "2024-01-05 01:00:00", 2)],
        "t string, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = previous_reading(df, ["t"], "ts", ["v"], F.to_date("ts"))
    assert sorted((r.t, r.v, r.prev_v) for r in out.collect()) == [("a", 1, None), ("a", 4, 1), ("a", 9, 4), ("b", 2, None)]
