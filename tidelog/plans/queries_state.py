"""Registered queries: merge semantics and the flagship daily trend on current state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import load
from tidelog.operators import state as st
from tidelog.registry import query

ORDER_KEYS = ["o_orderkey"]
ORDER_PARTITION = "o_ym"

_LATEST_ORDERS = """
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY _version DESC, arrival DESC) AS rn
      FROM order_log) r WHERE rn = 1"""


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "order_log")


def live_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.current_state(order_log(spark, sf_dir), ORDER_KEYS)


def show_order(df: DataFrame) -> DataFrame:
    return df.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"),
        "op",
        "_version",
    )


_SHOW = """o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, op, _version"""


@query("c01_latest_version", f"SELECT {_SHOW} FROM ({_LATEST_ORDERS}) s")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_order(st.current_state(order_log(spark, sf_dir), ORDER_KEYS, deleted=None))


@query("c02_current_state", f"SELECT {_SHOW} FROM ({_LATEST_ORDERS}) s WHERE _is_deleted = 0")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return show_order(live_orders(spark, sf_dir))


@query(
    "c02_current_users",
    """
    SELECT user_id, event_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM user_changes) r
    WHERE rn = 1 AND _is_deleted = 0""",
)
def current_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "user_changes")
    live = st.current_state(log, ["user_id"], version=["ts", "event_id"])
    return live.select("user_id", "event_id", "event_type", "value")


@query(
    "c03_raw_live",
    """
    SELECT op, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys, CAST(sum(o_totalprice) AS DOUBLE) AS price_sum
    FROM order_log WHERE _is_deleted = 0 GROUP BY op""",
)
def raw_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        st.raw_live(order_log(spark, sf_dir))
        .groupBy("op")
        .agg(
            F.count("*").alias("n"),
            F.count_distinct("o_orderkey").alias("n_keys"),
            F.sum("o_totalprice").cast("double").alias("price_sum"),
        )
    )


@query(
    "c06_partition_state",
    """
    SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, ym, _version FROM (
      SELECT *, strftime(o_orderdate, '%Y%m') AS ym,
             row_number() OVER (PARTITION BY o_orderkey, strftime(o_orderdate, '%Y%m')
                                ORDER BY _version DESC, arrival DESC) AS rn
      FROM order_log) r
    WHERE rn = 1 AND _is_deleted = 0""",
)
def partition_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir).withColumn("ym", F.date_format("o_orderdate", "yyyyMM"))
    live = st.current_state(log, ORDER_KEYS, scope="partition", partition=["ym"])
    return live.select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "ym", "_version")


@query(
    "c07_collapse_sum",
    """
    SELECT o_custkey, CAST(sum(amount * sign) AS DOUBLE) AS total_amount, CAST(sum(sign) AS BIGINT) AS n_orders
    FROM sign_rows GROUP BY o_custkey HAVING sum(sign) > 0""",
)
def collapse_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "sign_rows").withColumn("one", F.lit(1).cast("bigint"))
    out = st.collapse_sum(rows, ["o_custkey"], ["amount", "one"])
    return out.select(
        "o_custkey", F.col("amount").cast("double").alias("total_amount"), F.col("one").alias("n_orders")
    )


@query(
    "c08_versioned_collapse",
    """
    SELECT o_custkey, o_orderkey, version, amount FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY version DESC) AS rn
      FROM (SELECT o_custkey, o_orderkey, version, CAST(max(amount) AS DOUBLE) AS amount
            FROM sign_rows GROUP BY o_custkey, o_orderkey, version HAVING sum(sign) > 0) g) r
    WHERE rn = 1""",
)
def versioned_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.versioned_collapse(load(spark, sf_dir, "sign_rows"), ["o_custkey", "o_orderkey"], "version")
    return out.select("o_custkey", "o_orderkey", "version", F.col("amount").cast("double").alias("amount"))


@query(
    "c09_summing_merge",
    """
    SELECT l_returnflag AS flag, year(l_shipdate) AS ship_year,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(16, 2))) AS DOUBLE) AS revenue, count(*) AS n
    FROM lineitem GROUP BY l_returnflag, year(l_shipdate)""",
)
def summing_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums per supplier, merged to the totals."""
    items = load(spark, sf_dir, "lineitem")
    keys = [F.col("l_returnflag").alias("flag"), F.year("l_shipdate").cast("bigint").alias("ship_year")]
    parts = items.groupBy(*keys, F.col("l_suppkey")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(16,2)")).alias("revenue"), F.count("*").alias("n")
    )
    out = st.summing_merge(parts, ["flag", "ship_year"], ["revenue", "n"])
    return out.withColumn("revenue", F.col("revenue").cast("double"))


def _daily_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States built separately for the rows before and after mid month, as two refreshes would."""
    events = load(spark, sf_dir, "events").withColumn("amount", F.col("value").cast("decimal(16,2)"))
    day = F.col("ts").cast("date").cast("string").alias("day")
    batch = (F.dayofmonth("ts") > 15).alias("batch")
    return st.agg_state(
        events,
        [day, batch, F.col("event_type")],
        sums={"total_value": F.col("amount")},
        avgs={"avg_value": F.col("amount")},
        uniqs={"users": F.col("user_id")},
    )


@query(
    "c10_agg_state_merge",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(CAST(value AS DECIMAL(16, 2))) AS DOUBLE) AS total_value,
           CAST(sum(CAST(value AS DECIMAL(16, 2))) AS DOUBLE) / count(value) AS avg_value
    FROM events GROUP BY strftime(ts, '%Y-%m-%d')""",
)
def agg_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = st.agg_merge(_daily_states(spark, sf_dir), ["day"])
    return merged.select("day", F.col("total_value").cast("double").alias("total_value"), "avg_value")


@query("c10_agg_state_uniq")
def agg_state_uniq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users per day from merged HLL sketches (approximate: rows-only check)."""
    return st.agg_merge(_daily_states(spark, sf_dir), ["day"]).select("day", "users")


@query(
    "daily_trend_on_state",
    f"""
    SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS order_count,
           CAST(sum(o_totalprice) AS DOUBLE) AS total_sales,
           CAST(sum(o_totalprice) AS DOUBLE) / count(*) AS avg_order_value
    FROM ({_LATEST_ORDERS}) s WHERE _is_deleted = 0 GROUP BY 1""",
)
def daily_trend_on_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: change log, current state, daily trend."""
    return (
        live_orders(spark, sf_dir)
        .groupBy(F.col("o_orderdate").cast("date").cast("string").alias("day"))
        .agg(
            F.count("*").alias("order_count"),
            F.sum("o_totalprice").cast("double").alias("total_sales"),
            (F.sum("o_totalprice").cast("double") / F.count("*")).alias("avg_order_value"),
        )
    )
