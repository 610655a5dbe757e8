"""Registered queries: the analytic surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import ORDERS_AS_OF, SPARK, compose, load
from tidelog.operators import bi
from tidelog.operators import state as st
from tidelog.plans.queries_sources import change_batch, written
from tidelog.plans.queries_state import _LATEST_ORDERS, live_orders, order_log
from tidelog.registry import query
from tidelog.session import work_dir
from tidelog.sources import write
from tidelog.sources.rollups import DeltaRollup
from tidelog.streaming import jobs

_PRICE = "CAST(o_totalprice AS DECIMAL(16, 2))"


def price():
    return F.col("o_totalprice").cast("decimal(16,2)")


def text_date(name: str):
    return F.col(name).cast("date").cast("string").alias(name)


@query("h01_projection", "SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_totalprice FROM orders")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_custkey", text_date("o_orderdate"), "o_totalprice")


@query(
    "h02_recent",
    f"""SELECT o_orderkey, o_totalprice FROM orders
        WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF} 00:00:00' - INTERVAL 90 DAY AND o_orderstatus = 'F'""",
)
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bi.recent(load(spark, sf_dir, "orders"), "o_orderdate", 90, ORDERS_AS_OF, o_orderstatus="F")
    return out.select("o_orderkey", "o_totalprice")


@query(
    "h03_recent_orders",
    f"""SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_totalprice FROM (
          SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF} 00:00:00' - INTERVAL 365 DAY
          ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000) r""",
)
def recent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bi.recent(load(spark, sf_dir, "orders"), "o_orderdate", 365, ORDERS_AS_OF)
    columns = ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]
    return bi.recent_rows(rows, "o_orderdate", columns, 1000, ["o_orderkey"]).withColumn("o_orderdate", text_date("o_orderdate"))


@query(
    "h04_daily_trend",
    f"""SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS order_count, CAST(sum({_PRICE}) AS DOUBLE) AS total_sales,
          CAST(sum({_PRICE}) AS DOUBLE) / count(*) AS avg_order_value FROM orders GROUP BY 1""",
)
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bi.daily_trend(load(spark, sf_dir, "orders"), "o_orderdate", price())
    return out.withColumns({"day": F.col("day").cast("string"), "total_sales": F.col("total_sales").cast("double")})


@query(
    "h05_top_customers",
    f"""SELECT o_custkey, count(*) AS order_count, CAST(sum({_PRICE}) AS DOUBLE) AS total_spent,
          CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_order
        FROM orders GROUP BY o_custkey ORDER BY sum({_PRICE}) DESC, o_custkey LIMIT 100""",
)
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bi.top_customers(load(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", price())
    return out.withColumns({"total_spent": F.col("total_spent").cast("double"), "last_order": text_date("last_order")})


_REVENUE = "CAST(l_extendedprice AS DECIMAL(16, 2)) * CAST(l_quantity AS DECIMAL(10, 2))"


def item_revenue():
    return F.col("l_extendedprice").cast("decimal(16,2)") * F.col("l_quantity").cast("decimal(10,2)")


@query(
    "h06_product_performance",
    f"""SELECT p_partkey, p_name, count(*) AS units_sold, CAST(sum({_REVENUE}) AS DOUBLE) AS revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name ORDER BY sum({_REVENUE}) DESC, p_partkey LIMIT 50""",
)
def product_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bi.product_performance(
        load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part"), "l_partkey", "p_partkey", "p_name", item_revenue()
    )
    return out.withColumn("revenue", F.col("revenue").cast("double"))


@query(
    "h07_time_buckets",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(strftime(ts, '%Y%m') AS INTEGER) AS month,
          strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n FROM events GROUP BY ALL""",
)
def time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bi.time_buckets(load(spark, sf_dir, "events"), "ts")
    return out.groupBy(F.col("day").cast("string").alias("day"), "month", F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour")).agg(
        F.count("*").alias("n")
    )


@query("h08_uniq_exact", "SELECT event_type, count(DISTINCT user_id) AS n_distinct FROM events GROUP BY event_type")
def uniq_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.uniq(load(spark, sf_dir, "events"), "user_id", ["event_type"])


@query("h08_uniq_approx")
def uniq_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.uniq(load(spark, sf_dir, "events"), "user_id", ["event_type"], exact=False)


def rollup_folder(spark: SparkSession, sf_dir: str) -> str:
    """A rollup built before the last changes and refreshed after them."""
    log = order_log(spark, sf_dir)
    path = work_dir(spark, "rollup")
    before = st.current_state(log.where("_version = 0"), ["o_orderkey"])
    bi.write_rollup(bi.rollup_daily(before, "o_orderdate", F.col("o_totalprice")), path)
    changed = log.where("_version > 0").select("o_orderkey").distinct()
    # old rows of changed keys, plus changed keys that are new (their month comes from the new state)
    old = before.join(changed, "o_orderkey", "left_semi").select("o_orderkey", "o_orderdate")
    fresh = log.where("_version > 0").select("o_orderkey", "o_orderdate")
    bi.refresh_rollup(
        path, old.unionByName(fresh), st.current_state(log, ["o_orderkey"]), "o_orderdate", F.col("o_totalprice"), ["o_orderkey"]
    )
    return path


_ROLLUP_SQL = f"""
    SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(sum(o_totalprice) AS DOUBLE) AS total, count(*) AS n
    FROM ({_LATEST_ORDERS}) s WHERE _is_deleted = 0 GROUP BY 1"""


@query("h09_rollup_daily", _ROLLUP_SQL)
def rollup_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = written(spark, rollup_folder(spark, sf_dir))
    return out.select(F.col("day").cast("string").alias("day"), F.col("total").cast("double").alias("total"), "n")


@query("h09_delta_rollup", _ROLLUP_SQL)
def delta_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sums kept by signed deltas, in three batches that bring changes of a key out of order and twice."""
    log = order_log(spark, sf_dir)
    rollup = DeltaRollup(spark, work_dir(spark, "delta-rollup"), ["o_orderkey"], ["_version", "arrival"], "o_orderdate", "o_totalprice", buckets=16)
    for batch_id, third in enumerate((1, 0, 2)):
        rollup.apply(log.where(F.col("arrival") % 3 == third), batch_id)
        if batch_id == 1:
            rollup.fold()
    rollup.apply(log.where("arrival % 3 = 0"), 3)
    out = rollup.read()
    return out.select(F.col("day").cast("string").alias("day"), F.col("total").cast("double").alias("total"), "n")


@query(
    "h10_revenue_summary",
    f"""SELECT r_name AS region, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(sum({_PRICE}) AS DOUBLE) AS revenue,
          count(*) AS transactions
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def revenue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bi.revenue_summary(*[load(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region")])
    return out.withColumns({"day": F.col("day").cast("string"), "revenue": F.col("revenue").cast("double")})


@query("h11_read_rollup", f"SELECT * FROM ({_ROLLUP_SQL}) r WHERE day >= '2001-05-04'")
def read_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(spark, rollup_folder(spark, sf_dir))
    out = bi.read_rollup(stored, 90, ORDERS_AS_OF, ["total", "n"])
    return out.select(F.col("day").cast("string").alias("day"), F.col("total").cast("double").alias("total"), "n")


_COLUMN_COUNTS = """
    SELECT t.table_name, (SELECT count(*) FROM ddl_columns c WHERE c.table_name = t.table_name) AS n_columns
    FROM (SELECT DISTINCT table_name FROM target_columns) t"""


@query("h12_column_counts", _COLUMN_COUNTS)
def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated scalar subquery, as SQL: Spark plans it as an aggregate and a join."""
    return spark.sql(compose(_COLUMN_COUNTS, SPARK, sf_dir))


_DERIVED = """
    SELECT l_orderkey, l_linenumber, n FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) d WHERE n < 5"""


@query("h13_derived_having", _DERIVED)
def derived_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(compose(_DERIVED, SPARK, sf_dir))


@query(
    "h14_group_concat",
    "SELECT table_name, string_agg(column_name, ',' ORDER BY ordinal) AS joined FROM ddl_columns GROUP BY table_name",
)
def group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.group_concat(load(spark, sf_dir, "ddl_columns"), ["table_name"], "column_name", ["ordinal"])


@query(
    "h15_sum_if",
    """SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(16, 2)) ELSE 0 END) AS DOUBLE) AS bought,
          CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY user_id""",
)
def sum_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_type = lambda t: F.col("event_type") == t
    cases = {"bought": (is_type("purchase"), F.col("value").cast("decimal(16,2)")), "errors": (is_type("error"), F.lit(1).cast("bigint"))}
    out = bi.sum_if(load(spark, sf_dir, "events"), ["user_id"], cases)
    return out.withColumn("bought", F.col("bought").cast("double"))


@query("h16_sample_rows", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('11|' || o_orderkey), o_orderkey LIMIT 100")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.sample_rows(load(spark, sf_dir, "orders"), ["o_orderkey"], 100, seed=11).select("o_orderkey", "o_custkey")


@query(
    "h17_json_columns",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL::DOUBLE AS missing FROM events""",
)
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bi.json_columns(load(spark, sf_dir, "events"), "props", {"k": "bigint", "missing": "double"})
    return out.select("event_id", "k", "missing")


@query(
    "h18_array_ops",
    """SELECT vec_id, len(list_filter(a, lambda x: x > 0)) AS n_positive, CAST(list_contains(a, a[3]) AS INTEGER) AS has_value,
          CAST(list_position(a, a[3]) AS BIGINT) AS index_of, a[3] * 2 AS third_doubled, list_sort(a)[1] AS smallest
       FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings) e""",
)
def array_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").withColumn("a", F.col("embedding").cast("array<double>"))
    out = bi.array_ops(vectors, "a", 0.0, F.col("a")[2])
    return out.select(
        "vec_id",
        F.size("filtered").cast("bigint").alias("n_positive"),
        F.col("has_value").cast("int").alias("has_value"),
        "index_of",
        F.col("mapped")[2].alias("third_doubled"),
        F.col("sorted")[0].alias("smallest"),
    )


@query(
    "h19_dict_get",
    """SELECT event_id, coalesce(c_name, 'nobody') AS user_name, coalesce(c_mktsegment, 'nobody') AS segment
       FROM events LEFT JOIN customer ON user_id * 20 = c_custkey""",
)
def dict_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users beyond the customer table get the default."""
    events = load(spark, sf_dir, "events").withColumn("person", F.col("user_id") * 20)
    out = bi.dict_get(
        events, load(spark, sf_dir, "customer"), "person", {"c_name": "user_name", "c_mktsegment": "segment"}, "c_custkey", "nobody"
    )
    return out.select("event_id", "user_name", "segment")


@query(
    "h20_flatten_events",
    """SELECT event_id, event_type, coalesce(c_mktsegment, 'unknown') AS segment, coalesce(n_name, 'unknown') AS nation,
          coalesce(r_name, 'unknown') AS region, CAST(strftime(ts, '%Y%m') AS INTEGER) AS p_month
       FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def flatten_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = bi.flatten_events(*[load(spark, sf_dir, t) for t in ("events", "customer", "nation", "region")])
    path = work_dir(spark, "flat-events")
    write.write_partitioned(flat, path, "ts")
    return written(spark, path).select("event_id", "event_type", "segment", "nation", "region", "p_month")


@query(
    "h21_events_by_user",
    "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value >= 10 GROUP BY user_id",
)
def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.events_by_user(load(spark, sf_dir, "events"), "purchase", 10.0)


@query(
    "h22_playtime",
    """SELECT o_custkey, CAST(sum(amount * sign) AS DOUBLE) AS amount FROM sign_rows GROUP BY o_custkey HAVING sum(sign) > 0""",
)
def playtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bi.playtime(load(spark, sf_dir, "sign_rows"), "o_custkey", ["amount"])
    return out.withColumn("amount", F.col("amount").cast("double"))


@query(
    "h23_daily_metrics",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, CAST(sum(CAST(value AS DECIMAL(16, 2))) AS DOUBLE) AS score,
          CAST(sum(event_id) AS DOUBLE) / count(*) AS duration
       FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1, 2""",
)
def daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = bi.daily_metrics(
        load(spark, sf_dir, "events"), "user_id", "ts", F.col("value").cast("decimal(16,2)"), F.col("event_id"), F.col("event_id")
    )
    out = bi.read_daily_metrics(states, 7, "2024-01-31", ["day", "user_id"])
    return out.select(F.col("day").cast("string").alias("day"), "user_id", F.col("score").cast("double").alias("score"), "duration")


@query(
    "h24_active_users",
    """SELECT 'day' AS grain, strftime(ts, '%Y-%m-%d') AS period, count(DISTINCT user_id) AS active_users FROM events GROUP BY 2
       UNION ALL SELECT 'month', strftime(date_trunc('month', ts), '%Y-%m-%d'), count(DISTINCT user_id) FROM events GROUP BY 2""",
)
def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")

    def kpi(grain: str) -> DataFrame:
        out = bi.kpi_active(events, "user_id", "ts", grain)
        return out.select(F.lit(grain).alias("grain"), F.col("period").cast("string").alias("period"), "active_users")

    return kpi("day").unionByName(kpi("month"))


@query(
    "h24_arpu",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, count(DISTINCT user_id) AS active_users,
          CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(16, 2)) ELSE 0 END) AS DOUBLE) / count(DISTINCT user_id) AS arpu
       FROM events GROUP BY 1""",
)
def arpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(16,2)")).otherwise(F.lit(0).cast("decimal(16,2)"))
    out = bi.kpi_arpu(load(spark, sf_dir, "events"), "user_id", "ts", paid, "day")
    return out.select(F.col("period").cast("string").alias("period"), "active_users", "arpu")


def _retention_sql(grain: str, offset: str) -> str:
    return f"""
    WITH a AS (SELECT DISTINCT user_id, CAST(date_trunc('{grain}', ts) AS DATE) AS p FROM signups_and_rest),
    f AS (SELECT user_id, min(p) AS c FROM a GROUP BY user_id)
    SELECT '{grain}' AS grain, CAST(c AS VARCHAR) AS cohort, CAST({offset} AS INTEGER) AS "offset", count(DISTINCT a.user_id) AS users
    FROM a JOIN f ON a.user_id = f.user_id GROUP BY 2, 3""".replace("signups_and_rest", "events")


@query("h25_retention_week", _retention_sql("week", "date_diff('day', c, p) // 7"))
def retention_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bi.retention(load(spark, sf_dir, "events"), "user_id", "ts", "week")
    return out.select(F.lit("week").alias("grain"), F.col("cohort").cast("string").alias("cohort"), "offset", "users")


@query("h25_retention_day", _retention_sql("day", "date_diff('day', c, p)"))
def retention_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bi.retention(load(spark, sf_dir, "events"), "user_id", "ts", "day")
    return out.select(F.lit("day").alias("grain"), F.col("cohort").cast("string").alias("cohort"), "offset", "users")


def _funnel_sql(within: str) -> str:
    return f"""
    WITH s1 AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY user_id),
    s2 AS (SELECT e.user_id, min(e.ts) AS t, min(s1.t) AS t0 FROM events e JOIN s1 ON e.user_id = s1.user_id AND e.ts > s1.t
           WHERE event_type = 'view' AND e.ts <= s1.t + INTERVAL {within} GROUP BY e.user_id),
    s3 AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN s2 ON e.user_id = s2.user_id AND e.ts > s2.t
           WHERE event_type = 'purchase' AND e.ts <= s2.t0 + INTERVAL {within} GROUP BY e.user_id)
    SELECT 1 AS position, 'signup' AS step, (SELECT count(*) FROM s1) AS users
    UNION ALL SELECT 2, 'view', (SELECT count(*) FROM s2) UNION ALL SELECT 3, 'purchase', (SELECT count(*) FROM s3)"""


@query("h26_funnel", _funnel_sql("12 HOUR"))
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.funnel(load(spark, sf_dir, "events"), "user_id", "ts", "event_type", ["signup", "view", "purchase"], "12 HOUR")


@query(
    "h26_funnel_restarts",
    """
    WITH s1 AS (SELECT DISTINCT user_id, ts AS t FROM events WHERE event_type = 'signup'),
    s2 AS (SELECT DISTINCT s1.user_id, s1.t AS t0, e.ts AS t FROM events e JOIN s1 ON e.user_id = s1.user_id AND e.ts > s1.t AND e.ts <= s1.t + INTERVAL 12 HOUR
           WHERE event_type = 'view'),
    s3 AS (SELECT DISTINCT e.user_id FROM events e JOIN s2 ON e.user_id = s2.user_id AND e.ts > s2.t AND e.ts <= s2.t0 + INTERVAL 12 HOUR
           WHERE event_type = 'purchase')
    SELECT 1 AS position, 'signup' AS step, (SELECT count(DISTINCT user_id) FROM s1) AS users
    UNION ALL SELECT 2, 'view', (SELECT count(DISTINCT user_id) FROM s2)
    UNION ALL SELECT 3, 'purchase', (SELECT count(*) FROM s3)""",
)
def funnel_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any signup may start the twelve hours, not only a user's first."""
    return bi.funnel_restarts(load(spark, sf_dir, "events"), "user_id", "ts", "event_type", ["signup", "view", "purchase"], "12 HOURS", "6 HOURS")


@query(
    "h27_first_purchase",
    f"""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS INTEGER) AS is_first_purchase
        FROM orders""",
)
def first_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bi.first_purchase(load(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return out.select("o_orderkey", F.col("is_first_purchase").cast("int").alias("is_first_purchase"))


@query(
    "h27_product_revenue",
    """SELECT p_brand, CAST(f AS INTEGER) AS is_first_purchase, CAST(sum(CAST(l_extendedprice AS DECIMAL(16, 2))) AS DOUBLE) AS revenue
       FROM lineitem JOIN (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS f FROM orders) o
         ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def product_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by brand, split by first and later purchases; items are summed before names are joined."""
    flagged = bi.first_purchase(load(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    flags = flagged.select(F.col("o_orderkey").alias("l_orderkey"), F.col("is_first_purchase").cast("int").alias("is_first_purchase"))
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_extendedprice").cast("decimal(16,2)").alias("amount"))
    sums = items.join(flags, "l_orderkey").groupBy("l_partkey", "is_first_purchase").agg(F.sum("amount").alias("amount"))
    named = sums.join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return named.groupBy("p_brand", "is_first_purchase").agg(F.sum("amount").cast("double").alias("revenue"))


@query(
    "h28_leaderboard",
    f"""SELECT * FROM (SELECT c_mktsegment, o_custkey, spent, CAST(row_number() OVER (PARTITION BY c_mktsegment
              ORDER BY spent DESC, o_custkey) AS INTEGER) AS position
          FROM (SELECT o_custkey, CAST(sum({_PRICE}) AS DOUBLE) AS spent FROM orders GROUP BY o_custkey) s
          JOIN customer ON o_custkey = c_custkey) r WHERE position <= 10""",
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(price()).cast("double").alias("spent"))
    scores = spent.join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = bi.leaderboard(scores, ["c_mktsegment"], "o_custkey", "spent")
    return out.select("c_mktsegment", "o_custkey", "spent", "position")


@query(
    "h29_recent_window",
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n, value FROM (
         SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(16, 2))) AS DOUBLE) AS value
         FROM events GROUP BY 1, 2) x
       WHERE w + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events)""",
)
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute metrics from a stream, as far as the watermark closed the windows."""
    stream = change_batch(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    aggs = [F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(16,2)")).cast("double").alias("value")]
    windows = jobs.recent_window(stream, "ts", "5 minutes", ["event_type"], aggs, delay="0 seconds")
    out = work_dir(spark, "recent")
    jobs.append_to(windows, out, work_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return written(spark, out).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "value"
    )


@query("h30_sketch_users")
def sketch_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users per event type from daily sketches (approximate: rows-only check)."""
    daily = bi.sketch_users(load(spark, sf_dir, "events"), "user_id", [F.to_date("ts").alias("day"), "event_type"])
    return bi.merge_sketches(daily, ["event_type"])


@query(
    "h30_sketch_bounds",
    """SELECT event_type, count(DISTINCT user_id) AS users, true AS hll_within, true AS theta_within FROM events GROUP BY event_type""",
)
def sketch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are the estimates of merged daily sketches within three standard errors of the exact counts."""
    events = load(spark, sf_dir, "events")
    near = bi.merge_sketches(bi.sketch_users(events, "user_id", [F.to_date("ts").alias("day"), "event_type"]), ["event_type"])
    return bi.uniq(events, "user_id", ["event_type"]).withColumnRenamed("n_distinct", "users").join(near, "event_type").select(
        "event_type", "users",
        bi.within_errors("hll_users", "users", "users", 14, bi.HLL_ERROR).alias("hll_within"),
        bi.within_errors("theta_users", "users", "users", 14, bi.THETA_ERROR).alias("theta_within"),
    )


@query(
    "h30_returning_users",
    """
    WITH w AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events),
    n AS (SELECT *, week + 7 AS after FROM w)
    SELECT CAST(n.week AS VARCHAR) AS week, count(*) AS users, count(w.user_id) AS returned, count(*) - count(w.user_id) AS lost,
           true AS returned_within, true AS lost_within
    FROM n LEFT JOIN w ON w.user_id = n.user_id AND w.week = n.after
    WHERE n.after IN (SELECT week FROM w) GROUP BY n.week""",
)
def returning_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of a week that come back the week after, from weekly sketches, beside the exact counts."""
    events = load(spark, sf_dir, "events")
    week = F.date_trunc("week", "ts").cast("date").alias("week")
    sketches = bi.returning_users(bi.sketch_users(events, "user_id", [week]), "week", 7)
    seen = events.select("user_id", week).distinct()
    again = seen.select("user_id", F.date_sub("week", 7).alias("week"), F.lit(1).alias("back"))
    exact = seen.join(again, ["user_id", "week"], "left").groupBy("week").agg(F.count("*").alias("users"), F.count("back").alias("returned"))
    both = exact.withColumn("lost", F.col("users") - F.col("returned")).join(sketches, "week")
    return both.select(
        F.col("week").cast("string").alias("week"), "users", "returned", "lost",
        bi.within_errors("returned_estimate", "returned", "either_estimate", 14, bi.THETA_ERROR).alias("returned_within"),
        bi.within_errors("lost_estimate", "lost", "either_estimate", 14, bi.THETA_ERROR).alias("lost_within"),
    )


@query(
    "h31_expire",
    f"SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF} 00:00:00' - INTERVAL 365 DAY",
)
def expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bi.expire(load(spark, sf_dir, "orders"), "o_orderdate", 365, ORDERS_AS_OF).select("o_orderkey")


@query(
    "h31_drop_months",
    "SELECT event_type, count(*) AS n FROM events WHERE NOT (ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-07 00:00:00') GROUP BY 1",
)
def drop_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two day folders removed from a table partitioned by day."""
    path = work_dir(spark, "expire")
    write.write_partitioned(load(spark, sf_dir, "events"), path, "ts", "day")
    bi.drop_months(spark, path, [20240105, 20240106], "p_day")
    return written(spark, path).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "h32_tier",
    f"""SELECT o_orderpriority, tier, count(*) AS n FROM (SELECT *, CASE
          WHEN age <= CASE WHEN o_orderpriority = '1-URGENT' THEN 60 ELSE 30 END THEN 'hot'
          WHEN age <= CASE WHEN o_orderpriority = '1-URGENT' THEN 365 ELSE 90 END THEN 'warm' ELSE 'archive' END AS tier
        FROM (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), DATE '{ORDERS_AS_OF}') AS age FROM orders) a) t GROUP BY 1, 2""",
)
def tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bi.tier(
        load(spark, sf_dir, "orders"), "o_orderdate", ORDERS_AS_OF, dataset="o_orderpriority", policy={"1-URGENT": (60, 365)}
    )
    return out.groupBy("o_orderpriority", "tier").agg(F.count("*").alias("n"))


@query(
    "h33_secure_view",
    """SELECT user_name, count(*) AS n FROM access_policy p JOIN nation n ON n.n_regionkey = p.r_regionkey
       JOIN customer c ON c.c_nationkey = n.n_nationkey WHERE user_name IN ('lead', 'analyst_3') GROUP BY user_name""",
)
def secure_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = bi.dict_get(
        load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation"), "c_nationkey", {"n_regionkey": "r_regionkey"}, "n_nationkey", None
    )
    policy = load(spark, sf_dir, "access_policy")

    def seen(user: str) -> DataFrame:
        return bi.secure_view(customers, policy, "r_regionkey", user).agg(F.lit(user).alias("user_name"), F.count("*").alias("n"))

    return seen("lead").unionByName(seen("analyst_3"))


@query(
    "h34_write_partitioned",
    """SELECT event_type, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS p_day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
       FROM events GROUP BY 1, 2""",
)
def write_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid partitions: event type, then day."""
    path = work_dir(spark, "by-day")
    write.write_partitioned(load(spark, sf_dir, "events"), path, "ts", "day", cohort=["event_type"])
    return written(spark, path).groupBy("event_type", "p_day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "h35_bucket_by_entity",
    "SELECT user_id, count(*) AS n, 1 AS n_buckets FROM events GROUP BY user_id",
)
def bucket_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a user are in one bucket folder."""
    path = work_dir(spark, "buckets")
    write.bucket_by_entity(load(spark, sf_dir, "events"), path, "user_id", 8)
    return written(spark, path).groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_distinct("entity_bucket").cast("int").alias("n_buckets")
    )


@query(
    "h36_refresh_extract",
    f"""SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS order_count
        FROM ({_LATEST_ORDERS}) s WHERE _is_deleted = 0 GROUP BY 1""",
)
def refresh_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = bi.daily_trend(live_orders(spark, sf_dir), "o_orderdate", F.col("o_totalprice"))
    extract = write.refresh_extract(trend, work_dir(spark, "extract"))
    return extract.select(F.col("day").cast("string").alias("day"), "order_count")


@query(
    "h37_money",
    f"""SELECT o_orderstatus, CAST(sum({_PRICE}) AS DOUBLE) AS total, CAST(sum(CAST({_PRICE} * 100 AS BIGINT)) AS BIGINT) AS total_cents
        FROM orders GROUP BY o_orderstatus""",
)
def money(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bi.money(load(spark, sf_dir, "orders"), "o_totalprice", ["o_orderstatus"])
    return out.withColumn("total", F.col("total").cast("double"))
