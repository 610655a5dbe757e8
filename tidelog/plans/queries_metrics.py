"""Registered queries: lag, rates, progress, health, logs and alerts derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import EVENTS_AS_OF, load
from tidelog.functions.columns import duration_text, quantity_text, size_text
from tidelog.operators import metrics as mt
from tidelog.registry import query

# Users with few recent events lag, so the newest event per user gives every level.
_LAG_SQL = f"""
    SELECT user_id, lag_seconds, CASE WHEN lag_seconds > 14400 THEN 'alert' WHEN lag_seconds > 3600 THEN 'warn' ELSE 'ok' END AS level
    FROM (SELECT user_id, CAST(epoch(TIMESTAMP '{EVENTS_AS_OF}') - epoch(date_trunc('second', max(ts))) AS BIGINT) AS lag_seconds
          FROM events GROUP BY user_id) l"""


def lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.lag_report(load(spark, sf_dir, "events"), "ts", EVENTS_AS_OF, table="user_id", warn=3600, alert=14400)


_DURATION = """CASE WHEN {s} < 60 THEN {s} || 's' WHEN {s} < 3600 THEN ({s} // 60) || 'm ' || ({s} % 60) || 's'
    ELSE ({s} // 3600) || 'h ' || ({s} % 3600 // 60) || 'm' END"""


@query("g01_lag_report", f"SELECT *, {_DURATION.format(s='lag_seconds')} AS lag_text FROM ({_LAG_SQL}) r")
def lag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lags(spark, sf_dir)


@query(
    "g01_lag_summary",
    f"""SELECT count(*) AS tables, CAST(sum(lag_seconds) // count(*) AS BIGINT) AS avg_lag, max(lag_seconds) AS max_lag,
          CAST(max(lag_seconds) > 300 AS INTEGER) AS is_alert FROM ({_LAG_SQL}) r""",
)
def lag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.lag_summary(lags(spark, sf_dir)).withColumn("is_alert", F.col("is_alert").cast("int"))


_OFFSET_SQL = """
    SELECT topic, part, high_water - committed AS lag FROM offsets
    UNION ALL SELECT NULL, NULL, CAST(sum(high_water - committed) AS BIGINT) FROM offsets"""


@query("g02_offset_lag", _OFFSET_SQL)
def offset_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.offset_lag(load(spark, sf_dir, "offsets"))


@query(
    "g03_eta",
    """SELECT topic, part, high_water, eta_seconds, CASE WHEN eta_seconds < 60 THEN eta_seconds || ' seconds'
         WHEN eta_seconds < 3600 THEN (eta_seconds // 60) || ' minutes' ELSE (eta_seconds // 3600) || ' hours' END AS eta_text
       FROM (SELECT *, high_water * 500 // 1000 AS eta_seconds FROM offsets) o""",
)
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backlogs of 500 times the topic size, drained at 1000 records per second."""
    df = load(spark, sf_dir, "offsets").withColumn("backlog", F.col("high_water") * 500)
    return mt.eta(df, "backlog", 1000).select("topic", "part", "high_water", "eta_seconds", "eta_text")


@query(
    "g04_rates",
    """SELECT table_name, strftime(sample_ts, '%Y-%m-%d %H') AS hour, row_total,
          CAST(floor((row_total - p) / secs) AS BIGINT) AS rows_per_second, floor((row_total - p) * 600 / secs) / 10 AS rows_per_minute
       FROM (SELECT *, lag(row_total) OVER w AS p, epoch(sample_ts) - epoch(lag(sample_ts) OVER w) AS secs
             FROM samples WINDOW w AS (PARTITION BY table_name ORDER BY sample_ts)) s""",
)
def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mt.rates(load(spark, sf_dir, "samples"))
    return out.select(
        "table_name", F.date_format("sample_ts", "yyyy-MM-dd HH").alias("hour"), "row_total", "rows_per_second", "rows_per_minute"
    )


@query(
    "g05_progress",
    """SELECT topic, part, high_water, committed, committed * 100 // high_water AS percent_done,
          CAST(committed >= high_water AS INTEGER) AS is_complete FROM offsets""",
)
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mt.progress(load(spark, sf_dir, "offsets"), "committed", "high_water")
    return out.withColumn("is_complete", F.col("is_complete").cast("int"))


@query(
    "g06_snapshot_status",
    """SELECT topic, part, CASE WHEN part = 7 THEN 'UNKNOWN' WHEN part < 3 THEN 'COMPLETE' ELSE 'IN_PROGRESS' END AS snapshot_status
       FROM offsets""",
)
def snapshot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions below 3 are caught up, the lag of partition 7 is not known."""
    lag = F.when(F.col("part") == 7, None).when(F.col("part") < 3, 0).otherwise(F.col("high_water"))
    out = mt.snapshot_status(load(spark, sf_dir, "offsets").withColumn("lag", lag))
    return out.select("topic", "part", "snapshot_status")


_METRICS_SQL = """
    SELECT user_id AS host, event_type AS kind_of, max(value) AS top, count(*) AS n FROM events GROUP BY user_id, event_type"""


def host_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings per user as a host: signups a service, errors a connector, the rest usage."""
    rows = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("host"), "event_type").agg(
        F.max("value").alias("value"), F.count("*").alias("n")
    )
    kind = F.when(F.col("event_type") == "signup", "service").when(F.col("event_type") == "error", "connector").otherwise("usage")
    state = F.when(F.col("event_type") == "signup", F.when(F.col("n") % 2 == 0, "Up 3 hours").otherwise("Exited")).otherwise(
        F.when(F.col("n") % 3 == 0, "FAILED").otherwise("RUNNING")
    )
    return rows.select("host", kind.alias("kind"), state.alias("state"), "value")


@query(
    "g07_health_grade",
    f"""SELECT host, issues, warnings, CASE WHEN issues = 0 THEN 'HEALTHY' WHEN issues < 3 THEN 'MINOR' ELSE 'CRITICAL' END AS grade
        FROM (SELECT host, count(CASE WHEN kind_of = 'signup' AND n % 2 = 1 THEN 1 WHEN kind_of = 'error' AND n % 3 = 0 THEN 1
                 WHEN kind_of NOT IN ('signup', 'error') AND top > 90 THEN 1 END) AS issues,
                 count(CASE WHEN kind_of NOT IN ('signup', 'error') AND top > 80 AND top <= 90 THEN 1 END) AS warnings
              FROM ({_METRICS_SQL}) m GROUP BY host) g""",
)
def health_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.health_grade(host_metrics(spark, sf_dir), ["host"])


def _two_decimals(value: str, units: list[tuple[int, str]]) -> str:
    """``value`` in the largest unit it fills, rounded half up to two decimals in integers."""
    out = ""
    for size, name in reversed(units):
        cents = f"((({value}) * 200 + {size}) // (2 * {size}))"
        text = f"({cents} // 100) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0') || '{name}'"
        out += f"WHEN {value} >= {size} THEN {text} " if size > 1 else f"ELSE {text} "
    return f"CASE {out}END"


@query(
    "g08_formats",
    f"""SELECT c_custkey, {_DURATION.format(s='(c_custkey * 37)')} AS duration,
          {_two_decimals('c_custkey * 977', [(1, ' B'), (1024, ' KiB'), (1048576, ' MiB'), (1073741824, ' GiB')])} AS bytes,
          {_two_decimals('c_custkey * 1013', [(1, ''), (1000, ' thousand'), (1000000, ' million')])} AS quantity
        FROM customer""",
)
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        "c_custkey",
        duration_text(k * 37).alias("duration"),
        size_text(k * 977).alias("bytes"),
        quantity_text(k * 1013).alias("quantity"),
    )


_LOG_SQL = """
    SELECT worker, count(CASE WHEN line LIKE '%OutOfMemoryError%' OR line LIKE '%Java heap space%' THEN 1 END) AS memory_errors,
      count(CASE WHEN line LIKE '%Connection refused%' OR line LIKE '%ConnectException%' THEN 1 END) AS connection_errors,
      count(CASE WHEN line LIKE '%Code: 1001%' THEN 1 END) AS engine_errors,
      count(CASE WHEN line LIKE '%Task%failed%' THEN 1 END) AS task_errors,
      count(CASE WHEN line LIKE '%deadlock%' THEN 1 END) AS thread_errors,
      count(CASE WHEN line LIKE '%Starting Kafka Connect%' THEN 1 END) AS starts,
      max_by(line, struct_pack(a := ts, b := line_no)) FILTER (line ILIKE '%snapshot%complet%') AS last_completed,
      max_by(line, struct_pack(a := ts, b := line_no)) FILTER (line ILIKE '%snapshot%') AS last_snapshot
    FROM log_lines GROUP BY worker"""


@query(
    "g09_log_summary",
    f"""SELECT *, CASE WHEN last_completed IS NOT NULL THEN 'completed' WHEN last_snapshot IS NOT NULL THEN 'in_progress'
          ELSE 'no_messages' END AS snapshot_state,
          CASE WHEN starts > 2 THEN 'multiple' WHEN starts = 0 THEN 'none_seen' ELSE 'normal' END AS restarts FROM ({_LOG_SQL}) l""",
)
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.log_summary(load(spark, sf_dir, "log_lines"), ["worker"])


@query(
    "g10_primary_issue",
    f"""SELECT worker, memory_errors + connection_errors + engine_errors + task_errors + thread_errors AS errors,
          CASE WHEN memory_errors > 0 THEN 'memory' WHEN task_errors > 0 THEN 'task' WHEN connection_errors > 0 THEN 'connection'
               WHEN thread_errors > 0 THEN 'thread' WHEN engine_errors > 0 THEN 'engine' ELSE 'none' END AS primary_issue
        FROM ({_LOG_SQL.replace('SELECT worker,', "SELECT worker || '/' || strftime(ts, '%d') AS worker,").replace('GROUP BY worker', 'GROUP BY 1')}) l""",
)
def primary_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per worker and day, so that every kind comes first somewhere."""
    lines = load(spark, sf_dir, "log_lines").withColumn("worker", F.concat_ws("/", "worker", F.date_format("ts", "dd")))
    return mt.primary_issue(mt.log_summary(lines, ["worker"])).select("worker", "errors", "primary_issue")


@query(
    "g11_load_estimate",
    """SELECT *, CASE WHEN floor(load_minutes) < 30 THEN 'acceptable' WHEN floor(load_minutes) < 120 THEN 'consider_backfill'
          ELSE 'recommend_backfill' END AS load_band
       FROM (SELECT table_name, source_rows AS size_mb, floor(CAST(source_rows * 100 AS DOUBLE) / 0.25::DOUBLE / 60) / 100 AS load_minutes
             FROM side_counts) s""",
)
def load_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A megabyte per row at a quarter megabyte per second."""
    sizes = load(spark, sf_dir, "side_counts").select("table_name", F.col("source_rows").alias("size_mb"))
    return mt.load_estimate(sizes, "size_mb", 0.25)


@query(
    "g12_evaluate_alerts",
    f"""
    WITH m AS (SELECT 'consumer_lag' AS metric, topic || '/' || part AS subject, CAST(high_water * 10000 AS DOUBLE) AS value FROM offsets
      UNION ALL SELECT 'replication_lag_seconds', CAST(user_id AS VARCHAR), CAST(lag_seconds AS DOUBLE) FROM ({_LAG_SQL}) l
      UNION ALL SELECT 'dlq_records', h_class, CAST(count(*) * 10 AS DOUBLE) FROM dead_letters GROUP BY h_class)
    SELECT *, CASE metric WHEN 'consumer_lag' THEN 1000000::DOUBLE WHEN 'dlq_records' THEN 10000::DOUBLE ELSE 300::DOUBLE END AS threshold,
           CASE metric WHEN 'dlq_records' THEN 'warning' ELSE 'critical' END AS severity
    FROM m WHERE value > CASE metric WHEN 'consumer_lag' THEN 1000000 WHEN 'dlq_records' THEN 10000 ELSE 300 END""",
)
def evaluate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def metric(df: DataFrame, name: str, subject, value) -> DataFrame:
        return df.select(F.lit(name).alias("metric"), subject.cast("string").alias("subject"), value.cast("double").alias("value"))

    offsets = load(spark, sf_dir, "offsets")
    failed = load(spark, sf_dir, "dead_letters").groupBy("h_class").agg(F.count("*").alias("n"))
    readings = (
        metric(offsets, "consumer_lag", F.concat_ws("/", "topic", F.col("part").cast("string")), F.col("high_water") * 10000)
        .unionByName(metric(lags(spark, sf_dir), "replication_lag_seconds", F.col("user_id"), F.col("lag_seconds")))
        .unionByName(metric(failed, "dlq_records", F.col("h_class"), F.col("n") * 10))
    )
    return mt.evaluate_alerts(readings, mt.alert_rules(spark))


@query(
    "g13_file_counts",
    """SELECT table_name, count(*) AS partitions, CAST(sum(n) AS BIGINT) AS files, max(n) AS max_files,
          CASE WHEN sum(n) > 1000 THEN 'critical' WHEN max(n) > 300 THEN 'warning' ELSE 'ok' END AS level
       FROM (SELECT l_returnflag AS table_name, year(l_shipdate) AS ym, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2) p
       GROUP BY table_name""",
)
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per supplier and ship year."""
    items = load(spark, sf_dir, "lineitem")
    listing = items.select(
        F.col("l_returnflag").alias("table_name"),
        F.year("l_shipdate").cast("string").alias("partition"),
        F.concat(F.lit("part-"), F.col("l_suppkey").cast("string")).alias("file"),
    ).distinct()
    return mt.file_counts(listing)


@query(
    "g14_recent_activity",
    """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, event_type AS query_kind, user_id AS read_rows, event_id AS written_rows
       FROM events WHERE event_type <> 'error' AND ts > TIMESTAMP '2024-01-15 09:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00'
       ORDER BY ts DESC LIMIT 10""",
)
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    qlog = load(spark, sf_dir, "events").where("event_type <> 'error'").select(
        "ts", F.col("event_type").alias("query_kind"), F.col("user_id").alias("read_rows"), F.col("event_id").alias("written_rows")
    )
    out = mt.recent_activity(qlog, "ts", "2024-01-15 12:00:00", minutes=180, top=10)
    return out.withColumn("event_time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts")


@query(
    "g14_activity_by_kind",
    """SELECT event_type AS query_kind, count(*) AS queries FROM events
       WHERE ts > TIMESTAMP '2024-01-15 09:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY event_type""",
)
def activity_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    qlog = load(spark, sf_dir, "events").withColumnRenamed("event_type", "query_kind")
    return mt.activity_by_kind(qlog, "ts", "2024-01-15 12:00:00", "query_kind", minutes=180)
