"""Pipeline metrics and logs: lag, rates, progress, health, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.columns import duration_text, epoch, epoch_of, floor_div, instant
from tidelog.functions.skew import previous_reading
from tidelog.operators.dead_letters import first_rows


def lag_report(log: DataFrame, ts: str, as_of: str, table: str = "table_name", warn: int = 60, alert: int = 300) -> DataFrame:
    """Seconds between ``as_of`` and the newest row per table; above 60 warns, above 300 alerts."""
    lag = log.groupBy(table).agg((epoch_of(as_of) - epoch(F.max(ts))).alias("lag_seconds"))
    level = F.when(F.col("lag_seconds") > alert, "alert").when(F.col("lag_seconds") > warn, "warn").otherwise("ok")
    return lag.withColumns({"level": level, "lag_text": duration_text(F.col("lag_seconds"))})


def lag_summary(report: DataFrame, alert: int = 300) -> DataFrame:
    """Average (whole seconds) and maximum lag, and whether the maximum passes the threshold."""
    out = report.agg(
        F.count("*").alias("tables"),
        floor_div(F.sum("lag_seconds"), F.count("*")).alias("avg_lag"),
        F.max("lag_seconds").alias("max_lag"),
    )
    return out.withColumn("is_alert", F.col("max_lag") > alert)


def offset_lag(offsets: DataFrame) -> DataFrame:
    """Records waiting per topic and partition, and in total (topic NULL)."""
    per = offsets.select("topic", "part", (F.col("high_water") - F.col("committed")).alias("lag"))
    whole = per.agg(F.sum("lag").alias("lag")).select(
        F.lit(None).cast("string").alias("topic"), F.lit(None).cast(per.schema["part"].dataType).alias("part"), "lag"
    )
    return per.unionByName(whole)


def eta(df: DataFrame, lag: str = "lag", rate: int | Column = 1000) -> DataFrame:
    """Time to drain ``lag`` at ``rate`` per second, in whole seconds and as text in one unit."""
    seconds = floor_div(F.col(lag), F.lit(rate) if isinstance(rate, int) else rate)
    out = df.withColumn("eta_seconds", seconds)
    s = F.col("eta_seconds")
    text = (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" seconds")))
        .when(s < 3600, F.concat(floor_div(s, 60).cast("string"), F.lit(" minutes")))
        .otherwise(F.concat(floor_div(s, 3600).cast("string"), F.lit(" hours")))
    )
    return out.withColumn("eta_text", text)


def rates(samples: DataFrame, table: str = "table_name", ts: str = "sample_ts", value: str = "row_total") -> DataFrame:
    """Growth between successive readings: whole rows per second, per minute to one decimal.

    The previous reading is found per table and day with the last one of the day before
    carried over, so a table with a long history is not one window.
    """
    with_prev = previous_reading(samples, [table], ts, [value], F.to_date(ts))
    delta = F.col(value) - F.col(f"prev_{value}")
    seconds = epoch(ts) - epoch(f"prev_{ts}")
    per_minute = F.floor(F.try_divide((delta * 600).cast("double"), seconds.cast("double"))) / 10
    return with_prev.withColumns(
        {
            "rows_per_second": F.floor(F.try_divide(delta.cast("double"), seconds.cast("double"))).cast("bigint"),
            "rows_per_minute": per_minute,
        }
    )


def progress(df: DataFrame, done: str, expected: str | Column, populated: str | None = None, slack: int = 10) -> DataFrame:
    """Whole percent done; complete when everything expected is there and, if ``populated`` is
    given, at most ``slack`` of it is still empty."""
    want = F.col(expected) if isinstance(expected, str) else expected
    complete = F.col(done) >= want
    if populated is not None:
        complete = complete & (F.col(populated) >= want - slack)
    return df.withColumns(
        {"percent_done": F.floor(F.try_divide(F.col(done) * 100.0, want)).cast("bigint"), "is_complete": complete}
    )


def snapshot_status(df: DataFrame, lag: str = "lag") -> DataFrame:
    """UNKNOWN without a lag, COMPLETE at 0, else IN_PROGRESS."""
    status = F.when(F.col(lag).isNull(), "UNKNOWN").when(F.col(lag) == 0, "COMPLETE").otherwise("IN_PROGRESS")
    return df.withColumn("snapshot_status", status)


def health_grade(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Issues in a metrics frame ``kind, state, value``, graded 0, below 3, 3 and more.

    A ``service`` must be up, a ``connector`` running, a ``usage`` at most 90 percent (above 80
    only warns).
    """
    kind = F.col("kind")
    issue = (
        ((kind == "service") & ~F.col("state").contains("Up"))
        | ((kind == "connector") & (F.col("state") != "RUNNING"))
        | ((kind == "usage") & (F.col("value") > 90))
    )
    warning = (kind == "usage") & (F.col("value") > 80) & (F.col("value") <= 90)
    counted = [F.count_if(issue).alias("issues"), F.count_if(warning).alias("warnings")]
    out = metrics.groupBy(*by).agg(*counted) if by else metrics.agg(*counted)
    n = F.col("issues")
    return out.withColumn("grade", F.when(n == 0, "HEALTHY").when(n < 3, "MINOR").otherwise("CRITICAL"))


# What the log scan counts, by line pattern.
LOG_PATTERNS = {
    "memory": r"OutOfMemoryError|Java heap space",
    "connection": r"Connection refused|ConnectException",
    "engine": r"ClickHouseException|Code: 1001",
    "task": r"Task.*failed|WorkerSinkTask.*failed",
    "thread": r"deadlock|thread.*blocked|thread.*stuck",
}
SNAPSHOT_DONE = r"(?i)snapshot.*complet|snapshot.*finish"
SNAPSHOT_ANY = r"(?i)snapshot"
START_LINE = r"Starting Kafka Connect"
# Which issue is named first.
ISSUE_ORDER = ("memory", "task", "connection", "thread", "engine")


def log_summary(lines: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("ts", "line_no")) -> DataFrame:
    """Lines per problem kind, starts, and the last snapshot message, in one pass over the log."""
    line = F.col("line")

    def last(pattern: str) -> Column:
        return F.max_by("line", F.when(line.rlike(pattern), F.struct(*order)))

    aggs = [F.count_if(line.rlike(p)).alias(f"{k}_errors") for k, p in LOG_PATTERNS.items()]
    aggs += [
        F.count_if(line.rlike(START_LINE)).alias("starts"),
        last(SNAPSHOT_DONE).alias("last_completed"),
        last(SNAPSHOT_ANY).alias("last_snapshot"),
    ]
    out = lines.groupBy(*by).agg(*aggs) if by else lines.agg(*aggs)
    state = F.when(F.col("last_completed").isNotNull(), "completed").when(
        F.col("last_snapshot").isNotNull(), "in_progress"
    ).otherwise("no_messages")
    restarts = F.when(F.col("starts") > 2, "multiple").when(F.col("starts") == 0, "none_seen").otherwise("normal")
    return out.withColumns({"snapshot_state": state, "restarts": restarts})


def primary_issue(summary: DataFrame) -> DataFrame:
    """Sum of problem lines and the first kind that occurs, in fixed precedence."""
    issue = F.lit("none")
    for kind in reversed(ISSUE_ORDER):
        issue = F.when(F.col(f"{kind}_errors") > 0, kind).otherwise(issue)
    all_errors = sum((F.col(f"{k}_errors") for k in ISSUE_ORDER[1:]), F.col(f"{ISSUE_ORDER[0]}_errors"))
    return summary.withColumns({"errors": all_errors, "primary_issue": issue})


def load_estimate(df: DataFrame, size_mb: str, throughput: Column | float) -> DataFrame:
    """Minutes to load ``size_mb`` at ``throughput`` MB/s (cut to two decimals), in bands of 30 and 120."""
    rate = throughput if isinstance(throughput, Column) else F.lit(float(throughput))
    minutes = F.floor(F.try_divide(F.col(size_mb) * 100, rate) / 60) / 100
    out = df.withColumn("load_minutes", minutes)
    m = F.floor("load_minutes")
    band = F.when(m < 30, "acceptable").when(m < 120, "consider_backfill").otherwise("recommend_backfill")
    return out.withColumn("load_band", band)


# Thresholds named in the operating documents, as (metric, threshold, severity).
ALERT_RULES = [
    ("consumer_lag", 1000000.0, "critical"),
    ("replication_lag_seconds", 300.0, "critical"),
    ("freshness_seconds", 600.0, "warning"),
    ("dlq_records", 10000.0, "warning"),
    ("parts_per_partition", 300.0, "warning"),
    ("parts_per_table", 1000.0, "critical"),
    ("failed_insert_percent", 1.0, "critical"),
    ("disk_usage_percent", 85.0, "warning"),
    ("memory_usage_percent", 80.0, "warning"),
]


def alert_rules(spark: SparkSession, rules: Sequence[tuple[str, float, str]] = ALERT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "metric string, threshold double, severity string")


def evaluate_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Readings ``metric, subject, value`` above the threshold of a rule for their metric.

    The rule table is joined as it is; a short one is broadcast by its size.
    """
    return metrics.join(rules, "metric").where(F.col("value") > F.col("threshold"))


def file_listing(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Files of a table with their partition folder, from the file system."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    folder = F.regexp_extract("path", r"([^/]+=[^/]+(?:/[^/]+=[^/]+)*)/[^/]+$", 1)
    return files.select(F.lit(table).alias("table_name"), folder.alias("partition"), F.col("path").alias("file"))


def file_counts(listing: DataFrame, per_partition: int = 300, per_table: int = 1000) -> DataFrame:
    """Files per table, the fullest partition, and an alert above 300 per partition or 1000 per table."""
    parts = listing.groupBy("table_name", "partition").agg(F.count("*").alias("n"))
    out = parts.groupBy("table_name").agg(
        F.count("*").alias("partitions"), F.sum("n").alias("files"), F.max("n").alias("max_files")
    )
    level = F.when(F.col("files") > per_table, "critical").when(F.col("max_files") > per_partition, "warning").otherwise("ok")
    return out.withColumn("level", level)


def recent_activity(qlog: DataFrame, ts: str, as_of: str, minutes: int = 10, top: int | None = None) -> DataFrame:
    """The last finished queries within ``minutes`` before ``as_of``, newest first."""
    since = instant(as_of) - F.expr(f"INTERVAL {minutes} MINUTE")
    recent = qlog.where((F.col(ts) > since) & (F.col(ts) <= instant(as_of)))
    return first_rows(recent.orderBy(F.col(ts).desc(), *[c for c in qlog.columns if c != ts]), top)


def activity_by_kind(qlog: DataFrame, ts: str, as_of: str, kind: str, minutes: int = 10) -> DataFrame:
    since = instant(as_of) - F.expr(f"INTERVAL {minutes} MINUTE")
    recent = qlog.where((F.col(ts) > since) & (F.col(ts) <= instant(as_of)))
    return recent.groupBy(kind).agg(F.count("*").alias("queries"))

