"""Registered queries: change-event transforms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import EVENTS_AS_OF, load
from tidelog.functions.columns import instant
from tidelog.model import ORDER_TYPES
from tidelog.operators import events as ev
from tidelog.operators import history as hs
from tidelog.registry import query
from tidelog.session import staged


def messages(spark: SparkSession, sf_dir: str, tasks: Mapping[str, int] | None = None) -> DataFrame:
    return load(spark, sf_dir, "envelopes", tasks).drop("part_kind")


def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ev.parse_envelope(ev.handle_tombstones(messages(spark, sf_dir)), ORDER_TYPES)
    return ev.normalise_values(ev.unwrap(parsed), ORDER_TYPES)


def _text(name: str) -> str:
    return f"CAST({name} AS VARCHAR)"


#: What is known of each message of ``order_log``: a broken one (cut in half) keeps only its place in the topic.
_READ = """(SELECT arrival, o_orderkey % 4 AS part, arrival % 97 <> 5 AS whole,
           CASE WHEN arrival % 97 <> 5 THEN op END AS op, CASE WHEN arrival % 97 <> 5 THEN o_orderkey END AS o_orderkey,
           CASE WHEN arrival % 97 <> 5 AND arrival % 89 <> 7 THEN o_custkey END AS o_custkey,
           CASE WHEN arrival % 97 <> 5 THEN o_totalprice END AS o_totalprice,
           CASE WHEN arrival % 97 <> 5 THEN o_orderdate END AS o_orderdate,
           CASE WHEN arrival % 97 <> 5 THEN _version END AS _version,
           CASE WHEN arrival % 97 <> 5 THEN _is_deleted ELSE 0 END AS _is_deleted
    FROM order_log) m"""


@query(
    "b01_parse_envelope",
    f"""
    SELECT l.arrival AS off, 'event' AS kind, l.op,
           CASE WHEN l.op IN ('u', 'd') THEN {_text('l.o_orderkey')} END AS before_key,
           CASE WHEN l.op <> 'd' THEN CAST(l.o_totalprice AS DOUBLE) END AS after_price,
           'binlog.' || {_text('999998 + l._version')} AS log_file,
           1700000000500 + l.arrival AS ts_ms, 0 AS is_corrupt
    FROM order_log l WHERE l.arrival % 97 <> 5
    UNION ALL
    SELECT arrival, 'event', NULL, NULL, NULL, NULL, NULL, 1 FROM order_log WHERE arrival % 97 = 5
    UNION ALL
    SELECT arrival, 'tombstone', NULL, NULL, NULL, NULL, NULL, 0 FROM order_log WHERE op = 'd'""",
)
def parse_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ev.parse_envelope(messages(spark, sf_dir), ORDER_TYPES)
    return parsed.select(
        "off",
        F.when(F.col("value").isNull(), "tombstone").otherwise("event").alias("kind"),
        "op",
        F.col("before.o_orderkey").cast("string").alias("before_key"),
        F.col("after.o_totalprice").cast("double").alias("after_price"),
        F.col("source.file").alias("log_file"),
        "ts_ms",
        F.col("_corrupt_record").isNotNull().cast("int").alias("is_corrupt"),
    )


@query(
    "b02_unwrap",
    f"""
    SELECT arrival AS off, op, {_text('o_orderkey')} AS o_orderkey, {_text('o_custkey')} AS o_custkey,
           CAST(o_totalprice AS DOUBLE) AS o_totalprice, {_text('o_orderdate')} AS o_orderdate
    FROM {_READ}""",
)
def unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ev.parse_envelope(ev.handle_tombstones(messages(spark, sf_dir)), ORDER_TYPES)
    rows = ev.unwrap(parsed)
    price = F.col("o_totalprice").cast("double").alias("o_totalprice")
    texts = [F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "o_orderdate")]
    return rows.select("off", "op", price, *texts)


@query(
    "b03_rewrite_deletes",
    f"""
    SELECT op AS __op, CASE WHEN op = 'd' THEN 'true' WHEN op <> 'd' THEN 'false' END AS __deleted,
           count(*) AS n, CAST(sum(CASE WHEN whole THEN 1700000000000 + arrival END) AS BIGINT) AS ts_sum,
           count(DISTINCT o_orderkey) AS n_keys
    FROM {_READ} GROUP BY op""",
)
def rewrite_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ev.parse_envelope(ev.handle_tombstones(messages(spark, sf_dir)), ORDER_TYPES)
    rows = ev.rewrite_deletes(ev.unwrap(parsed))
    sums = rows.groupBy("__op", "__deleted").agg(
        F.count("*").alias("n"),
        F.sum(F.col("__source_ts_ms").cast("decimal(19,0)")).alias("ts_sum"),
        F.count_distinct("o_orderkey").alias("n_keys"),
    )
    # Five million times of an epoch in ms sum up to more than 64 bits hold. A bigint while all sums fit, else a decimal.
    sums = staged(sums, "rewrite-deletes")
    short = F.col("ts_sum").try_cast("bigint")
    fit = sums.where(F.col("ts_sum").isNotNull() & short.isNull()).isEmpty()
    return sums.withColumn("ts_sum", short) if fit else sums


@query(
    "b04_tombstones",
    """
    SELECT 'dropped' AS handling, count(*) AS n_messages, 0 AS n_tombstones FROM order_log
    UNION ALL
    SELECT 'kept', count(*) + count(CASE WHEN op = 'd' THEN 1 END), count(CASE WHEN op = 'd' THEN 1 END)
    FROM order_log""",
)
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = messages(spark, sf_dir)

    def summary(drop: bool) -> DataFrame:
        return ev.handle_tombstones(msgs, drop).agg(
            F.lit("dropped" if drop else "kept").alias("handling"),
            F.count("*").alias("n_messages"),
            F.count_if(F.col("value").isNull()).cast("int").alias("n_tombstones"),
        )

    return summary(True).unionByName(summary(False))


@query(
    "b05_normalise_values",
    f"""
    SELECT arrival AS off, o_orderkey, o_custkey,
           CAST(o_totalprice AS DOUBLE) AS price,
           CAST(CAST(o_totalprice * 100 AS BIGINT) AS BIGINT) AS cents,
           CAST(o_orderdate AS VARCHAR) AS order_date,
           CASE WHEN whole AND arrival % 89 = 7 THEN 'o_custkey' ELSE '' END AS problems,
           CASE WHEN whole THEN CAST(to_timestamp((1700000000500 + arrival) / 1000.0) AT TIME ZONE 'UTC' AS DATE)::VARCHAR END AS event_day
    FROM {_READ}""",
)
def normalise_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_rows(spark, sf_dir).select(
        "off",
        "o_orderkey",
        "o_custkey",
        F.col("o_totalprice").cast("double").alias("price"),
        (F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.col("o_orderdate").cast("string").alias("order_date"),
        F.array_join("_problems", ",").alias("problems"),
        F.date_from_unix_date(F.floor(F.col("ts_ms") / 86400000).cast("int")).cast("string").alias("event_day"),
    )


@query(
    "b06_cdc_columns",
    f"""
    SELECT o_orderkey, arrival AS off, op,
           CASE WHEN op = 'r' THEN 0 ELSE (999998 + _version) * 4294967296 + arrival END AS _version,
           _is_deleted, '{EVENTS_AS_OF}' AS _extracted_at
    FROM {_READ}""",
)
def cdc_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.with_cdc_columns(typed_rows(spark, sf_dir), ev.version_number(), instant(EVENTS_AS_OF))
    return out.select(
        "o_orderkey", "off", "op", "_version", "_is_deleted", F.col("_extracted_at").cast("string").alias("_extracted_at")
    )



@query(
    "b07_version_order",
    f"""
    SELECT o_orderkey,
           max_by(op, struct_pack(a := _version, b := arrival)) AS last_op,
           max_by(arrival, struct_pack(a := CASE WHEN whole THEN 0 ELSE part END, b := arrival)) AS last_arrival_by_clock, count(*) AS n
    FROM {_READ} GROUP BY o_orderkey""",
)
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last change of each key; broken messages share the NULL key and are ordered by their place in the topic."""
    return typed_rows(spark, sf_dir).groupBy("o_orderkey").agg(
        F.max_by("op", ev.version_expr("composite")).alias("last_op"),
        F.max_by("off", ev.version_expr("timestamp")).alias("last_arrival_by_clock"),
        F.count("*").alias("n"),
    )


# Versions 999998 + _version name the log file: a schema for the snapshot and first changes, one from the deletes on.
_CHANGED_AT = (999998 + 2) << 32
SCHEMAS = [
    (0, {"o_orderkey": "bigint", "o_custkey": "string", "o_totalprice": "decimal(18,2)"}),
    (_CHANGED_AT, {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "decimal(18,2)", "o_orderpriority": "string"}),
]


@query(
    "a11_schema_history",
    f"""
    SELECT arrival AS off, op, CASE WHEN _version >= 2 THEN {_CHANGED_AT} ELSE 0 END AS since,
           o_orderkey, CASE WHEN arrival % 89 <> 7 THEN o_custkey END AS o_custkey, CAST(o_totalprice AS DOUBLE) AS price,
           CASE WHEN _version >= 2 THEN o_orderpriority END AS o_orderpriority,
           CASE WHEN arrival % 89 = 7 THEN 'o_custkey' ELSE '' END AS problems
    FROM order_log WHERE arrival % 97 <> 5
    UNION ALL SELECT arrival, NULL, 0, NULL, NULL, NULL, NULL, '' FROM order_log WHERE arrival % 97 = 5""",
)
def schema_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halfway through the log a column is added and another gets a number type; every change is read as its time had it."""
    rows = [("orders", since, c, t) for since, types in SCHEMAS for c, t in types.items()]
    history = spark.createDataFrame(rows, "table_name string, since bigint, column_name string, column_type string")
    out = hs.typed_as_of(ev.handle_tombstones(messages(spark, sf_dir)), history, "orders")
    return out.select(
        "off", "op", "since", "o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("price"), "o_orderpriority",
        F.array_join("_problems", ",").alias("problems"),
    )
