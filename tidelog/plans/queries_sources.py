"""Registered queries: sources and sinks. Sinks write to the shared work folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import load
from tidelog.model import MESSAGE_SCHEMA, ORDER_TYPES
from tidelog.operators import events as ev
from tidelog.operators import schema as sc
from tidelog.operators import state as st
from tidelog.plans.queries_events import messages, typed_rows
from tidelog.plans.queries_state import _LATEST_ORDERS, _SHOW, order_log, show_order
from tidelog.registry import query
from tidelog.session import work_dir
from tidelog.sources import read, write
from tidelog.sources import snapshot as snap
from tidelog.sources.cursors import Cursors, sync_tables
from tidelog.sources.folding import FoldingLog, LocatedTable, folding_sink
from tidelog.streaming import jobs
from tidelog.streaming.intervals import TakenPositions, once

FILES = 4
ORDERS_PER_FILE = 250_000  # about 120 MB of messages
PATTERN = r"mysql\.shop\..*"


def segments(spark: SparkSession, sf_dir: str) -> int:
    """How many files hold a ``FILES``th of the topic, so that none takes a task more than ``ORDERS_PER_FILE``."""
    return max(1, -(-load(spark, sf_dir, "orders").count() // (FILES * ORDERS_PER_FILE)))


def topic_files(spark: SparkSession, sf_dir: str) -> str:
    """The messages as JSON-line files, ``FILES`` times ``segments``, standing in for a topic.

    The orders are dealt to tasks, each of which writes their messages: these are ten times as long as the orders.
    """
    path = work_dir(spark, "topic")
    files = FILES * segments(spark, sf_dir)
    messages(spark, sf_dir, {"orders": files}).select(*MESSAGE_SCHEMA.names).write.json(path)
    return path


def written(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@query(
    "a01_read_snapshot",
    """
    SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(16, 2))) AS DOUBLE) AS price_sum,
           CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM orders GROUP BY o_orderstatus""",
)
def read_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read.read_snapshot(spark, "orders", path=sf_dir)
        .groupBy("o_orderstatus")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("o_totalprice").cast("decimal(16,2)")).cast("double").alias("price_sum"),
            F.sum("o_orderkey").alias("key_sum"),
        )
    )


@query(
    "a01_chunk_bounds",
    """
    SELECT 32 AS chunks, true AS within_two, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders""",
)
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that crowd at the lower end (cubes) in chunks whose sizes differ by less than the factor two."""
    # As doubles: a cube leaves 64 bits at key 2,097,152, and rounding keeps the order of the cubes.
    root = F.col("o_orderkey").cast("double")
    rows = load(spark, sf_dir, "orders").withColumn("key", root * root * root)
    bounds = snap.chunk_bounds(rows, "key", 32)
    parts = rows.groupBy(snap.chunk_number("key", bounds).alias("chunk")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))
    return parts.agg(
        F.count("*").cast("int").alias("chunks"),
        (F.max("n") <= 2 * F.min("n")).alias("within_two"),
        F.sum("n").alias("n"),
        F.sum("key_sum").alias("key_sum"),
    )


@query(
    "a02_select_tables",
    """
    SELECT table_name FROM side_tables
    WHERE (table_name LIKE 'a\\_%' ESCAPE '\\' OR table_name IN ('n_o_1995', 'n_o_1996', 'r_f_1999'))
      AND table_name NOT LIKE '%2000'""",
)
def select_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = load(spark, sf_dir, "side_tables").withColumn("db", F.lit("shop"))
    include = [r"shop\.a_.*", r"shop\.n_o_199[56]", r"shop\.r_f_1999"]
    return read.select_tables(catalog, include, exclude=[r".*2000"]).select("table_name")


@query(
    "a03_read_changes",
    """
    SELECT topic, part, count(*) AS n, count(value) AS n_values, CAST(sum(off) AS BIGINT) AS off_sum
    FROM envelopes GROUP BY topic, part""",
)
def read_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = read.read_changes(spark, PATTERN, path=topic_files(spark, sf_dir))
    out = work_dir(spark, "changes")
    jobs.append_to(stream, out, work_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return (
        written(spark, out)
        .groupBy("topic", "part")
        .agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.sum("off").alias("off_sum"))
    )


@query(
    "a04_route_topic",
    """
    SELECT h_topic AS topic, table_name, count(*) AS n FROM (
      SELECT h_topic, CASE WHEN h_topic LIKE 'mysql.shop.%' THEN substr(h_topic, 12) ELSE h_topic END AS table_name
      FROM dead_letters) t
    GROUP BY h_topic, table_name""",
)
def route_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = load(spark, sf_dir, "dead_letters").select(F.col("h_topic").alias("topic"))
    return ev.route_topic(topics).groupBy("topic", "table_name").agg(F.count("*").alias("n"))


@query(
    "a05_bootstrap",
    """
    WITH logged AS (SELECT 'initial' AS mode, op, _version, o_totalprice FROM order_log WHERE op <> 'r'
      UNION ALL SELECT 'initial', 'r', 0, CAST(o_totalprice AS DECIMAL(18, 2)) FROM orders
      UNION ALL SELECT 'initial_only', 'r', 0, CAST(o_totalprice AS DECIMAL(18, 2)) FROM orders
      UNION ALL SELECT 'never', op, _version, o_totalprice FROM order_log WHERE op <> 'r')
    SELECT mode, op, _version, count(*) AS n, CAST(sum(o_totalprice) AS DOUBLE) AS price_sum
    FROM logged GROUP BY mode, op, _version""",
)
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = load(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    changes = order_log(spark, sf_dir).where("op <> 'r'")

    def summary(mode: str) -> DataFrame:
        log = read.bootstrap(snapshot, changes, mode)
        return log.groupBy(F.lit(mode).alias("mode"), "op", "_version").agg(
            F.count("*").alias("n"), F.sum("o_totalprice").cast("double").alias("price_sum")
        )

    return summary("initial").unionByName(summary("initial_only")).unionByName(summary("never"))


@query("a05_chunked_snapshot", f"SELECT {_SHOW} FROM ({_LATEST_ORDERS}) s WHERE _is_deleted = 0")
def chunked_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five chunks, each read while another kind of change flows, and no change before them taken from elsewhere.

    The log runs kind by kind (updates, moves, new rows, deletes, returns). A chunk is read halfway through one kind, so
    it has seen the changes of some of its keys and missed those of others; what the log said before counts as consumed.
    """
    step = 10**11
    log = order_log(spark, sf_dir).withColumn("pos", F.col("arrival") % 8 * step + F.col("arrival"))
    middle = load(spark, sf_dir, "orders").agg(F.max("o_orderkey") * 4).scalar()
    chunk = F.col("o_orderkey") % 5
    low = (chunk + 2) * step
    seen = st.current_state(log.where(F.col("pos") <= low + middle), ["o_orderkey"], ["pos"])
    rows = seen.withColumns({"_low": low, "_high": low + step - 1, "op": F.lit("r")}).drop("pos")
    changes = log.where((F.col("op") != "r") & (F.col("pos") > low))
    merged = snap.between_marks(rows, changes, ["o_orderkey"], "pos")
    # Operation and version as the log has them, to compare with it.
    last = st.current_state(merged, ["o_orderkey"], ["pos"]).drop("op", "_version")
    known = st.latest_by_key(log, ["o_orderkey"], ["pos"]).select("o_orderkey", "op", "_version")
    return show_order(last.join(known, "o_orderkey"))


_OK_ROWS = "SELECT * FROM order_log WHERE arrival % 97 <> 5 AND arrival % 89 <> 7"


@query(
    "a06_append_versions",
    f"""
    SELECT 'table' AS sink, op, count(*) AS n, CAST(sum(o_totalprice) AS DOUBLE) AS price_sum,
           CAST(max(CASE WHEN op = 'r' THEN 0 ELSE (999998 + _version) * 4294967296 + arrival END) AS BIGINT) AS top_version
    FROM ({_OK_ROWS}) o GROUP BY op
    UNION ALL
    SELECT 'dead_letters', NULL, count(*), NULL, NULL FROM order_log WHERE arrival % 97 = 5 OR arrival % 89 = 7""",
)
def append_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole replication stream: topic files to a versioned table and a dead-letter table."""
    stream = read.read_changes(spark, PATTERN, path=topic_files(spark, sf_dir), max_files=2 * segments(spark, sf_dir))
    table, dlq = work_dir(spark, "orders"), work_dir(spark, "dead-letters")
    jobs.replicate(
        stream, ORDER_TYPES, table, dlq, work_dir(spark, "checkpoint"), required=["o_orderkey"], available_now=True
    ).awaitTermination()
    rows = written(spark, table).groupBy(F.lit("table").alias("sink"), "op").agg(
        F.count("*").alias("n"),
        F.sum("o_totalprice").cast("double").alias("price_sum"),
        F.max("_version").alias("top_version"),
    )
    failed = written(spark, dlq).agg(
        F.lit("dead_letters").alias("sink"),
        F.lit(None).cast("string").alias("op"),
        F.count("*").alias("n"),
        F.lit(None).cast("double").alias("price_sum"),
        F.lit(None).cast("bigint").alias("top_version"),
    )
    return rows.unionByName(failed)


TABLE_TYPES = {
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
}


def table_messages(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """One create event for each row of a table; rows whose key divides by 11 hold text where a number belongs."""
    rows = load(spark, sf_dir, name)
    columns = [F.when(F.col(key) % 11 == 0, F.lit("x")).otherwise(F.col(c).cast("string")).alias(c) if c.endswith("nationkey") and c != key else F.col(c) for c in rows.columns[:4]]
    source = F.struct(F.lit("bin.000001").alias("file"), F.col(key).cast("bigint").alias("pos"))
    value = F.to_json(F.struct(F.struct(*columns).alias("after"), source.alias("source"), F.lit("c").alias("op")))
    return rows.select(
        F.lit(f"mysql.shop.{name}").alias("topic"), F.lit(0).cast("bigint").alias("part"), F.col(key).cast("bigint").alias("off"),
        F.col(key).cast("string").alias("msg_key"), value.alias("value"),
    )


_REPLICATED = """
    SELECT 'customer' AS sink, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum, max(c_name) AS last_name, CAST(sum(c_nationkey) AS BIGINT) AS place_sum
    FROM customer WHERE c_custkey % 11 <> 0
    UNION ALL SELECT 'supplier', count(*), CAST(sum(s_suppkey) AS BIGINT), max(s_name), CAST(sum(s_nationkey) AS BIGINT) FROM supplier WHERE s_suppkey % 11 <> 0
    UNION ALL SELECT 'nation', count(*), CAST(sum(n_nationkey) AS BIGINT), max(n_name), CAST(sum(n_regionkey) AS BIGINT) FROM nation
    UNION ALL SELECT 'failed ' || topic, count(*), CAST(sum(k) AS BIGINT), NULL, NULL FROM (
      SELECT 'mysql.shop.customer' AS topic, c_custkey AS k FROM customer WHERE c_custkey % 11 = 0
      UNION ALL SELECT 'mysql.shop.supplier', s_suppkey FROM supplier WHERE s_suppkey % 11 = 0
      UNION ALL SELECT 'mysql.shop.region', r_regionkey FROM region) f GROUP BY topic"""


@query(
    "a06_replicate_tables",
    _REPLICATED,
)
def replicate_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four topics in one stream: three tables with columns of their own, and one that nothing takes."""
    return replicated(spark, sf_dir, TABLE_TYPES, {n: [k] for n, k in TABLE_KEYS.items()})


_CATALOG = [
    ("customer", 1, "c_custkey", "bigint NOT NULL", 1), ("customer", 2, "c_name", "varchar(25) DEFAULT NULL", 0), ("customer", 3, "c_nationkey", "int DEFAULT NULL", 0),
    ("supplier", 1, "s_suppkey", "bigint NOT NULL", 1), ("supplier", 2, "s_name", "varchar(25) DEFAULT NULL", 0), ("supplier", 3, "s_nationkey", "int DEFAULT NULL", 0),
    ("nation", 1, "n_nationkey", "int NOT NULL", 1), ("nation", 2, "n_name", "char(25) DEFAULT NULL", 0), ("nation", 3, "n_regionkey", "int DEFAULT NULL", 0),
]


@query("d10_catalog_stream", _REPLICATED)
def catalog_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream with the types and keys that the source's column catalog converts to."""
    catalog = spark.createDataFrame(_CATALOG, "table_name string, ordinal int, column_name string, column_def string, key_position int")
    return replicated(spark, sf_dir, *sc.stream_tables(catalog))


TABLE_KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey"}


def replicated(spark: SparkSession, sf_dir: str, types: dict, required: dict) -> DataFrame:
    """Counts and sums of each table that the stream wrote, and of what it could not take."""
    topic, root, dlq = work_dir(spark, "topics"), work_dir(spark, "tables"), work_dir(spark, "dead-letters")
    for name, key in (TABLE_KEYS | {"region": "r_regionkey"}).items():
        table_messages(spark, sf_dir, name, key).write.mode("append").json(topic)
    stream = read.read_changes(spark, PATTERN, path=topic)
    jobs.replicate_tables(stream, types, root, dlq, work_dir(spark, "checkpoint"), required=required, available_now=True).awaitTermination()
    out = written(spark, dlq).groupBy(F.concat(F.lit("failed "), "topic").alias("sink")).agg(
        F.count("*").alias("n"), F.sum("off").alias("key_sum"), F.lit(None).cast("string").alias("last_name"), F.lit(None).cast("bigint").alias("place_sum")
    )
    for name, columns in TABLE_TYPES.items():
        key, label, place = columns
        out = out.unionByName(
            written(spark, f"{root}/{name}").agg(
                F.lit(name).alias("sink"), F.count("*").alias("n"), F.sum(key).cast("bigint").alias("key_sum"),
                F.max(label).alias("last_name"), F.sum(place).cast("bigint").alias("place_sum"),
            )
        )
    return out


@query("a07_upsert", f"SELECT {_SHOW} FROM ({_LATEST_ORDERS}) s WHERE _is_deleted = 0")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot table by order month; the changes are applied in place."""
    log = order_log(spark, sf_dir).withColumn("ym", F.date_format("o_orderdate", "yyyyMM").cast("int"))
    target = work_dir(spark, "upsert-target")
    snapshot = st.latest_by_key(log.where("op = 'r'"), ["o_orderkey"], ["_version", "arrival"])
    write.write_table(snapshot, target, ["ym"])
    write.upsert(target, log.where("op <> 'r'"), ["o_orderkey"], ["_version", "arrival"], "ym")
    return show_order(written(spark, target))


@query("a07_upsert_located", f"SELECT {_SHOW} FROM ({_LATEST_ORDERS}) s WHERE _is_deleted = 0")
def upsert_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the key locator, in three batches that bring many changes of a key out of order."""
    log = order_log(spark, sf_dir).withColumn("ym", F.date_format("o_orderdate", "yyyyMM").cast("int"))
    target = LocatedTable(spark, work_dir(spark, "located"), ["o_orderkey"], ["_version", "arrival"], "ym", buckets=16)
    target.create(st.latest_by_key(log.where("op = 'r'"), ["o_orderkey"], ["_version", "arrival"]))
    changes = log.where("op <> 'r'")
    for batch_id in (2, 1, 0):
        target.upsert(changes.where(F.col("arrival") % 3 == batch_id), 2 - batch_id)
    return show_order(target.read())


@query("a07_merge_upsert", f"SELECT {_SHOW} FROM ({_LATEST_ORDERS}) s WHERE _is_deleted = 0")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge as one plan, without writing."""
    log = order_log(spark, sf_dir)
    snapshot = st.latest_by_key(log.where("op = 'r'"), ["o_orderkey"], ["_version", "arrival"])
    return show_order(st.merge_upsert(snapshot, log.where("op <> 'r'"), ["o_orderkey"], ["_version", "arrival"]))


@query("a08_micro_batches", f"SELECT {FILES} AS n_batches, count(*) AS n_messages FROM envelopes")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per batch, or the segments that stand for it in a large topic: as many batches as ``FILES``."""
    stream = read.read_changes(spark, PATTERN, path=topic_files(spark, sf_dir), max_files=segments(spark, sf_dir))
    out = work_dir(spark, "batches")
    jobs.append_to(stream, out, work_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return written(spark, out).agg(
        F.count_distinct("batch_id").cast("int").alias("n_batches"), F.count("*").alias("n_messages")
    )


@query(
    "a09_split_valid",
    """
    SELECT arrival AS off, CASE WHEN arrival % 97 = 5 THEN 'JsonParseException' ELSE 'DataException' END AS error_class,
           CASE WHEN arrival % 97 = 5 THEN '' ELSE 'o_custkey' END AS problem_fields, 'dlq' AS outcome
    FROM order_log WHERE arrival % 97 = 5 OR arrival % 89 = 7
    UNION ALL
    SELECT arrival, '', '', 'ok' FROM order_log WHERE arrival % 97 <> 5 AND arrival % 89 <> 7""",
)
def split_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, dlq = ev.split_valid(typed_rows(spark, sf_dir), required=["o_orderkey"])
    headers = F.map_from_entries("headers")
    failed = dlq.select(
        "off",
        headers["__connect.errors.exception.class.name"].alias("error_class"),
        F.array_join("problematic_fields", ",").alias("problem_fields"),
        F.lit("dlq").alias("outcome"),
    )
    fine = ok.select("off", F.lit("").alias("error_class"), F.lit("").alias("problem_fields"), F.lit("ok").alias("outcome"))
    return failed.unionByName(fine)


@query(
    "a10_idempotent_sink",
    """
    SELECT op, count(*) AS n, count(DISTINCT arrival) AS n_arrivals FROM order_log GROUP BY op""",
)
def idempotent_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch 0 is delivered twice; the table holds it once."""
    out = work_dir(spark, "idempotent")
    sink = write.idempotent_sink(out)
    log = order_log(spark, sf_dir)
    first, rest = log.where("op = 'r'"), log.where("op <> 'r'")
    for batch, batch_id in ((first, 0), (rest, 1), (first, 0)):
        sink(batch, batch_id)
    return written(spark, out).groupBy("op").agg(
        F.count("*").alias("n"), F.count_distinct("arrival").alias("n_arrivals")
    )


@query(
    "a11_align",
    """
    SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderstatus, NULL::VARCHAR AS o_comment
    FROM orders""",
)
def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"o_orderkey": "bigint", "O_TOTALPRICE": "double", "o_orderstatus": "string", "o_comment": "string"}
    out = ev.align(load(spark, sf_dir, "orders"), schema)
    return out.withColumnRenamed("O_TOTALPRICE", "o_totalprice")


_SYNC_TARGET = "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'"


@query(
    "a12_sync_modes",
    f"""
    WITH src AS (SELECT o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(16, 2)) AS price FROM orders),
    tgt AS (SELECT o_orderkey, o_orderdate, CAST(o_totalprice AS DECIMAL(16, 2)) AS price FROM ({_SYNC_TARGET}) t),
    done AS (SELECT 'overwrite' AS mode, * FROM src
      UNION ALL SELECT 'append', * FROM src UNION ALL SELECT 'append', * FROM tgt
      UNION ALL SELECT 'incremental', * FROM tgt
      UNION ALL SELECT 'incremental', * FROM src WHERE o_orderdate > (SELECT max(o_orderdate) FROM tgt))
    SELECT mode, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys, CAST(sum(price) AS DOUBLE) AS price_sum
    FROM done GROUP BY mode""",
)
def sync_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(16,2)").alias("price")
    )
    target = source.where("o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    out = None
    for mode in ("overwrite", "append", "incremental"):
        done = write.sync(source, target, mode, ["o_orderkey"], "o_orderdate").agg(
            F.lit(mode).alias("mode"),
            F.count("*").alias("n"),
            F.count_distinct("o_orderkey").alias("n_keys"),
            F.sum("price").cast("double").alias("price_sum"),
        )
        out = done if out is None else out.unionByName(done)
    return out


@query(
    "a13_read_incremental",
    """
    SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum,
           CAST((SELECT max(ts) FROM events) AS VARCHAR) AS high_water
    FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'""",
)
def read_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    rows, mark = read.read_incremental(load(spark, sf_dir, "events"), "ts", last)
    return rows.agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum")).withColumn(
        "high_water", mark.select(F.col("high_water").cast("string")).scalar()
    )


@query(
    "a13_stored_cursors",
    """
    SELECT 'events' AS table_name, 2 AS rounds, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS key_sum, CAST(max(ts) AS VARCHAR) AS mark FROM events
    UNION ALL SELECT 'orders', 2, count(*), CAST(sum(o_orderkey) AS BIGINT), CAST(max(o_orderdate) AS VARCHAR) FROM orders
    UNION ALL SELECT 'customer', 1, count(*), CAST(sum(c_custkey) AS BIGINT), CAST(max(c_custkey) AS VARCHAR) FROM customer""",
)
def stored_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables in three rounds: the first finds half of two of them, the second the rest, the third nothing."""
    events, orders, customer = (load(spark, sf_dir, t) for t in ("events", "orders", "customer"))
    store, root = Cursors(spark, work_dir(spark, "cursors")), work_dir(spark, "synced")
    half = {
        "events": (events.where("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'"), "ts"),
        "orders": (orders.where("o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'"), "o_orderdate"),
        "customer": (customer, "c_custkey"),
    }
    whole = {"events": (events, "ts"), "orders": (orders, "o_orderdate"), "customer": (customer, "c_custkey")}
    for tables in (half, whole, whole):
        rounds = sync_tables(tables, root, store)
    out = None
    for name, key in (("events", "event_id"), ("orders", "o_orderkey"), ("customer", "c_custkey")):
        one = written(spark, f"{root}/{name}").agg(
            F.lit(name).alias("table_name"), F.lit(rounds[name]).alias("rounds"), F.count("*").alias("n"), F.sum(key).cast("bigint").alias("key_sum"),
            F.lit(store.get(name)["mark"]).alias("mark"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "a14_append_above_max",
    f"""
    SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM orders
    WHERE o_orderdate > (SELECT max(o_orderdate) FROM ({_SYNC_TARGET}) t)""",
)
def append_above_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = load(spark, sf_dir, "orders")
    target = source.where("o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    out = read.append_above_max(source, target, "o_orderdate")
    return out.select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"))


@query("a15_export_restore", "SELECT page_id, url, html, length(html) AS n_chars FROM pages")
def export_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through a backup, a restore and a CSV export: quotes and line breaks survive."""
    pages = load(spark, sf_dir, "pages")
    saved, csv = work_dir(spark, "backup"), work_dir(spark, "csv")
    write.backup(pages, saved)
    restored = write.restore(spark, saved, work_dir(spark, "restored"))
    write.export_csv(restored, csv)
    back = write.import_csv(spark, csv, pages.schema)
    return back.withColumn("n_chars", F.length("html").cast("bigint"))


@query(
    "a16_ctas",
    """
    SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS order_year, o_totalprice FROM orders""",
)
def ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").withColumn("order_year", F.year("o_orderdate"))
    copy = write.ctas(orders, work_dir(spark, "ctas"), ["o_custkey", "o_orderdate"], ["order_year"])
    return copy.select("o_orderkey", "o_custkey", "order_year", "o_totalprice")


# --- compaction and stream state -----------------------------------------------------


@query("c04_compact", f"SELECT {_SHOW}, _is_deleted FROM ({_LATEST_ORDERS}) s")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir)
    out = write.compact(log, work_dir(spark, "compact"), ["o_orderkey"], purge_deleted=False)
    return show_order(out).join(out.select("o_orderkey", "_is_deleted"), "o_orderkey")


@query("c04_folding_log", f"SELECT {_SHOW} FROM ({_LATEST_ORDERS}) s WHERE _is_deleted = 0")
def folding_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches, deletes before older changes, folded twice in between; a batch that comes again changes nothing."""
    log = FoldingLog(spark, work_dir(spark, "folding"), ["o_orderkey"], ["_version", "arrival"], buckets=16)
    changes = order_log(spark, sf_dir)
    for batch_id in range(4):
        log.append(changes.where(F.col("arrival") % 4 == batch_id), batch_id)
        if batch_id % 2:
            log.fold(ratio=0.1)
    log.append(changes.where("arrival % 4 = 3"), 3)
    return show_order(log.state())


_HALF = "arrival % 3 < 2 OR arrival <= (SELECT max(o_orderkey) * 4 FROM orders)"


@query(
    "c05_late_after_delete",
    f"""
    SELECT {_SHOW}, _is_deleted FROM ({_LATEST_ORDERS}) s
    WHERE _is_deleted = 0 OR arrival > (SELECT least(max(CASE WHEN arrival % 3 = 0 THEN arrival END), max(CASE WHEN arrival % 3 = 1 THEN arrival END),
                                                     max(CASE WHEN arrival % 3 = 2 THEN arrival END)) FROM order_log WHERE {_HALF})""",
)
def late_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three source partitions, one after the other, the last in two halves: tombstones go up to the least consumed position."""
    log = FoldingLog(
        spark, work_dir(spark, "late"), ["o_orderkey"], ["_version", "arrival"], buckets=16, position="arrival", source=["part"], sources=["0", "1", "2"]
    )
    changes = order_log(spark, sf_dir).withColumn("part", (F.col("arrival") % 3).cast("int"))
    middle = load(spark, sf_dir, "orders").agg(F.max("o_orderkey") * 4).scalar()
    early = F.col("arrival") <= middle
    for batch_id, rows in enumerate([F.col("part") == 0, F.col("part") == 1, (F.col("part") == 2) & early]):
        log.append(changes.where(rows), batch_id)
        log.fold(ratio=0)
    log.append(changes.where((F.col("part") == 2) & ~early), 3)
    out = log.latest()
    return show_order(out).join(out.select("o_orderkey", "_is_deleted"), "o_orderkey")


@query("c05_purge_deleted", f"SELECT {_SHOW} FROM ({_LATEST_ORDERS}) s WHERE _is_deleted = 0")
def purge_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = order_log(spark, sf_dir).withColumn("ym", F.date_format("o_orderdate", "yyyyMM").cast("int"))
    return show_order(write.compact(log, work_dir(spark, "purge"), ["o_orderkey"], partition_by=["ym"]))


def change_files(spark: SparkSession, sf_dir: str, name: str, files: int = FILES) -> DataFrame:
    """A fixture as a stream of parquet files in no particular order."""
    path = work_dir(spark, name)
    rows = load(spark, sf_dir, name)
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def change_batch(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a stream that delivers all its files, as many as Spark writes, in one batch."""
    path = work_dir(spark, name)
    rows = load(spark, sf_dir, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query(
    "c11_stream_state",
    """
    SELECT user_id, event_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM user_changes) r
    WHERE rn = 1 AND _is_deleted = 0""",
)
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = change_files(spark, sf_dir, "user_changes").drop("props", "op")
    out = work_dir(spark, "state")
    jobs.stream_state(
        changes, ["user_id"], ["ts", "event_id"], out, work_dir(spark, "checkpoint"), available_now=True
    ).awaitTermination()
    state = jobs.read_state(spark, out, ["user_id"])
    return state.where("_is_deleted = 0").select("user_id", "event_id", "event_type", "value")


@query(
    "c11_folded_stream",
    """
    SELECT user_id, event_id, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM user_changes) r
    WHERE rn = 1 AND _is_deleted = 0""",
)
def folded_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state without a state store: a stream into a log that folds as it grows."""
    changes = change_files(spark, sf_dir, "user_changes").drop("props", "op")
    log = FoldingLog(spark, work_dir(spark, "folded"), ["user_id"], ["ts", "event_id"], buckets=8)
    writer = changes.writeStream.foreachBatch(folding_sink(log, ratio=0.2))
    jobs.start(writer, work_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return log.state().select("user_id", "event_id", "event_type", "value")


@query(
    "c12_dedup_events",
    """
    SELECT o_orderkey, _version, min(op) AS op FROM order_log GROUP BY o_orderkey, _version""",
)
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated deliveries arrive once: the version is the topic partition, the key the position in it."""
    taken = TakenPositions(spark, work_dir(spark, "taken"), ["_version"], "o_orderkey")
    out = work_dir(spark, "dedup")
    stream = change_files(spark, sf_dir, "order_log")
    writer = stream.writeStream.foreachBatch(once(taken, write.idempotent_sink(out)))
    jobs.start(writer, work_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return written(spark, out).select("o_orderkey", "_version", "op")
