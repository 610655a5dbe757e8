"""Streams: replication with dead letters, latest state, duplicate removal, alerts, recent windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.util import inheritable_thread_target

from tidelog.model import VERSION
from tidelog.operators import events as ev
from tidelog.sources.write import append_versions, idempotent_sink, stream_id

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def trigger(seconds: int | None = None, available_now: bool = False) -> dict:
    """Trigger arguments: every ``seconds``, or everything there is and stop.

    The row limit per batch belongs to the source (``read_changes(max_rows=...)``).
    """
    if available_now:
        return {"availableNow": True}
    return {"processingTime": f"{seconds or 10} seconds"}


def replicate(
    messages: DataFrame,
    types: Mapping[str, str],
    table_path: str,
    dlq_path: str,
    checkpoint: str,
    required: Sequence[str] = (),
    version: str = "position",
    partition_by: Sequence[str] = (),
    **when,
) -> StreamingQuery:
    """Messages to a versioned table, failures to a dead-letter table, both once per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stamped, stream = _typed(ev.handle_tombstones(batch), types, version).persist(), stream_id(batch)
        try:
            ok, dlq = ev.split_valid(stamped, required)
            append_versions(ok.select(*_log_columns(types)), table_path, batch_id, partition_by, stream)
            append_versions(dlq, dlq_path, batch_id, stream=stream)
        finally:
            stamped.unpersist()

    return start(messages.writeStream.foreachBatch(write), checkpoint, **when)


def replicate_tables(
    messages: DataFrame,
    tables: Mapping[str, Mapping[str, str]],
    root: str,
    dlq_path: str,
    checkpoint: str,
    required: Mapping[str, Sequence[str]] | None = None,
    version: str = "position",
    partition_by: Mapping[str, Sequence[str]] | None = None,
    writers: int = 16,
    **when,
) -> StreamingQuery:
    """Messages of many tables, each routed by its topic, typed by its own columns and appended below ``root``.

    ``tables`` gives the column types by table name. Messages of other topics, or of none, become
    dead letters together with the rows that fail. A batch writes the tables it has messages of,
    ``writers`` of them at a time: small tables then share the cluster instead of waiting for each other.
    """
    required, partition_by = required or {}, partition_by or {}

    def write(batch: DataFrame, batch_id: int) -> None:
        stream = stream_id(batch)
        routed = ev.route_topic(ev.handle_tombstones(batch)).persist()
        known = F.coalesce(F.col("table_name").isin(*tables), F.lit(False))
        held, failures = [routed], [ev.unroutable(routed.where(~known))]
        try:
            present = {r[0] for r in routed.where(known).select("table_name").distinct().collect()}  # names of given tables
            parts = {}
            for name in sorted(present):
                mine = routed.where(F.col("table_name") == name).drop("table_name")
                stamped = _typed(mine, tables[name], version).persist()
                held.append(stamped)
                parts[name], dlq = ev.split_valid(stamped, required.get(name, ()))
                failures.append(dlq)

            def append(name: str) -> None:
                append_versions(parts[name].select(*_log_columns(tables[name])), f"{root.rstrip('/')}/{name}", batch_id, partition_by.get(name, ()), stream)

            with ThreadPoolExecutor(writers) as pool:
                list(pool.map(inheritable_thread_target(batch.sparkSession)(append), parts))
            append_versions(reduce(DataFrame.unionByName, failures), dlq_path, batch_id, stream=stream)
        finally:
            for df in held:
                df.unpersist()

    return start(messages.writeStream.foreachBatch(write), checkpoint, **when)


def _typed(messages: DataFrame, types: Mapping[str, str], version: str) -> DataFrame:
    rows = ev.normalise_values(ev.unwrap(ev.parse_envelope(messages, types)), types)
    return ev.with_cdc_columns(rows, ev.version_number(version), F.current_timestamp())


def _log_columns(types: Mapping[str, str]) -> list[str]:
    return [*types, "op", "part", "off", VERSION, "_is_deleted", "_extracted_at"]


def stream_state(
    changes: DataFrame, keys: Sequence[str], version: Sequence[str], path: str, checkpoint: str, **when
) -> StreamingQuery:
    """Latest row per key of a change stream; late and repeated changes never replace newer ones.

    The streaming ``max_by`` keeps one row per key in the state store (RocksDB) and needs no
    Python state code. Each batch writes the keys it changed; ``read_state`` gives the newest
    row of each. State grows with the number of keys: where keys are unbounded, append the
    log (``replicate``) and merge when reading.
    """
    values = [c for c in changes.columns if c not in keys]
    state = (
        changes.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), F.struct(*version)).alias("_row"))
        .select(*keys, "_row.*")
    )
    writer = state.writeStream.outputMode("update").foreachBatch(idempotent_sink(path))
    return start(writer, checkpoint, **when)


def read_state(spark, path: str, keys: Sequence[str], version: Sequence[str] = ()) -> DataFrame:
    """Newest written row per key: by ``version``, then by batch.

    Batch numbers start again with a new checkpoint; name the version where there was more than one.
    """
    log = spark.read.parquet(path)
    values = [c for c in log.columns if c not in (*keys, "batch_id", "stream")]
    return (
        log.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), F.struct(*version, "batch_id")).alias("_row"))
        .select(*keys, "_row.*")
    )


def dedup_events(changes: DataFrame, id_cols: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Drop repeated deliveries of a log position that arrive within ``delay`` of each other."""
    return changes.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(id_cols))


def dlq_alert(dlq: DataFrame, ts: str, window: str, threshold: int, delay: str = "10 minutes") -> DataFrame:
    """Windows in which more than ``threshold`` records failed."""
    counted = dlq.withWatermark(ts, delay).groupBy(F.window(ts, window)).agg(F.count("*").alias("failures"))
    return counted.where(F.col("failures") > threshold).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "failures"
    )


def recent_window(
    stream: DataFrame, ts: str, length: str = "5 minutes", keys: Sequence[str] = (), aggs=None, delay: str = "1 minute"
) -> DataFrame:
    """Metrics per window of ``length``, emitted once the watermark has passed it."""
    measures = aggs or [F.count("*").alias("n")]
    grouped = stream.withWatermark(ts, delay).groupBy(F.window(ts, length), *keys).agg(*measures)
    rest = [c for c in grouped.columns if c != "window"]
    return grouped.select(F.col("window.start").alias("window_start"), *rest)


def start(writer: DataStreamWriter, checkpoint: str, **when) -> StreamingQuery:
    """Start a stream with the arguments of ``trigger``."""
    options: dict = trigger(**when)
    return writer.trigger(**options).option("checkpointLocation", checkpoint).start()


def append_to(stream: DataFrame, path: str, checkpoint: str, **when) -> StreamingQuery:
    """Append-mode stream to a table, one folder per batch."""
    writer = stream.writeStream.outputMode("append").foreachBatch(idempotent_sink(path))
    return start(writer, checkpoint, **when)
