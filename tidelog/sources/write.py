"""Sinks: versioned appends, upserts, compaction, copies and exports.

Partitioned writes cluster rows with a ``rebalance`` hint: AQE then merges small partitions into
full files and splits a hot one over several tasks, where ``repartition`` by the partition columns
would give a hot month to one task. Unpartitioned writes are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import DELETED
from tidelog.operators.state import current_state, last_of_batch, merge_upsert
from tidelog.session import staged


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    mode: str = "overwrite",
    dynamic: bool = False,
) -> None:
    """Write parquet, clustered by partition and sorted in files (row-group min/max pruning)."""
    out = df.hint("rebalance", *partition_by) if partition_by else df
    order = [*partition_by, *sort_by]
    if order:
        out = out.sortWithinPartitions(*order)
    writer = out.write.mode(mode).option("partitionOverwriteMode", "dynamic" if dynamic else "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def stream_id(batch: DataFrame) -> str | None:
    """Id of the streaming query that delivers a batch; it lives in the checkpoint and survives restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def append_versions(
    batch: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = (), stream: str | None = None
) -> None:
    """Append every change of a batch as a new row under ``batch_id=<n>``, below ``stream=<id>`` if given.

    The folder of a batch is replaced as a whole, so a batch that is delivered again after a
    failure leaves the same rows: at-least-once delivery, exactly-once content. Batch numbers start
    again with a new checkpoint: with the id of the stream, its rows are added to those there are.
    """
    folder = path.rstrip("/") + (f"/stream={stream}" if stream else "")
    write_table(batch, f"{folder}/batch_id={batch_id}", partition_by)


def idempotent_sink(path: str, partition_by: Sequence[str] = ()):
    """``foreachBatch`` function that appends each batch with ``append_versions``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_versions(batch, path, batch_id, partition_by, stream_id(batch))

    return write


def ctas(df: DataFrame, path: str, sort_by: Sequence[str] = (), partition_by: Sequence[str] = ()) -> DataFrame:
    """Copy a table, with another sort key or partitioning, and read the copy."""
    write_table(df, path, partition_by, sort_by, mode="error")
    return df.sparkSession.read.parquet(path)


def drop_partitions(spark: SparkSession, path: str, partition: str, values: Sequence) -> None:
    """Remove partition folders; only metadata operations, no data is read.

    Names are escaped as Spark writes them, and nothing but a direct child of the table is deleted.
    """
    jvm = spark.sparkContext._jvm
    table = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for v in values:
        text = None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        folder = jvm.org.apache.hadoop.fs.Path(table, escape(partition, text))
        if not folder.getParent().equals(table):
            raise ValueError(f"{v!r} names no partition of {path}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def upsert(path: str, batch: DataFrame, keys: Sequence[str], version: Sequence[str], partition: str) -> None:
    """Apply changes to a partitioned parquet table in place, rewriting touched partitions only.

    Touched are the partitions that hold a key of the batch now and those the batch writes to,
    so a key that moves leaves no copy behind. The merged partitions are first written to the
    shared folder; the table is replaced from there, never from a job that still reads it, and
    an interrupted replacement can be run again.
    """
    spark = batch.sparkSession
    table = spark.read.parquet(path)
    last = staged(last_of_batch(batch, keys, version), "upsert-batch")
    held = table.join(last.select(*keys), list(keys), "left_semi").select(partition)
    into = last.where(F.col(DELETED) == 0).select(F.col(partition).cast(table.schema[partition].dataType))
    touched = [r[0] for r in held.union(into).distinct().collect()]  # partition values, not rows
    if not touched:
        return
    in_touched = F.col(partition).isin([v for v in touched if v is not None])
    current = table.where(F.coalesce(in_touched, F.lit(None in touched)))
    merged = staged(merge_upsert(current, last, keys, version), "upsert-merged", [partition])
    write_table(merged.select(*table.columns), path, [partition], dynamic=True)
    left = {r[0] for r in merged.select(partition).distinct().collect()}
    drop_partitions(spark, path, partition, [v for v in touched if v not in left])


def compact(
    log: DataFrame,
    path: str,
    keys: Sequence[str],
    version: Sequence[str] = ("_version", "arrival"),
    partition_by: Sequence[str] = (),
    purge_deleted: bool = True,
) -> DataFrame:
    """Write the current state of a log as a new table generation and read it.

    ``path`` must be new: readers switch to it once the write has committed, and the old
    generation stays readable until then. ``purge_deleted=False`` keeps tombstones, needed
    while older changes of a deleted key may still arrive.
    """
    state = current_state(log, keys, version, deleted=DELETED if purge_deleted else None)
    return ctas(state, path, sort_by=list(keys), partition_by=partition_by)


def sync(
    source: DataFrame, target: DataFrame, mode: str, keys: Sequence[str] = (), cursor: str | None = None
) -> DataFrame:
    """The target after a batch sync.

    ``overwrite``: the source. ``append``: target and source rows. ``incremental``: source rows
    above the target's cursor appended, then the latest row per key.
    """
    if mode == "overwrite":
        return source
    if mode == "append":
        return target.unionByName(source)
    if mode == "incremental":
        if not keys or cursor is None:
            raise ValueError("an incremental sync needs keys and a cursor")
        top = target.agg(F.max(cursor)).scalar()
        fresh = source.where(top.isNull() | (F.col(cursor) > top)).withColumn("_arrival", F.lit(1))
        merged = current_state(
            target.withColumn("_arrival", F.lit(0)).unionByName(fresh), keys, [cursor, "_arrival"], deleted=None
        )
        return merged.drop("_arrival")
    raise ValueError(f"unknown sync mode: {mode}")


# How CSV files say NULL, so that it stays apart from empty text.
CSV_NULL = "\\N"


def export_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; quotes, line breaks, empty text and NULL survive a round trip."""
    df.write.mode("error").option("header", True).option("escape", '"').option("nullValue", CSV_NULL).csv(path)


def import_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
        .option("nullValue", CSV_NULL).option("enforceSchema", False).csv(path)
    )


def backup(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    write_table(df, path, partition_by, mode="error")


def restore(spark: SparkSession, backup_path: str, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    write_table(spark.read.parquet(backup_path), path, partition_by, mode="error")
    return spark.read.parquet(path)


_GRAINS = {"month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH"}


def write_partitioned(df: DataFrame, path: str, ts: str, grain: str = "month", cohort: Sequence[str] = ()) -> None:
    """Partition by time at a grain, optionally below cohort columns.

    The partition column ``p_<grain>`` is an integer: filters should name it as well as the
    timestamp, since a parquet scan does not derive one from the other.
    """
    column = f"p_{grain}"
    tagged = df.withColumn(column, F.date_format(ts, _GRAINS[grain]).cast("int"))
    write_table(tagged, path, [*cohort, column], [ts])


def bucket_by_entity(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Distribute rows by entity hash into ``entity_bucket`` folders.

    Queries for one entity read one folder (``entity_bucket(key)`` gives the filter). A hot
    entity fills several files of its folder rather than one task.
    """
    write_table(df.withColumn("entity_bucket", entity_bucket(key, buckets)), path, ["entity_bucket"], [key])


def entity_bucket(key, buckets: int = 64):
    col = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


def refresh_extract(df: DataFrame, path: str) -> DataFrame:
    """Recompute a saved dashboard extract under a new folder and read it."""
    write_table(df, path, mode="error")
    return df.sparkSession.read.parquet(path)
