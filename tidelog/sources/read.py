"""Sources: table snapshots, change topics, incremental reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import MESSAGE_SCHEMA, RECORD_SCHEMA, VERSION

FETCH_SIZE = 10240


def jdbc_options(
    url: str,
    table: str,
    column: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int = 64,
    fetch_size: int = FETCH_SIZE,
    **extra: str,
) -> dict[str, str]:
    """Options of a chunked table read without locks.

    With ``column`` the read is split in ``partitions`` key ranges that executors fetch in
    parallel, ``fetch_size`` rows at a time; without it one task reads the table.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), "isolationLevel": "READ_COMMITTED", **extra}
    if column is not None:
        if lower is None or upper is None:
            raise ValueError("a chunked read needs the lower and upper bound of the column")
        options.update(
            partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions)
        )
    return options


def read_snapshot(spark: SparkSession, table: str, path: str | None = None, **options) -> DataFrame:
    """A whole table: from files under ``path``, or over JDBC with ``jdbc_options`` arguments."""
    if path is not None:
        return spark.read.parquet(f"{path.rstrip('/')}/{table}.parquet")
    return spark.read.format("jdbc").options(**jdbc_options(table=table, **options)).load()


def federated(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """The live table of an operational database; filters and aggregates are pushed to it."""
    pushed = {"pushDownPredicate": "true", "pushDownAggregate": "true", "pushDownLimit": "true"}
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **{**pushed, **options})).load()


def kafka_options(servers: str, pattern: str, starting: str = "earliest", max_rows: int | None = None,
                  fail_on_loss: bool = True) -> dict[str, str]:
    """Options of a topic subscription by regex."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribePattern": pattern,
        "startingOffsets": starting,
        "failOnDataLoss": str(fail_on_loss).lower(),
        "includeHeaders": "true",
    }
    if max_rows:
        options["maxOffsetsPerTrigger"] = str(max_rows)
    return options


def read_changes(
    spark: SparkSession,
    pattern: str,
    servers: str | None = None,
    path: str | None = None,
    max_rows: int | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """A stream of messages ``topic, part, off, msg_key, value`` from the topics that match.

    ``path`` reads JSON lines of the same shape instead of a broker.
    """
    if path is not None:
        reader = spark.readStream.schema(MESSAGE_SCHEMA)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.json(path).where(F.col("topic").rlike(f"^(?:{pattern})$"))
    if servers is None:
        raise ValueError("name the broker or a path")
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, pattern, max_rows=max_rows)).load()
    return broker_records(raw).select(*MESSAGE_SCHEMA.names)


def broker_records(raw: DataFrame) -> DataFrame:
    """Records as the broker source gives them, with texts for bytes: ``RECORD_SCHEMA``."""
    return raw.select(
        "topic",
        F.col("partition").cast("bigint").alias("part"),
        F.col("offset").cast("bigint").alias("off"),
        F.col("key").cast("string").alias("msg_key"),
        F.col("value").cast("string").alias("value"),
        F.transform("headers", lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value"))).alias("headers"),
        F.col("timestamp").alias("ts"),
    )


def read_records(
    spark: SparkSession,
    pattern: str,
    servers: str | None = None,
    path: str | None = None,
    stream: bool = False,
    max_rows: int | None = None,
) -> DataFrame:
    """Records of the topics that match, with headers and time (``RECORD_SCHEMA``), as a batch or a stream.

    The batch form reads what the topics hold now; dead letters are read so for analysis, and as a stream for
    alerts. ``path`` reads JSON lines of the same shape instead of a broker.
    """
    reader = spark.readStream if stream else spark.read
    if path is not None:
        return reader.schema(RECORD_SCHEMA).json(path).where(F.col("topic").rlike(f"^(?:{pattern})$"))
    if servers is None:
        raise ValueError("name the broker or a path")
    options = kafka_options(servers, pattern, max_rows=max_rows if stream else None)
    return broker_records(reader.format("kafka").options(**options).load())


def select_tables(
    catalog: DataFrame, include: Sequence[str], exclude: Sequence[str] = (), db: str = "db", table: str = "table_name"
) -> DataFrame:
    """Catalog rows whose ``db.table`` matches an include pattern and no exclude pattern.

    Patterns are regular expressions over the full name; ``shop.*`` takes a whole database.
    """
    full = F.concat_ws(".", F.col(db), F.col(table))
    keep = full.rlike("^(?:" + "|".join(include) + ")$")
    if exclude:
        keep = keep & ~full.rlike("^(?:" + "|".join(exclude) + ")$")
    return catalog.where(keep)


def bootstrap(snapshot: DataFrame, changes: DataFrame | None, mode: str = "initial") -> DataFrame:
    """One log from a snapshot (operation ``r``, version 0) and the changes after it.

    ``initial`` takes both, ``initial_only`` the snapshot, ``never`` the changes.
    """
    base = snapshot.withColumns({"op": F.lit("r"), VERSION: F.lit(0).cast("bigint")})
    if mode == "initial_only":
        return base
    if changes is None:
        raise ValueError(f"mode {mode} needs the changes")
    if mode == "never":
        return changes
    if mode == "initial":
        return base.unionByName(changes, allowMissingColumns=True)
    raise ValueError(f"unknown snapshot mode: {mode}")


def read_incremental(df: DataFrame, cursor: str, last) -> tuple[DataFrame, DataFrame]:
    """Rows with ``cursor > last`` and a one-row frame with the new high-water mark.

    The filter reaches the scan. Without new rows the mark stays ``last``. Rows come in no
    order: a sink that merges by version needs none, and a sort would move all rows.
    """
    since = F.lit(last)
    rows = df.where(F.col(cursor) > since) if last is not None else df
    mark = rows.agg(F.coalesce(F.max(cursor), since.cast(df.schema[cursor].dataType)).alias("high_water"))
    return rows, mark


def append_above_max(source: DataFrame, target: DataFrame, cursor: str) -> DataFrame:
    """Source rows above the target's greatest cursor; all of them when the target is empty."""
    top = target.agg(F.max(cursor)).scalar()
    return source.where(top.isNull() | (F.col(cursor) > top))
