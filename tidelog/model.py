"""Shared names: change envelope fields, metadata columns, typed row descriptions."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION, DELETED, EXTRACTED = "_version", "_is_deleted", "_extracted_at"
CDC_COLUMNS = (VERSION, DELETED, EXTRACTED)
OPS = ("c", "r", "u", "d")

# Header names a connect worker writes on a dead letter.
HEADER_PREFIX = "__connect.errors."
HEADER_FIELDS = {
    "original_topic": "topic",
    "partition": "partition",
    "offset": "offset",
    "connector_name": "connector.name",
    "task_id": "task.id",
    "stage": "stage",
    "exception_class": "exception.class.name",
    "exception_message": "exception.message",
    "stacktrace": "exception.stacktrace",
}

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("off", T.LongType()),
        T.StructField("msg_key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

HEADER_LIST = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))

# A message as the topic holds it: with its headers and the time it was written.
RECORD_SCHEMA = T.StructType(
    [*MESSAGE_SCHEMA.fields, T.StructField("headers", HEADER_LIST), T.StructField("ts", T.TimestampType())]
)

SOURCE_SCHEMA = T.StructType(
    [
        T.StructField("db", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("snapshot", T.StringType()),
        T.StructField("server_id", T.LongType()),
        T.StructField("gtid", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
    ]
)


# The row description of the order messages used by fixtures, tests and queries.
ORDER_TYPES = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_totalprice": "decimal(18,2)",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}
