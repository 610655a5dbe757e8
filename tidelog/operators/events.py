"""Change-event transforms: envelope to row image, values, versions, valid and failed rows."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import (
    DELETED,
    EXTRACTED,
    HEADER_PREFIX,
    OPS,
    SOURCE_SCHEMA,
    VERSION,
)


_parse_count = itertools.count(1)

# How a declared type is read from JSON before ``normalise_values`` finishes it.
_READ_AS = {
    "unsigned bigint": "decimal(20,0)",
    "unsigned int": "bigint",
    "epoch_millis": "bigint",
    "epoch_micros": "bigint",
    "epoch_days": "bigint",
}


def _envelope(row: Mapping[str, str]) -> str:
    fields = ", ".join(f"`{c}`: {t}" for c, t in row.items())
    return (
        f"before struct<{fields}>, after struct<{fields}>, source {SOURCE_SCHEMA.simpleString()}, "
        "op string, ts_ms bigint, _corrupt_record string"
    )


def parse_envelope(messages: DataFrame, types: Mapping[str, str], value: str = "value") -> DataFrame:
    """Add ``before, after, source, op, ts_ms, _problems`` and ``_corrupt_record``.

    Messages are read by ``from_json`` with the declared types, so decimals and unsigned
    numbers never pass through a double. Only messages it rejects are read again as text:
    ``_problems`` then names the columns whose text does not fit, and the other columns keep
    their values. A message that is no JSON at all is NULL in every field with its text in
    ``_corrupt_record``; a tombstone is NULL everywhere.

    The observed counts (``envelopes-<n>``) show up in query listeners and streaming progress.
    They also hold later filters above the parse: pushed below it, a filter on ``op`` would
    parse every message a second time.
    """
    read = {c: _READ_AS.get(t, t) for c, t in types.items()}
    fast, text = F.col("_fast"), F.col("_text")
    rejected = fast["_corrupt_record"].isNotNull()
    readable = rejected & text["_corrupt_record"].isNull()

    def image(side: str) -> Column:
        fields = [F.coalesce(fast[side][c], typed(text[side][c], t)).alias(c) for c, t in read.items()]
        second = F.when(readable & text[side].isNotNull(), F.struct(*fields))
        return F.when(rejected, second).otherwise(fast[side]).alias(side)

    def misfits(side: str) -> Column:
        return F.array(
            *[F.when(text[side][c].isNotNull() & typed(text[side][c], t).isNull(), F.lit(c)) for c, t in read.items()]
        )

    problems = F.array_compact(F.when(text["op"] == "d", misfits("before")).otherwise(misfits("after")))
    plain = [
        F.when(rejected, F.when(readable, text[c])).otherwise(fast[c]).alias(c) for c in ("source", "op", "ts_ms")
    ]
    mode = {"mode": "PERMISSIVE"}
    return (
        messages.withColumn("_fast", F.from_json(value, _envelope(read), mode))
        .withColumn("_text", F.when(rejected, F.from_json(value, _envelope(dict.fromkeys(read, "string")), mode)))
        .select(
            *messages.columns,
            image("before"),
            image("after"),
            *plain,
            F.when(readable, problems).otherwise(F.array().cast("array<string>")).alias("_problems"),
            F.when(rejected & ~readable, F.col(value)).alias("_corrupt_record"),
        )
        .observe(
            f"envelopes-{next(_parse_count)}",
            F.count(F.lit(1)).alias("messages"),
            F.count("_corrupt_record").alias("broken"),
        )
    )


def unwrap(parsed: DataFrame) -> DataFrame:
    """Row image per event: ``before`` for deletes, ``after`` otherwise.

    Broken messages and events with a missing or unknown operation stay, with a NULL image, so
    that ``split_valid`` can send them to the dead letters; ``_problems`` names ``op`` for the latter.
    """
    columns = parsed.schema["after"].dataType.names
    known = F.coalesce(F.col("op").isin(*OPS), F.lit(False))
    image = F.when(F.col("op") == "d", F.col("before")).when(known, F.col("after"))
    unknown = F.when(~known & F.col("_corrupt_record").isNull(), F.array(F.lit("op"))).otherwise(F.array().cast("array<string>"))
    rest = [c for c in parsed.columns if c not in ("before", "after", "_problems")]
    found = F.concat("_problems", unknown) if "_problems" in parsed.columns else unknown
    return parsed.select(*rest, *[image.getField(c).alias(c) for c in columns], found.alias("_problems"))


def rewrite_deletes(rows: DataFrame, add_fields: Sequence[str] = ("op", "source.ts_ms")) -> DataFrame:
    """Keep deletes as rows marked ``__deleted`` and carry metadata as ``__<field>`` columns."""
    extra = {f"__{f.replace('.', '_')}": F.col(f) for f in add_fields}
    return rows.withColumns({**extra, "__deleted": (F.col("op") == "d").cast("string")})


def handle_tombstones(messages: DataFrame, drop: bool = True, value: str = "value") -> DataFrame:
    """Drop messages without a value, or keep them when ``drop`` is false."""
    return messages.where(F.col(value).isNotNull()) if drop else messages


def typed(col: Column, type_name: str) -> Column:
    """``col`` as ``type_name``, NULL when it does not fit.

    Besides SQL types: ``unsigned bigint`` (decimal(20,0), no wrap-around), ``unsigned int``,
    ``epoch_millis`` and ``epoch_micros`` (integers since 1970 as timestamps) and
    ``epoch_days`` (integers as dates).
    """
    number = col.try_cast("bigint")
    if type_name == "unsigned bigint":
        value = col.try_cast("decimal(20,0)")
        return F.when((value >= 0) & (value <= F.lit("18446744073709551615").cast("decimal(20,0)")), value)
    if type_name == "unsigned int":
        return F.when((number >= 0) & (number <= 4294967295), number)
    if type_name == "epoch_millis":
        return F.timestamp_millis(number)
    if type_name == "epoch_micros":
        return F.timestamp_micros(number)
    if type_name == "epoch_days":
        return F.date_from_unix_date(number.try_cast("int"))
    return col.try_cast(type_name)


def normalise_values(rows: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Typed columns from text or raw values: decimals exactly, unsigned without sign flip, time precision kept.

    ``_problems`` names the columns whose value does not fit the type.
    """
    present = {c: t for c, t in types.items() if c in rows.columns}
    values = {c: typed(F.col(c), t) for c, t in present.items()}
    problems = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull() & v.isNull(), F.lit(c)) for c, v in values.items()])
    )
    known = F.col("_problems") if "_problems" in rows.columns else F.array().cast("array<string>")
    return rows.withColumns({**values, "_problems": F.array_distinct(F.concat(known, problems))})


def version_parts(kind: str = "position") -> list[Column]:
    """Columns that order changes of a key, most significant first; arrival last.

    ``position``: log file number and offset (the number, since file names sort wrongly once a
    digit is added). ``timestamp``: source clock. ``composite``: source id before position,
    for rows that come from several writers.
    """
    file_no = F.regexp_extract(F.col("source.file"), r"(\d+)$", 1).try_cast("bigint")
    position = [file_no, F.col("source.pos")]
    arrival = [F.col("part"), F.col("off")]
    if kind == "position":
        return [*position, *arrival]
    if kind == "timestamp":
        return [F.col("source.ts_ms"), *arrival]
    if kind == "composite":
        return [F.col("source.server_id"), *position, *arrival]
    raise ValueError(f"unknown version kind: {kind}")


def version_expr(kind: str = "position") -> Column:
    """One orderable value built from ``version_parts``."""
    names = ("v1", "v2", "v3", "v4", "v5")
    return F.struct(*[p.alias(n) for p, n in zip(version_parts(kind), names)])


def version_number(kind: str = "position") -> Column:
    """The version as one bigint: file number times 2^32 plus offset, or the source clock.

    Snapshot rows get 0, below every logged change.
    """
    if kind == "timestamp":
        number = F.col("source.ts_ms")
    else:
        file_no, pos = version_parts("position")[:2]
        number = F.shiftleft(file_no, 32) + pos
    return F.when(F.col("op") == "r", F.lit(0).cast("bigint")).otherwise(number)


def with_cdc_columns(rows: DataFrame, version: Column, extracted_at: Column) -> DataFrame:
    """Add ``_version, _is_deleted, _extracted_at``; the batch time is an argument, not a clock."""
    return rows.withColumns(
        {
            VERSION: version,
            DELETED: F.when(F.col("op") == "d", F.lit(1)).otherwise(F.lit(0)),
            EXTRACTED: extracted_at,
        }
    )


def unroutable(messages: DataFrame) -> DataFrame:
    """Messages of a table that nothing takes, as dead letters."""
    text = F.concat(F.lit("No table for topic "), F.coalesce("topic", F.lit("NULL")))
    return messages.withColumns(_context_headers("ROUTING", F.lit("UnknownTableException"), text)).select(
        "topic", "part", "off", "msg_key", "value", "headers",
        F.array().cast("array<string>").alias("problematic_fields"), F.lit(0).alias("attempt"),
    )


def _failure_columns(stage: str = "VALUE_CONVERTER") -> dict[str, Column]:
    fields = F.concat_ws(", ", F.transform("_problems", lambda c: F.concat(F.lit("field '"), c, F.lit("'"))))
    message = F.when(F.col("_corrupt_record").isNotNull(), F.lit("Cannot convert message: invalid JSON")).otherwise(
        F.concat(F.lit("Cannot convert value of "), fields)
    )
    kind = F.when(F.col("_corrupt_record").isNotNull(), F.lit("JsonParseException")).otherwise(F.lit("DataException"))
    return _context_headers(stage, kind, message)


def _context_headers(stage: str, kind: Column, message: Column) -> dict[str, Column]:
    pairs = [
        ("topic", F.col("topic")),
        ("partition", F.col("part").cast("string")),
        ("offset", F.col("off").cast("string")),
        ("stage", F.lit(stage)),
        ("exception.class.name", kind),
        ("exception.message", message),
    ]
    headers = F.array(
        *[F.struct(F.lit(HEADER_PREFIX + name).alias("key"), value.alias("value")) for name, value in pairs]
    )
    return {"headers": headers}


def split_valid(rows: DataFrame, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Separate typed rows from failures, row by row: one bad row never fails its batch.

    Failures are the broken messages, events without a known operation, rows with a value that does
    not fit and rows without a ``required`` value. A version is required where there is a column for
    it: a NULL would lose against every other. They keep the original message and get context headers.
    """
    required = [*required, *([VERSION] if VERSION in rows.columns and VERSION not in required else [])]
    missing = F.array_compact(
        F.array(*[F.when(F.col(c).isNull() & F.col("_corrupt_record").isNull(), F.lit(c)) for c in required])
    ) if required else F.array().cast("array<string>")
    checked = rows.withColumn("_problems", F.array_distinct(F.concat("_problems", missing)))
    failed = F.col("_corrupt_record").isNotNull() | (F.size("_problems") > 0)
    ok = checked.where(~failed).drop("_problems", "_corrupt_record")
    dlq = (
        checked.where(failed)
        .withColumns(_failure_columns())
        .withColumn("attempt", F.coalesce(F.col("attempt"), F.lit(0)) if "attempt" in rows.columns else F.lit(0))
        .select("topic", "part", "off", "msg_key", "value", "headers", "_problems", "attempt")
        .withColumnRenamed("_problems", "problematic_fields")
    )
    return ok, dlq


def align(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Exactly the columns of ``schema``: unknown ones are ignored, missing ones are NULL."""
    have = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(have[c.lower()]) if c.lower() in have else F.lit(None)).cast(t).alias(c)
            for c, t in schema.items()
        ]
    )


def route_topic(df: DataFrame, pattern: str = r"^[^.]+\.[^.]+\.(.*)$", replacement: str = "$1",
                topic: str = "topic", out: str = "table_name") -> DataFrame:
    """Target table from topic by regex; a topic that does not match keeps its name."""
    return df.withColumn(out, F.regexp_replace(topic, pattern, replacement))
