"""Schemas that change while a stream runs: each change is typed by the catalog version valid at its log position."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators import events as ev


def versions(history: DataFrame) -> DataFrame:
    """table_name, since, until and columns (name to type) of each catalog version, without an end for the last.

    ``history`` lists the columns of every version: table_name, since (log position), column_name, column_type.
    Metadata: a row for each change of a schema.
    """
    declared = F.map_from_entries(F.collect_list(F.struct("column_name", "column_type"))).alias("columns")
    each = history.groupBy("table_name", "since").agg(declared)
    return each.withColumn("until", F.lead("since").over(Window.partitionBy("table_name").orderBy("since")))


def as_of(changes: DataFrame, catalog: DataFrame, position: str, table: str = "table_name") -> DataFrame:
    """Changes with ``since`` and ``columns`` of the version valid at their position; NULL before the first one.

    A join on the table with at most one match for each change. A change without a position has no version.
    """
    known = catalog.select(F.col("table_name").alias("_table"), "since", "until", "columns")
    inside = (F.col(position) >= F.col("since")) & (F.col("until").isNull() | (F.col(position) < F.col("until")))
    return changes.join(known, (F.col(table) == F.col("_table")) & inside, "left").drop("_table", "until")


def message_position(value: str = "value") -> Column:
    """Log position of a change message before it is parsed: file number and offset, as ``events.version_number``."""
    file_no = F.regexp_extract(F.get_json_object(value, "$.source.file"), r"(\d+)$", 1).try_cast("bigint")
    return F.shiftleft(file_no, 32) + F.get_json_object(value, "$.source.pos").try_cast("bigint")


def typed_as_of(messages: DataFrame, history: DataFrame, table: str, position: Column | None = None) -> DataFrame:
    """Rows of one table's messages, each read by the version valid at its position and brought to the last version's columns.

    A column that a version does not know is NULL there, whatever the message holds; a value is read as the type it had and
    then cast, and ``_problems`` names it if that fails. Messages before the first version, and broken ones, are read
    by the first. ``since`` says which version was used. Versions are metadata: the plan has one branch for each.
    """
    catalog = versions(history.where(F.col("table_name") == table))
    known = sorted(((r["since"], dict(r["columns"])) for r in catalog.collect()), key=lambda v: v[0])
    if not known:
        raise ValueError(f"no version of {table} is known")
    last = known[-1][1]
    # One table's versions are a few thresholds: a join on nothing but a range would be a nested loop.
    place, valid = position if position is not None else message_position(), F.lit(known[0][0])
    for since, _ in known[1:]:
        valid = F.when(place >= F.lit(since), F.lit(since)).otherwise(valid)
    tagged = messages.withColumn("since", valid)
    out = None
    for since, types in known:
        rows = ev.normalise_values(ev.unwrap(ev.parse_envelope(tagged.where(F.col("since") == since), types)), types)
        rows = _brought_to(rows, types, last)
        out = rows if out is None else out.unionByName(rows)
    return out


def _brought_to(rows: DataFrame, types: Mapping[str, str], last: Mapping[str, str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in types and c not in last and c != "_problems"]
    values, misfits = [], []
    for c, t in last.items():
        value = ev.typed(F.col(c), t) if c in types and types[c] != t else F.col(c) if c in types else ev.typed(F.lit(None).cast("string"), t)
        values.append(value.alias(c))
        if c in types and types[c] != t:
            misfits.append(F.when(F.col(c).isNotNull() & value.isNull(), F.lit(c)))
    found = F.array_distinct(F.concat("_problems", F.array_compact(F.array(*misfits)))) if misfits else F.col("_problems")
    return rows.select(*rest, *values, found.alias("_problems"))
