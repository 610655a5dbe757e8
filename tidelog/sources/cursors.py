"""Incremental reads of many tables that go on where the last one stopped."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tidelog.sources.files import Folder
from tidelog.sources.write import append_versions


class Cursors:
    """The high-water mark of each table, in a folder of small numbered files that appear whole.

    A mark is kept as text together with its type. It moves only after the rows up to it are written.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def _names(self, table: str) -> list[str]:
        return [n for n in self.folder.names(table) if n.endswith(".json")]

    def get(self, table: str) -> dict:
        """``round`` (0: never read), ``mark`` and ``type`` of a table."""
        names = self._names(table)
        return json.loads(self.folder.read(f"{table}/{names[-1]}")) if names else {"round": 0, "mark": None, "type": None}

    def advance(self, table: str, before: dict, mark: str | None, kind: str) -> None:
        after = {"round": before["round"] + 1, "mark": mark if mark is not None else before["mark"], "type": kind}
        if not self.folder.put(f"{table}/{after['round']:012d}.json", json.dumps(after)):
            raise RuntimeError(f"another reader has advanced {table} beyond round {before['round']}")


def read_on(df: DataFrame, cursor: str, state: Mapping) -> tuple[DataFrame, str | None]:
    """Rows above a stored mark, and the mark of these rows as text (None without rows). The filter reaches the scan."""
    kind = df.schema[cursor].dataType.simpleString()
    rows = df if state["mark"] is None else df.where(F.col(cursor) > F.lit(state["mark"]).cast(state["type"] or kind))
    return rows, rows.agg(F.max(cursor).cast("string")).first()[0]


def sync_tables(tables: Mapping[str, tuple[DataFrame, str]], root: str, cursors: Cursors, writers: int = 16) -> dict[str, int]:
    """Append the new rows of every table (rows and cursor column by name) below ``root`` and move its mark; its round.

    The upper mark is fixed before rows are written and bounds them, so rows that arrive meanwhile wait for the next round. A
    round that is interrupted and run again replaces its own folder. Tables are read ``writers`` at a time. Rows without a
    cursor value come with the first round, as there is no telling when they arrived.
    """

    def sync(name: str) -> int:
        df, cursor = tables[name]
        before = cursors.get(name)
        rows, mark = read_on(df, cursor, before)
        kind = df.schema[cursor].dataType.simpleString()
        if before["mark"] is None or mark is not None:
            upto = F.col(cursor) <= F.lit(mark).cast(kind)
            append_versions(rows.where(F.coalesce(upto, F.lit(before["mark"] is None))), f"{root.rstrip('/')}/{name}", before["round"])
        if mark is not None:
            cursors.advance(name, before, mark, kind)
        return before["round"] + (mark is not None)

    spark = next(iter(tables.values()))[0].sparkSession if tables else None
    if spark is None:
        return {}
    run: Callable = inheritable_thread_target(spark)(sync)
    with ThreadPoolExecutor(writers) as pool:
        return dict(zip(tables, pool.map(run, tables)))
