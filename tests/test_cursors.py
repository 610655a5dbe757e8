"""Stored cursors of many tables, and streams fed by a catalog."""

import pytest

from tidelog.operators import schema as sc
from tidelog.session import work_dir
from tidelog.sources.cursors import Cursors, sync_tables


def table(spark, rows):
    return spark.createDataFrame(rows, "id int, seen timestamp_ntz")


def at(day):
    import datetime

    return datetime.datetime(2024, 1, day, 12, 0, 0, 123456)


def ids(spark, root, name="t"):
    return sorted(r.id for r in spark.read.parquet(f"{root}/{name}").collect())


def test_each_round_takes_what_is_new(spark):
    root, store = work_dir(spark, "test-sync"), Cursors(spark, work_dir(spark, "test-cursors"))
    first = [(1, at(1)), (2, at(2)), (9, None)]
    assert sync_tables({"t": (table(spark, first), "seen"), "u": (table(spark, [(5, at(3))]), "id")}, root, store) == {"t": 1, "u": 1}
    assert ids(spark, root) == [1, 2, 9] and store.get("t")["mark"].startswith("2024-01-02 12:00:00.123456") and store.get("u")["mark"] == "5"
    assert sync_tables({"t": (table(spark, first), "seen")}, root, store) == {"t": 1}
    more = [*first, (3, at(3)), (4, at(2)), (10, None)]  # 4 and 10 cannot be told from rows seen before
    assert sync_tables({"t": (table(spark, more), "seen")}, root, store) == {"t": 2}
    assert ids(spark, root) == [1, 2, 3, 9]
    assert sync_tables({}, root, store) == {}


def test_an_interrupted_round_is_replaced(spark, monkeypatch):
    root, store = work_dir(spark, "test-sync"), Cursors(spark, work_dir(spark, "test-cursors"))
    advance = store.advance
    monkeypatch.setattr(store, "advance", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sync_tables({"t": (table(spark, [(1, at(1))]), "seen")}, root, store)
    monkeypatch.setattr(store, "advance", advance)
    assert sync_tables({"t": (table(spark, [(1, at(1)), (2, at(2))]), "seen")}, root, store) == {"t": 1}
    assert ids(spark, root) == [1, 2]
    with pytest.raises(RuntimeError):
        store.advance("t", {"round": 0, "mark": None, "type": None}, "x", "string")


def test_tables_without_rows_or_cursor_values(spark):
    root, store = work_dir(spark, "test-sync"), Cursors(spark, work_dir(spark, "test-cursors"))
    assert sync_tables({"t": (table(spark, []), "seen"), "u": (table(spark, [(7, None)]), "seen")}, root, store) == {"t": 0, "u": 0}
    assert ids(spark, root, "u") == [7]
    sync_tables({"u": (table(spark, [(7, None), (8, at(1))]), "seen")}, root, store)
    assert ids(spark, root, "u") == [7, 8]


def test_types_and_keys_of_a_catalog(spark):
    rows = [("a", 2, "name", "varchar(9) DEFAULT NULL", 0), ("a", 1, "id", "bigint unsigned NOT NULL", 1), ("b", 1, "x", "int NOT NULL", 2), ("b", 2, "y", "date NOT NULL", 1)]
    types, keys = sc.stream_tables(spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, column_def string, key_position int"))
    assert types == {"a": {"id": "decimal(20,0)", "name": "string"}, "b": {"x": "int", "y": "date"}} and keys == {"a": ["id"], "b": ["y", "x"]}
