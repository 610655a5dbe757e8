import os

import pytest

from tidelog.operators import schema as sc

DDL = os.path.join(os.path.dirname(__file__), "data", "ddl")


@pytest.fixture(scope="module")
def catalog(spark):
    return sc.ddl_catalog(sc.read_ddl(spark, DDL)).cache()


def types(df, column="target_type"):
    return {(r.table_name, r.column_name): r[column] for r in df.collect()}


def test_every_file_is_read_and_the_broken_one_reported(spark):
    parsed = {r.file_name: r.table_name for r in sc.parse_ddl(sc.read_ddl(spark, DDL)).collect()}
    assert len(parsed) == 12 and parsed["shop_broken.sql"] is None
    assert all(n == f[:-4] for f, n in parsed.items() if n)


def test_columns_and_keys(catalog):
    rows = {}
    for r in catalog.orderBy("table_name", "ordinal").collect():
        rows.setdefault(r.table_name, []).append((r.column_name, r.key_position))
    assert rows["shop_parcel"] == [
        ("parcel_no", 1), ("shelf", 0), ("weight_grams", 0), ("is_fragile", 0), ("route_note", 0), ("pickup_date", 0), ("scanned", 0),
    ]
    assert rows["shop_daily"] == [("day", 1), ("game_id", 2), ("plays", 0), ("stake", 0)]
    assert [c for c, _ in rows["shop_json"]] == ["id", "payload", "blob_data"]
    assert [c for c, _ in rows["shop_ticks"]] == ["id", "best_score", "city"]
    assert [c for c, _ in rows["shop_enum"]] == ["id", "kind", "flags", "made", "opens"]
    keys = {r.table_name: r.sort_key for r in sc.primary_keys(catalog).collect()}
    assert keys["shop_daily"] == "(day, game_id)" and keys["shop_log"] == "tuple()"


def test_base_types(catalog):
    t = types(sc.map_type(catalog), "mapped_type")
    assert t["shop_order", "id"] == "UInt64" and t["shop_parcel", "parcel_no"] == "Int32"
    assert t["shop_order", "total_amount"] == "Decimal(20,8)" and t["shop_daily", "stake"] == "Decimal64(2)"
    assert t["shop_enum", "made"] == "UInt16" and t["shop_enum", "opens"] == "String"
    s = types(sc.map_type(catalog), "spark_type")
    assert s["shop_order", "id"] == "decimal(20,0)" and s["shop_json", "blob_data"] == "binary"


def test_names_refine_only_what_fits_unless_asked_otherwise(catalog):
    safe, ref = types(sc.refine_types(catalog)), types(sc.refine_types(catalog, "reference"))
    for column in (("shop_history", "object_id"), ("shop_history", "phone_number"), ("shop_daily", "game_id")):
        assert safe[column] == "String" and ref[column] == "Int32"
    assert safe["shop_history", "discount"] == "Float64" and ref["shop_history", "discount"] == "Int32"
    assert safe["shop_country", "country"] == "LowCardinality(FixedString(2))" and ref["shop_country", "country"] == "Int32"
    for t in (safe, ref):
        assert t["shop_parcel", "is_fragile"] == "Bool"
        assert t["shop_order", "created_at"] == "DateTime64(3, 'UTC')" and t["shop_log", "seen"] == "DateTime('UTC')"
        assert t["shop_order", "fee_amount"] == "Decimal64(2)" and t["shop_order", "status"] == "LowCardinality(String)"
        assert t["shop_token", "ref_guid"] == "UUID" and t["shop_token", "secret"] == "String"
        assert t["shop_ticks", "city"] == "LowCardinality(String)" and t["shop_ticks", "best_score"] == "Int32"


def test_nulls_and_defaults(catalog):
    full = types(sc.null_policy(sc.refine_types(catalog)), "full_type")
    assert full["shop_order", "fee_amount"] == "Nullable(Decimal64(2))"
    assert full["shop_parcel", "scanned"] == "DateTime64(6, 'UTC') DEFAULT toDateTime(0)"
    assert full["shop_parcel", "shelf"] == "String" and full["shop_log", "message"] == "String DEFAULT ''"
    clause = types(sc.column_defaults(catalog), "default_clause")
    assert clause["shop_quotes", "note"] == "DEFAULT 'it'" and clause["shop_quotes", "empty"] == "DEFAULT ''"
    assert clause["shop_quotes", "rate"] == "DEFAULT 1.5" and clause["shop_log", "seen"] == "DEFAULT now()"
    assert clause["shop_parcel", "scanned"] == "DEFAULT NULL" and clause["shop_parcel", "shelf"] == ""


def test_partition_columns(catalog):
    chosen = {r.table_name: r.partition_column for r in sc.partition_column(catalog).collect()}
    assert chosen == {"shop_parcel": "pickup_date", "shop_order": "created_at", "shop_log": "seen", "shop_history": "history_date"}


def test_generated_tables_can_be_created_and_described(spark, catalog):
    ddl = {r.table_name: r.ddl for r in sc.target_schema(catalog).collect()}
    assert len(ddl) == 11
    for name, text in ddl.items():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(text)
        assert {"_version", "_is_deleted", "_extracted_at"} <= set(spark.table(name).columns)
        spark.sql(f"DROP TABLE {name}")
    schema = sc.struct_type(catalog, "shop_order")
    assert schema["id"].dataType.simpleString() == "decimal(20,0)" and not schema["id"].nullable


def test_rebuild_sets_aside_what_does_not_fit(spark):
    df = spark.createDataFrame([("1", "2.5"), ("x", "1"), (None, "3")], "a string, b string")
    ok, failed = sc.rebuild(df, {"a": "int", "b": "decimal(5,2)"})
    assert sorted((r.a, float(r.b)) for r in ok.collect() if r.a) == [(1, 2.5)] and ok.count() == 2
    assert [r._problems for r in failed.collect()] == [["a"]]
