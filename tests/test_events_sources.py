import decimal

import pytest
from pyspark.sql import functions as F

from tidelog.fixtures import load
from tidelog.model import ORDER_TYPES
from tidelog.operators import events as ev
from tidelog.operators import metrics as mt
from tidelog.operators import quality as ql
from tidelog.sources import read, write

TYPES = {"id": "unsigned bigint", "price": "decimal(38,12)", "at": "epoch_millis", "day": "epoch_days", "flag": "boolean"}


def parse(spark, *values, types=TYPES):
    df = spark.createDataFrame([("t", 0, i, "k", v) for i, v in enumerate(values)],
                               "topic string, part long, off long, msg_key string, value string")
    return ev.normalise_values(ev.unwrap(ev.parse_envelope(ev.handle_tombstones(df), types)), types)


def message(row, op="c"):
    return '{"before":null,"after":%s,"source":{"file":"binlog.1000000","pos":5,"server_id":1},"op":"%s","ts_ms":1}' % (row, op)


def test_numbers_keep_every_digit(spark):
    r = parse(spark, message('{"id":18446744073709551615,"price":12345678901234567890.123456789012,"at":1700000000123,"day":19000,"flag":true}')).first()
    assert r.id == decimal.Decimal("18446744073709551615")
    assert r.price == decimal.Decimal("12345678901234567890.123456789012")
    assert r["at"].microsecond == 123000 and str(r.day) == "2022-01-08" and r.flag is True
    assert r._problems == []


def test_a_bad_value_names_its_column_and_spares_the_others(spark):
    r = parse(spark, message('{"id":-1,"price":"1.50","at":"soon","day":19000,"flag":1}')).first()
    assert sorted(r._problems) == ["at", "id"]
    assert r.price == decimal.Decimal("1.5") and str(r.day) == "2022-01-08" and r._corrupt_record is None


def test_broken_json_unknown_operations_and_tombstones(spark):
    df = parse(spark, '{"before":null,"aft', None, message('{"id":1}', op="t"), message('{"id":2}'))
    ok, dlq = ev.split_valid(df, ["id"])
    assert [int(r.id) for r in ok.collect()] == [2]
    failed = dlq.collect()
    assert len(failed) == 2 and any(r.value.endswith("aft") for r in failed)
    assert ["op"] in [r.problematic_fields[:1] for r in failed]


def test_missing_required_value_is_a_failure(spark):
    ok, dlq = ev.split_valid(parse(spark, message('{"price":1}')), ["id"])
    assert ok.count() == 0 and dlq.first().problematic_fields == ["id"]


def test_version_orders_files_by_number(spark):
    values = [message('{"id":1,"price":1}').replace("1000000", n) for n in ("999999", "1000000", "2")]
    df = parse(spark, *values)
    best = df.agg(F.max_by("off", ev.version_expr("position"))).first()[0]
    assert best == 1
    with pytest.raises(ValueError):
        ev.version_parts("clock")


def test_option_builders():
    o = read.jdbc_options("jdbc:x", "t", "id", 1, 100, 8)
    assert o["partitionColumn"] == "id" and o["numPartitions"] == "8" and o["fetchsize"] == "10240"
    assert "partitionColumn" not in read.jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        read.jdbc_options("jdbc:x", "t", "id")
    k = read.kafka_options("h:1", r"mysql\.shop\..*", max_rows=10000)
    assert k["subscribePattern"] == r"mysql\.shop\..*" and k["maxOffsetsPerTrigger"] == "10000"


def test_incremental_read_without_new_rows_keeps_the_mark(spark):
    df = spark.createDataFrame([(1,), (5,)], "c long")
    rows, mark = read.read_incremental(df, "c", 9)
    assert rows.count() == 0 and mark.first()[0] == 9
    rows, mark = read.read_incremental(df, "c", 1)
    assert rows.count() == 1 and mark.first()[0] == 5
    assert read.append_above_max(df, df.where("c > 100"), "c").count() == 2


def test_upsert_moves_keys_between_partitions_and_empties_them(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k long, v string, ym int, _version long, _is_deleted int, arrival long"
    start = [(1, "a", 1, 0, 0, 1), (2, "b", 1, 0, 0, 2), (3, "c", 2, 0, 0, 3), (4, "d", None, 0, 0, 4)]
    write.write_table(spark.createDataFrame(start, schema), path, ["ym"])
    changes = [(1, "a2", 3, 1, 0, 5), (2, "b", 1, 1, 1, 6), (5, "e", 2, 1, 0, 7), (4, "d", None, 1, 1, 8), (9, "x", 9, 1, 1, 9)]
    for _ in range(2):  # a repeated delivery changes nothing
        write.upsert(path, spark.createDataFrame(changes, schema), ["k"], ["_version", "arrival"], "ym")
        got = sorted((r.k, r.v, r.ym) for r in spark.read.parquet(path).collect())
        assert got == [(1, "a2", 3), (3, "c", 2), (5, "e", 2)]


def test_csv_round_trip_of_awkward_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", twice'), (2, "two\nlines"), (3, ""), (4, None)], "id long, t string")
    write.export_csv(df, str(tmp_path / "c"))
    back = write.import_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted((r.id, r.t) for r in back.collect()) == [(1, 'say "hi", twice'), (2, "two\nlines"), (3, ""), (4, None)]


def test_file_listing_and_sizes(spark, sf_dir, tmp_path):
    path = str(tmp_path / "t")
    write.write_partitioned(load(spark, sf_dir, "events"), path, "ts", "day")
    listing = mt.file_listing(spark, path, "events").where("partition <> ''")
    assert listing.select("partition").distinct().count() == spark.read.parquet(path).select("p_day").distinct().count()
    assert mt.file_counts(listing).first().level == "ok"
    assert ql.file_sizes(spark, path).agg(F.sum("n_bytes")).first()[0] > 0


def test_checksum_handles_nulls_positions_and_types(spark):
    a = spark.createDataFrame([(1, "a", None), (2, "a", "b"), (3, "x", "y")], "k long, p string, q string")
    b = spark.createDataFrame([(1, None, "a"), (2, "a", "b"), (3, "x", "y"), (3, "x", "y")], "k long, p string, q string")
    got = sorted((r.k, r.difference) for r in ql.checksum_diff(a, b, ["k"], ["k", "p", "q"]).collect())
    assert got == [(1, "changed"), (3, "changed")]
    narrow = b.withColumn("k", F.col("k").cast("int"))
    got = sorted((r.k, r.difference) for r in ql.checksum_diff(a, narrow, ["k"], ["k", "p", "q"]).collect())
    assert got == [(1, "changed"), (3, "changed")]
    assert ql.fingerprint(a, ["p", "q"]).first().hash_sum != ql.fingerprint(
        spark.createDataFrame([(None, "a"), ("a", "b"), ("x", "y")], "p string, q string"), ["p", "q"]).first().hash_sum


def test_every_category_occurs(spark):
    from tidelog.plans.queries_quality import counts

    frame = counts(spark, "/root/testdata/sf0.01")
    seen = lambda df: {r[0] for r in df.select("category").distinct().collect()}
    assert seen(ql.sync_category7(frame)) == {"missing", "empty_both", "empty_target", "perfect", "overfull", "close", "partial"}
    assert seen(ql.sync_category6(frame)) == {"missing", "empty_source", "empty_target", "overfull", "partial", "success"}
    assert seen(ql.sync_category4(frame)) == {"missing", "empty", "partial", "success"}


def test_empty_source_with_rows_in_target_is_overfull_without_percentage(spark):
    df = spark.createDataFrame([("t", 0, 5)], "table_name string, source_rows long, target_rows long")
    for fn in (ql.sync_category6, ql.sync_category7):
        r = fn(df).first()
        assert r.category == "overfull" and r.synced_percent is None


def test_order_types_are_what_the_fixture_writes(spark, sf_dir):
    assert set(ORDER_TYPES) <= set(load(spark, sf_dir, "order_log").columns)
