"""Tables that few tasks read are dealt to tasks whose share stays bounded as the tables grow."""

import pytest
from pyspark.sql import functions as F

from tidelog import fixtures, registry


@pytest.fixture
def parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "PARTS_PER_TASK", 100)
    rows = spark.range(1234).select(F.col("id").alias("p_partkey"), F.lit("STEEL").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def rows_by_task(df):
    return df.groupBy(F.spark_partition_id().alias("task")).count().collect()


def dealt(spark, parts, monkeypatch, name):
    """Result, how often its plan deals the parts, and the result when one task reads them all."""
    found = registry.QUERIES[name](spark, parts)
    times = found._jdf.queryExecution().optimizedPlan().toString().count("Repartition 13, true")
    monkeypatch.setattr(fixtures, "PARTS_PER_TASK", 10**9)
    return sorted(found.collect()), times, sorted(registry.QUERIES[name](spark, parts).collect())


def test_the_parts_of_one_file_become_columns_in_many_tasks(spark, parts):
    counts = [r["count"] for r in rows_by_task(fixtures.load(spark, parts, "ddl_columns"))]
    assert len(counts) == 13 and max(counts) <= 2 * min(counts)


def test_parse_type_deals_the_parts(spark, parts, monkeypatch):
    found, times, plain = dealt(spark, parts, monkeypatch, "d02_parse_type")
    assert times == 1 and found == plain and len(found) > 1234 * 16


def test_refine_types_deals_the_parts(spark, parts, monkeypatch):
    found, times, plain = dealt(spark, parts, monkeypatch, "d05_refine_types_reference")
    assert times == 1 and found == plain and len(found) > 1234 * 16


def test_target_schema_deals_the_parts_for_columns_and_for_partitions(spark, parts, monkeypatch):
    found, times, plain = dealt(spark, parts, monkeypatch, "d10_target_schema")
    assert times == 2 and found == plain and len(found) == 1234


def test_describe_tables_deals_the_parts_for_both_schemas_and_the_counts(spark, parts, monkeypatch):
    found, times, plain = dealt(spark, parts, monkeypatch, "d16_describe_tables")
    assert times == 3 and found == plain and len(found) == 1234


def test_describe_tables_works_in_as_many_parts_as_asked_for(spark, parts):
    found = registry.QUERIES["d16_describe_tables"](spark, parts)
    assert len(rows_by_task(found)) == 13
