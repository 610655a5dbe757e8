"""Reports cut nothing unless a limit is given."""

from tidelog.operators import metrics as mt
from tidelog.operators import quality as ql


def test_no_limit_by_default(spark):
    names = spark.range(40).selectExpr("concat('t', id) AS table_name", "id AS source_bytes", "id AS target_bytes", "id AS source_rows", "'close' AS category")
    assert ql.size_report(names.select("table_name", "source_bytes", "target_bytes")).count() == 40
    assert ql.size_report(names, top=3).count() == 3
    assert ql.category_topn(names, size="source_rows").count() == 40
    assert ql.category_topn(names, n=3, size="source_rows").count() == 3
    log = spark.range(40).selectExpr("TIMESTAMP '2024-01-15 11:59:00' AS ts", "id")
    assert mt.recent_activity(log, "ts", "2024-01-15 12:00:00").count() == 40
    assert mt.recent_activity(log, "ts", "2024-01-15 12:00:00", top=3).count() == 3
