"""Registered queries: reconciliation over the two sides derived from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import BASE_TABLES, EVENTS_AS_OF, load
from tidelog.operators import quality as ql
from tidelog.registry import percent_sql, query

COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
KEYS = ["table_name", "l_orderkey", "l_linenumber"]


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.compare_counts(load(spark, sf_dir, "side_tables"), load(spark, sf_dir, "side_rows"))


def side(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, "side_rows").where(F.col("side") == name)


def _enc(col: str) -> str:
    return f"length(CAST({col} AS VARCHAR)) || ':' || CAST({col} AS VARCHAR)"


def _hash(cols: list[str]) -> str:
    text = " || ".join(_enc(c) for c in cols)
    return f"CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT)"


_TARGET_INVENTORY = "SELECT table_name FROM side_tables WHERE in_target = 1"


@query(
    "e01_table_count_diff",
    f"""SELECT (SELECT count(*) FROM side_tables) AS source_tables, (SELECT count(*) FROM ({_TARGET_INVENTORY}) t) AS target_tables,
        CASE WHEN (SELECT min(in_target) FROM side_tables) = 1 THEN 'match' ELSE 'mismatch' END AS status""",
)
def table_count_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = load(spark, sf_dir, "side_tables")
    return ql.table_count_diff(tables, tables.where("in_target = 1"))


@query(
    "e02_row_counts",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in BASE_TABLES),
)
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.row_counts({t: load(spark, sf_dir, t) for t in BASE_TABLES})


@query(
    "e03_count_status",
    """SELECT table_name, source_rows, target_rows, CASE WHEN target_rows IS NULL THEN 'MISSING'
         WHEN target_rows = source_rows THEN 'OK' ELSE 'MISMATCH' END AS status FROM side_counts""",
)
def count_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.count_status(counts(spark, sf_dir))


@query(
    "e04_count_tolerance",
    """SELECT *, CASE WHEN gone THEN 'missing' WHEN diff = 0 THEN 'matched' WHEN diff_percent < 1 THEN 'minor'
                ELSE 'major' END AS level FROM (
         SELECT table_name, source_rows, target_rows, target_rows IS NULL AND source_rows > 0 AS gone,
           source_rows - coalesce(target_rows, 0) AS diff,
           CASE WHEN source_rows = 0 THEN 0 ELSE abs(source_rows - coalesce(target_rows, 0)) * 100 // source_rows END
             AS diff_percent
         FROM side_counts) t""".replace("SELECT *, CASE WHEN gone", "SELECT * EXCLUDE (gone), CASE WHEN gone"),
)
def count_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.count_tolerance(counts(spark, sf_dir)).drop("diff_exact")


_PCT1 = percent_sql("target_rows", "source_rows", 1)


@query(
    "e05_sync_category4",
    f"""SELECT table_name, category, CASE WHEN category = 'partial' THEN {_PCT1} END AS synced_percent FROM (
        SELECT *, CASE WHEN target_rows IS NULL THEN 'missing' WHEN target_rows = 0 THEN 'empty'
                       WHEN source_rows > 0 AND target_rows < source_rows THEN 'partial' ELSE 'success' END AS category
        FROM side_counts) c""",
)
def sync_category4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.sync_category4(counts(spark, sf_dir)).select("table_name", "category", "synced_percent")


@query(
    "e05_success_rate",
    f"""SELECT tables, success_rate, CASE WHEN success_rate >= 90 THEN 'good' WHEN success_rate >= 70 THEN 'fair' ELSE 'poor' END AS rating
       FROM (SELECT count(*) AS tables,
               {percent_sql("count(CASE WHEN target_rows > 0 AND target_rows >= source_rows THEN 1 END)", "count(*)", 1)} AS success_rate
             FROM side_counts) r""",
)
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.success_rate(ql.sync_category4(counts(spark, sf_dir)))


_CAT6 = """CASE WHEN target_rows IS NULL THEN 'missing' WHEN source_rows + target_rows = 0 THEN 'empty_source'
    WHEN target_rows = 0 THEN 'empty_target' WHEN target_rows > source_rows THEN 'overfull'
    WHEN target_rows < source_rows THEN 'partial' ELSE 'success' END"""


@query(
    "e06_sync_category6",
    f"""SELECT table_name, {_CAT6} AS category,
          CASE WHEN {_CAT6} IN ('overfull', 'partial') AND source_rows > 0 THEN {_PCT1} END AS synced_percent FROM side_counts""",
)
def sync_category6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.sync_category6(counts(spark, sf_dir)).select("table_name", "category", "synced_percent")


_CAT7 = f"""CASE WHEN target_rows IS NULL THEN 'missing' WHEN source_rows = target_rows AND source_rows = 0 THEN 'empty_both'
    WHEN target_rows = 0 THEN 'empty_target' WHEN target_rows = source_rows THEN 'perfect'
    WHEN target_rows > source_rows THEN 'overfull'
    WHEN {_PCT1} >= 95 OR source_rows - target_rows <= 100 THEN 'close' ELSE 'partial' END"""


@query("e07_sync_category7", f"SELECT table_name, source_rows, target_rows, {_CAT7} AS category FROM side_counts")
def sync_category7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.sync_category7(counts(spark, sf_dir)).drop("synced_percent")


@query(
    "e08_category_topn",
    f"""SELECT category, table_name, source_rows, CAST(position AS INTEGER) AS position FROM (
          SELECT *, row_number() OVER (PARTITION BY category ORDER BY source_rows DESC, table_name) AS position
          FROM (SELECT *, {_CAT7} AS category FROM side_counts) c) r WHERE position <= 3""",
)
def category_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ql.category_topn(ql.sync_category7(counts(spark, sf_dir)), n=3)
    return top.select("category", "table_name", "source_rows", "position")


_TOTALS = f"""
    SELECT source_rows, target_rows, missing_rows, {percent_sql("target_rows", "source_rows", 2)} AS sync_percent,
           {percent_sql("missing_rows", "source_rows", 4)} AS missing_percent
    FROM (SELECT CAST(sum(source_rows) AS BIGINT) AS source_rows, CAST(sum(coalesce(target_rows, 0)) AS BIGINT) AS target_rows,
            CAST(sum(greatest(source_rows - coalesce(target_rows, 0), 0)) AS BIGINT) AS missing_rows
          FROM side_counts WHERE source_rows > 0) s"""


@query("e09_sync_totals", _TOTALS)
def sync_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.sync_totals(counts(spark, sf_dir))


_BREAKDOWN = f"""
    SELECT t.*, d.n AS dlq_rows, greatest(missing_rows - d.n, 0) AS in_transit,
           {percent_sql("d.n", "source_rows", 4)} AS dlq_percent,
           {percent_sql("greatest(missing_rows - d.n, 0)", "source_rows", 4)} AS transit_percent
    FROM ({_TOTALS}) t, (SELECT count(*) AS n FROM dead_letters) d"""


def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = load(spark, sf_dir, "dead_letters")
    return ql.missing_breakdown(ql.sync_totals(counts(spark, sf_dir)), failed)


@query("e10_missing_breakdown", _BREAKDOWN)
def missing_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown(spark, sf_dir)


@query(
    "e11_sync_grade",
    f"""SELECT sync_percent, dlq_percent,
          CASE WHEN sync_percent >= 99.5 THEN 'EXCELLENT' WHEN sync_percent >= 98 THEN 'GOOD'
               WHEN sync_percent >= 95 THEN 'ACCEPTABLE' ELSE 'NEEDS ATTENTION' END AS sync_grade,
          CASE WHEN dlq_percent < 0.5 THEN 'ACCEPTABLE' WHEN dlq_percent < 2 THEN 'INVESTIGATE' ELSE 'RECOVER' END AS dlq_grade
        FROM ({_BREAKDOWN}) b""",
)
def sync_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.sync_grade(breakdown(spark, sf_dir)).select("sync_percent", "dlq_percent", "sync_grade", "dlq_grade")


@query(
    "e12_accuracy_grade",
    """SELECT tables, accuracy_percent, CASE WHEN accuracy_percent >= 95 THEN 'PASSED' WHEN accuracy_percent >= 80 THEN 'WARNING'
         ELSE 'FAILED' END AS grade
       FROM (SELECT count(*) AS tables, count(CASE WHEN source_rows = target_rows THEN 1 END) * 100 // count(*) AS accuracy_percent
             FROM side_counts) s""",
)
def accuracy_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.accuracy_grade(ql.count_status(counts(spark, sf_dir)))


@query(
    "e13_fingerprint",
    f"""SELECT table_name, side, count(*) AS n_rows, max(l_orderkey) AS max_id, CAST(sum({_hash(COLS)}) AS VARCHAR) AS hash_sum
        FROM side_rows GROUP BY table_name, side""",
)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ql.fingerprint(load(spark, sf_dir, "side_rows"), COLS, ["table_name", "side"], "l_orderkey")
    return out.withColumn("hash_sum", F.col("hash_sum").cast("string"))


_PER_KEY = f"""SELECT table_name, l_orderkey, l_linenumber, count(*) AS n, sum({_hash(COLS)}) AS h
    FROM side_rows WHERE side = '%s' GROUP BY table_name, l_orderkey, l_linenumber"""


@query(
    "e14_checksum_diff",
    f"""SELECT coalesce(s.table_name, t.table_name) AS table_name, coalesce(s.l_orderkey, t.l_orderkey) AS l_orderkey,
          coalesce(s.l_linenumber, t.l_linenumber) AS l_linenumber,
          CASE WHEN t.n IS NULL THEN 'missing' WHEN s.n IS NULL THEN 'extra' ELSE 'changed' END AS difference
        FROM ({_PER_KEY % 'src'}) s FULL OUTER JOIN ({_PER_KEY % 'tgt'}) t
          ON s.table_name = t.table_name AND s.l_orderkey = t.l_orderkey AND s.l_linenumber = t.l_linenumber
        WHERE s.n IS DISTINCT FROM t.n OR s.h IS DISTINCT FROM t.h""",
)
def checksum_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.checksum_diff(side(spark, sf_dir, "src"), side(spark, sf_dir, "tgt"), KEYS, COLS)


@query(
    "e15_sample_match",
    f"""
    WITH k AS (SELECT DISTINCT table_name, l_orderkey, l_linenumber FROM side_rows WHERE side = 'src'),
    pick AS (SELECT * FROM k ORDER BY md5('7|' || table_name || '|' || l_orderkey || '|' || l_linenumber),
                                      table_name, l_orderkey, l_linenumber LIMIT 200)
    SELECT p.*, CAST(t.n IS NOT NULL AS INTEGER) AS is_found,
           CAST(coalesce(s.n = t.n AND s.h = t.h, false) AS INTEGER) AS is_equal
    FROM pick p JOIN ({_PER_KEY % 'src'}) s USING (table_name, l_orderkey, l_linenumber)
    LEFT JOIN ({_PER_KEY % 'tgt'}) t USING (table_name, l_orderkey, l_linenumber)""",
)
def sample_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ql.sample_match(side(spark, sf_dir, "src"), side(spark, sf_dir, "tgt"), KEYS, COLS, n=200, seed=7)
    return out.withColumns({c: F.col(c).cast("int") for c in ("is_found", "is_equal")})


@query(
    "e16_reconcile",
    f"""
    WITH f AS (SELECT table_name, side, count(*) AS n, sum({_hash(COLS)}) AS h FROM side_rows GROUP BY table_name, side),
    j AS (SELECT coalesce(s.table_name, t.table_name) AS table_name, coalesce(s.n, 0) AS source_rows,
                 coalesce(t.n, 0) AS target_rows, s.h IS NOT DISTINCT FROM t.h AS same
          FROM (SELECT * FROM f WHERE side = 'src') s FULL OUTER JOIN (SELECT * FROM f WHERE side = 'tgt') t
            ON s.table_name = t.table_name)
    SELECT table_name, source_rows, target_rows,
           CASE WHEN source_rows <> target_rows THEN 'counts_differ' WHEN NOT same THEN 'values_differ' ELSE 'equal' END AS status,
           CAST(CASE WHEN source_rows = target_rows THEN NOT same WHEN source_rows = 0 THEN true
                ELSE abs(source_rows - target_rows) * 1000 > source_rows END AS INTEGER) AS is_alert
    FROM j""",
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ql.reconcile(side(spark, sf_dir, "src"), side(spark, sf_dir, "tgt"), COLS)
    return out.drop("gap_percent").withColumn("is_alert", F.col("is_alert").cast("int"))


_NULL_SQL = "SELECT 'h_topic' AS column_name, count(*) AS null_rows FROM dead_letters WHERE h_topic IS NULL"


@query("e17_pk_nulls", _NULL_SQL)
def pk_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.pk_nulls(load(spark, sf_dir, "dead_letters"), ["off", "part", "h_topic"])


@query(
    "e18_duplicate_groups",
    """SELECT o_orderkey, _version, count(*) AS n_copies FROM order_log
       GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, op, _version, _is_deleted
       HAVING count(*) > 1""",
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ql.duplicate_groups(load(spark, sf_dir, "order_log").drop("arrival"))
    return out.select("o_orderkey", "_version", "n_copies")


_FRESH_SQL = f"""
    SELECT user_id, age_seconds, CASE WHEN age_seconds > 3600 THEN 'very_stale' WHEN age_seconds > 600 THEN 'stale' ELSE 'fresh' END AS level
    FROM (SELECT user_id, CAST(epoch(TIMESTAMP '{EVENTS_AS_OF}') - epoch(date_trunc('second', max(ts))) AS BIGINT) AS age_seconds
          FROM events GROUP BY user_id) a"""


def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.freshness(load(spark, sf_dir, "events"), "ts", EVENTS_AS_OF, table="user_id")


@query("e19_freshness", _FRESH_SQL)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fresh(spark, sf_dir)


@query(
    "e20_quality_grade",
    f"""
    WITH x AS (SELECT (SELECT count(*) FROM side_counts WHERE source_rows <> coalesce(target_rows, 0)) AS count_issues,
                      (SELECT count(*) FROM ({_NULL_SQL}) n) AS null_issues,
                      (SELECT count(*) FROM ({_FRESH_SQL}) f WHERE level <> 'fresh') AS stale_issues)
    SELECT *, count_issues + null_issues + stale_issues AS issues,
           CASE WHEN count_issues + null_issues + stale_issues = 0 THEN 'EXCELLENT'
                WHEN count_issues + null_issues + stale_issues < 5 THEN 'GOOD' ELSE 'NEEDS ATTENTION' END AS grade FROM x""",
)
def quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    nulls = ql.pk_nulls(load(spark, sf_dir, "dead_letters"), ["off", "part", "h_topic"])
    return ql.quality_grade(ql.count_tolerance(counts(spark, sf_dir)), nulls, fresh(spark, sf_dir))


@query(
    "e21_size_report",
    """
    SELECT *, round(CAST(source_bytes AS DOUBLE) / target_bytes, 2) AS ratio,
      CASE WHEN target_bytes < 1024 THEN printf('%.2f B', target_bytes::DOUBLE)
           WHEN target_bytes < 1048576 THEN printf('%.2f KiB', target_bytes / 1024.0::DOUBLE)
           WHEN target_bytes < 1073741824 THEN printf('%.2f MiB', target_bytes / 1048576.0::DOUBLE)
           ELSE printf('%.2f GiB', target_bytes / 1073741824.0::DOUBLE) END AS target_size
    FROM (SELECT table_name, CAST(sum(CASE WHEN side = 'src' THEN 48 ELSE 0 END) AS BIGINT) AS source_bytes,
            CAST(sum(CASE WHEN side = 'tgt' THEN length(CAST(l_orderkey AS VARCHAR)) + length(CAST(l_extendedprice AS VARCHAR)) ELSE 0 END)
                 AS BIGINT) AS target_bytes
          FROM side_rows GROUP BY table_name) b
    ORDER BY target_bytes DESC, table_name LIMIT 20""",
)
def size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six 8-byte columns on the source side against two values as text on the target side."""
    rows = load(spark, sf_dir, "side_rows")
    text = F.length(F.col("l_orderkey").cast("string")) + F.length(F.col("l_extendedprice").cast("string"))
    zero = F.lit(0).cast("bigint")
    sizes = rows.select(
        "table_name",
        F.when(F.col("side") == "src", F.lit(48).cast("bigint")).otherwise(zero).alias("source_bytes"),
        F.when(F.col("side") == "tgt", text.cast("bigint")).otherwise(zero).alias("target_bytes"),
    )
    return ql.size_report(sizes, top=20)


@query(
    "e22_population_stats",
    """SELECT count(*) AS tables, count(CASE WHEN target_rows > 0 THEN 1 END) AS populated,
          count(CASE WHEN target_rows = 0 THEN 1 END) AS empty, CAST(sum(target_rows) AS BIGINT) AS rows FROM side_counts""",
)
def population_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.population_stats(counts(spark, sf_dir))
