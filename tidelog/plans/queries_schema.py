"""Registered queries: schema conversion and comparison over the corpus derived from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import load, part_tasks, run
from tidelog.operators import schema as sc
from tidelog.operators import type_rules as rules
from tidelog.registry import query


def source_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "ddl_columns")


def target_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "target_columns")


# --- the same rules as SQL ---------------------------------------------------------

_BASE = "upper(regexp_extract(column_def, '^(\\w+)', 1))"
_ARGS = "regexp_extract(column_def, '^\\w+(\\([^)]+\\))', 1)"
_UNSIGNED = "column_def ILIKE '%unsigned%'"
_NULLABLE = "column_def NOT ILIKE '%not null%'"


def parsed_sql(table: str = "ddl_columns") -> str:
    return f"""SELECT *, {_BASE} AS base, {_ARGS} AS args, {_UNSIGNED} AS uns, {_NULLABLE} AS nullable,
        lower(column_name) AS lname FROM {table}"""


def _map_case(signed: int, default: str) -> str:
    lines = "\n".join(
        f"WHEN base = '{b}' THEN CASE WHEN uns THEN '{r[signed + 1]}' ELSE '{r[signed]}' END"
        for b, r in rules.BASE_TYPES.items()
    )
    word = "Decimal" if signed == 0 else "decimal"
    return f"CASE WHEN base = 'DECIMAL' AND args <> '' THEN '{word}' || args {lines} ELSE '{default}' END"


_MAPPED = _map_case(0, "String")
_SPARK = _map_case(2, "string")


def _like(names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lname, '{n}')" for n in names) + ")"


_INTS = ", ".join(f"'{b}'" for b in rules.INTEGER_TYPES)


def refined_sql(mode: str, table: str = "ddl_columns") -> str:
    counter = _like(rules.COUNTER_NAMES) + ("" if mode == "reference" else f" AND base IN ({_INTS})")
    code = "args IN ('(36)', '(32)')" + ("" if mode == "reference" else " AND base IN ('CHAR', 'VARCHAR')")
    rule = f"""CASE WHEN base = 'TINYINT' AND args = '(1)' THEN 'boolean'
        WHEN {counter} THEN 'counter' WHEN {_like(rules.MONEY_NAMES)} THEN 'money'
        WHEN lname IN ('country', 'country_code') AND base IN ('CHAR', 'VARCHAR') AND args = '(2)' THEN 'country'
        WHEN {_like(rules.CATEGORY_NAMES)} AND base IN ('VARCHAR', 'CHAR', 'ENUM', 'SET') THEN 'category'
        WHEN base IN ('DATETIME', 'TIMESTAMP') THEN 'moment'
        WHEN {code} AND {_like(rules.UUID_NAMES)} THEN 'uuid'
        WHEN {code} THEN 'code' ELSE 'base' END"""
    return f"""SELECT *, CASE rule WHEN 'boolean' THEN 'Bool'
          WHEN 'counter' THEN CASE WHEN base IN ({_INTS}) THEN mapped ELSE 'Int32' END
          WHEN 'money' THEN CASE WHEN base = 'DOUBLE' THEN 'Decimal64(2)' ELSE mapped END
          WHEN 'country' THEN 'LowCardinality(FixedString(2))' WHEN 'category' THEN 'LowCardinality(String)'
          WHEN 'moment' THEN CASE args WHEN '(6)' THEN 'DateTime64(6, ''UTC'')'
            WHEN '(3)' THEN 'DateTime64(3, ''UTC'')' ELSE 'DateTime(''UTC'')' END
          WHEN 'uuid' THEN 'UUID' WHEN 'code' THEN 'String' ELSE mapped END AS target_type
        FROM (SELECT *, {_MAPPED} AS mapped, {_SPARK} AS spark_mapped, {rule} AS rule
              FROM ({parsed_sql(table)}) p) m"""


# --- queries -------------------------------------------------------------------------


@query(
    "d01_ddl_catalog",
    """SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY ordinal) AS INTEGER) AS ordinal,
              column_name, column_def, key_position FROM ddl_columns""",
)
def ddl_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.ddl_catalog(load(spark, sf_dir, "ddl_texts"))


@query(
    "d02_parse_type",
    f"""SELECT table_name, column_name, base AS base_type, args AS type_args,
           CAST(uns AS INTEGER) AS is_unsigned, CAST(nullable AS INTEGER) AS is_nullable FROM ({parsed_sql()}) p""",
)
def parse_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.parse_type(source_catalog(spark, sf_dir)).select(
        "table_name", "column_name", "base_type", "type_args",
        F.col("is_unsigned").cast("int").alias("is_unsigned"), F.col("is_nullable").cast("int").alias("is_nullable"),
    )


@query(
    "d03_map_type",
    f"SELECT table_name, column_name, {_MAPPED} AS mapped_type, {_SPARK} AS spark_type FROM ({parsed_sql()}) p",
)
def map_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.map_type(source_catalog(spark, sf_dir)).select("table_name", "column_name", "mapped_type", "spark_type")


@query(
    "d04_integer_types",
    f"""SELECT base AS base_type, CAST(uns AS INTEGER) AS is_unsigned, {_MAPPED} AS mapped_type, count(*) AS n
        FROM ({parsed_sql()}) p WHERE base IN ({_INTS}) GROUP BY ALL""",
)
def integer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = sc.map_type(source_catalog(spark, sf_dir)).where(F.col("base_type").isin(*rules.INTEGER_TYPES))
    return mapped.groupBy("base_type", F.col("is_unsigned").cast("int").alias("is_unsigned"), "mapped_type").agg(
        F.count("*").alias("n")
    )


@query(
    "d05_refine_types",
    f"SELECT table_name, column_name, rule, target_type FROM ({refined_sql('safe')}) r",
)
def refine_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.refine_types(source_catalog(spark, sf_dir)).select("table_name", "column_name", "rule", "target_type")


@query(
    "d05_refine_types_reference",
    f"SELECT table_name, column_name, rule, target_type FROM ({refined_sql('reference')}) r",
)
def refine_types_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    refined = sc.refine_types(source_catalog(spark, sf_dir), "reference")
    return refined.select("table_name", "column_name", "rule", "target_type")


@query(
    "d06_null_policy",
    f"""SELECT table_name, column_name, CASE WHEN NOT nullable THEN target_type
             WHEN d IS NULL THEN 'Nullable(' || target_type || ')' ELSE target_type || ' DEFAULT ' || d END AS full_type
        FROM (SELECT *, CASE WHEN rule IN ('money', 'uuid') THEN NULL
                WHEN rule IN ('boolean', 'counter') THEN '0' WHEN rule = 'moment' THEN 'toDateTime(0)'
                WHEN rule IN ('country', 'category', 'code') THEN ''''''
                WHEN regexp_matches(target_type, 'Int|Bool|Decimal') THEN '0'
                WHEN target_type LIKE 'Float%' THEN '0.0' WHEN target_type = 'Date' THEN 'toDate(0)'
                ELSE '''''' END AS d FROM ({refined_sql('safe')}) r) t""",
)
def null_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.null_policy(sc.refine_types(source_catalog(spark, sf_dir)))
    return out.select("table_name", "column_name", "full_type")


@query(
    "d06_apply_defaults",
    """SELECT arrival AS off, CASE WHEN arrival % 89 = 7 OR arrival % 97 = 5 THEN 0 ELSE o_custkey END AS o_custkey
       FROM order_log""",
)
def apply_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.plans.queries_events import typed_rows

    return sc.apply_defaults(typed_rows(spark, sf_dir), {"o_custkey": F.lit(0).cast("bigint")}).select("off", "o_custkey")


@query(
    "d07_column_defaults",
    """SELECT table_name, column_name,
         CASE WHEN column_def NOT LIKE '%DEFAULT%' THEN '' WHEN column_def LIKE '%DEFAULT NULL%' THEN 'DEFAULT NULL'
              WHEN column_def LIKE '%CURRENT_TIMESTAMP%' THEN 'DEFAULT now()'
              ELSE 'DEFAULT ' || string_split(column_def, 'DEFAULT ')[2] END AS default_clause
       FROM ddl_columns""",
)
def column_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.column_defaults(source_catalog(spark, sf_dir)).select("table_name", "column_name", "default_clause")


@query(
    "d08_primary_keys",
    """SELECT table_name, coalesce('(' || string_agg(CASE WHEN key_position > 0 THEN column_name END, ', '
                                                    ORDER BY key_position) || ')', 'tuple()') AS sort_key,
              count(CASE WHEN key_position > 0 THEN 1 END) AS n_keys
       FROM ddl_columns GROUP BY table_name""",
)
def primary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.primary_keys(source_catalog(spark, sf_dir))
    return out.select("table_name", "sort_key", F.size("key_columns").cast("bigint").alias("n_keys"))


_PARTITION_SQL = f"""
    SELECT table_name, column_name AS partition_column FROM (
      SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY
          CASE WHEN contains(lname, 'created_at') THEN 1 WHEN contains(lname, 'created') THEN 2
               WHEN contains(lname, 'date') THEN 3 WHEN contains(lname, 'timestamp') THEN 4 ELSE 5 END, ordinal) AS rn
      FROM ({parsed_sql()}) p
      WHERE base IN ('DATETIME', 'TIMESTAMP') AND lname NOT IN ('updated_at', 'deleted_at')) r
    WHERE rn = 1"""


@query("d09_partition_column", _PARTITION_SQL)
def partition_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.partition_column(source_catalog(spark, sf_dir))


@query(
    "d10_target_schema",
    f"""
    WITH cols AS (SELECT table_name, ordinal, '  `' || column_name || '` ' || upper(spark) ||
        CASE WHEN NOT nullable THEN ' NOT NULL' WHEN rule IN ('money', 'uuid') THEN ''
             WHEN spark = 'boolean' THEN ' NOT NULL DEFAULT false'
             WHEN spark IN ('string', 'binary') THEN ' NOT NULL DEFAULT ' || CASE spark WHEN 'string' THEN '''''' ELSE '0' END
             WHEN spark = 'date' THEN ' NOT NULL DEFAULT DATE ''1970-01-01'''
             WHEN spark = 'timestamp' THEN ' NOT NULL DEFAULT TIMESTAMP ''1970-01-01 00:00:00'''
             ELSE ' NOT NULL DEFAULT 0' END AS line
      FROM (SELECT *, CASE rule WHEN 'boolean' THEN 'boolean'
               WHEN 'money' THEN CASE WHEN base = 'DOUBLE' THEN 'decimal(18,2)' ELSE spark_mapped END
               WHEN 'country' THEN 'string' WHEN 'category' THEN 'string' WHEN 'uuid' THEN 'string' WHEN 'code' THEN 'string'
               ELSE spark_mapped END AS spark FROM ({refined_sql('safe')}) r) s),
    part_cols AS ({_PARTITION_SQL})
    SELECT c.table_name, count(*) AS n_columns, max(p.partition_column) AS partition_column,
      'CREATE TABLE IF NOT EXISTS `' || c.table_name || '` (' || chr(10) || string_agg(line, ',' || chr(10) ORDER BY ordinal)
      || ',' || chr(10) || '  `_version` BIGINT NOT NULL DEFAULT 0,' || chr(10)
      || '  `_is_deleted` TINYINT NOT NULL DEFAULT 0,' || chr(10) || '  `_extracted_at` TIMESTAMP'
      || CASE WHEN max(p.partition_column) IS NOT NULL THEN ',' || chr(10) || '  `p_month` INT' ELSE '' END
      || chr(10) || ') USING parquet'
      || CASE WHEN max(p.partition_column) IS NOT NULL THEN chr(10) || 'PARTITIONED BY (`p_month`)' ELSE '' END AS ddl
    FROM cols c LEFT JOIN part_cols p ON c.table_name = p.table_name GROUP BY c.table_name""",
)
def target_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.target_schema(source_catalog(spark, sf_dir))


_VALIDATION_SQL = f"""
    WITH s AS (SELECT table_name, count(*) AS source_columns, count(CASE WHEN key_position > 0 THEN 1 END) AS k
               FROM ddl_columns GROUP BY table_name),
    t AS (SELECT table_name, count(*) AS target_columns, count(CASE WHEN key_position > 0 THEN 1 END) AS k,
                 count(CASE WHEN mapped = 'String' THEN 1 END) AS texts
          FROM (SELECT *, {_MAPPED} AS mapped FROM ({parsed_sql('target_columns')}) p) m GROUP BY table_name)
    SELECT s.table_name, s.source_columns, coalesce(t.target_columns, 0) AS target_columns,
           CASE WHEN t.table_name IS NULL THEN 'failed' ELSE 'converted' END AS outcome,
           CAST(coalesce(t.target_columns = s.source_columns + 3, false) AS INTEGER) AS columns_ok,
           CAST(coalesce(t.k = s.k, false) AS INTEGER) AS key_ok,
           CAST(coalesce(t.texts > s.source_columns * 0.7, false) AS INTEGER) AS text_warning,
           CAST(coalesce(t.target_columns = s.source_columns + 3 AND t.k = s.k, false) AS INTEGER) AS is_valid
    FROM s LEFT JOIN t ON s.table_name = t.table_name"""


@query("d11_validate_conversion", _VALIDATION_SQL)
def validate_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.validate_conversion(source_catalog(spark, sf_dir), target_catalog(spark, sf_dir))
    flags = ("columns_ok", "key_ok", "text_warning", "is_valid")
    return out.withColumns({c: F.col(c).cast("int") for c in flags})


@query(
    "d12_conversion_summary",
    f"""SELECT count(*) AS total, count(CASE WHEN outcome = 'converted' THEN 1 END) AS converted,
          count(CASE WHEN outcome = 'failed' THEN 1 END) AS failed, count(CASE WHEN is_valid = 1 THEN 1 END) AS valid,
          count(CASE WHEN is_valid = 0 THEN 1 END) AS with_issues, count(CASE WHEN text_warning = 1 THEN 1 END) AS warned
        FROM ({_VALIDATION_SQL}) v""",
)
def conversion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.conversion_summary(sc.validate_conversion(source_catalog(spark, sf_dir), target_catalog(spark, sf_dir)))


@query(
    "d13_profile_tables",
    """
    SELECT t.table_name, coalesce(c.n, 0) AS n_rows, round(coalesce(c.n, 0) * 48 / 1048576.0::DOUBLE, 2) AS size_mb,
           'l_orderkey,l_linenumber' AS primary_key
    FROM side_tables t LEFT JOIN (SELECT table_name, count(*) AS n FROM side_rows WHERE side = 'src' GROUP BY table_name) c
      ON t.table_name = c.table_name""",
)
def profile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bytes (six 8-byte columns per row) and key list of every source table."""
    tables = load(spark, sf_dir, "side_tables")
    counts = load(spark, sf_dir, "side_counts").select("table_name", F.col("source_rows").alias("n_rows"))
    sizes = counts.select("table_name", (F.col("n_rows") * 48).alias("n_bytes"))
    keys = tables.select("table_name", F.array(F.lit("l_orderkey"), F.lit("l_linenumber")).alias("key_columns"))
    return sc.profile_tables(counts, sizes, keys)


@query(
    "d14_schema_count_diff",
    """
    SELECT s.table_name, s.n AS source_columns, t.n AS target_columns
    FROM (SELECT table_name, count(*) AS n FROM ddl_columns GROUP BY table_name) s
    JOIN (SELECT table_name, count(*) AS n FROM target_columns WHERE column_name NOT LIKE '\\_%' ESCAPE '\\'
          GROUP BY table_name) t ON s.table_name = t.table_name AND s.n <> t.n""",
)
def schema_count_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = target_catalog(spark, sf_dir).where(~F.col("column_name").startswith("_"))
    return sc.schema_count_diff(source_catalog(spark, sf_dir), target)


@query(
    "d15_schema_diff",
    """
    WITH s AS (SELECT table_name, column_name FROM ddl_columns WHERE table_name IN (SELECT table_name FROM target_columns)),
         t AS (SELECT table_name, column_name FROM target_columns)
    SELECT *, 'missing' AS difference FROM (SELECT * FROM s EXCEPT SELECT * FROM t) a
    UNION ALL SELECT *, 'extra' FROM (SELECT * FROM t EXCEPT SELECT * FROM s) b""",
)
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.schema_diff(source_catalog(spark, sf_dir), target_catalog(spark, sf_dir))


_ROWS_OF_TABLES = """
    SELECT table_name, num % 9 AS source_rows, CASE WHEN num % 13 = 12 THEN NULL ELSE num % 7 END AS target_rows
    FROM (SELECT DISTINCT table_name, CAST(split_part(table_name, '_', 3) AS INT) AS num FROM ddl_columns) n"""


@query(
    "d16_describe_tables",
    f"""
    SELECT r.table_name, r.source_rows, r.target_rows, s.n AS source_columns, s.txt AS source_schema,
           t.n AS target_columns, t.txt AS target_schema,
           CASE WHEN r.target_rows IS NULL THEN 'missing' WHEN r.source_rows = 0 AND r.target_rows = 0 THEN 'empty_both'
                WHEN r.target_rows = 0 THEN 'empty_target' WHEN r.target_rows >= r.source_rows THEN 'synced'
                ELSE 'partial ' || printf('%.1f', r.target_rows / r.source_rows * 100) || '%' END AS status
    FROM ({_ROWS_OF_TABLES}) r
    LEFT JOIN (SELECT table_name, count(*) AS n, string_agg(column_name || ' ' || column_def, '; ' ORDER BY ordinal) AS txt
               FROM ddl_columns GROUP BY table_name) s ON s.table_name = r.table_name
    LEFT JOIN (SELECT table_name, count(*) AS n, string_agg(column_name || ' ' || column_def, '; ' ORDER BY ordinal) AS txt
               FROM target_columns GROUP BY table_name) t ON t.table_name = r.table_name""",
)
def describe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = run(spark, _ROWS_OF_TABLES, sf_dir)
    return sc.describe_tables(source_catalog(spark, sf_dir), target_catalog(spark, sf_dir), counts, part_tasks(spark, sf_dir))


@query(
    "d17_evolve",
    """SELECT o_orderkey, 'web' AS channel, 0::DOUBLE AS rebate FROM orders""",
)
def evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = {"channel": ("string", "web"), "rebate": ("double", 0), "o_orderkey": ("bigint", -1)}
    return sc.evolve(load(spark, sf_dir, "orders"), added).select("o_orderkey", "channel", "rebate")


@query(
    "d18_rebuild",
    """SELECT CASE WHEN p_retailprice >= 1000 THEN 'failed' ELSE 'rebuilt' END AS outcome, count(*) AS n,
         CAST(sum(p_partkey) AS BIGINT) AS key_sum,
         CAST(sum(CASE WHEN p_retailprice < 1000 THEN CAST(p_retailprice AS DECIMAL(16, 2)) END) AS DOUBLE) AS price_sum
       FROM part GROUP BY 1""",
)
def rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price narrowed to decimal(5,2): prices of 1000 and more do not fit and are set aside."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    ok, failed = sc.rebuild(parts, {"p_partkey": "bigint", "p_retailprice": "decimal(5,2)"})

    def summary(df: DataFrame, outcome: str, price) -> DataFrame:
        return df.groupBy(F.lit(outcome).alias("outcome")).agg(
            F.count("*").alias("n"), F.sum("p_partkey").alias("key_sum"), price.alias("price_sum")
        )

    price = F.sum("p_retailprice").cast("double")
    return summary(ok, "rebuilt", price).unionByName(summary(failed, "failed", F.lit(None).cast("double")))


@query(
    "d19_creation_report",
    """SELECT table_name, CASE WHEN table_name IN (SELECT table_name FROM target_columns) THEN 'created'
              ELSE 'failed' END AS outcome
       FROM (SELECT DISTINCT table_name FROM ddl_columns) s""",
)
def creation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.creation_report(source_catalog(spark, sf_dir), target_catalog(spark, sf_dir))
