"""Schema as data: column catalogs from table definitions, type mapping, comparison, evolution.

A catalog has one row per column: ``table_name, ordinal, column_name, column_def, key_position``
(0 when the column is not part of the primary key).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.model import CDC_COLUMNS
from tidelog.operators import type_rules as rules
from tidelog.operators.events import align, typed


def read_ddl(spark: SparkSession, path: str) -> DataFrame:
    """One row per definition file: ``file_name, text``."""
    raw = spark.read.text(path, wholetext=True)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return raw.select(name.alias("file_name"), F.col("value").alias("text"))


def parse_ddl(texts: DataFrame) -> DataFrame:
    """One row per file: ``file_name, table_name, lines, keys``; NULL table name when there is none.

    Warning and header lines before the statement are skipped, escaped newlines and quotes are
    resolved, and names may be quoted with ``"`` or a backtick.
    """
    statement = F.regexp_extract("text", r"(?s)(CREATE TABLE\s+[\"`].*)", 1)
    plain = F.replace(F.replace(F.replace(statement, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')),
                      F.lit("\\'"), F.lit("'"))
    body = F.regexp_extract("_ddl", r"(?s)CREATE TABLE[^(]+\((.*)\)", 1)
    lines = F.filter(F.transform(F.split(body, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    key_line = F.try_element_at(F.filter("lines", lambda s: s.startswith("PRIMARY KEY")), F.lit(1))
    name = F.regexp_extract("_ddl", r"CREATE TABLE\s+[\"`](\w+)[\"`]", 1)
    return (
        texts.withColumn("_ddl", plain)
        .select("file_name", F.when(name != "", name).alias("table_name"), lines.alias("lines"))
        .withColumn(
            "keys",
            F.coalesce(
                F.regexp_extract_all(key_line, F.lit(r"[\"`](\w+)[\"`]"), F.lit(1)),
                F.array().cast("array<string>"),
            ),
        )
    )


def ddl_catalog(texts: DataFrame) -> DataFrame:
    """Column catalog of all definition files in one job. Lines that start with a quoted name
    are columns; keys, constraints and checks start with a keyword."""
    column = F.filter("lines", lambda s: s.rlike(r"^[\"`]\w+[\"`]\s"))
    parsed = parse_ddl(texts).where(F.col("table_name").isNotNull())
    rows = parsed.select("table_name", "keys", F.posexplode(column).alias("_pos", "_line"))
    name = F.regexp_extract("_line", r"^[\"`](\w+)[\"`]", 1)
    definition = F.regexp_extract("_line", r"^[\"`]\w+[\"`]\s+(.+?),?\s*$", 1)
    return rows.select(
        "table_name",
        (F.col("_pos") + 1).alias("ordinal"),
        name.alias("column_name"),
        definition.alias("column_def"),
        F.array_position("keys", name).cast("int").alias("key_position"),
    )


def parse_type(catalog: DataFrame) -> DataFrame:
    """Add ``base_type, type_args, is_unsigned, is_nullable``."""
    upper = F.upper("column_def")
    return catalog.withColumns(
        {
            "base_type": F.upper(F.regexp_extract("column_def", r"^(\w+)", 1)),
            "type_args": F.regexp_extract("column_def", r"^\w+(\([^)]+\))", 1),
            "is_unsigned": upper.contains("UNSIGNED"),
            "is_nullable": ~upper.contains("NOT NULL"),
        }
    )


def _lookup(column: int, default: str) -> Column:
    table = F.create_map(*[F.lit(v) for base, row in rules.BASE_TYPES.items() for v in (base, row[column])])
    return F.coalesce(F.try_element_at(table, F.col("base_type")), F.lit(default))


def _by_sign(column: int, default: str) -> Column:
    return F.when(F.col("is_unsigned"), _lookup(column + 1, default)).otherwise(_lookup(column, default))


def map_type(catalog: DataFrame) -> DataFrame:
    """Add ``mapped_type`` and ``spark_type`` from the base type, sign and arguments."""
    parsed = catalog if "base_type" in catalog.columns else parse_type(catalog)
    exact = (F.col("base_type") == "DECIMAL") & (F.col("type_args") != "")
    return parsed.withColumns(
        {
            "mapped_type": F.when(exact, F.concat(F.lit("Decimal"), "type_args")).otherwise(_by_sign(0, "String")),
            "spark_type": F.when(exact, F.concat(F.lit("decimal"), "type_args")).otherwise(_by_sign(2, "string")),
        }
    )


def _named(name: Column, fragments: Sequence[str]) -> Column:
    """Whether a name holds one of the fragments. They are plain text, and searching for it takes a fraction of a pattern's time."""
    return reduce(Column.__or__, [name.contains(f) for f in fragments])


def refine_types(catalog: DataFrame, mode: str = "safe") -> DataFrame:
    """Add ``rule`` and ``target_type`` by the first name rule that applies, and adapt ``spark_type``.

    ``safe``: a rule refines only a type it can hold, so text named ``object_id`` stays text.
    ``reference``: any base type named like a counter becomes an integer (Int32 when the base
    type is no integer), and since ``country`` contains ``count`` the country rule is dead.
    """
    if mode not in ("safe", "reference"):
        raise ValueError(f"unknown mode: {mode}")
    mapped = catalog if "mapped_type" in catalog.columns else map_type(catalog)
    base, args, name = F.col("base_type"), F.col("type_args"), F.col("_name")
    integer = base.isin(*rules.INTEGER_TYPES)
    counter = _named(name, rules.COUNTER_NAMES) & (F.lit(True) if mode == "reference" else integer)
    money = _named(name, rules.MONEY_NAMES)
    country = name.isin(*rules.COUNTRY_NAMES) & base.isin("CHAR", "VARCHAR") & (args == "(2)")
    category = _named(name, rules.CATEGORY_NAMES) & base.isin("VARCHAR", "CHAR", "ENUM", "SET")
    moment = base.isin("DATETIME", "TIMESTAMP")
    coded = args.isin("(36)", "(32)")
    if mode == "safe":
        coded = coded & base.isin("CHAR", "VARCHAR")
    rule = (
        F.when((base == "TINYINT") & (args == "(1)"), "boolean")
        .when(counter, "counter")
        .when(money, "money")
        .when(country, "country")
        .when(category, "category")
        .when(moment, "moment")
        .when(coded & _named(name, rules.UUID_NAMES), "uuid")
        .when(coded, "code")
        .otherwise("base")
    )
    ruled = mapped.withColumn("_name", F.lower("column_name")).withColumn("rule", rule).drop("_name")
    r = F.col("rule")
    target = (
        F.when(r == "boolean", "Bool")
        .when(r == "counter", F.when(integer, F.col("mapped_type")).otherwise("Int32"))
        .when((r == "money") & (base == "DOUBLE"), "Decimal64(2)")
        .when(r == "country", "LowCardinality(FixedString(2))")
        .when(r == "category", "LowCardinality(String)")
        .when(
            r == "moment",
            F.when(args == "(6)", "DateTime64(6, 'UTC')").when(args == "(3)", "DateTime64(3, 'UTC')").otherwise("DateTime('UTC')"),
        )
        .when(r == "uuid", "UUID")
        .when(r == "code", "String")
        .otherwise(F.col("mapped_type"))
    )
    spark = (
        F.when(r == "boolean", "boolean")
        .when((r == "counter") & ~integer, "int")
        .when((r == "money") & (base == "DOUBLE"), "decimal(18,2)")
        .when(r.isin("country", "category", "uuid", "code"), "string")
        .otherwise(F.col("spark_type"))
    )
    return ruled.withColumns({"target_type": target, "spark_type": spark})


def null_policy(refined: DataFrame) -> DataFrame:
    """Add ``default_value`` (NULL when none is known) and ``full_type``.

    A nullable column with a known default becomes not-null with that default; without one it
    stays nullable. Money and uuid columns have none, since a made-up value would be wrong.
    """
    t = F.col("target_type")
    default = (
        F.when(F.col("rule").isin("money", "uuid"), None)
        .when(F.col("rule").isin("country", "category", "code"), "''")
        .when(t.contains("Int"), "0")
        .when((t == "String") | t.contains("LowCardinality"), "''")
        .when(t.contains("DateTime"), "toDateTime(0)")
        .when(t == "Date", "toDate(0)")
        .when(t == "Bool", "0")
        .when(t.contains("Float"), "0.0")
        .when(t.contains("Decimal"), "0")
    )
    withdef = refined.withColumn("default_value", F.when(F.col("is_nullable"), default))
    d = F.col("default_value")
    full = (
        F.when(~F.col("is_nullable"), t)
        .when(d.isNotNull(), F.concat(t, F.lit(" DEFAULT "), d))
        .otherwise(F.concat(F.lit("Nullable("), t, F.lit(")")))
    )
    return withdef.withColumn("full_type", full)


# Spark default per Spark type, as SQL text.
_SPARK_DEFAULTS = {
    "boolean": "false", "tinyint": "0", "smallint": "0", "int": "0", "bigint": "0", "float": "0", "double": "0",
    "string": "''", "date": "DATE '1970-01-01'", "timestamp": "TIMESTAMP '1970-01-01 00:00:00'",
}


def apply_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Replace NULLs by the known default of each column."""
    return df.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in df.columns})


def column_defaults(catalog: DataFrame) -> DataFrame:
    """Add ``default_clause``: quoted text kept quoted, NULL, ``now()`` for the current time,
    other words as they are, empty when the definition has none."""
    pattern = r"(?i)DEFAULT\s+('[^']*'|[^\s,]+)"
    raw = F.regexp_extract("column_def", pattern, 1)
    upper = F.upper(raw)
    clause = (
        F.when(raw == "", "")
        .when(upper == "NULL", "DEFAULT NULL")
        .when(upper.startswith("CURRENT_TIMESTAMP") | (upper == "NOW()"), "DEFAULT now()")
        .otherwise(F.concat(F.lit("DEFAULT "), raw))
    )
    return catalog.withColumn("default_clause", clause)


def primary_keys(catalog: DataFrame) -> DataFrame:
    """One row per table: key columns in key order, and the sort key (``tuple()`` without one)."""
    marked = F.when(F.col("key_position") > 0, F.struct("key_position", "column_name"))
    names = F.transform(F.array_sort(F.collect_list(marked)), lambda s: s["column_name"])
    return catalog.groupBy("table_name").agg(names.alias("key_columns")).withColumn(
        "sort_key",
        F.when(F.size("key_columns") == 0, "tuple()").otherwise(
            F.concat(F.lit("("), F.array_join("key_columns", ", "), F.lit(")"))
        ),
    )


def partition_column(catalog: DataFrame) -> DataFrame:
    """Time column to partition by, per table that has one: preferred names first, then the
    first time column; never the update or delete time."""
    parsed = catalog if "base_type" in catalog.columns else parse_type(catalog)
    name = F.lower("column_name")
    rank = F.lit(len(rules.PARTITION_NAMES))
    for i, fragment in reversed(list(enumerate(rules.PARTITION_NAMES))):
        rank = F.when(name.contains(fragment), F.lit(i)).otherwise(rank)
    moments = parsed.where(F.col("base_type").isin("DATETIME", "TIMESTAMP") & ~name.isin(*rules.NOT_PARTITION))
    return moments.groupBy("table_name").agg(
        F.min_by("column_name", F.struct(rank, "ordinal")).alias("partition_column")
    )


def target_schema(catalog: DataFrame, mode: str = "safe") -> DataFrame:
    """One row per table: ``ddl``, a Spark table definition with the metadata columns.

    Columns with a known default are declared ``NOT NULL DEFAULT``; the table is partitioned by
    month of its partition column (``p_month``) when it has one.
    """
    typed_cols = null_policy(refine_types(catalog, mode))
    known = F.create_map(*[F.lit(x) for kv in _SPARK_DEFAULTS.items() for x in kv])
    default = F.when(F.col("default_value").isNotNull(), F.coalesce(F.try_element_at(known, F.col("spark_type")), F.lit("0")))
    line = F.concat(
        F.lit("  `"), "column_name", F.lit("` "), F.upper("spark_type"),
        F.when(~F.col("is_nullable"), F.lit(" NOT NULL"))
        .when(default.isNotNull(), F.concat(F.lit(" NOT NULL DEFAULT "), default))
        .otherwise(F.lit("")),
    )
    # The aggregate would interpret the expression of a line for each row: lines are made below it, in compiled code.
    lines = typed_cols.select("table_name", F.struct("ordinal", line.alias("line")).alias("column"))
    columns = F.sort_array(F.collect_list("column"))["line"]
    per_table = lines.groupBy("table_name").agg(columns.alias("lines"), F.count("*").alias("n_columns"))
    joined = per_table.join(partition_column(catalog), "table_name", "left")
    meta = F.array(
        F.lit("  `_version` BIGINT NOT NULL DEFAULT 0"),
        F.lit("  `_is_deleted` TINYINT NOT NULL DEFAULT 0"),
        F.lit("  `_extracted_at` TIMESTAMP"),
    )
    month = F.when(F.col("partition_column").isNotNull(), F.array(F.lit("  `p_month` INT"))).otherwise(
        F.array().cast("array<string>")
    )
    ddl = F.concat(
        F.lit("CREATE TABLE IF NOT EXISTS `"), F.col("table_name"), F.lit("` (\n"),
        F.array_join(F.concat("lines", meta, month), ",\n"), F.lit("\n) USING parquet"),
        F.when(F.col("partition_column").isNotNull(), F.lit("\nPARTITIONED BY (`p_month`)")).otherwise(F.lit("")),
    )
    return joined.select("table_name", "n_columns", "partition_column", ddl.alias("ddl"))


def struct_type(catalog: DataFrame, table: str, mode: str = "safe") -> T.StructType:
    """Schema of one table for a reader (the catalog rows of that table only)."""
    refined = refine_types(catalog.where(F.col("table_name") == table), mode)
    rows = refined.select("column_name", "spark_type", "is_nullable").orderBy("ordinal").collect()
    fields = ", ".join(f"`{r[0]}` {r[1]}" + ("" if r[2] else " not null") for r in rows)
    return T._parse_datatype_string(fields)


def stream_tables(catalog: DataFrame, mode: str = "safe") -> tuple[dict[str, dict[str, str]], dict[str, list[str]]]:
    """Column types and key columns of every table of a catalog, as ``replicate_tables`` takes them (types, required).

    Metadata: one row for each column of the catalog comes to the driver.
    """
    rows = refine_types(catalog, mode).select("table_name", "ordinal", "column_name", "spark_type", "key_position").collect()
    types: dict[str, dict[str, str]] = {}
    keys: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["table_name"], r["ordinal"])):
        types.setdefault(r["table_name"], {})[r["column_name"]] = r["spark_type"]
        if r["key_position"]:
            keys.setdefault(r["table_name"], []).append((r["key_position"], r["column_name"]))
    return types, {t: [c for _, c in sorted(k)] for t, k in keys.items()}


def validate_conversion(source: DataFrame, target: DataFrame) -> DataFrame:
    """Per source table: column counts, whether the key arrived, share of text columns.

    Valid: the target has the source columns plus the three metadata columns, and the key is
    the same. More than 70 % text columns only warns.
    """
    def counted(catalog: DataFrame, side: str) -> DataFrame:
        mapped = map_type(catalog)
        return mapped.groupBy("table_name").agg(
            F.count("*").alias(f"{side}_columns"),
            F.count_if(F.col("key_position") > 0).alias(f"{side}_keys"),
            F.count_if(F.col("mapped_type") == "String").alias(f"{side}_text"),
        )

    joined = counted(source, "source").join(counted(target, "target"), "table_name", "left")
    found = F.col("target_columns").isNotNull()
    columns_ok = F.col("target_columns") == F.col("source_columns") + len(CDC_COLUMNS)
    key_ok = F.col("source_keys") == F.col("target_keys")
    return joined.select(
        "table_name",
        "source_columns",
        F.coalesce("target_columns", F.lit(0).cast("bigint")).alias("target_columns"),
        F.when(found, "converted").otherwise("failed").alias("outcome"),
        F.coalesce(columns_ok, F.lit(False)).alias("columns_ok"),
        F.coalesce(key_ok, F.lit(False)).alias("key_ok"),
        F.coalesce(F.col("target_text") > F.col("source_columns") * 0.7, F.lit(False)).alias("text_warning"),
        F.coalesce(found & columns_ok & key_ok, F.lit(False)).alias("is_valid"),
    )


def conversion_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "converted").alias("converted"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("with_issues"),
        F.count_if("text_warning").alias("warned"),
    )


def profile_tables(counts: DataFrame, sizes: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows, size in MB (two decimals) and ordered key list per table; ``none`` without a key."""
    mb = F.round(F.coalesce("n_bytes", F.lit(0)) / F.lit(1048576.0), 2)
    joined = counts.join(sizes, "table_name", "left").join(keys, "table_name", "left")
    key_list = F.when(F.size("key_columns") > 0, F.array_join("key_columns", ",")).otherwise("none")
    return joined.select("table_name", "n_rows", mb.alias("size_mb"), F.coalesce(key_list, F.lit("none")).alias("primary_key"))


def _column_counts(catalog: DataFrame, name: str) -> DataFrame:
    return catalog.groupBy("table_name").agg(F.count("*").alias(name))


def schema_count_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Tables on both sides whose number of columns differs."""
    both = _column_counts(source, "source_columns").join(_column_counts(target, "target_columns"), "table_name")
    return both.where(F.col("source_columns") != F.col("target_columns"))


def schema_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns that only one side has, for tables that both have: ``missing`` or ``extra``."""
    names = ["table_name", "column_name"]
    s = source.select(*names, F.lit(1).alias("_s"))
    t = target.select(*names, F.lit(1).alias("_t"))
    both = source.select("table_name").distinct().join(target.select("table_name").distinct(), "table_name", "left_semi")
    joined = s.join(t, names, "full_outer").where(F.col("_s").isNull() | F.col("_t").isNull())
    side = F.when(F.col("_t").isNull(), "missing").otherwise("extra")
    return joined.join(both, "table_name", "left_semi").select(*names, side.alias("difference"))


def describe_tables(source: DataFrame, target: DataFrame, counts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Both schemas and the sync status of every source table.

    ``counts`` has ``table_name, source_rows, target_rows`` (NULL target rows: no such table). ``tasks`` is the number of
    parts that tables are dealt to: schemas are alike and shuffle to few bytes, of which Spark gives a task too many.
    """
    if tasks:
        source, target, counts = (df.repartition(tasks, "table_name") for df in (source, target, counts))

    def listed(catalog: DataFrame, name: str) -> DataFrame:
        lines = F.collect_list(F.struct("ordinal", F.concat_ws(" ", "column_name", "column_def").alias("line")))
        return catalog.groupBy("table_name").agg(
            F.count("*").alias(f"{name}_columns"),
            F.array_join(F.transform(F.array_sort(lines), lambda s: s["line"]), "; ").alias(f"{name}_schema"),
        )

    joined = counts.join(listed(source, "source"), "table_name", "left").join(listed(target, "target"), "table_name", "left")
    s, t = F.col("source_rows"), F.col("target_rows")
    status = (
        F.when(t.isNull(), "missing")
        .when((s == 0) & (t == 0), "empty_both")
        .when((s > 0) & (t == 0), "empty_target")
        .when(t >= s, "synced")
        .otherwise(F.concat(F.lit("partial "), F.format_string("%.1f", t / s * 100), F.lit("%")))
    )
    return joined.withColumn("status", status)


def evolve(df: DataFrame, added: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Add columns that are missing, with a type and a default for the rows there are."""
    new = {c: F.lit(v).cast(t) for c, (t, v) in added.items() if c not in df.columns}
    return df.withColumns(new) if new else df


def rebuild(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows recast to new types, and rows with a value that does not fit (with its column names)."""
    values = {c: typed(F.col(c), t) for c, t in types.items() if c in df.columns}
    problems = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull() & v.isNull(), F.lit(c)) for c, v in values.items()])
    )
    checked = df.withColumn("_problems", problems)
    ok = checked.where(F.size("_problems") == 0).select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns])
    return align(ok, types), checked.where(F.size("_problems") > 0)


def creation_report(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected tables, created ones and the names of those that were not."""
    marked = expected.select("table_name").distinct().join(
        present.select("table_name", F.lit(1).alias("_there")).distinct(), "table_name", "left"
    )
    return marked.select("table_name", F.when(F.col("_there") == 1, "created").otherwise("failed").alias("outcome"))
