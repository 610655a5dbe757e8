"""What the schema jobs do for each column of a catalog runs in compiled code, by plain text searches."""

import re

from pyspark.sql import functions as F

from tidelog.operators import schema as sc
from tidelog.operators import type_rules as rules

CATALOG = "table_name string, ordinal int, column_name string, column_def string, key_position int"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_target_schema_makes_lines_below_the_aggregate(spark):
    rows = [
        ("t", 10, "note", "text DEFAULT NULL", 0), ("t", 2, "made_date", "datetime NOT NULL", 0), ("t", 1, "ID", "bigint NOT NULL", 1),
        ("u", None, "a", "int NOT NULL", 0), ("u", 1, "b", "json", 0), (None, 1, "seen_at", "datetime NOT NULL", 0),
    ]
    out = sc.target_schema(spark.createDataFrame(rows, CATALOG))
    aggregate = next(line for line in plan(out).splitlines() if "collect_list" in line)
    assert "concat" not in aggregate.lower() and "upper" not in aggregate.lower()
    found = {r["table_name"]: r for r in out.collect()}
    names = {t: re.findall(r"^  `(\w+)`", r["ddl"] or "", re.M) for t, r in found.items()}
    meta = ["_version", "_is_deleted", "_extracted_at"]
    assert names["t"] == ["ID", "made_date", "note", *meta, "p_month"] and found["t"]["partition_column"] == "made_date"
    assert names["u"] == ["a", "b", *meta]  # no ordinal comes first
    assert found[None]["n_columns"] == 1 and found[None]["partition_column"] is None and found[None]["ddl"] is None


def test_refine_types_looks_for_name_fragments_without_patterns(spark):
    words = [*rules.COUNTER_NAMES, *rules.MONEY_NAMES, *rules.CATEGORY_NAMES, *rules.UUID_NAMES, "plain", "id", "uui d"]
    names = [None, ""] + [n for w in words for n in (w, f"a{w.upper()}b", f"x_{w}", w[:-1])]
    defs = ["char(36) NOT NULL", "int unsigned", "double", "datetime(3)", None]
    rows = [("t", i, n, d, 0) for i, (n, d) in enumerate((n, d) for n in names for d in defs)]
    catalog = spark.createDataFrame(rows, CATALOG)
    for mode in ("reference", "safe"):
        out = sc.refine_types(catalog, mode)
        assert "RLIKE" not in plan(out).upper() and "_name" not in out.columns

        def holds(words):
            return F.lower("column_name").rlike("|".join(words))

        base, args = F.col("base_type"), F.col("type_args")
        whole = base.isin(*rules.INTEGER_TYPES) if mode == "safe" else F.lit(True)
        coded = (args == "(36)") & (base.isin("CHAR", "VARCHAR") if mode == "safe" else F.lit(True))
        rule = (
            F.when(holds(rules.COUNTER_NAMES) & whole, "counter").when(holds(rules.MONEY_NAMES), "money")
            .when(holds(rules.CATEGORY_NAMES) & base.isin("VARCHAR", "CHAR", "ENUM", "SET"), "category")
            .when(base.isin("DATETIME", "TIMESTAMP"), "moment").when(coded & holds(rules.UUID_NAMES), "uuid")
            .when(coded, "code").otherwise("base")
        )
        assert out.count() == len(rows) and out.where(~F.col("rule").eqNullSafe(rule)).count() == 0
