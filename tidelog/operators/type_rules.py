"""Type conversion tables of the schema jobs."""

from __future__ import annotations

# Source base type -> (target type, target type when unsigned, Spark type,
# Spark type when unsigned). Types not listed become String / string.
BASE_TYPES = {
    "TINYINT": ("Int8", "UInt8", "tinyint", "smallint"),
    "SMALLINT": ("Int16", "UInt16", "smallint", "int"),
    "MEDIUMINT": ("Int32", "UInt32", "int", "bigint"),
    "INT": ("Int32", "UInt32", "int", "bigint"),
    "INTEGER": ("Int32", "UInt32", "int", "bigint"),
    "BIGINT": ("Int64", "UInt64", "bigint", "decimal(20,0)"),
    "FLOAT": ("Float32", "Float32", "float", "float"),
    "DOUBLE": ("Float64", "Float64", "double", "double"),
    "DECIMAL": ("Decimal64(2)", "Decimal64(2)", "decimal(18,2)", "decimal(18,2)"),
    "CHAR": ("String", "String", "string", "string"),
    "VARCHAR": ("String", "String", "string", "string"),
    "TEXT": ("String", "String", "string", "string"),
    "TINYTEXT": ("String", "String", "string", "string"),
    "MEDIUMTEXT": ("String", "String", "string", "string"),
    "LONGTEXT": ("String", "String", "string", "string"),
    "BLOB": ("String", "String", "binary", "binary"),
    "TINYBLOB": ("String", "String", "binary", "binary"),
    "MEDIUMBLOB": ("String", "String", "binary", "binary"),
    "LONGBLOB": ("String", "String", "binary", "binary"),
    "BINARY": ("String", "String", "binary", "binary"),
    "VARBINARY": ("String", "String", "binary", "binary"),
    "DATE": ("Date", "Date", "date", "date"),
    "DATETIME": ("DateTime", "DateTime", "timestamp", "timestamp"),
    "TIMESTAMP": ("DateTime", "DateTime", "timestamp", "timestamp"),
    "TIME": ("String", "String", "string", "string"),
    "YEAR": ("UInt16", "UInt16", "int", "int"),
    "ENUM": ("LowCardinality(String)", "LowCardinality(String)", "string", "string"),
    "SET": ("String", "String", "string", "string"),
    "JSON": ("String", "String", "string", "string"),
    "BOOL": ("Bool", "Bool", "boolean", "boolean"),
    "BOOLEAN": ("Bool", "Bool", "boolean", "boolean"),
}

INTEGER_TYPES = ("TINYINT", "SMALLINT", "MEDIUMINT", "INT", "INTEGER", "BIGINT")

# Name fragments of the refinement rules.
COUNTER_NAMES = ("_id", "count", "number", "score")
MONEY_NAMES = ("amount", "balance", "price", "revenue", "cost", "limit")
COUNTRY_NAMES = ("country", "country_code")
CATEGORY_NAMES = (
    "type", "status", "tier", "level", "category", "platform",
    "gender", "zone", "woreda", "kebele", "region", "city",
)
UUID_NAMES = ("uuid", "guid")

# Partition column preference and columns never chosen.
PARTITION_NAMES = ("created_at", "created", "date", "timestamp")
NOT_PARTITION = ("updated_at", "deleted_at")
