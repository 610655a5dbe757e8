"""Rule tables of the dead-letter analysis."""

from __future__ import annotations

# Patterns per category, matched without regard to case.
EXCEPTION_PATTERNS = {
    "SCHEMA_MISMATCH": [
        r"DataException",
        r"ClassCastException",
        r"SQLException.*conversion",
        r"SQLException.*type",
        r"Cannot convert",
        r"Type mismatch",
    ],
    "MISSING_TABLE": [
        r"SQLException.*Table.*not.*exist",
        r"SQLException.*Unknown table",
        r"table doesn't exist",
        r"no such table",
        r"Table .* not found",
    ],
    "PRIMARY_KEY": [
        r"DataException.*key",
        r"ConnectException.*primary",
        r"null key",
        r"key is required",
        r"key cannot be null",
        r"primary key constraint",
    ],
    "CONNECTION": [
        r"SQLException.*timeout",
        r"ConnectException",
        r"SocketTimeoutException",
        r"connection refused",
        r"unable to connect",
        r"network",
    ],
    "TRANSFORM": [
        r"TransformException",
        r"PatternSyntaxException",
        r"transform",
        r"regex.*failed",
        r"route.*error",
    ],
    "DATA_OVERFLOW": [
        r"out of range",
        r"overflow",
        r"exceeds maximum",
        r"too large",
        r"value.*out of bounds",
    ],
    "ENCODING": [
        r"encoding",
        r"charset",
        r"invalid character",
        r"UTF",
        r"character set",
    ],
}
PATTERN_SCORE = 15

# Keywords per category and what each one found adds.
KEYWORD_SCORES = {
    "SCHEMA_MISMATCH": (10, ["cannot convert", "type mismatch", "incompatible", "ClassCast", "conversion"]),
    "MISSING_TABLE": (15, ["table doesn't exist", "unknown table", "not found", "no such table"]),
    "PRIMARY_KEY": (12, ["null key", "key is required", "primary key", "key cannot be null"]),
    "DATA_OVERFLOW": (10, ["out of range", "overflow", "exceeds", "too large"]),
    "ENCODING": (8, ["encoding", "charset", "invalid character"]),
    "TRANSFORM": (12, ["transform", "regex", "route", "replacement"]),
    "CONNECTION": (10, ["timeout", "refused", "unable to connect", "network"]),
}

# Stage -> (category, score).
STAGE_HINTS = {"VALUE_CONVERTER": ("SCHEMA_MISMATCH", 5), "TRANSFORMATION": ("TRANSFORM", 10)}

# Category -> fix complexity, and complexity -> priority weight.
COMPLEXITY = {
    "MISSING_TABLE": "EASY (Create tables)",
    "PRIMARY_KEY": "EASY (Config change)",
    "TRANSFORM": "MEDIUM (Fix transform pattern)",
    "SCHEMA_MISMATCH": "MEDIUM-HARD (Schema alignment)",
    "CONNECTION": "MEDIUM (Config/network fix)",
}
DATE_COMPLEXITY = "MEDIUM (Alter column types)"
COMPLEXITY_WEIGHTS = {
    "EASY (Create tables)": 1.5,
    "EASY (Config change)": 1.5,
    "MEDIUM (Fix transform pattern)": 1.0,
    "MEDIUM (Alter column types)": 1.0,
    "MEDIUM-HARD (Schema alignment)": 0.7,
    "MEDIUM (Config/network fix)": 1.0,
    "UNKNOWN": 0.5,
}

# Engine error codes.
ERROR_CODES = {
    "6": "Cannot parse data",
    "16": "Table does not exist",
    "27": "Type mismatch",
    "44": "Cannot insert NULL",
    "60": "Database does not exist",
    "81": "Database already exists",
    "252": "Too many parts",
    "1001": "Generic exception (std::exception)",
}

# What to do, per category (own wording).
ADVICE = {
    "SCHEMA_MISMATCH": [
        "compare the source and target column types of the affected tables",
        "store date and time columns with millisecond range",
        "hold columns that still fail as text until their type is settled",
    ],
    "MISSING_TABLE": [
        "create the missing target tables from the converted schema",
        "replay the dead letters of those tables afterwards",
    ],
    "PRIMARY_KEY": [
        "take the key from the record value instead of the record key",
        "name the key columns explicitly in the sink configuration",
    ],
    "TRANSFORM": [
        "check the topic routing pattern against real topic names",
        "test the replacement on one topic of each database",
    ],
    "CONNECTION": [
        "raise the connection timeout and pool size",
        "check load and health of the target",
    ],
}
SETTINGS = {
    "PRIMARY_KEY": ("primary.key.mode", "record_value"),
    "SCHEMA_MISMATCH": ("schema.evolution", "basic"),
}
