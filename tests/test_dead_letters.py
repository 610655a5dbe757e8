import re

import pytest
from pyspark.sql import functions as F

from tidelog.model import HEADER_PREFIX
from tidelog.operators import dead_letters as dl
from tidelog.operators import dlq_rules as rules
from tidelog.plans.queries_dead_letters import errors, letters


def restated(kind, message, stage):
    """The scoring rules in plain Python, one record at a time."""
    text = f"{kind} {message} {stage}"
    scores = {}
    for category, patterns in rules.EXCEPTION_PATTERNS.items():
        if any(re.search(p, text, re.IGNORECASE) for p in patterns):
            scores[category] = scores.get(category, 0) + 15
    for category, (weight, words) in rules.KEYWORD_SCORES.items():
        for w in words:
            if w.lower() in text.lower():
                scores[category] = scores.get(category, 0) + weight
    if stage in rules.STAGE_HINTS:
        category, extra = rules.STAGE_HINTS[stage]
        scores[category] = scores.get(category, 0) + extra
    if not scores:
        return "UNKNOWN", 0
    best = max(scores.items(), key=lambda x: x[1])
    return best[0], min(100, best[1] * 5)


MESSAGES = [
    "", "plain failure", "Cannot convert field 'a'", "SQLException: bad type", "SQLException then conversion", "Type mismatch",
    "SQLException: Table x does not exist", "Table x was not found", "not found", "null key", "a KEY is REQUIRED", "utf8 text",
    "ConnectException: primary", "Network unreachable", "regex has failed", "route with error", "replacement", "transform",
    "value is way out of bounds", "exceeds quota", "overflow, timeout", "character set", "invalid character and charset",
    "timeout\nSQLException", "SQLException\ntimeout", "value out of range, unable to connect", "table doesn't exist", "incompatible",
]


def test_classifier_equals_the_rules_restated(spark):
    kinds = ["DataException", "RuntimeException", "java.sql.SQLException", "ClassCastException", "ConnectException"]
    stages = ["VALUE_CONVERTER", "TRANSFORMATION", "TASK_PUT", "unknown"]
    rows = [(k, m, s) for k in kinds for m in MESSAGES for s in stages]
    df = spark.createDataFrame(rows, "exception_class string, exception_message string, stage string")
    got = {(r[0], r[1], r[2]): (r.category, r.confidence) for r in dl.classify_dlq(df).collect()}
    wrong = [(r, got[r], restated(*r)) for r in rows if got[r] != restated(*r)]
    assert not wrong, wrong[:3]


def test_all_categories_and_a_tie_occur(spark, sf_dir):
    seen = {r.category for r in errors(spark, sf_dir).select("category").distinct().collect()}
    assert seen == {*rules.EXCEPTION_PATTERNS, "UNKNOWN"}


def test_header_forms_and_defaults(spark):
    listed = spark.sql(f"""SELECT array(named_struct('key', '{HEADER_PREFIX}topic', 'value', 'a.b.c'),
        named_struct('key', '{HEADER_PREFIX}topic', 'value', 'a.b.last')) AS headers, '' AS value""")
    mapped = spark.sql(f"SELECT map('{HEADER_PREFIX}topic', 'a.b.last') AS headers, '' AS value")
    for df in (listed, mapped):
        r = dl.dlq_table(dl.parse_dlq(df)).first()
        assert r.table_name == "last" and r.stage == "unknown" and r.partition == "-1" and r.exception_message == ""


def test_table_name_falls_back_to_the_payload(spark):
    df = spark.createDataFrame([('{"source":{"table":"bets"}}',), ("insert into a.b.wins",), ("nothing",)], "value string")
    parsed = df.withColumn("original_topic", F.lit("unknown"))
    assert [r.table_name for r in dl.dlq_table(parsed).collect()] == ["bets", "wins", "unknown"]
    assert {r.table_name for r in dl.dlq_table(parsed, fallback=False).collect()} == {"unknown"}


def test_replay_counts_attempts(spark):
    df = spark.createDataFrame([("mysql.shop.t", 0, 1, "k", "{bad", 2)],
                               "topic string, part long, off long, msg_key string, value string, attempt int")
    _, failed = dl.replay(df, {"id": "bigint"})
    assert failed.first().attempt == 3
    assert dl.replay(df, {"id": "bigint"}, exclude=["t"])[1].count() == 0


@pytest.mark.parametrize("top", [1, 3])
def test_top_reports_are_ordered(spark, sf_dir, top):
    rows = dl.dlq_tables(dl.analyse(letters(spark, sf_dir)), top).collect()
    assert len(rows) == top and [r.n_errors for r in rows] == sorted((r.n_errors for r in rows), reverse=True)
