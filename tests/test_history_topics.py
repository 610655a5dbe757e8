"""Schemas that change in a stream, records with headers, hash trees, restarting funnels, sketch sets."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.model import HEADER_PREFIX, RECORD_SCHEMA
from tidelog.operators import bi
from tidelog.operators import dead_letters as dl
from tidelog.operators import history as hs
from tidelog.operators import quality as ql
from tidelog.session import work_dir
from tidelog.sources import read

HISTORY = [
    ("t", 0, "id", "bigint"), ("t", 0, "v", "string"),
    ("t", 100, "id", "bigint"), ("t", 100, "v", "int"), ("t", 100, "w", "date"),
    ("t", 200, "id", "bigint"), ("t", 200, "w", "date"),
    ("other", 50, "id", "string"),
]


def history(spark):
    return spark.createDataFrame(HISTORY, "table_name string, since bigint, column_name string, column_type string")


def message(off, image, op="c", pos=None):
    pos = off if pos is None else pos
    return ("x.y.t", 0, off, "k", f'{{"after":{image},"source":{{"pos":{pos},"file":"bin.000000"}},"op":"{op}"}}')


def test_every_change_is_typed_by_its_version(spark):
    rows = [
        message(1, '{"id":1,"v":"abc","w":"2024-01-01"}'),  # w is not known yet
        message(99, '{"id":2,"v":"12"}'),
        message(100, '{"id":3,"v":13,"w":"2024-02-03"}'),
        message(150, '{"id":4,"v":"abc","w":"nodate"}'),
        message(200, '{"id":5,"v":77,"w":"2024-02-04"}'),  # v is gone
        message(7, '{"id":6,"v":"x"}', pos="null"),
        ("x.y.t", 0, 8, "k", "broken"),
        message(9, '{"id":7}', op="?"),
    ]
    messages = spark.createDataFrame(rows, "topic string, part int, off bigint, msg_key string, value string")
    out = hs.typed_as_of(messages, history(spark), "t")
    assert [c for c in out.columns if c in ("id", "v", "w")] == ["id", "w"]
    got = {r.off: (r.since, r.id, None if r.w is None else str(r.w), r._problems) for r in out.collect()}
    assert got == {
        1: (0, 1, None, []), 99: (0, 2, None, []), 100: (100, 3, "2024-02-03", []), 150: (100, 4, None, ["v", "w"]), 200: (200, 5, "2024-02-04", []),
        7: (0, 6, None, []), 8: (0, None, None, []), 9: (0, None, None, ["op"]),
    }
    with pytest.raises(ValueError):
        hs.typed_as_of(messages, history(spark), "nothing")


def test_versions_meet_changes_of_their_table_only(spark):
    catalog = hs.versions(history(spark))
    changes = spark.createDataFrame([("t", 0), ("t", 99), ("t", 100), ("t", 10**12), ("other", 49), ("other", 50), ("none", 5), ("t", None)], "table_name string, pos bigint")
    got = {(r.table_name, r.pos): r.since for r in hs.as_of(changes, catalog, "pos").where("pos IS NOT NULL").collect()}
    assert got == {("t", 0): 0, ("t", 99): 0, ("t", 100): 100, ("t", 10**12): 200, ("other", 49): None, ("other", 50): 50, ("none", 5): None}
    assert hs.as_of(changes, catalog, "pos").where("pos IS NULL").collect()[0].since is None


def test_records_keep_headers_and_time(spark):
    path = work_dir(spark, "test-records")
    pairs = [{"key": HEADER_PREFIX + "topic", "value": "a.b.c"}, {"key": HEADER_PREFIX + "topic", "value": "a.b.last"}]
    import datetime

    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123000)
    rows = [("dlq.x", 1, 2, "k", "v", pairs, at), ("dlq.x", 1, 3, None, None, None, None), ("other", 0, 0, "k", "v", [], at)]
    spark.createDataFrame(rows, RECORD_SCHEMA).write.json(path)
    records = read.read_records(spark, r"dlq\..*", path=path)
    assert records.schema.names == RECORD_SCHEMA.names and not records.isStreaming
    got = {r.off: r for r in dl.parse_dlq(records).collect()}
    assert set(got) == {2, 3} and got[2].original_topic == "a.b.last" and got[2].ts == at and got[3].original_topic == "unknown"
    assert read.read_records(spark, "dlq", path=path, stream=True).isStreaming
    with pytest.raises(ValueError):
        read.read_records(spark, "dlq")


def test_broker_records_have_texts_for_bytes(spark):
    raw = spark.sql("SELECT 't' AS topic, 3 AS partition, 4L AS offset, CAST('k' AS BINARY) AS key, CAST('v' AS BINARY) AS value, "
                    "array(named_struct('key', 'h', 'value', CAST('x' AS BINARY))) AS headers, TIMESTAMP '2024-01-01 00:00:00' AS timestamp")  # fmt: skip
    out = read.broker_records(raw)
    assert out.schema.simpleString() == RECORD_SCHEMA.simpleString()
    assert out.first().headers[0].value == "x"


def pair(spark, n, changed):
    base = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 3).alias("p"))
    return base, base.withColumn("p", F.when(F.col("k").isin(changed), F.col("p") + 1).otherwise(F.col("p")))


def test_rows_that_move_follow_the_differences(spark):
    moved = {}
    for changed in ([], [5], list(range(0, 1000, 100))):
        a, b = pair(spark, 200_000, changed)
        left, right = ql.differing_rows(a, b, ["k"], ["p"], nodes=64, leaf_rows=32)
        moved[len(changed)] = left.count() + right.count()
        assert sorted((r.k, r.difference) for r in ql.checksum_diff(a, b, ["k"], ["p"], nodes=64, leaf_rows=32).collect()) == [(k, "changed") for k in changed]
    assert moved[0] == 0 and 2 <= moved[1] <= 200 and moved[10] <= 2000


def test_tree_with_missing_extra_repeated_and_null_keys(spark):
    a = spark.createDataFrame([(k, k) for k in range(500)] + [(None, 1), (None, 1), (7, 7)], "k int, p int")
    b = spark.createDataFrame([(k, k) for k in range(3, 503)] + [(None, 1), (7, 7)], "k int, p int")
    want = [(k, "missing") for k in range(3)] + [(k, "extra") for k in range(500, 503)]
    for nodes, leaf_rows in ((1, 10), (16, 4), (4096, 64)):
        got = ql.checksum_diff(a, b, ["k"], ["p"], nodes, leaf_rows).collect()
        keyed = sorted((r.k, r.difference) for r in got if r.k is not None)
        assert keyed == sorted(want)


def test_sampled_keys_are_those_of_a_full_sort(spark):
    rows = spark.range(5000).select((F.col("id") % 1700).alias("k"))
    salted = F.md5(F.concat_ws("|", F.lit("3"), F.col("k").cast("string")))
    for n in (1, 40, 1690, 5000):
        want = [r.k for r in rows.distinct().orderBy(salted, "k").limit(n).collect()]
        assert sorted(r.k for r in ql.sample_keys(rows, ["k"], n, 3).collect()) == sorted(want)
    assert ql.sample_keys(rows.limit(0), ["k"], 5).count() == 0


def reached(events, steps, within):
    best = {}
    by = {}
    for user, t, step in events:
        by.setdefault(user, []).append((t, step))
    for user, rows in by.items():
        chains = {(t, t) for t, s in rows if s == steps[0]}
        level = 1 if chains else 0
        for k, step in enumerate(steps[1:], 2):
            chains = {(start, t) for start, end in chains for t, s in rows if s == step and t > end and (within is None or t - start <= within)}
            level = k if chains else level
            if not chains:
                break
        best[user] = level
    return [(k, step, sum(1 for v in best.values() if v >= k)) for k, step in enumerate(steps, 1)]


@pytest.mark.parametrize("within,bucket", [(None, "1 HOUR"), (90, "1 HOUR"), (90, "7 SECONDS"), (20, "1 DAY")])
def test_funnel_honours_restarts_in_any_bucket(spark, within, bucket):
    rng = random.Random(within or 1)
    events = [(rng.randrange(40), rng.randrange(400), rng.choice("abcx")) for _ in range(900)] + [(99, t, "a") for t in range(50)] + [(98, 5, s) for s in "abc"]
    frame = spark.createDataFrame(events + [(None, 1, "a"), (1, None, "a")], "u int, t int, s string").withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    out = bi.funnel_restarts(frame.repartition(4), "u", "ts", "s", ["a", "b", "c"], None if within is None else f"{within} SECONDS", bucket)
    assert sorted((r.position, r.step, r.users) for r in out.collect()) == reached(events, "abc", within)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    with pytest.raises(ValueError):
        bi.funnel_restarts(frame, "u", "ts", "s", ["a", "a"])


def test_sketch_sets_of_large_periods(spark):
    users = spark.range(60000).select(F.col("id").alias("u"), F.explode(F.expr("array_compact(array(DATE '2024-01-01', CASE WHEN id % 3 = 0 THEN DATE '2024-01-08' END))")).alias("day"))
    row = bi.returning_users(bi.sketch_users(users, "u", ["day"]), "day", 7).first()
    assert abs(row.either_estimate - 60000) < 1500 and abs(row.returned_estimate - 20000) < 1500 and abs(row.lost_estimate - 40000) < 1500
