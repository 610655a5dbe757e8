import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from tidelog.fixtures import load
from tidelog.operators import state as st

LOG = "k long, v string, ym int, _version long, _is_deleted int, arrival long"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_delete_then_insert_again_and_late_delete(spark):
    df = log(spark, [
        (1, "a", 1, 1, 0, 1), (1, "a", 1, 2, 1, 2), (1, "b", 1, 3, 0, 3),   # comes back
        (2, "a", 1, 1, 0, 4), (2, "a", 1, 2, 1, 5),                          # stays deleted
        (3, "new", 1, 5, 0, 6), (3, "old", 1, 2, 1, 7),                      # late delete of an older version
        (4, "x", 1, 1, 1, 8),                                                # deleted before ever inserted
    ])
    assert rows(st.current_state(df, ["k"]), "k", "v") == [(1, "b"), (3, "new")]
    assert rows(st.raw_live(df), "k", "v") == [(1, "a"), (1, "b"), (2, "a"), (3, "new")]


def test_equal_versions_last_arrival_wins(spark):
    df = log(spark, [(1, "first", 1, 7, 0, 10), (1, "second", 1, 7, 0, 11)])
    assert rows(st.current_state(df, ["k"]), "k", "v") == [(1, "second")]


def test_partition_scope_keeps_both_sides_of_a_move(spark):
    df = log(spark, [(1, "jan", 1, 1, 0, 1), (1, "feb", 2, 2, 0, 2)])
    assert rows(st.current_state(df, ["k"]), "v") == [("feb",)]
    assert rows(st.current_state(df, ["k"], scope="partition", partition=["ym"]), "v") == [("feb",), ("jan",)]


def test_null_key_is_one_key_and_keyless_is_refused(spark):
    df = log(spark, [(None, "a", 1, 1, 0, 1), (None, "b", 1, 2, 0, 2)])
    assert rows(st.current_state(df, ["k"]), "v") == [("b",)]
    with pytest.raises(ValueError):
        st.current_state(df, [])


def test_empty_log(spark):
    assert st.current_state(log(spark, []), ["k"]).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st_.lists(st_.tuples(st_.integers(1, 4), st_.integers(0, 5), st_.booleans()), min_size=1, max_size=20), st_.randoms())
def test_order_and_repetition_do_not_matter(spark, changes, rng):
    base = [(k, f"{k}-{v}-{i}", 1, v, int(d), i) for i, (k, v, d) in enumerate(changes)]
    again = base + rng.sample(base, len(base) // 2)
    rng.shuffle(again)
    expected = {}
    for r in base:
        if r[0] not in expected or (r[3], r[5]) > (expected[r[0]][3], expected[r[0]][5]):
            expected[r[0]] = r
    want = sorted((r[0], r[1]) for r in expected.values() if not r[4])
    assert rows(st.current_state(log(spark, again), ["k"]), "k", "v") == want


def test_versioned_collapse_in_any_order(spark):
    events = [(1, 1, 10.0, 1), (1, 1, 10.0, -1), (1, 2, 12.0, 1), (2, 1, 5.0, -1), (2, 1, 5.0, 1), (3, 1, 7.0, 1)]
    random.Random(3).shuffle(events)
    df = spark.createDataFrame(events, "k long, version int, amount double, sign int")
    assert rows(st.versioned_collapse(df, ["k"], "version"), "k", "version", "amount") == [(1, 2, 12.0), (3, 1, 7.0)]
    assert rows(st.collapse_sum(df, ["k"], ["amount"]), "k", "amount") == [(1, 12.0), (3, 7.0)]


def test_merged_states_equal_recomputation(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    whole = st.agg_state(events, ["user_id"], uniqs={"n": F.col("event_id")})
    split = st.agg_state(events, ["user_id", "event_type"], uniqs={"n": F.col("event_id")})
    exact = dict(rows(events.groupBy("user_id").agg(F.count_distinct("event_id").alias("n")), "user_id", "n"))
    for df in (whole, split):
        for user, n in rows(st.agg_merge(df, ["user_id"]), "user_id", "n"):
            assert abs(n - exact[user]) <= max(2, 0.05 * exact[user])


def test_upsert_of_known_properties(spark):
    """Properties of the 0.01 data set found independently."""
    log_ = load(spark, "/root/testdata/sf0.01", "user_changes")
    live = st.current_state(log_, ["user_id"], ["ts", "event_id"])
    assert tuple(live.agg(F.count("*"), F.sum("event_id")).first()) == (120, 1183126)
