"""Chunk bounds, snapshots between marks, position intervals and signed rollups."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators.state import current_state
from tidelog.session import work_dir
from tidelog.sources import snapshot as snap
from tidelog.sources.files import Folder
from tidelog.sources.rollups import DeltaRollup
from tidelog.streaming import intervals
from tidelog.streaming.intervals import TakenPositions, once


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("expr", ["id * id * id", "pmod(id * 7919, 20000) * 3 - 50000", "CAST(exp(id / 1500.0) * 1000 AS BIGINT)"])
def test_chunks_are_alike_however_keys_are_spread(spark, expr):
    rows = spark.range(20000).select(F.expr(expr).alias("k")).distinct()
    bounds = snap.chunk_bounds(rows, "k", 16)
    sizes = [r["count"] for r in rows.groupBy(snap.chunk_number("k", bounds).alias("c")).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * min(sizes)


def test_every_row_is_in_one_chunk(spark):
    rows = spark.createDataFrame([(None,), (1,), (1,), (5,), (9,), (9,), (9,), (100,)], "k int")
    for chunks in (1, 2, 4, 50):
        bounds = snap.chunk_bounds(rows, "k", chunks)
        conditions = snap.chunk_predicates("k", bounds)
        assert len(conditions) == len(bounds) + 1
        by_condition = [sorted(str(r.k) for r in rows.where(c).collect()) for c in conditions]
        numbered = rows.select("k", snap.chunk_number("k", bounds).alias("c")).collect()
        assert by_condition == [sorted(str(r.k) for r in numbered if r.c == c) for c in range(len(conditions))]
    days = spark.sql("SELECT explode(sequence(DATE '2020-01-01', DATE '2020-12-31')) AS d")
    bounds = snap.chunk_bounds(days, "d", 4)
    assert len(bounds) == 3 and sum(days.where(c).count() for c in snap.chunk_predicates("d", bounds)) == 366
    assert snap.chunk_bounds(rows.limit(0), "k", 4) == []
    with pytest.raises(ValueError):
        snap.chunk_bounds(rows, "k", 0)


def test_bounds_need_one_pass_and_no_sort(spark):
    plan = physical(spark.range(100).agg(F.percentile_approx("id", [0.5], 20)))
    assert "partial_percentile_approx" in plan and "Sort" not in plan.replace("SortAggregate", "")


def test_snapshot_between_marks_with_random_changes(spark):
    """Chunks read at any moment between their marks give the final state, whatever happened meanwhile."""
    rng = random.Random(4)
    keys = list(range(40)) + [None]
    state, log, versions = {k: 0 for k in keys[:30]}, [], {0: {k: 0 for k in keys[:30]}}
    for pos in range(1, 301):
        k = rng.choice(keys)
        if k in state and rng.random() < 0.4:
            del state[k]
            log.append((k, None, 1, pos))
        else:
            state[k] = pos
            log.append((k, pos, 0, pos))
        versions[pos] = dict(state)
    rows, start = [], 40
    for chunk in range(4):
        low = start + chunk * 50
        high, at = low + 49, low + rng.randrange(50)
        rows += [(k, v, 0, low, high) for k, v in versions[at].items() if (-1 if k is None else k) % 4 == chunk]
        log_from = start
    snapshot = spark.createDataFrame(rows, "id int, v int, _is_deleted int, _low bigint, _high bigint").repartition(3)
    changes = spark.createDataFrame([e for e in log if e[3] > log_from], "id int, v int, _is_deleted int, pos bigint").repartition(3)
    merged = snap.between_marks(snapshot, changes, ["id"], "pos")
    assert {r.id: r.v for r in current_state(merged, ["id"], ["pos"]).collect()} == state
    assert merged.columns == ["id", "v", "_is_deleted", "pos"]
    assert {r.id for r in snap.between_marks(snapshot, changes.limit(0), ["id"], "pos").collect()} == {r[0] for r in rows}
    assert "NestedLoop" not in physical(merged) and "Cartesian" not in physical(merged)


def offsets(spark, rows):
    return spark.createDataFrame(rows, "topic string, off bigint, lo string").repartition(3)


def taken(spark):
    return TakenPositions(spark, work_dir(spark, "test-taken"), ["topic"], "off")


def test_positions_are_taken_once_and_the_state_holds_the_gaps(spark, monkeypatch):
    t = taken(spark)
    first = offsets(spark, [("a", k, "x") for k in range(1000)] + [("a", 5, "x"), ("b", 7, "x"), (None, 3, "n"), ("a", None, "n"), (None, 3, "n")])
    got = t.fresh(first, 0)
    assert got.columns == first.columns
    assert sorted((str(r.topic), str(r.off)) for r in got.collect()) == sorted([("a", str(k)) for k in range(1000)] + [("b", "7"), ("None", "3"), ("None", "3"), ("a", "None")])
    assert sorted((r[0], r.lo, r.hi) for r in t.intervals().collect()) == [("a", 0, 999), ("b", 7, 7)]
    second = offsets(spark, [("a", k, "y") for k in range(990, 1010)] + [("a", 2000, "y"), ("b", 8, "y"), ("b", 6, "y"), ("b", 7, "y")])
    assert sorted((r.topic, r.off) for r in t.fresh(second, 1).collect()) == [*[("a", k) for k in range(1000, 1010)], ("a", 2000), ("b", 6), ("b", 8)]
    again = t.fresh(second, 1)  # the same batch once more gives the same rows
    assert again.count() == 13
    assert sorted((r[0], r.lo, r.hi) for r in t.intervals().collect()) == [("a", 0, 1009), ("a", 2000, 2000), ("b", 6, 8)]
    t.fresh(offsets(spark, [("a", k, "z") for k in range(1005, 2001)]), 2)
    assert sorted((r[0], r.lo, r.hi) for r in t.intervals().collect()) == [("a", 0, 2000), ("b", 6, 8)]
    assert [n for n in Folder(spark, t.path).names() if n.startswith("state=")] == ["state=1", "state=2"]
    assert t.fresh(offsets(spark, []), 3).count() == 0 and t.intervals().count() == 2


def test_positions_of_a_hot_partition_are_looked_at_in_spans(spark, monkeypatch):
    monkeypatch.setattr(intervals, "SPAN_BITS", 4)
    t, rng, seen = taken(spark), random.Random(5), set()
    for batch_id in range(4):
        wanted = [rng.randrange(200) for _ in range(120)]
        got = [r.off for r in t.fresh(offsets(spark, [("hot", k, "x") for k in wanted]), batch_id).collect()]
        assert sorted(got) == sorted(set(wanted) - seen)
        seen |= set(wanted)
    held = t.intervals().collect()
    assert {k for r in held for k in range(r.lo, r.hi + 1)} == seen and all(r.lo >> 4 == r.hi >> 4 == r.span for r in held)


def test_intervals_merge_in_any_grouping(spark):
    rng = random.Random(6)
    parts = [[(1, 0, k, k) for k in rng.sample(range(100), 40)] for _ in range(3)]
    frames = [spark.createDataFrame(p, "s int, span bigint, lo bigint, hi bigint") for p in parts]
    merge = lambda df: intervals.as_intervals(df, ["s"], "lo", "hi").select("s", "span", "lo", "hi")
    a, b, c = frames
    left = merge(merge(a.unionByName(b)).unionByName(c))
    right = merge(a.unionByName(merge(c.unionByName(b))))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(left) == rows(right) and {k for *_, lo, hi in rows(left) for k in range(lo, hi + 1)} == {k for p in parts for *_, k in p}


def test_sink_behind_positions(spark):
    got = []
    sink = once(taken(spark), lambda df, batch_id: got.append((batch_id, df.count())))
    for batch_id in (0, 1, 1):
        sink(offsets(spark, [("a", k, "x") for k in range(batch_id * 5, batch_id * 5 + 10)]), batch_id)
    assert got == [(0, 10), (1, 5), (1, 5)]


def test_rollup_follows_updates_deletes_moves_and_repeats(spark):
    schema = "id int, v int, ts timestamp_ntz, amount decimal(10,2), _is_deleted int"
    rollup = DeltaRollup(spark, work_dir(spark, "test-rollup"), ["id"], ["v"], "ts", "amount", buckets=4)
    with pytest.raises(ValueError):
        rollup.read()
    rng, batches, rows = random.Random(7), [], []
    for v in range(1, 6):
        for k in rng.sample(range(30), 18):
            rows.append((k, v, f"2024-0{rng.randint(1, 3)}-0{rng.randint(1, 3)} 10:00:00", f"{rng.randint(1, 900)}.25", int(rng.random() < 0.2)))
    rng.shuffle(rows)
    batches = [rows[:20], rows[20:60], rows[60:], rows[10:40]]
    frame = lambda data: spark.createDataFrame(data, "id int, v int, ts string, amount string, _is_deleted int").selectExpr(
        "id", "v", "CAST(ts AS timestamp_ntz) AS ts", "CAST(amount AS decimal(10,2)) AS amount", "_is_deleted")
    assert frame([]).schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    for batch_id, data in enumerate(batches):
        rollup.apply(frame(data), batch_id)
        rollup.apply(frame(data), batch_id)  # delivered again
        if batch_id % 2:
            rollup.fold()
        live = {}
        for k, v, ts, amount, gone in sorted(rows if batch_id >= 2 else sum(batches[: batch_id + 1], []), key=lambda r: r[1]):
            live[k] = (ts[:10], float(amount), gone)
        want = {}
        for day, amount, gone in live.values():
            if not gone:
                total, n = want.get(day, (0, 0))
                want[day] = (total + amount, n + 1)
        assert {str(r.day): (float(r.total), r.n) for r in rollup.read().collect()} == want


def test_rollup_reads_no_table(spark):
    schema = "id int, v int, ts timestamp_ntz, amount int, _is_deleted int"
    rollup = DeltaRollup(spark, work_dir(spark, "test-rollup"), ["id"], ["v"], "ts", "amount", buckets=32)
    row = lambda k, v: (k, v, __import__("datetime").datetime(2024, 1, 1 + k % 20), 1, 0)
    rollup.apply(spark.createDataFrame([row(k, 1) for k in range(2000)], schema), 0)
    held = rollup.rows.may_hold(spark.createDataFrame([(3,)], "id int"))
    assert len(held) == 1  # one bucket of 32 for one key
    rollup.apply(spark.createDataFrame([row(3, 2)], schema), 1)
    assert all("/increments/" in f for f in rollup.read().inputFiles())
