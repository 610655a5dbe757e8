"""The folding log and the upsert that finds its keys through it."""

import pytest
from pyspark.sql import functions as F

from tidelog.session import work_dir
from tidelog.sources.files import Folder
from tidelog.sources.folding import FoldingLog, LocatedTable

SCHEMA = "id bigint, v bigint, place string, amount int, _is_deleted int, part string"


def rows(spark, data):
    """(id, version, place, amount, deleted, source partition)"""
    return spark.createDataFrame(data, SCHEMA)


def new_log(spark, buckets=4, **options):
    return FoldingLog(spark, work_dir(spark, "test-folding"), ["id"], ["v"], buckets=buckets, **options)


def many(spark, ids, version, amount=1):
    return rows(spark, [(i, version, "a", amount, 0, "p") for i in ids])


def files(log):
    """{(run, bucket): data files}"""
    folder = Folder(log.spark, log.path)
    return {(e["run"], e["bucket"]): tuple(n for n in folder.names(f"runs/{e['run']}/_bucket={e['bucket']}") if n.endswith(".parquet")) for e in log.manifest()["runs"]}


def test_only_buckets_that_are_due_are_rewritten(spark):
    log = new_log(spark, buckets=8)
    log.append(many(spark, range(4000), 1), 0)
    first = files(log)
    busy = [r[0] for r in many(spark, range(4000), 1).where(log.bucket() == 3).select("id").collect()]
    log.append(many(spark, busy, 2, 7), 1)
    assert log.due(0.5) == [3] and log.fold(0.5) == [3]
    second = files(log)
    assert {k: f for k, f in second.items() if k[1] != 3} == {k: f for k, f in first.items() if k[1] != 3}
    assert len(second) == 8 and log.due(0.5) == []
    log.append(many(spark, busy[:5], 3, 9), 2)
    log.append(many(spark, range(0, 4000, 2), 4, 11), 3)
    folded = log.fold(0.5)
    third = files(log)
    assert folded and {k[1] for k in third if k in second}.isdisjoint(folded)
    got = {r.id: (r.v, r.amount) for r in log.state().collect()}
    want = {i: (4, 11) if i % 2 == 0 else (3, 9) if i in busy[:5] else (2, 7) if i in busy else (1, 1) for i in range(4000)}
    assert got == want


def test_generations_stay_readable_and_unnamed_runs_go(spark):
    log = new_log(spark)
    log.append(many(spark, range(50), 1), 0)
    before = log.rows()
    log.append(many(spark, range(50), 2), 1)
    log.fold(0)
    assert before.count() == 50 and {r.v for r in before.collect()} == {1}
    log._write_run(many(spark, range(9), 5))  # interrupted before its manifest
    assert log.state().where("v = 5").count() == 0 and log.rows().count() == 50
    assert len(log.vacuum(keep=1)) == 3
    assert log.state().count() == 50 and {r.v for r in log.state().collect()} == {2}


def test_a_batch_counts_once_and_a_lost_race_fails(spark):
    log = new_log(spark)
    assert log.append(many(spark, range(5), 1), 0) and not log.append(many(spark, range(9), 2), 0)
    assert log.append(many(spark, range(6), 2), 0, stream="other")
    stale = log.manifest()
    log.append(many(spark, range(7), 3), 1)
    with pytest.raises(RuntimeError):
        log._commit(stale, runs=[])
    assert log.state().count() == 7
    assert not Folder(spark, log.path).put("manifest/000000000001.json", "x")


def test_late_changes_and_tombstones(spark):
    log = new_log(spark, position="v", source=["part"], sources=["p", "q"])
    log.append(rows(spark, [(1, 1, "a", 1, 0, "p"), (2, 2, "a", 1, 0, "p"), (1, 10, "a", 1, 1, "p"), (2, 30, "a", 1, 1, "p")]), 0)
    assert log.low_mark() is None  # nothing of q yet
    log.fold(buckets=range(4))
    assert log.state().count() == 0 and log.latest().count() == 2
    log.append(rows(spark, [(1, 7, "a", 5, 0, "q")]), 1)  # older than the delete
    log.fold(buckets=range(4))
    assert log.state().count() == 0 and log.low_mark() == 7 and log.latest().count() == 2
    log.append(rows(spark, [(3, 20, "a", 1, 0, "q")]), 2)
    log.fold(buckets=range(4))
    assert log.low_mark() == 20
    assert sorted((r.id, r.v, r._is_deleted) for r in log.latest().collect()) == [(2, 30, 1), (3, 20, 0)]  # 1 is forgotten, 2 not yet
    log.append(rows(spark, [(1, 21, "b", 6, 0, "q"), (2, 25, "b", 6, 0, "q")]), 3)
    assert sorted((r.id, r.v) for r in log.state().collect()) == [(1, 21), (3, 20)]


def test_a_lookup_reads_only_what_may_hold_a_key(spark):
    log = new_log(spark, buckets=16)
    log.append(many(spark, range(0, 2000), 1), 0)
    log.append(many(spark, range(2000, 4000), 1), 1)
    found = log.may_hold(spark.createDataFrame([(2001,)], "id bigint"))
    assert len(found) <= 2 and log.manifest()["runs"][-1]["run"] in {e["run"] for e in found}
    assert len(log.may_hold(spark.range(10**6, 10**6 + 3).select("id"))) <= 1  # one false hit in some hundred
    plan = log._read(log.manifest(), found)
    assert 0 < len(plan.inputFiles()) <= 2
    assert [tuple(r) for r in log.lookup(spark.createDataFrame([(2001,), (2001,), (9999999,)], "id bigint")).select("id", "v").collect()] == [(2001, 1)]


def test_null_keys_and_empty_batches(spark):
    log = new_log(spark)
    with pytest.raises(ValueError):
        log.rows()
    log.append(rows(spark, []), 0)
    assert log.state().count() == 0 and log.lookup(spark.createDataFrame([(1,)], "id bigint")).count() == 0
    log.append(rows(spark, [(None, 1, "a", 1, 0, None), (None, 2, "a", 2, 0, None), (5, None, "a", 3, 0, "p")]), 1)
    assert sorted(((r.id, r.v, r.amount) for r in log.state().collect()), key=str) == [(5, None, 3), (None, 2, 2)]
    assert [r.amount for r in log.lookup(spark.createDataFrame([(None,)], "id bigint")).collect()] == [2]
    with pytest.raises(ValueError):
        FoldingLog(spark, "x", [], ["v"])


def located(spark, **options):
    table = LocatedTable(spark, work_dir(spark, "test-located"), ["id"], ["v"], "place", buckets=4, **options)
    table.create(rows(spark, [(i, 1, "abcd"[i % 4], i, 0, "p") for i in range(40)]))
    return table


def state(table):
    return {r.id: (r.v, r.place, r.amount) for r in table.read().collect()}


def test_upsert_rewrites_only_the_partitions_of_its_keys(spark):
    table = located(spark)
    folder = Folder(spark, table.data)
    names = lambda: {p: folder.names(f"place={p}") for p in "abcd"}
    before = names()
    touched = table.upsert(rows(spark, [(0, 2, "a", 100, 0, "p"), (4, 2, "b", 104, 0, "p"), (8, 2, "a", 0, 1, "p")]), 0)
    after = names()
    assert sorted(touched) == ["a", "b"]
    assert after["c"] == before["c"] and after["d"] == before["d"] and after["a"] != before["a"] != []
    got = state(table)
    assert got[0] == (2, "a", 100) and got[4] == (2, "b", 104) and 8 not in got and len(got) == 39


def test_upsert_scans_no_other_partition(spark):
    table = located(spark)
    scan = table.holding(["c"])
    scan.collect()
    read = scan.select(F.input_file_name()).distinct().collect()
    assert read and all("place=c" in r[0] for r in read)


def test_stale_and_late_changes_rewrite_nothing(spark):
    table = located(spark)
    table.upsert(rows(spark, [(3, 10, "d", 0, 1, "p"), (5, 10, "a", 55, 0, "p")]), 0)
    before = state(table)
    assert 3 not in before and before[5] == (10, "a", 55)
    assert table.upsert(rows(spark, [(3, 7, "d", 9, 0, "p"), (5, 4, "b", 9, 0, "p"), (6, 0, "c", 1, 1, "p")]), 1) == []
    assert state(table) == before
    assert table.upsert(rows(spark, [(3, 99, "d", 9, 0, "p")]), 1) == []  # the batch was applied before
    assert table.upsert(rows(spark, [(3, 11, "d", 9, 0, "p")]), 2) == ["d"]
    assert state(table)[3] == (11, "d", 9)


def test_upsert_of_null_keys_and_partitions_and_emptied_partitions(spark):
    table = located(spark)
    table.upsert(rows(spark, [(None, 5, None, 1, 0, "p"), (1000, 5, "new", 1, 0, "p")]), 0)
    assert state(table)[None] == (5, None, 1)
    table.upsert(rows(spark, [(None, 6, None, 1, 1, "p"), (1000, 6, "a", 2, 0, "p")]), 1)
    got = state(table)
    assert None not in got and got[1000] == (6, "a", 2)
    assert "place=new" not in Folder(spark, table.data).names()
    assert table.upsert(rows(spark, [(None, 5, "a", 1, 0, "p")]), 2) == []
