"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidelog.llm import (
    components,
    decontamination,
    fingerprints,
    jaccard_join,
    line_dedup,
    quality,
    sentencepiece_codec,
    suffix_dedup,
    token_files,
    toxicity,
    warc,
)

from tidelog.session import work_dir

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, region bigint, set_id bigint, spans string, n_words int, x double, gone string, toxic int, dkey bigint"


def _texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passage, copy = "This LINE stands in many texts.", prose(60), prose(80)
    near = copy.split()
    near[40] = "changed"
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, copy), (7, copy), (8, " ".join(near)), (8, " ".join(near)), (9, prose(5000)),
        (10, "x" * 30000), (11, f"{line}\nown {prose(30)}"), (12, f"  {line.lower()}\t\n{prose(20)}"), (13, f"{prose(9)}\n{line}\n{line}"), (14, f"{prose(15)} {passage} {prose(12)}"),
        (15, f"{passage} {prose(40)}"), (None, f"{line}\n{passage}"), (None, None), (16, "a b\x00c ▁ \U0001f600!? 中文\r\n"), (17, prose(3) + "\n\n\n" + prose(4)), (17, "other text of the same id"),
    ]


ITEMS = [("q1", None), ("q2", ""), ("q3", "one TWO"), ("q4", " ".join(_texts()[5][1].split()[5:25])), ("q4", "one, two"), (None, " ".join(_texts()[14][1].split()[20:33]))]


@pytest.fixture(scope="module")
def rows():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None, 1, 1, "s", 1, 0.5, "g", 1, 7) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_decontamination(spark, docs, rows, none, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    want = [(d, n, hit, found) for d, n, hit, found in brute.contamination(rows, [(i or "null", t) for i, t in ITEMS])]
    take = lambda df: df.select("doc_id", "n_words", "n_hit", "items").collect()
    same(take(decontamination.contamination(docs, items)), want)
    monkeypatch.setattr(decontamination, "BLOCK", 3)  # several blocks meet in the same documents
    same(take(decontamination.contamination(docs, items)), want)
    assert decontamination.contamination(none, items).count() == 0
    same(take(decontamination.contamination(docs, items.limit(0))), [(d, n, 0, []) for d, n, _, _ in want])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha so beta gamma delta"), (3, "alpha " + "so " * 9 + "beta gamma delta")], "doc_id int, text string")
    items = spark.createDataFrame([("i", "alpha beta gamma delta")], "item_id string, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in decontamination.search(decontamination.build_index(docs), items, slop=1).collect()}
    assert got == {1: (["i"], []), 2: ([], ["i"]), 3: ([], [])}


@pytest.mark.parametrize("region_size", [1000, 2])
def test_jaccard_join(docs, rows, none, region_size):
    same(jaccard_join.near_duplicates(docs, region_size=region_size).collect(), brute.components(rows))
    assert jaccard_join.near_duplicates(none).count() == 0


def test_jaccard_join_of_a_dense_group(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(60):
        ws = list(base)
        for k in rng.sample(range(120), rng.randint(0, 4)):
            ws[k] = f"v{rng.randint(0, 9)}"
        rows.append((d, " ".join(ws)))
    rows += [(100 + d, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(40)) + " " + " ".join(base[:30])) for d in range(20)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string"), region_size=8).collect()
    same(got, brute.components(rows))


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(chain, "a int, b int")).collect())
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100, 102: 100}


def test_quality(spark, docs, rows, none):
    labels = spark.createDataFrame([(6, 1), (6, 0), (9, 0), (14, 1), (15, 1), (None, 1), (3, None)], "doc_id bigint, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (6, 7)}) == 1
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0


def test_monotone():
    import numpy as np

    assert quality.monotone(np.array([0.0, 2, 1, 3]), np.array([1.0, 1, 3, 1])).tolist() == [0, 1.25, 1.25, 3]


def test_line_dedup(docs, rows, none):
    same(line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect(), brute.line_dedup(rows))
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    same([(r.doc_id, r.text or "") for r in kept.collect()], [(d, t) for d, _, _, t in brute.line_dedup(rows)])
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.SortedRuns(spark, fanout=2)
    for low in (30, 20, 10, 0):
        runs.add(spark.createDataFrame([(1, 1, low), (low, 2, low + 1)], "h1 bigint, h2 bigint, doc_id bigint"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    merged = runs.merged()
    assert {r.fresh for r in merged.collect()} == {True}
    same(merged.drop("fresh").collect(), [(1, 1, 4, 30), (30, 2, 1, 31), (20, 2, 1, 21), (10, 2, 1, 11), (0, 2, 1, 1)])


def lines_rows(kind):
    rng = random.Random(11)
    name = (lambda k: k) if kind == "bigint" else (lambda k: f"d{k:03d}")
    shared = [f"the shared line number {k} of the corpus" for k in range(6)]
    return [(name(k), "\n".join([rng.choice(shared), f"own line of document {k} here", rng.choice(shared).upper(), "short"])) for k in range(60)]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_lines_of_batches_added_to_stored_runs(spark, kind):
    rows = lines_rows(kind)
    rows += [(rows[5][0], "another text of the same id\n" + rows[7][1])] + [(rows[9][0], f"{rows[9][1]}\n{k}") for k in range(30)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    take = lambda df: df.select("doc_id", "n_lines", "n_dropped", "text").collect()
    want = brute.line_dedup(rows)
    same(take(line_dedup.drop_repeated_lines(docs)), want)
    cut = sorted({d for d, _ in rows})[20]
    folder = work_dir(spark, "test-runs")
    early, late = docs.where(docs.doc_id > cut), docs.where(docs.doc_id <= cut)  # smaller ids come later
    line_dedup.drop_repeated_lines(early, runs=line_dedup.SortedRuns(spark, folder, fanout=2)).count()
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]:
        spark.sql(f"DROP TABLE {name}")  # as in a session of its own
    again = line_dedup.SortedRuns(spark, folder)
    got = take(line_dedup.drop_repeated_lines(late, runs=again))
    same(got, [r for r in want if r[0] <= cut])
    whole = line_dedup.SortedRuns(spark)
    held = docs.selectExpr("doc_id", "text").select("doc_id", F.explode(line_dedup.placed_keys(F.col("text"), 20)).alias("k")).select("doc_id", "k.h.h1", "k.h.h2")
    whole.add(held)
    same(again.merged().collect(), [tuple(r) for r in whole.merged().collect()])
    again.forget()
    whole.forget()


def test_runs_meet_where_they_lie(spark):
    runs = line_dedup.SortedRuns(spark, fanout=9)
    for first in (0, 50):
        runs.add(spark.range(first, first + 100).select(F.col("id").alias("h1"), (F.col("id") * 2).alias("h2"), F.lit(first).alias("doc_id")))
    one, two = (runs._table(n) for n in runs.levels[0])
    assert two.where("fresh").count() == 50  # the others were known
    plan = line_dedup._merge(one.hint("merge"), two)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") >= 2
    runs.forget()


def test_lines_of_one_hot_line_and_hot_id(spark):
    hot = "a line that a third of all documents hold"
    rows = [(k, f"{hot}\nown text number {k} of this corpus") for k in range(300)] + [(1000, f"{k} lines of the hot document\n{hot}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    same(line_dedup.drop_repeated_lines(docs).collect(), brute.line_dedup(rows))


def test_warc(spark, none, monkeypatch):
    pages = [(5, "http://a/\r\nx y", "<p>one</p>"), (2, None, "<p>one</p>"), (9, "http://b", None), (7, "http://c", ""), (3, "http://d", "<p>é" + "z" * 50000), (3, "http://e", "<p>one</p>"), (None, "http://f", "<p>one</p>")]
    frame = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id bigint, url string, html string, shard int, sha string")
    for min_bytes in (0, 1):
        manifest = warc.write_warc(frame, min_bytes=min_bytes, shard_records=2, file_bytes=200)
        first = {h: min(i for i, _, g in pages if (g or "") == (h or "") and i is not None) for _, _, h in pages}
        want = []
        for i, _, h in pages:
            raw = (h or "").encode()
            ref = first[h] if len(raw) >= min_bytes and i != first[h] else None
            want.append((i, len(raw), warc.digest(raw), "response" if ref is None else "revisit", ref))
        same(warc.read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), want)
    again = warc.write_warc(frame.repartition(5), min_bytes=1, shard_records=2, file_bytes=200)
    assert {(r.file, r.sha256) for r in again.collect()} == {(r.file, r.sha256) for r in manifest.collect()}
    assert warc.read_warc(warc.write_warc(frame.limit(0))).count() == 0


def test_warc_of_awkward_ids(spark):
    ids = ["", "a\r\nWARC-Type: x", "é", "a b", "%41", None, "", "z" * 300, None]
    pages = spark.createDataFrame([(i, None, f"<p>{k % 4}</p>") for k, i in enumerate(ids)], "page_id string, url string, html string").repartition(4)
    by = {}
    for k, i in enumerate(ids):
        by.setdefault(k % 4, []).append(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in by.items()}
    want = [(i, "response" if first[k % 4] in (None, i) else "revisit", None if first[k % 4] in (None, i) else first[k % 4]) for k, i in enumerate(ids)]
    got = warc.read_warc(warc.write_warc(pages, shard_records=2), "string")
    same(got.select("page_id", "record_type", "refers_to").collect(), want)


def test_warc_of_one_hot_id_and_payload(spark):
    rows = [(1, f"http://{k}", f"<p>{k}</p>") for k in range(60)] + [(k, f"http://{k}", "<p>same</p>") for k in range(60)]
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(5), shard_records=16)
    files = manifest.collect()
    assert len({r.shard for r in files}) >= 7 and sum(r.records for r in files) == 120  # the hot id is in several shards
    back = warc.read_warc(manifest, "int").groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in back} == {"response": 61, "revisit": 59}


def test_sentencepiece(docs, rows, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = sentencepiece_codec.encode(docs, PIECES)
    same([(r.doc_id, r.ids) for r in encoded.collect()], [(d, library.encode(t or "")) for d, t in rows])
    same([tuple(r) for r in sentencepiece_codec.decode(encoded, PIECES).collect()], [(d, library.decode(library.encode(t or ""))) for d, t in rows])
    assert sentencepiece_codec.encode(none, PIECES).count() == 0


@pytest.mark.parametrize("group", [4096, 1])
def test_suffix_dedup(docs, rows, none, group):
    got = suffix_dedup.remove_repeats(docs, group=group, with_kept=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    same([(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got], brute.repeats(rows))
    plain = suffix_dedup.remove_repeats(docs, group=group).select("doc_id", "kept_sha256").collect()
    same(plain, [(d, brute.sha(k)) for d, _, _, _, k in brute.repeats(rows)])
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_prefix_intervals():
    import numpy as np

    # Suffixes of banana: a, ana, anana, banana, na, nana.
    assert sorted(map(tuple, suffix_dedup.prefix_intervals(np.array([1, 3, 0, 0, 2])).tolist())) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_fingerprints(docs, rows, none):
    got = fingerprints.compare_with_edits(docs).select("doc_id", "n_chars", "edited_sha256").collect()
    want = [(d, len(t or ""), brute.sha(brute.edited(t or "", n))) for (d, t), n in zip(rows, brute.successor_texts(rows))]
    same(got, want)
    trees = {r.doc_id: r for r in fingerprints.compare_with_edits(docs).collect()}
    assert trees[4].fingerprint == trees[5].fingerprint != trees[6].fingerprint and trees[6].near_next == 1.0
    assert fingerprints.compare_with_edits(none).count() == 0


@pytest.mark.parametrize("ranges", [1, 3, 50])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_next_document_over_ranges(spark, ranges, kind):
    rows = [(k if kind == "int" else f"{k:03}", None if k % 7 == 0 else f"text {k}. " * (k % 5) + "end") for k in range(40)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)
    got = fingerprints.compare_with_edits(docs, ranges=ranges).select("doc_id", "n_chars", "edited_sha256").collect()
    texts = [t or "" for _, t in rows]
    same(got, [(d, len(t or ""), brute.sha(brute.edited(t or "", n))) for (d, t), n in zip(rows, [*texts[1:], texts[0]])])
    alone = fingerprints.compare_with_edits(docs.where(docs.doc_id == rows[3][0]), ranges=ranges).collect()
    assert [(r.doc_id, r.near_next) for r in alone] == [(rows[3][0], 1.0)]


def test_changed_paragraphs(spark):
    lines = [f"line {k}" for k in range(30)]
    other = [*lines[:11], "changed", *lines[12:], "new"]
    tree = lambda ls: fingerprints.merkle_tree(spark.createDataFrame([(1, "\n".join(ls)), (2, "same")], "doc_id int, text string"))
    assert [tuple(r) for r in fingerprints.changed_paragraphs(tree(lines), tree(other)).collect()] == [(1, [11, 30])]


def test_edits_are_aligned_by_content(spark):
    lines = [f"line {k}" for k in range(40)]
    cases = {
        1: (lines, ["new first", *lines]), 2: (lines, lines[:17] + lines[18:]), 3: (lines, lines[:20] + ["changed"] + lines[21:]), 4: (lines, lines),
        5: (lines, [lines[-1], *lines[:-1]]), 6: (["a", "b", "a"], ["a", "a", "a", "b"]), 7: (["x"], [""]), 8: (lines, [*lines, "last"]), 9: (lines[:16], lines[:16] + ["p"] * 9),
    }
    frame = lambda side: spark.createDataFrame([(k, "\n".join(v[side])) for k, v in cases.items()], "doc_id int, text string")
    got = {r.doc_id: (r.added, r.removed) for r in fingerprints.edits(fingerprints.merkle_tree(frame(0)), fingerprints.merkle_tree(frame(1))).collect()}
    assert got == {1: ([0], []), 2: ([], [17]), 3: ([20], [20]), 5: ([], []), 6: ([2], []), 7: ([0], [0]), 8: ([40], []), 9: (list(range(16, 25)), [])}


def test_token_files(docs, rows, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    manifest = token_files.write_token_files(docs, BYTES)
    got = token_files.read_documents(manifest).collect()
    same([(r.doc_id, r.n_tokens) for r in got], [(d, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows])
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:k]) for k in range(len(ordered))]
    assert [r.doc_id for r in ordered] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    for shard in manifest.collect():
        _, sequences = token_files.open_shard(shard.folder, shard.shard)
        mask = [m for row in sequences.column("mask").to_pylist() for m in row]
        assert sum(mask) == shard.n_tokens and mask == sorted(mask, reverse=True)
    assert token_files.read_documents(token_files.write_token_files(none, BYTES)).count() == 0


def test_added_tokens_are_encoded_as_the_library_does(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    text = "before<|endoftext|> after 'quoted' it's we'll"
    ids = [*Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids, 2]
    frame = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert token_files.read_documents(token_files.write_token_files(frame, BYTES)).first().ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_toxicity(spark, docs, rows, none):
    labels = spark.createDataFrame([(6, 1), (6, 0), (9, 0), (14, 0), (15, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = toxicity.severity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.expected_severity <= 3 for r in got)
    assert {r.toxic for r in toxicity.severity(docs, labels.limit(0)).collect()} == {False}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    same([(r.doc_id, r.text) for r in kept.collect()], [(d, t) for d, t in rows if d not in {r.doc_id for r in got if r.toxic} or d is None and not [r for r in got if r.doc_id is None and r.toxic]])
    assert toxicity.severity(none, labels).count() == 0
