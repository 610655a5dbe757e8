"""The registered queries over the smallest tables, against SQL, the public libraries or brute force."""

import sys
import zlib
from pathlib import Path

import brute
import duckdb
import numpy as np
import oracle
import public_tokenizers
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from tidelog.llm import queries, toxicity  # noqa: E402
from tidelog.session import staged, table  # noqa: E402


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLES[name]) is None


def test_all_are_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {*(f"op{n}" for n in range(1, 14)), "pipeline"}


def test_suffix_dedup(spark, sf_dir, docs):
    got = sorted(tuple(r) for r in queries.op7_suffix_dedup(spark, sf_dir).collect())
    assert got == [(d, n, gone, spans, brute.sha(kept)) for d, n, gone, spans, kept in brute.repeats(docs)]
    assert any(r[2] for r in got)


def test_token_files(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for doc, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op9_token_files(spark, sf_dir).collect()) == want


def test_sentencepiece(spark, sf_dir, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries.op6_sentencepiece(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc, text in docs:
        ids = library.encode(text or "")
        assert got[doc].ids == ids and got[doc].n_tokens == len(ids) and got[doc].round_trip
        assert got[doc].decoded_sha256 == brute.sha(library.decode(ids))


def test_quality_on_the_held_out_fold(spark, sf_dir):
    sf = str(Path(sf_dir).parent / "sf0.01")
    marks = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    rows = queries.op3_quality(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in marks]
    assert len(test) > 50 and np.mean([r.predicted == marks[r.doc_id] for r in test]) >= 0.97


def test_toxicity_finds_toxic_and_leaves_clean(spark, sf_dir):
    sf = str(Path(sf_dir).parent / "sf0.1")
    marks = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    # Fitted on the labels of even ids, judged on the others.
    labels = table(spark, sf, "labels")
    rows = toxicity.severity(table(spark, sf, "documents"), labels.where("doc_id % 2 = 0")).collect()
    odd = [r for r in rows if r.doc_id % 2 and r.doc_id in marks]
    caught = np.mean([r.toxic for r in odd if marks[r.doc_id] == 1])
    wrong = np.mean([r.toxic for r in odd if marks[r.doc_id] == 0])
    assert caught >= 0.7 and wrong <= 0.02
    assert all(0 <= r.expected_severity <= 3 and 0 <= r.grade <= 3 for r in rows)
    toxic = [r.expected_severity for r in odd if marks[r.doc_id] == 1]
    assert np.mean(toxic) > 5 * np.mean([r.expected_severity for r in odd if marks[r.doc_id] == 0])


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, sf_dir), f"test-{name}")
        frames.append((docs, after))
        docs = after
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "sentencepiece"]
    for before, after in frames[:-1]:
        assert after.columns == before.columns
    before, after = frames[0]
    flags = {r.doc_id: r.toxic for r in toxicity.severity(before, table(spark, sf_dir, "labels")).collect()}
    assert rows(after) == [(d, t) for d, t in rows(before) if not flags[d]]
    before, after = frames[1]
    assert [(d, t or "") for d, t in rows(after)] == [(d, t) for d, _, _, t in brute.line_dedup(rows(before))]
    before, after = frames[2]
    assert rows(after) == [(d, t) for (d, t), (_, _, c) in zip(rows(before), brute.components(rows(before))) if c == d]
    before, after = frames[3]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    assert rows(after) == [(d, t) for (d, t), (_, _, hit, _) in zip(rows(before), brute.contamination(rows(before), items)) if not hit]
    before, after = frames[4]
    assert sorted(r.doc_id for r in after.collect()) == [d for d, _ in rows(before)]
