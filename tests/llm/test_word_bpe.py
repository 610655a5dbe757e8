"""Byte-pair encoding of words against the tokenizers library."""

import random

import brute
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidelog.llm import queries, word_bpe
from tidelog.llm import text as tx

WORDS = public_tokenizers.path("word_bpe_49k.json")
CLASHING = "doc_id bigint, text string, ids string, n_tokens string, decoded int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def encoded(texts):
    coder, out = word_bpe.codec(WORDS), []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for _, data, offsets in tx.text_chunks([batch]):
        ids, counts = coder.encode(data, offsets)
        ends = np.cumsum(counts)
        out += list(zip((ids[b - n : b].tolist() for b, n in zip(ends, counts)), coder.decode(ids, counts)))
    return out


def test_query_equals_the_library(spark, sf_dir, library):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
    want = []
    for doc, text in docs:
        ids, decoded = expected(library, text)
        want.append((doc, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(decoded)))
    assert sorted(tuple(r) for r in queries.op11_word_bpe(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("alphabet,longest", [
    ("etaoinshrdlu", 25), ("ab", 40), ("abcxyzäñß'.,!?0123456789 ", 60), ("aΣσςİıﬁ中文한국e\u0301\u0308\u00a0\u3000\x1c\x85<|>😀 \n", 30),
])
def test_random_texts(library, alphabet, longest):
    rng = random.Random(len(alphabet))
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(4000)]
    assert encoded(texts) == [expected(library, t) for t in texts]


def test_special_tokens_long_words_and_contractions(library):
    texts = [
        None, "", " \t\n", "a<|endoftext|>B <|startoftext|><|endoftext|>é<|endoftext|>\u0301 <|x <|endoftext|", "</w> a</w>b \x00", "Don't WE'LL it's'S 'tis",
        "a" * 70001, "haha" * 3000, "the" * 40 + "z" * 30, "?!" * 900, "é" * 500, "one word" * 2000,
    ]
    assert encoded(texts) == [expected(library, t) for t in texts]


def test_only_words_with_a_failing_border_are_merged_exactly(monkeypatch):
    coder = word_bpe.WordBpe(WORDS)
    merged = []
    exact = coder._merge_all
    monkeypatch.setattr(coder, "_merge_all", lambda codes, starts, ends: merged.extend(ends - starts) or exact(codes, starts, ends))
    words = ["the", "photograph", "xylophonist", "qzvkj", "aaaaaaa"]
    tokens, counts = coder.encode_words(words)
    ends = np.cumsum(counts)
    for word, n, end in zip(words, counts, ends):
        codes = coder._codes(word + "</w>")
        assert tokens[end - n : end].tolist() == coder.merge(coder.symbol[codes].tolist())
    assert len(merged) < len(words)


def test_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "twice the same"), (3, "twice the same"), (None, "no id"), (4, "x" * 5000)]
    docs = spark.createDataFrame([(d, t, "a", "b", 3) for d, t in rows], CLASHING).repartition(2)
    out = word_bpe.encode(docs, WORDS)
    key = lambda r: str(r)
    want = [(d, *expected(library, t)) for d, t in rows]
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in out.collect()), key=key) == sorted(want, key=key)
    back = word_bpe.decode(out.select("doc_id", "ids"), WORDS)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=key) == sorted(((d, x) for d, _, x in want), key=key)
    assert word_bpe.encode(docs.limit(0), WORDS).count() == 0
    assert word_bpe.decode(spark.createDataFrame([(1, None), (2, [320, None, -5, 10**6])], "doc_id int, ids array<int>"), WORDS).collect() == [(1, ""), (2, library.decode([320]))]


def test_unsupported_files(tmp_path):
    import json

    spec = json.load(open(WORDS))
    spec["model"]["byte_fallback"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        word_bpe.WordBpe(str(tmp_path / "v.json"))
