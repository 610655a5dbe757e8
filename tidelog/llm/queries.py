"""Registered queries of this subpackage and the SQL they must agree with.

Each query reads its whole tables and returns one row for each row of them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import (
    decontamination,
    fingerprints,
    hard_negatives,
    jaccard_join,
    line_dedup,
    quality,
    sentencepiece_codec,
    suffix_dedup,
    token_files,
    toxicity,
    warc,
    whitening,
    word_bpe,
)
from tidelog.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _alnum_words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op1_decontamination",
    f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {_alnum_words('text')} AS ws FROM documents),
    b AS (SELECT item_id, {_alnum_words('text')} AS ws FROM benchmark),
    iw AS (SELECT DISTINCT item_id, ws[p : p + least(10, len(ws)) - 1] AS win
           FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)),
    dw AS (SELECT doc_id, p, l, ws[p : p + l - 1] AS win
           FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS p
                 FROM d, (SELECT DISTINCT len(win) AS l FROM iw) WHERE len(ws) >= l)),
    hits AS (SELECT doc_id, p, l, item_id FROM dw JOIN iw USING (win)),
    cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hits) GROUP BY doc_id),
    found AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM hits GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
           CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
           sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


_STRIPPED = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"


@query(
    "op2_jaccard_join",
    f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS MATERIALIZED (
        SELECT DISTINCT doc_id, ws[p : p + least(5, len(ws)) - 1] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS p FROM w WHERE len(ws) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS MATERIALIZED (
        SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) c
        JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
    r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
    SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id
    FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
)
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op2_jaccard_links",
    f"""
    WITH w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS MATERIALIZED (
        SELECT DISTINCT doc_id, ws[p : p + least(5, len(ws)) - 1] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS p FROM w WHERE len(ws) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS (
        SELECT a, count(*) AS n_links
        FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) c
        JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k) GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.n_links, 0) AS n_links
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN l ON l.a = d.doc_id
    """,
)
def op2_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), links=True).select("doc_id", "n_shingles", "n_links")


QUALITY_THRESHOLD = 0.3


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


@query(
    "op4_line_dedup",
    f"""
    WITH l AS MATERIALIZED (
        SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], {_STRIPPED}), '{UPPER}', '{LOWER}') AS k
        FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
    r AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT l.*, r.keeper IS NOT NULL AND l.doc_id < r.keeper AS gone FROM l LEFT JOIN r USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE = " + ".join(f"CAST(b[i * 5 + {k + 1}] AS INT) * {16 >> k}" for k in range(5))


@query(
    "op5_warc",
    f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS b FROM pages),
    d AS (SELECT page_id, html, array_to_string(list_transform(range(32), lambda i: substr('{_ALPHABET}', {_FIVE} + 1, 1)), '') AS digest FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM d)
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM f
    """,
)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = warc.read_warc(warc.write_warc(pages), pages.schema["page_id"].dataType.simpleString())
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def _tree_sql(text: str) -> str:
    paragraphs = f"list_transform(string_split({text}, chr(10)), lambda p: sha256(p))"
    return (
        f"sha256(array_to_string(list_transform(range(1, len({paragraphs}) + 1, {fingerprints.SECTION}), "
        f"lambda s: sha256(array_to_string(({paragraphs})[s : s + {fingerprints.SECTION - 1}], '-'))), '/'))"
    )


def _leaves_sql(text: str) -> str:
    return f"list_distinct(flatten(list_transform(string_split({text}, chr(10)), lambda p: regexp_extract_all(p, '{fingerprints.BLOCK}'))))"


def _like_sql(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE {common} / (len({a}) + len({b}) - {common})::DOUBLE END"


@query(
    "op8_fingerprints",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
    n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next FROM d),
    e AS (SELECT *, left(text, n - n // 4) || left(next, n // 4) AS edited FROM n),
    t AS MATERIALIZED (SELECT *, {_leaves_sql('text')} AS a, {_leaves_sql('edited')} AS b, {_leaves_sql('next')} AS c FROM e)
    SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {_tree_sql('text')} AS fingerprint,
           {_tree_sql('edited')} AS edited_fingerprint, {_like_sql('a', 'b')} AS near_edited, {_like_sql('a', 'c')} AS near_next
    FROM t
    """,
)
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(manifest)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_word_bpe")
def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = word_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", "n_tokens", F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query(
    "op12_hard_negatives",
    """
    WITH e AS MATERIALIZED (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    s AS MATERIALIZED (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
        FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
    QUALIFY row_number() OVER w <= 10
    """,
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
