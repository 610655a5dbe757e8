"""Merkle trees over documents (operator 8, DataFrame functions only).

Leaves are blocks of a paragraph: a sentence, or 200 characters where no sentence ends earlier.
A paragraph (line) hashes its text, a section of ``SECTION`` paragraphs hashes its paragraphs, and
the root hashes the sections. Equal roots mean equal texts; sections and paragraphs with differing
hashes locate an edit, and the share of common leaves says how alike two documents are.

Defined results: null text is empty and has one empty paragraph and no leaves; two texts without
leaves are alike by 1, a text with leaves and one without by 0. The next document is the one with
the next larger doc_id (of rows that share it, the smallest text), after the last the first. A row
with a null doc_id has no next document: its last quarter is replaced by nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import staged, texts

SECTION = 8
BLOCK = r"[^.!?]{1,200}[.!?]*|[.!?]+"


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def leaf_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the blocks."""
    blocks = F.flatten(F.transform(paragraphs(text), lambda p: F.regexp_extract_all(p, F.lit(BLOCK), F.lit(0))))
    return F.array_distinct(F.transform(blocks, lambda b: F.xxhash64(b)))


def paragraph_hashes(text: Column) -> Column:
    return F.transform(paragraphs(text), lambda p: F.sha2(p, 256))


def section_hashes(hashes: Column) -> Column:
    """Hash of each run of SECTION paragraph hashes."""
    starts = F.sequence(F.lit(1), F.size(hashes), F.lit(SECTION))
    return F.transform(starts, lambda s: F.sha2(F.array_join(F.slice(hashes, s, SECTION), "-"), 256))


def root_hash(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, "/"), 256)


def fingerprint(text: Column) -> Column:
    return root_hash(section_hashes(paragraph_hashes(text)))


def likeness(a: Column, b: Column) -> Column:
    """Common leaves over all leaves of both, 1 if neither has any."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - common
    return F.when(either == 0, F.lit(1.0)).otherwise(common / either)


def merkle_tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, root, section hashes, paragraph hashes and leaf hashes of every document."""
    base = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return (
        base.withColumn("paragraphs", paragraph_hashes(F.col("text")))
        .withColumn("sections", section_hashes(F.col("paragraphs")))
        .select("doc_id", root_hash(F.col("sections")).alias("root"), "sections", "paragraphs", leaf_hashes(F.col("text")).alias("leaves"))
    )


def changed_paragraphs(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id and the numbers (from 0) of paragraphs that differ, looked for in differing sections only.

    Trees come from ``merkle_tree``; documents whose roots are equal give no row.
    """
    old = before.select("doc_id", *(F.col(c).alias(f"old_{c}") for c in ("root", "sections", "paragraphs")))
    pair = after.join(old, "doc_id").where(F.col("root") != F.col("old_root"))
    count = F.greatest(F.size("sections"), F.size("old_sections"))
    branches = F.filter(
        F.sequence(F.lit(0), count - 1),
        lambda i: ~F.get(F.col("sections"), i).eqNullSafe(F.get(F.col("old_sections"), i)),
    )
    numbers = F.flatten(F.transform(branches, lambda s: F.sequence(s * SECTION, s * SECTION + SECTION - 1)))
    return pair.select(
        "doc_id",
        F.filter(
            numbers, lambda i: ~F.get(F.col("paragraphs"), i).eqNullSafe(F.get(F.col("old_paragraphs"), i))
        ).alias("changed"),
    )


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, added and removed: numbers (from 0) of paragraphs that only the new and only the old text holds.

    Paragraphs are aligned by hash and by how often it has come before, not by number, so one paragraph put in front of
    others is one addition, and a paragraph that only moved is none. Documents whose roots are equal, and leading
    sections that are, are not looked into. Trees come from ``merkle_tree``; ids are looked up once on either side.
    """
    old = before.select("doc_id", *(F.col(c).alias(f"old_{c}") for c in ("root", "sections", "paragraphs")))
    pair = after.join(old, "doc_id").where(F.col("root") != F.col("old_root"))
    shorter = F.least(F.size("sections"), F.size("old_sections"))
    differs = F.filter(F.sequence(F.lit(0), shorter), lambda i: ~F.get(F.col("sections"), i).eqNullSafe(F.get(F.col("old_sections"), i)))
    skipped = F.coalesce(F.get(differs, F.lit(0)), shorter) * SECTION  # paragraphs of equal leading sections
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("hashes")) for side, c in ((0, "old_paragraphs"), (1, "paragraphs"))])
    rest = pair.select("doc_id", skipped.alias("skipped"), F.inline(sides))
    rows = rest.select("doc_id", "skipped", "side", F.posexplode("hashes").alias("place", "h")).where("place >= skipped")
    nth = F.row_number().over(Window.partitionBy("doc_id", "side", "h").orderBy("place"))
    single = rows.withColumn("nth", nth).groupBy("doc_id", "h", "nth").agg(F.min("side").alias("low"), F.max("side").alias("high"), F.min("place").alias("place"))
    only = lambda side: F.array_sort(F.collect_list(F.when((F.col("low") == side) & (F.col("high") == side), F.col("place"))))
    return single.groupBy("doc_id").agg(only(1).alias("added"), only(0).alias("removed"))


def successors(ids: DataFrame) -> DataFrame:
    """doc_id and next_id over distinct ids: ranges sorted in parallel, joined at their edges."""
    ranked = staged(
        ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id()), "id-ranges"
    )
    firsts = ranked.groupBy("part").agg(F.min("doc_id").alias("first"))  # a row for each range
    edge = Window.orderBy("part")
    follow = firsts.select(
        "part", F.coalesce(F.lead("first").over(edge), F.first("first").over(edge.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("follow")
    )
    lead = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranked.withColumn("after", lead).join(follow, "part").select("doc_id", F.coalesce("after", "follow").alias("next_id"))


def range_starts(ids: DataFrame, ranges: int) -> list:
    """First ids of at most ``ranges`` ranges of distinct ids, ascending; a bounded list whatever the table."""
    firsts = ids.repartitionByRange(ranges, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("first"))
    return sorted(r.first for r in firsts.select("first").collect())


def _next_in_range(named: DataFrame, starts: list) -> DataFrame:
    """doc_id, text, head and next_leaves, for ids that do not repeat: texts are shuffled once.

    A range of ids is a partition; the first document of each also goes, as a guest, behind the
    last one of the range before (of the first range: behind the last range).
    """
    bounds = F.array(*map(F.lit, starts)).cast(f"array<{named.schema['doc_id'].dataType.simpleString()}>")
    part = F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))) - 1
    before = F.pmod(part + len(starts) - 1, F.lit(len(starts)))
    own, guest = (F.struct(p.cast("int").alias("part"), F.lit(g).alias("guest")) for p, g in ((part, False), (before, True)))
    places = F.when(F.array_contains(bounds, F.col("doc_id")), F.array(own, guest)).otherwise(F.array(own))
    placed = named.select("doc_id", "text", F.inline(places)).repartitionById(len(starts), F.col("part"))
    order = Window.partitionBy("part").orderBy("guest", "doc_id")
    follow = placed.withColumn("leaves", leaf_hashes(F.col("text"))).select(
        "doc_id", "text", "guest", "leaves", F.lead("text").over(order).alias("head"), F.lead("leaves").over(order).alias("next_leaves")
    )
    return follow.where("NOT guest").drop("guest")


def _next_by_join(named: DataFrame, ids: DataFrame) -> DataFrame:
    """The same where ids repeat: a document's text goes to all rows of the id before; joins can be split where one id is hot."""
    sizes = staged(named.groupBy("doc_id").agg(F.max(F.floor(F.char_length("text") / 4)).cast("int").alias("need")), "doc-sizes")
    links = successors(ids.select("doc_id")).join(sizes, "doc_id")
    asked = links.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("asker"), "need")
    heads = named.groupBy("doc_id").agg(F.min("text").alias("text")).join(asked, "doc_id").select(
        F.col("asker").alias("doc_id"), F.expr("substring(text, 1, need)").alias("head"), leaf_hashes(F.col("text")).alias("next_leaves")
    )
    return named.join(heads, "doc_id").select("doc_id", "text", leaf_hashes(F.col("text")).alias("leaves"), "head", "next_leaves")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and likeness to that and to the next document.

    The edited text has the last quarter of the characters replaced by as many of the next document.
    ``ranges`` of ids are worked on one by one, as many as there are shuffle partitions if not given.
    """
    base = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    named = base.where("doc_id IS NOT NULL")
    ids = staged(named.groupBy("doc_id").agg(F.count("*").alias("rows")), "doc-ids")
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = range_starts(ids, ranges)
    single = bool(starts) and ids.where("rows > 1").isEmpty()
    follow = _next_in_range(named, starts) if single else _next_by_join(named, ids)
    nameless = base.where("doc_id IS NULL").select(
        "doc_id", "text", leaf_hashes(F.col("text")).alias("leaves"), F.lit("").alias("head"), F.lit(None).cast("array<bigint>").alias("next_leaves")
    )
    joined = (
        follow.unionByName(nameless)
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
        .withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars AS INT) - cut), substring(head, 1, cut))"))
        .withColumn("edited_leaves", leaf_hashes(F.col("edited")))
    )
    none = F.array().cast("array<bigint>")
    return joined.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("leaves"), F.coalesce("next_leaves", none)).alias("near_next"),
    )
