"""Benchmark decontamination through a positional inverted index (operator 1).

``build_index`` stores the token postings of the training texts in the shared folder, in segments
of bounded size, each under an id of its own: sorted term hashes and, for each term, the ascending word positions. ``search``
takes the benchmark windows in blocks; in each segment it starts from the rarest term of a window
and intersects the offset-adjusted lists of the others, exactly (phrase) or within ``slop`` words of
the expected place (proximity). Nothing is shuffled: a hot word is one list in each segment.

Terms are 64-bit hashes of whole words; two different words share one with probability below 1e-4
even for 10**7 distinct words.

Defined results: null or empty text has no words, an item without words has no windows and is found
nowhere, an item with a null id is named "null", an empty benchmark leaves every document clean, an
empty corpus gives no rows; rows that repeat a document each get their own result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import text as tx
from tidelog.llm.shared import Scratch, portable, staged, texts

WINDOW = 10
SEGMENT = 1 << 21  # bytes of text in a segment: each names its terms once
BLOCK = 20_000  # windows that go to the executors at a time: at most 10 * 8 * 20,000 bytes of hashes
GAP = 128  # positions left free between documents; windows and slop stay below it
CANDIDATES = 1 << 20


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = tx.words(data, offsets, tx.ALNUM)
    return tx.RangeHash(tx.LOWER[data]).of(starts, ends), first


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stage: Callable = staged) -> DataFrame:
    """One row for each segment: its documents, their word counts, terms and postings."""
    base = texts(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tx.text_chunks(batches, limit=SEGMENT):
            terms, first = _word_hashes(data, offsets)
            counts = np.diff(first)
            place = np.arange(len(terms)) + np.repeat(np.arange(len(counts)) * GAP, counts)
            order = np.argsort(terms, kind="stable")
            ordered = terms[order]
            head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else order
            ids = rows.column(0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    tx.binary([counts.astype(np.int32)]),
                    tx.binary([ordered[head]]),
                    tx.binary([head.astype(np.int32)]),
                    tx.binary([place[order].astype(np.int32)]),
                    pa.array([uuid.uuid4().bytes], pa.binary()),  # fixed once written; equal segments keep apart
                ],
                names=["doc_ids", "counts", "terms", "heads", "places", "segment"],
            )

    return stage(
        base.mapInArrow(portable(segments), f"doc_ids array<{kind}>, counts binary, terms binary, heads binary, places binary, segment binary"),
        "postings",
    )


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """item_id and the term hashes of each distinct window; an item shorter than the window is one window."""
    base = texts(items, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tx.text_chunks(batches):
            terms, first = _word_hashes(data, offsets)
            terms = terms.view(np.int64)
            names, out = rows.column(0).to_pylist(), []
            for k, name in enumerate(names):
                own = terms[first[k] : first[k + 1]]
                size = min(window, len(own))
                out += [(name, own[j : j + size]) for j in range(len(own) - size + 1)] if size else []
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in out]), pa.array([w for _, w in out], pa.list_(pa.int64()))], names=["item_id", "terms"]
                )

    return base.mapInArrow(portable(cut), "item_id string, terms array<bigint>").distinct()


def _blocks(windows: DataFrame) -> Iterator[list[tuple[str, list[int]]]]:
    block: list[tuple[str, list[int]]] = []
    for row in windows.toLocalIterator():
        block.append((row.item_id, row.terms))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


class _Postings:
    """One segment, opened for lookups."""

    def __init__(self, terms: bytes, heads: bytes, places: bytes):
        self.terms, self.places = np.frombuffer(terms, np.uint64), np.frombuffer(places, np.int32).astype(np.int64)
        self.heads = np.append(np.frombuffer(heads, np.int32).astype(np.int64), len(self.places))
        self.span = int(self.places.max(initial=0)) + 2 * GAP + 1
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.heads)) * self.span + self.places

    def matches(self, windows: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Window numbers, start places and exactness of all matches of windows of one length."""
        if not len(self.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, windows), len(self.terms) - 1)
        alive = np.flatnonzero((self.terms[at] == windows).all(1))
        if not len(alive):
            return
        at = at[alive]
        sizes = self.heads[at + 1] - self.heads[at]
        rarity = np.argsort(sizes, 1, kind="stable")
        fewest = np.take_along_axis(sizes, rarity[:, :1], 1)[:, 0]
        parts = np.cumsum(fewest) // CANDIDATES
        for part in np.unique(parts):
            mine = np.flatnonzero(parts == part)
            col = rarity[mine, 0]
            which = np.repeat(mine, fewest[mine])
            start = self.places[tx.ranges(self.heads[at[mine, col]], fewest[mine])] - np.repeat(col, fewest[mine])
            exact = np.ones(len(which), bool)
            for step in range(1, windows.shape[1]):
                col = rarity[which, step]
                wanted = at[which, col] * self.span + start + col
                found = np.searchsorted(self.keys, wanted - slop)
                inside = found < len(self.keys)
                near = inside & (self.keys[np.minimum(found, len(self.keys) - 1)] <= wanted + slop)
                if slop:
                    spot = np.searchsorted(self.keys, wanted)
                    exact &= (spot < len(self.keys)) & (self.keys[np.minimum(spot, len(self.keys) - 1)] == wanted)
                which, start, exact = which[near], start[near], exact[near]
            if len(which):
                yield alive[which], start, exact


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents with the word spans hit by a window and the items they come from.

    Columns doc_id, n_words, spans (array of first word, word after the last; ascending, apart),
    items (distinct, sorted as strings), near_items (those found within ``slop`` only). A span of
    a proximity match runs from its expected start for the length of the window.
    """
    if window + 2 * slop >= GAP:
        raise ValueError(f"window and slop must stay below {GAP} words")
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    shape = f"doc_id {kind}, n_words bigint, spans array<struct<first:int,after:int>>, items array<string>, near_items array<string>, segment binary, row int"
    parts = [index.mapInArrow(portable(_finder(block, slop, k == 0)), shape) for k, block in enumerate(_blocks(item_windows(items, window, item_id, item_text)))]
    if not parts:
        parts = [index.mapInArrow(portable(_finder([], slop, True)), shape)]
    found = parts[0]
    if len(parts) > 1:  # each block reports its own spans; they meet by document
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.groupBy("segment", "row").agg(
            F.first("doc_id", ignorenulls=True).alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"),
        )
    return found.select("doc_id", "n_words", F.array_sort("spans").alias("spans"), F.array_sort("items").alias("items"), F.array_sort(F.array_except("near_items", "items")).alias("near_items"))


def _finder(block: list, slop: int, every: bool):
    """Function over segments: rows for documents with hits in this block, or for all documents."""
    by_length: dict[int, list] = {}
    for item, terms in block:
        by_length.setdefault(len(terms), []).append((item, terms))
    sets = []
    for size, rows in by_length.items():
        windows, inverse = np.unique(np.array([t for _, t in rows], np.int64).view(np.uint64), axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        names = np.array([n for n, _ in rows], object)[order]
        sets.append((size, windows, np.searchsorted(inverse.ravel()[order], np.arange(len(windows) + 1)), names))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(0).slice(k, 1).flatten()
                counts, terms, heads, places, segment = (batch.column(c)[k].as_py() for c in range(1, 6))
                yield _found(ids, np.frombuffer(counts, np.int32).astype(np.int64), _Postings(terms, heads, places), sets, slop, every, segment)

    return find


def _found(ids: pa.Array, counts: np.ndarray, postings: _Postings, sets: list, slop: int, every: bool, segment: bytes) -> pa.RecordBatch:
    origin = np.concatenate(([0], np.cumsum(counts + GAP)))
    hits: dict[int, tuple[list, set, set]] = {}
    for size, windows, first, names in sets:
        for which, start, exact in postings.matches(windows, slop):
            doc = np.clip(np.searchsorted(origin, start, "right") - 1, 0, len(counts) - 1)
            begin = start - origin[doc]
            low, high = np.maximum(begin, 0), np.minimum(begin + size, counts[doc])
            order = np.argsort(doc, kind="stable")
            cuts = np.flatnonzero(np.diff(doc[order])) + 1
            for rows in np.split(order, cuts):
                spans, items, near = hits.setdefault(int(doc[rows[0]]), ([], set(), set()))
                spans.append(np.stack((low[rows], high[rows]), 1))
                for into, chosen in ((items, rows[exact[rows]]), (near, rows[~exact[rows]])):
                    for w in np.unique(which[chosen]):
                        into.update(names[first[w] : first[w + 1]])
    rows = np.arange(len(counts)) if every else np.array(sorted(hits), np.int64)
    spans, items, near = [], [], []
    for row in rows:
        mine = hits.get(int(row))
        spans.append(_merged(np.concatenate(mine[0])) if mine else [])
        items.append(sorted(mine[1]) if mine else [])
        near.append(sorted(mine[2]) if mine else [])
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(rows)),
            pa.array(counts[rows], pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))),
            pa.array(items, pa.list_(pa.string())),
            pa.array(near, pa.list_(pa.string())),
            pa.array([segment] * len(rows), pa.binary()),
            pa.array(rows, pa.int32()),
        ],
        names=["doc_id", "n_words", "spans", "items", "near_items", "segment", "row"],
    )


def _merged(spans: np.ndarray) -> list[dict]:
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(spans) - 1]))
    return [{"first": int(a), "after": int(b)} for a, b in zip(spans[new, 0], reach[last])]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items and contaminated for every document."""
    scratch = Scratch(docs.sparkSession)
    found = search(build_index(docs, id_col, text_col, scratch.stage), items, window)
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("reach")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["after"] - F.greatest(s["first"], acc["reach"]))).cast("bigint").alias("n"),
            F.greatest(acc["reach"], s["after"]).alias("reach"),
        ),
        lambda acc: acc["n"],
    )
    out = found.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")
    out = staged(out.withColumn("contaminated", F.col("n_hit") > 0), "contamination")
    scratch.clear()
    return out
