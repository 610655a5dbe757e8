"""Repeated byte strings by an enhanced suffix array over sampled suffixes (operator 7).

A string of ``REPEAT`` bytes that occurs twice has its smallest hash of ``GRAM`` consecutive bytes at
the same offset in both places. These anchors are the sampled suffixes: one for each run of window
starts that share it (about 76 bytes of text). The steps:

1. Count anchors; those that occur once carry no repeat (a bitmap keeps most of them back). Runs with the same anchor and the same bytes
   form a class; every byte of a class with two members is repeated.
2. Of each anchor with several classes, one run of each class goes on with its bytes. Suffixes
   (bytes from the anchor on) are sorted within partitions, neighbours give the array of common
   prefix lengths, and a stack scan yields the common-prefix intervals as a tree.
3. The members of an interval are ordered by their reversed left context. Where left extensions
   differ, the common left length of neighbours and the common prefix give the longest string that a
   member shares with another: the repeat is maximal and holds all members of the interval that share it.
4. Anchors with more than ``GROUP`` classes do not meet in one task: their windows are hashed
   and counted one by one, with partial sums.

Matches never cross documents; overlapping and self-overlapping repeats count. Hashes have 64 bits and
are compared only together with a second one or with the bytes.

Defined results: null text is empty; texts below ``REPEAT`` bytes keep every byte; rows that repeat
a document find their text in each other; a null doc_id is an id like any other; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import text as tx
from tidelog.llm.shared import Marks, Scratch, portable, staged, texts

REPEAT = 200
GRAM = 48
GROUP = 4096
SLAB = 1 << 17
CHUNK = 1 << 20


def window_runs(data: np.ndarray, offsets: np.ndarray, repeat: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of window starts that share an anchor: row, first and last start, anchor (bytes of the chunk) and hashes."""
    sizes = np.diff(offsets)
    starts = tx.ranges(offsets[:-1], np.maximum(sizes - repeat + 1, 0))
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("row", "lo", "hi", "at")} | {k: np.zeros(0, np.uint64) for k in ("anchor", "content")}
    n = len(data)
    hashes = tx.RangeHash(data)
    grams = hashes.of(np.arange(n - gram + 1), np.arange(gram, n + 1))
    bits = np.uint64(max(20, n.bit_length()))
    # The place in the low bits makes the leftmost of equal hashes the smallest.
    order = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    width = repeat - gram + 1
    blocks = -(-len(order) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(order)] = order
    padded = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(padded, 1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    at = (np.minimum(backward[starts], forward[starts + width - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - repeat + 1, 0))
    head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
    lo, hi, at, row = starts[head], starts[np.append(head[1:], len(starts)) - 1], at[head], row[head]
    content = tx.mix(hashes.of(lo, hi + repeat) + (at - lo).astype(np.uint64))
    return {"row": row, "lo": lo, "hi": hi, "at": at, "anchor": tx.mix(grams[at]), "content": content}


def _anchors(base: DataFrame, repeat: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in tx.text_chunks(batches, limit=CHUNK):
            runs = window_runs(data, offsets, repeat, gram)
            yield pa.RecordBatch.from_arrays([pa.array(runs["anchor"].view(np.int64))], names=["anchor"])

    return base.mapInArrow(portable(run), "anchor bigint")


def _runs(base: DataFrame, repeat: int, gram: int, marks: Marks) -> DataFrame:
    """anchor, content, doc_id, dkey, and the run's first and last window start and anchor in the document.

    Only anchors that are marked; a stranger that passes is a class of its own and matches nothing.
    """
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tx.text_chunks(batches, limit=CHUNK):
            runs = window_runs(data, offsets, repeat, gram)
            often = marks.holds(runs["anchor"])
            runs = {k: v[often] for k, v in runs.items()}
            row, first = pa.array(runs["row"]), offsets[runs["row"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs[k].view(np.int64)) for k in ("anchor", "content")]
                + [rows.column(0).take(row), rows.column(2).take(row)]
                + [pa.array((runs[k] - first).astype(np.int32)) for k in ("lo", "hi", "at")],
                names=["anchor", "content", "doc_id", "dkey", "lo", "hi", "at"],
            )

    return base.mapInArrow(portable(run), f"anchor bigint, content bigint, doc_id {kind}, dkey bigint, lo int, hi int, at int")


def _marked_texts(base: DataFrame, marks: Marks, every: bool) -> DataFrame:
    """doc_id, dkey and text of marked documents; with ``every`` also the others, their text null."""
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(marks.holds(batch.column(2).to_numpy()))
            if every:
                text = pc.if_else(hit, batch.column(1), pa.scalar(None, batch.column(1).type))
                batch = batch.set_column(1, batch.schema.names[1], text)
            else:
                batch = batch.filter(hit)
            yield batch

    return base.mapInArrow(portable(run), ", ".join(f"{name} {kind}" for name, kind in base.dtypes))


def prefix_intervals(lcp: np.ndarray) -> np.ndarray:
    """Common-prefix intervals (length, first, last) of a suffix array, from its array of neighbours' common lengths.

    lcp[i] belongs to entries i and i + 1. One pass with a stack; children come before their parents.
    """
    out, stack = [], [(0, 0)]
    for i, length in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack[-1][0] > length:
            top, first = stack.pop()
            out.append((top, first, i))
        if length > stack[-1][0]:
            stack.append((length, first))
    return np.array(out, np.int64).reshape(-1, 3)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix length of the rows of two byte matrices; 0 ends a row and matches nothing."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Bytes + 1 of each value in a row, padded with 0 (UTF-8 has no byte 255)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    out = np.zeros((len(column), width), np.uint8)
    out[np.repeat(np.arange(len(column)), sizes), tx.ranges(np.zeros(len(column), np.int64), sizes)] = raw[tx.ranges(offsets[:-1], sizes)] + 1
    return out


def shared_strings(anchor: np.ndarray, right: np.ndarray, left: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members of common-prefix intervals with the longest string of at least ``repeat`` bytes that each shares there.

    Rows are sorted by (anchor, right context). Returns interval, member, bytes left of and from the
    anchor on. Intervals whose members have one left extension only are not maximal by themselves:
    their strings come out longer to the left.
    """
    lcp = np.where(anchor[1:] == anchor[:-1], _common(right[1:], right[:-1]), 0)
    tree = prefix_intervals(lcp)
    empty = np.zeros(0, np.int64)
    found = [(empty, empty, empty, empty)]
    names = np.ascontiguousarray(left).view(f"S{left.shape[1]}").ravel()
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(names, kind="stable")] = np.arange(len(names))
    sizes = tree[:, 2] - tree[:, 1] + 1
    slabs = np.cumsum(sizes) // SLAB
    for slab in np.unique(slabs):
        mine = np.flatnonzero(slabs == slab)
        node = np.repeat(mine, sizes[mine])
        member = tx.ranges(tree[mine, 1], sizes[mine])
        order = np.lexsort((rank[member], node))
        node, member = node[order], member[order]
        beside = np.flatnonzero(node[1:] == node[:-1])
        common = np.zeros(len(node), np.int64)
        extent = _common(left[member[beside]], left[member[beside + 1]])
        common[beside] = extent
        np.maximum.at(common, beside + 1, extent)
        keep = np.flatnonzero(common + tree[node, 0] >= repeat)
        found.append((node[keep], member[keep], common[keep], tree[node[keep], 0]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _suffix_spans(rows: DataFrame, repeat: int, gram: int) -> DataFrame:
    """doc_id, dkey, start, after of strings that single runs share with other classes of their anchor."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["anchor", "rightward", "leftward", "copies", "doc_id", "dkey", "at"]

    def scan(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        column = lambda c: table.column(c).combine_chunks() if table.column(c).num_chunks != 1 else table.column(c).chunk(0)
        anchor = column("anchor").to_numpy()
        _, member, back, ahead = shared_strings(anchor, _matrix(column("rightward"), repeat), _matrix(column("leftward"), repeat - gram), repeat)
        alone = column("copies").to_numpy()[member] == 1
        member, back, ahead = member[alone], back[alone], ahead[alone]
        at, pick = column("at").to_numpy()[member], pa.array(member)
        return pa.RecordBatch.from_arrays(
            [column("doc_id").take(pick), column("dkey").take(pick), pa.array((at - back).astype(np.int32)), pa.array((at + ahead).astype(np.int32))],
            names=["doc_id", "dkey", "start", "after"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            last = int(np.searchsorted(anchor, anchor[-1]))  # rows before the last anchor of this batch
            if held + last >= 2 * GROUP and (last or held and waiting[-1].column(0)[-1].as_py() != anchor[0]):
                yield scan(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
                waiting, held = [batch.slice(last)], batch.num_rows - last
            else:
                waiting.append(batch)
                held += batch.num_rows
        if waiting:
            yield scan(pa.Table.from_batches(waiting))

    ordered = rows.select(*names).repartition("anchor").sortWithinPartitions("anchor", "rightward", "leftward")
    return ordered.mapInArrow(portable(run), f"doc_id {kind}, dkey bigint, start int, after int")


def _window_spans(rows: DataFrame, repeat: int, stage: Callable) -> DataFrame:
    """The same for anchors with very many classes: every window is hashed, and windows are counted."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tx.text_chunks([batch], "content", 1 << 18):
                n = np.diff(offsets) - repeat + 1
                starts = tx.ranges(offsets[:-1], n)
                row = np.repeat(np.arange(len(n)), n)
                lo = part.column(part.schema.get_field_index("lo")).to_numpy()
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pick),
                        pa.array(tx.RangeHash(data).of(starts, starts + repeat).view(np.int64)),
                        part.column(1).take(pick),
                        part.column(2).take(pick),
                        part.column(3).take(pick),
                        pa.array((starts - offsets[row] + lo[row]).astype(np.int32)),
                    ],
                    names=["anchor", "window", "copies", "doc_id", "dkey", "start"],
                )

    whole = rows.select("anchor", "copies", "doc_id", "dkey", "lo", "content")
    windows = stage(
        whole.mapInArrow(portable(run), f"anchor bigint, window bigint, copies bigint, doc_id {kind}, dkey bigint, start int"), "hot-windows"
    )
    repeated = windows.groupBy("anchor", "window").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor", "window")
    return windows.where("copies = 1").join(repeated, ["anchor", "window"], "left_semi").select("doc_id", "dkey", "start", (F.col("start") + repeat).alias("after"))


def repeated_spans(base: DataFrame, repeat: int = REPEAT, gram: int = GRAM, group: int = GROUP, stage: Callable = staged) -> DataFrame:
    """doc_id, dkey, start, after (bytes): spans that cover exactly the repeated bytes; they may overlap.

    ``base`` has doc_id, text and dkey, a hash of the text.
    """
    often = _anchors(base, repeat, gram).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    runs = stage(_runs(base, repeat, gram, Marks(stage(often, "repeat-anchors"), "anchor")), "repeat-runs")
    classes = stage(
        runs.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "dkey", "lo", "hi", "at")).alias("one")), "repeat-classes"
    )
    whole = (
        runs.join(classes.where("copies > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
        .select("doc_id", "dkey", F.col("lo").alias("start"), (F.col("hi") + repeat).alias("after"))
    )
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("size"), F.min("copies").alias("least")).where("size > 1 AND least = 1").select("anchor", "size")
    wanted = stage(classes.join(mixed, "anchor").select("anchor", "size", "copies", "one.*"), "repeat-wanted")
    needs = wanted.groupBy("doc_id", "dkey").agg(F.collect_list(F.struct("anchor", "size", "copies", "lo", "hi", "at")).alias("runs"))
    marked = _marked_texts(base, Marks(wanted.select("dkey").distinct(), "dkey"), False)
    left = marked.alias("t").join(needs.alias("w"), F.expr("t.doc_id <=> w.doc_id AND t.dkey = w.dkey")).select("t.doc_id", "t.dkey", "t.text", "w.runs")
    cut = stage(_contexts(left, repeat, gram), "repeat-contexts")
    fine = _suffix_spans(cut.where(F.col("size") <= group), repeat, gram)
    hot = _window_spans(cut.where(F.col("size") > group), repeat, stage)
    return whole.unionByName(fine).unionByName(hot)


def _contexts(rows: DataFrame, repeat: int, gram: int) -> DataFrame:
    """The bytes of each wanted run: from its anchor on, before its anchor (reversed), and as a whole."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tx.text_chunks([batch], limit=1 << 19):
                lists = part.column(3)
                flat = lists.flatten()
                sizes = np.diff(np.asarray(lists.offsets.to_numpy(), np.int64))
                row = np.repeat(np.arange(len(sizes)), sizes)
                field = lambda c: flat.field(c).to_numpy(zero_copy_only=False)  # noqa: E731,B023
                lo, hi, at = (field(c) + offsets[row] for c in ("lo", "hi", "at"))
                raw, pick = data.tobytes(), pa.array(row)
                spots = list(zip(lo.tolist(), hi.tolist(), at.tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        flat.field("anchor"), flat.field("size"), flat.field("copies"), part.column(0).take(pick), part.column(1).take(pick), flat.field("lo"), flat.field("at"),
                        pa.array([raw[c : b + repeat] for _, b, c in spots], pa.binary()),
                        pa.array([raw[a:c][::-1] for a, _, c in spots], pa.binary()),
                        pa.array([raw[a : b + repeat] for a, b, _ in spots], pa.binary()),
                    ],
                    names=["anchor", "size", "copies", "doc_id", "dkey", "lo", "at", "rightward", "leftward", "content"],
                )

    shape = f"anchor bigint, size bigint, copies bigint, doc_id {kind}, dkey bigint, lo int, at int, rightward binary, leftward binary, content binary"
    return rows.mapInArrow(portable(run), shape)


def remove_repeats(docs: DataFrame, repeat: int = REPEAT, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every document."""
    base = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("dkey", F.xxhash64("text"))
    scratch = Scratch(docs.sparkSession)
    spans = staged(repeated_spans(base, repeat, gram, group, scratch.stage).groupBy("doc_id", "dkey").agg(F.collect_set(F.struct("start", "after")).alias("spans")), "repeat-spans")
    scratch.clear()
    sized = base.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("sha", F.sha2("text", 256))
    if not with_kept:  # texts without a repeat need not travel
        sized = _marked_texts(sized, Marks(spans.select("dkey").distinct(), "dkey"), True)
    joined = sized.alias("t").join(spans.alias("s"), F.expr("t.doc_id <=> s.doc_id AND t.dkey = s.dkey"), "left").select("t.doc_id", "t.text", "t.n_bytes", "t.sha", "s.spans")
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, count, sums, kept = [], [], [], []
            for k in range(batch.num_rows):
                spans = batch.column(4)[k].as_py()
                if not spans:
                    removed.append(0)
                    count.append(0)
                    sums.append(batch.column(3)[k].as_py())
                    kept.append((batch.column(1)[k].as_py() or "").encode() if with_kept else None)
                    continue
                raw, at, parts, n = batch.column(1)[k].as_py().encode(), 0, [], 0
                for start, after in sorted((s["start"], s["after"]) for s in spans):
                    if start > at or not n:
                        n += 1
                        parts.append(raw[at:start])
                    at = max(at, after)
                parts.append(raw[at:])
                rest = b"".join(parts)
                removed.append(len(raw) - len(rest))
                count.append(n)
                sums.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_kept else None)
            columns = [batch.column(0), batch.column(2), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sums, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(portable(run), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_kept else ""))
