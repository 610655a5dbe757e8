"""Exact n-gram Jaccard join of whole texts in the metric space of shingle sets (operator 2).

The distance of two sets is 1 - intersection / union, a metric. Two texts of a corpus are nearly
always at distance 1, from each other and from any document taken as a pivot, so document pivots alone
part nothing. The join therefore has two levels:

* The first pivots are the single shingles. A set of n shingles is at distance 1 - 1/n from those it
  holds and 1 from the others; ties go by a fixed order, rare shingles first, so its home region is
  that of its first shingle. A set within the threshold lacks at most n - ceil(t n) of the shingles of
  its partner: by the triangle inequality the two meet in one of the first n - ceil(t n) + 1 regions of
  both. That window replicates every set; sets that are alone in a region drop out.
* Regions with the same smallest member are joined together. That member is the pivot; distances to
  it bound the others (windows |d(x, p) - d(y, p)| <= 1 - t), members within the threshold leave, and
  the rest is joined recursively around the next pivot. A region of more than ``REGION`` sets is cut
  into blocks; the blocks' components meet through representatives, and what is then outside the
  largest component is joined with every block.

A sketch of shingle parities bounds the symmetric difference of two sets from below and keeps sets
without any possible partner from travelling. No step caps partners or candidates. Equal sets are joined
once; components need only links enough to connect what is connected, not all pairs of a group. With
``links`` the pairs of each region, and of each two blocks of a large one, are all compared and counted
where the two sets first meet (their least common pivot), so that each document has its exact number
of links. That takes time with the square of a region's size; pairs are counted, never written.

Shingles are compared by 54-bit hashes, sets by 64-bit sums of these.

Defined results: null or empty text and text of white space only have no shingles and are a component
of their own; fewer words than a shingle make one shingle; rows with equal doc_id are documents of
their own; a document with a null doc_id gets no component and links nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import text as tx
from tidelog.llm.components import connected_components
from tidelog.llm.shared import Marks, Scratch, portable, staged, texts

SHINGLE = 5
THRESHOLD = 80  # percent
REGION = 1000
ROWS = 1024
ROW_BITS, HASH_BITS = np.uint64(10), np.uint64(54)
BUCKET_BITS = 24
OFTEN = 32
SKETCH_WORDS = 128
COLUMNS = 4096  # shingles compared at a time when links are counted


class Sets:
    """Distinct shingles of the texts of a chunk, ascending by (row, hash)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, shingle: int):
        low = tx.LOWER[data]
        starts, ends, first = tx.words(low, offsets, ~tx.SPACE)
        hashes, rows = tx.shingles(tx.RangeHash(low).of(starts, ends), first, shingle)
        packed = np.sort(rows.astype(np.uint64) << HASH_BITS | hashes >> ROW_BITS)
        packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))] if len(packed) else packed
        self.row = (packed >> HASH_BITS).astype(np.int64)
        self.code = packed & ((np.uint64(1) << HASH_BITS) - np.uint64(1))
        self.bounds = np.searchsorted(self.row, np.arange(len(offsets)))
        self.n = np.diff(self.bounds)

    def ids(self) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tx.mix(self.code + np.uint64(1)))))
        return tx.mix(sums[self.bounds[1:]] - sums[self.bounds[:-1]] + self.n.astype(np.uint64)).view(np.int64)

    def sketches(self) -> list[bytes]:
        """Parity of the number of shingles at each position; as many positions as shingles, to a power of two."""
        words = np.minimum(1 << np.ceil(np.log2(np.maximum(self.n, 64) / 64)).astype(int), SKETCH_WORDS)
        first = np.cumsum(words) - words
        out = np.zeros(int(words.sum()), np.uint64)
        spread = tx.mix(self.code)
        slot = (spread & (words[self.row] * 64 - 1).astype(np.uint64)).astype(np.int64)
        np.bitwise_xor.at(out, first[self.row] + (slot >> 6), np.uint64(1) << (slot & 63).astype(np.uint64))
        return [out[a : a + w].tobytes() for a, w in zip(first, words)]

    def in_order(self, levels: np.ndarray | None) -> np.ndarray:
        """Positions row by row, rare shingles first, then by hash."""
        if levels is None:
            return np.arange(len(self.row))
        level = levels[(self.code >> (HASH_BITS - np.uint64(BUCKET_BITS))).astype(np.int64)]
        return np.argsort(self.row * 8 + level, kind="stable")

    def first(self, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The first ``counts`` positions of each row in an order."""
        return order[tx.ranges(self.bounds[:-1], np.minimum(counts, self.n))]


def window_size(n: np.ndarray, threshold: int) -> np.ndarray:
    """How many regions a set of n shingles must enter: n - ceil(t n) + 1."""
    return np.where(n > 0, n + (-threshold * n) // 100 + 1, 0)


def _set_rows(base: DataFrame, shingle: int) -> DataFrame:
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tx.text_chunks(batches, rows=ROWS):
            sets = Sets(data, offsets, shingle)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets.n), pa.array(sets.ids()), pa.array(sets.sketches(), pa.binary())], names=["doc_id", "n", "set_id", "sketch"])

    return base.mapInArrow(portable(run), f"doc_id {kind}, n bigint, set_id bigint, sketch binary")


def _levels(base: DataFrame, shingle: int, threshold: int, stage: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of frequent shingles and their level; any order is exact, this one keeps regions small.

    Counted over all texts, for somewhat more shingles than a window holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in tx.text_chunks(batches, rows=ROWS):
            sets = Sets(data, offsets, shingle)
            some = sets.first(window_size(sets.n, threshold) + sets.n // 25 + 2, sets.in_order(None))
            found, counts = np.unique((sets.code[some] >> (HASH_BITS - np.uint64(BUCKET_BITS))).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.astype(np.int32))], names=["bucket", "k"])

    counts = base.mapInArrow(portable(run), "bucket int, k int").groupBy("bucket").agg(F.sum("k").alias("k"))
    counts = stage(counts.where(F.col("k") >= OFTEN), "shingle-counts")
    load = (counts.agg(F.sum("k")).first()[0] or 0) / (1 << BUCKET_BITS)
    level = F.least(F.lit(7), 1 + F.floor(F.log(F.col("k") / (OFTEN + 4 * load)) / F.log(F.lit(4.0)))).cast("int")
    hot = counts.where(F.col("k") >= OFTEN + 4 * load).select("bucket", level.alias("level")).toPandas()  # at most 2**24 rows of a bucket
    return hot["bucket"].to_numpy(np.int32), hot["level"].to_numpy(np.uint8)


def _regions(base: DataFrame, shingle: int, threshold: int, hot: tuple[np.ndarray, np.ndarray], marks: Marks | None) -> DataFrame:
    """region (shingle) and set_id for every region that a set enters; with ``marks`` only regions marked there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.zeros(1 << BUCKET_BITS, np.uint8)
        levels[hot[0]] = hot[1]
        for _, data, offsets in tx.text_chunks(batches, rows=ROWS):
            sets = Sets(data, offsets, shingle)
            some = sets.first(window_size(sets.n, threshold), sets.in_order(levels))
            if marks is not None:
                some = some[marks.holds(sets.code[some])]
            yield pa.RecordBatch.from_arrays([pa.array(sets.code[some].view(np.int64)), pa.array(sets.ids()[sets.row[some]])], names=["region", "set_id"])

    return base.mapInArrow(portable(run), "region bigint, set_id bigint")


def _codes(base: DataFrame, shingle: int, marks: Marks) -> DataFrame:
    """set_id, doc_id and shingle hashes of the sets marked."""
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = marks.holds(batch.column(2).to_numpy())
            for rows, data, offsets in tx.text_chunks([batch.filter(pa.array(hit))], rows=ROWS):
                sets = Sets(data, offsets, shingle)
                values = tx.binary([sets.code[a:b] for a, b in zip(sets.bounds[:-1], sets.bounds[1:])])
                yield pa.RecordBatch.from_arrays([pa.array(sets.ids()), rows.column(0), values], names=["set_id", "doc_id", "codes"])

    return base.mapInArrow(portable(run), f"set_id bigint, doc_id {kind}, codes binary")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one value of the first column at a time, for batches sorted by it."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            if waiting and waiting[-1].column(0)[-1].as_py() != key[a]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def possible(n: np.ndarray, sketches: list[bytes], threshold: int) -> np.ndarray:
    """Which sets have another one whose size and sketch do not rule out the threshold."""
    widths = np.array([len(s) // 8 for s in sketches])
    out = np.zeros(len(n), bool)
    for width in np.unique(widths):
        same, wider = np.flatnonzero(widths == width), np.flatnonzero(widths == 2 * width)
        own = np.frombuffer(b"".join(sketches[k] for k in same), np.uint64).reshape(len(same), width)
        folded = np.frombuffer(b"".join(sketches[k] for k in wider), np.uint64).reshape(len(wider), 2 * width)
        every = np.concatenate((own, folded[:, :width] ^ folded[:, width:]))
        ids = np.concatenate((same, wider))
        for k, i in enumerate(same):
            rest = np.arange(k + 1, len(ids))
            rest = rest[(100 * n[ids[rest]] >= threshold * n[i]) & (100 * n[i] >= threshold * n[ids[rest]])]
            if not len(rest):
                continue
            apart = np.bitwise_count(every[rest] ^ own[k]).sum(1)
            # J >= t means |x ^ y| <= (1 - t) / (1 + t) * (|x| + |y|)
            near = ids[rest[apart * (100 + threshold) <= (100 - threshold) * (n[ids[rest]] + n[i])]]
            if len(near):
                out[i] = True
                out[near] = True
    return out


def components_of(codes: list[np.ndarray], threshold: int, label: np.ndarray | None = None) -> np.ndarray:
    """Component (a member's number) of each set, exactly; sets with equal ``label`` are connected beforehand.

    A pivot is compared with all sets not reached yet, except those that size or the distance to the
    component's first pivot rules out; sets within the threshold join its component and become pivots.
    """
    m = len(codes)
    n = np.array([len(c) for c in codes])
    first = np.cumsum(n) - n
    _, flat = np.unique(np.concatenate(codes), return_inverse=True)
    flat = flat.ravel()
    held = np.zeros(int(flat.max(initial=0)) + 1, bool)
    out, open_ = np.full(m, -1), np.ones(m, bool)
    label = np.arange(m) if label is None else label
    slack = (100 - threshold) / 100 + 1e-9
    while open_.any():
        seed = int(np.flatnonzero(open_)[0])
        frontier = np.flatnonzero(open_ & (label == label[seed])).tolist()
        open_[frontier] = False
        out[frontier] = seed
        far = np.full(m, np.nan)  # distance to the first pivot
        while frontier:
            p = frontier.pop(0)
            rest = np.flatnonzero(open_)
            rest = rest[(100 * n[rest] >= threshold * n[p]) & (100 * n[p] >= threshold * n[rest])]
            if not np.isnan(far[p]):
                rest = rest[~(np.abs(far[rest] - far[p]) > slack)]
            if not len(rest):
                continue
            mine = flat[first[p] : first[p] + n[p]]
            held[mine] = True
            common = np.add.reduceat(held[flat[tx.ranges(first[rest], n[rest])]].astype(np.int64), np.cumsum(n[rest]) - n[rest])
            held[mine] = False
            union = n[rest] + n[p] - common
            if p == seed:
                far[rest], far[p] = 1 - common / union, 0.0
            near = rest[100 * common >= threshold * union]
            if len(near):
                near = np.flatnonzero(open_ & np.isin(label, label[near]))
                open_[near] = False
                out[near] = seed
                frontier += near.tolist()
    return out


def _join_groups(rows: DataFrame, threshold: int) -> DataFrame:
    """Components inside each group of (group, set_id, label, codes): group, set_id, root (a set of the group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        for table in _grouped(batches):
            ids, label = table.column("set_id").to_numpy(), table.column("label").to_numpy()
            codes = [np.frombuffer(c, np.uint64) for c in table.column("codes").to_pylist()]
            held.append((table.column(0)[0].as_py(), ids, ids[components_of(codes, threshold, label)]))
            if sum(len(h[1]) for h in held) >= 10_000:
                yield _roots(held)
                held = []
        if held:
            yield _roots(held)

    ordered = rows.select("group", "set_id", "label", "codes").repartition("group").sortWithinPartitions("group", "set_id")
    return ordered.mapInArrow(portable(run), "group bigint, set_id bigint, root bigint")


def _roots(held: list) -> pa.RecordBatch:
    group = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
    return pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.concatenate([h[1] for h in held])), pa.array(np.concatenate([h[2] for h in held]))], names=["group", "set_id", "root"])


def _edges(joined: DataFrame) -> DataFrame:
    return joined.where("set_id <> root").select(F.col("set_id").alias("a"), F.col("root").alias("b"))


def _large_regions(members: DataFrame, sets: DataFrame, threshold: int, region_size: int, stage: Callable) -> list[DataFrame]:
    """Links of regions above ``region_size``; members has pivot, set_id, size."""
    half = region_size // 2
    blocks = F.pmod(F.xxhash64("set_id"), F.ceil(F.col("size") / half))
    cut = stage(members.withColumn("block", blocks), "large-regions")
    own = cut.join(sets, "set_id").select(F.xxhash64("pivot", "block").alias("group"), "set_id", F.col("set_id").alias("label"), "codes")
    inner = stage(_join_groups(own, threshold), "block-links")
    local = cut.select("pivot", "set_id", "size", "block", F.xxhash64("pivot", "block").alias("group")).join(inner, ["group", "set_id"])
    roots = local.select("pivot", "root").distinct()
    many = roots.groupBy("pivot").agg(F.count("*").alias("roots"))
    meet = (
        roots.join(many, "pivot")
        .join(sets.withColumnRenamed("set_id", "root"), "root")
        .select(F.xxhash64("pivot", F.pmod(F.xxhash64("root"), F.ceil(F.col("roots") / region_size))).alias("group"), F.col("root").alias("set_id"), F.col("root").alias("label"), "codes")
    )
    between = stage(_join_groups(meet, threshold), "root-links")
    links = _edges(inner).unionByName(_edges(between))
    # What is then not in the largest component of its region meets every block of it.
    tops = connected_components(links, stage).select(F.col("v").alias("root"), F.col("component").alias("top"))
    known = stage(local.join(tops, "root", "left").select("pivot", "set_id", "size", "block", F.coalesce("top", "root").alias("label")), "region-labels")
    weight = known.groupBy("pivot", "label").agg(F.count("*").alias("k"))
    main = weight.groupBy("pivot").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("pivot", F.col("m.label").alias("main"))
    outside = known.join(main, "pivot").where("label <> main").select("pivot", "set_id", "label")
    counts = outside.groupBy("pivot").agg(F.count("*").alias("others"))
    outside = outside.join(counts, "pivot").withColumn("part", F.pmod(F.xxhash64("set_id", F.lit(1)), F.ceil(F.col("others") / half)))
    pairs = outside.select("pivot", "part").distinct().join(known.select("pivot", "block").distinct(), "pivot")  # blocks of stragglers by blocks
    group = F.xxhash64("pivot", "part", "block").alias("group")
    asked = outside.join(pairs, ["pivot", "part"]).select(group, "set_id", "label")
    against = known.join(pairs, ["pivot", "block"]).select(group, "set_id", "label")
    last = asked.unionByName(against).distinct().join(sets, "set_id")
    return [links, _edges(stage(_join_groups(last, threshold), "straggler-links"))]


def _common(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the lists share; a list has no value twice."""
    values, flat, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    row, flat = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), flat.ravel()
    order = np.argsort(flat, kind="stable")
    order = order[times[flat[order]] > 1]
    row, col = row[order], (np.cumsum(times > 1) - 1)[flat[order]]
    out, width = np.zeros((len(lists), len(lists)), np.int64), int(np.count_nonzero(times > 1))
    for start in range(0, width, COLUMNS):
        a, b = np.searchsorted(col, [start, start + COLUMNS])
        part = np.zeros((len(lists), min(COLUMNS, width - start)), np.float32)
        part[row[a:b], col[a:b] - start] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def links_of(codes: list[np.ndarray], homes: list[np.ndarray], copies: np.ndarray, pivot: int, side: np.ndarray | None, threshold: int) -> np.ndarray:
    """Copies of the other sets within the threshold of each set, for pairs that share no pivot below ``pivot``; with ``side`` only across."""
    n, common = np.array([len(c) for c in codes]), _common(codes)
    near = 100 * common >= threshold * (n[:, None] + n - common)
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side
    if near.any():
        near &= _common([h[h < pivot] for h in homes]) == 0
    return near @ copies


def _link_counts(small: DataFrame, large: DataFrame, sets: DataFrame, copies: DataFrame, threshold: int, region_size: int, stage: Callable) -> DataFrame:
    """set_id and k, the documents of other sets linked to it, of all sets in a region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            codes = [np.frombuffer(c, np.uint64) for c in table.column("codes").to_pylist()]
            homes = [np.frombuffer(h, ">i8").astype(np.int64) for h in table.column("homes").to_pylist()]
            cross = table.column("cross")[0].as_py()
            side = table.column("side").to_numpy() if cross else None
            k = links_of(codes, homes, table.column("copies").to_numpy(), table.column("pivot")[0].as_py(), side, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(table.column("set_id").to_numpy()), pa.array(k)], names=["set_id", "k"])

    met = small.unionByName(large.select("pivot", "set_id"))
    homes = met.groupBy("set_id").agg(F.unhex(F.array_join(F.collect_list(F.lpad(F.hex("pivot"), 16, "0")), "")).alias("homes"))
    known = stage(sets.join(homes, "set_id").join(copies, "set_id"), "link-sets")
    whole = small.select(F.col("pivot").alias("group"), "pivot", "set_id", F.lit(0).cast("bigint").alias("side"), F.lit(False).alias("cross"))
    blocks = F.ceil(F.col("size") / max(1, region_size // 2))
    cut = large.select("pivot", "set_id", blocks.alias("blocks"), F.pmod(F.xxhash64("set_id"), blocks).alias("side"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    pair = F.xxhash64("pivot", F.least("side", "other"), F.greatest("side", "other")).alias("group")
    parts = cut.select(pair, "pivot", "set_id", "side", (F.col("side") != F.col("other")).alias("cross"))
    rows = whole.unionByName(parts).join(known, "set_id").select("group", "pivot", "set_id", "side", "cross", "codes", "homes", "copies")
    rows = rows.repartition("group").sortWithinPartitions("group", "set_id")
    return rows.mapInArrow(portable(run), "set_id bigint, k bigint").groupBy("set_id").agg(F.sum("k").alias("k"))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, region_size: int = REGION, id_col: str = "doc_id", text_col: str = "text", links: bool = False
) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; with ``links`` also n_links, how many others are within the threshold."""
    base = texts(docs, id_col, text_col).withColumn("dkey", F.xxhash64("doc_id"))
    # One row a document, kept in the shared folder: everything else hangs on it.
    scratch, early = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    documents = scratch.stage(_set_rows(base, shingle), "shingle-sets")
    filled = documents.where("n > 0 AND doc_id IS NOT NULL")
    owners = scratch.stage(filled.groupBy("set_id").agg(F.min("doc_id").alias("owner"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "set-owners")
    known = base.where("doc_id IS NOT NULL")
    hot = _levels(known, shingle, threshold, early.stage)
    shared = early.stage(
        _regions(known, shingle, threshold, hot, None)
        .groupBy("region")
        .agg(F.min("set_id").alias("pivot"), F.max("set_id").alias("last"))
        .where("pivot <> last")
        .select("region", "pivot"),
        "shared-regions",
    )
    entered = _regions(known, shingle, threshold, hot, Marks(shared, "region")).distinct()
    members = entered.join(shared, "region").select("pivot", "set_id").distinct()
    members = early.stage(members.join(owners.select("set_id", "n", "sketch"), "set_id"), "region-members")
    sizes = members.groupBy("pivot").agg(F.count("*").alias("size")).where("size > 1")
    sized = members.join(sizes, "pivot")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            if table.num_rows > 1:
                table = table.combine_chunks()
                keep = possible(table.column("n").to_numpy(), table.column("sketch").to_pylist(), threshold)
                yield from table.select(["pivot", "set_id"]).filter(pa.array(keep)).to_batches()

    small = sized.where(F.col("size") <= region_size).select("pivot", "set_id", "n", "sketch").repartition("pivot").sortWithinPartitions("pivot", "set_id")
    small = scratch.stage(small.mapInArrow(portable(screen), "pivot bigint, set_id bigint"), "possible-members")
    large = scratch.stage(sized.where(F.col("size") > region_size).select("pivot", "set_id", "size"), "large-members")
    early.clear()
    needed = small.select("set_id").unionByName(large.select("set_id")).distinct().join(owners.select("set_id", "owner"), "set_id")
    needed = scratch.stage(needed.withColumn("dkey", F.xxhash64("owner")), "needed-sets")
    codes = _codes(known, shingle, Marks(needed, "dkey")).alias("c").join(needed.alias("o"), F.expr("c.set_id = o.set_id AND c.doc_id = o.owner"))
    sets = scratch.stage(codes.select("c.set_id", "c.codes").dropDuplicates(["set_id"]), "set-codes")
    groups = small.join(sets, "set_id").select(F.col("pivot").alias("group"), "set_id", F.col("set_id").alias("label"), "codes")
    edges = _edges(_join_groups(groups, threshold))
    if not large.isEmpty():
        for more in _large_regions(large, sets, threshold, region_size, scratch.stage):
            edges = edges.unionByName(more)
    # Over sets, not their owners: texts that share a doc_id must not connect what only one of them reaches.
    found = connected_components(edges, scratch.stage)
    reached = found.unionByName(found.select(F.col("component").alias("v"), "component").distinct())
    reached = scratch.stage(reached.join(owners.select(F.col("set_id").alias("v"), "owner"), "v"), "reached-sets")
    least = reached.groupBy("component").agg(F.min("owner").alias("least"))
    named = reached.join(least, "component").select(F.col("v").alias("set_id"), "least")
    classes = owners.select("set_id", "owner").join(named, "set_id", "left").select("set_id", F.coalesce("least", "owner").alias("component_id"))
    names = ["doc_id", F.col("n").alias("n_shingles")]
    alone = documents.where("n = 0 OR doc_id IS NULL").select(*names, F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    n_links = F.lit(0).cast("bigint")
    if links:
        copies = owners.select("set_id", "copies")
        counted = scratch.stage(_link_counts(small, large, sets, copies, threshold, region_size, scratch.stage), "link-counts")
        classes = classes.join(copies, "set_id").join(counted, "set_id", "left")
        n_links = F.coalesce("k", F.lit(0)) + F.col("copies") - 1
    out = filled.join(classes, "set_id").select(*names, "component_id", n_links.alias("n_links")).unionByName(alone)
    out = staged(out if links else out.drop("n_links"), "near-duplicates")
    scratch.clear()
    return out
