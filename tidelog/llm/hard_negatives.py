"""Hard negatives by a vertical branch-and-bound scan of decomposed vectors (operator 12).

Vectors are kept dimension by dimension in blocks, each with the least and greatest entry of every dimension. For an
anchor, dimensions are read in falling order of the anchor's magnitude. After each few dimensions a candidate's score
lies between its partial score plus the least and plus the greatest possible remaining contribution; candidates
that cannot reach a place leave the bitmap, and only the rest is read on. What is left has exact scores.

The first scan finds each anchor's positives, the highest rows of its label; their scores set windows. The second finds
for each positive the highest rows of other labels inside its window. Anchors and blocks meet in the cells of a grid:
a cell holds a bounded number of rows and of anchors and returns at most the places asked for; a rank-limited
window merges the cells. Every anchor meets every block, nothing is sampled.

Defined results: rows with a null id or label, a null vector, or one that holds null, nan or infinity, take no part.
Shorter vectors count as filled up with entries 0. Scaled entries are held within plus and minus 2**26. Rows that repeat are
rows of their own as positives and negatives; an anchor that repeats with equal label and vector is answered once. Rows
with an anchor's id are never its positives. Anchors without a positive, positives without a negative, and empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import Scratch, portable, portable_pair, staged
from tidelog.llm.vectors import finite, matrix, scaled, vector_column

LIMIT = 1 << 26
BLOCK = 1 << 20  # entries of a block
CELL, CELL_ANCHORS = 1 << 21, 1 << 19  # entries of the rows and of the anchors that meet in a cell
READ = (0.25, 0.5, 0.625, 0.75, 0.875, 1.0)  # shares of the dimensions after which candidates are judged


def blocks(vectors: DataFrame, scale: float) -> DataFrame:
    """Blocks of (id, label, vector) rows: ids and labels, sorted by label, and entries dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        for batch in batches:
            widest = max(1, int(np.diff(batch.column(2).offsets.to_numpy(zero_copy_only=False)).max(initial=1)))
            step = max(1, BLOCK // widest)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows, lengths, entries = finite(part.column(2))
                if not len(rows):
                    continue
                x = matrix(lengths, scaled(entries, scale, LIMIT), int(lengths.max())).astype("<i4")
                ids, labels = (part.column(c).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype("<i8") for c in (0, 1))
                order = np.argsort(labels, kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([place], pa.int64()),
                        pa.array([len(rows)], pa.int32()),
                        pa.array([x.shape[1]], pa.int32()),
                        *(pa.array([v[order].tobytes()], pa.binary()) for v in (ids, labels)),
                        pa.array([np.ascontiguousarray(x[order].T).tobytes()], pa.binary()),
                    ],
                    names=["place", "n", "dims", "ids", "labels", "entries"],
                )
                place += 1

    rows = vectors.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    return rows.mapInArrow(portable(run), "place bigint, n int, dims int, ids binary, labels binary, entries binary")


def anchor_rows(vectors: DataFrame, scale: float, every: int) -> DataFrame:
    """anchor, anchor_id, label and entries of every distinct row whose id is divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, entries = finite(batch.column(2))
            x = scaled(entries, scale, LIMIT).astype("<i4")
            ends = np.cumsum(lengths).tolist()
            found = [x[b - n : b].tobytes() for b, n in zip(ends, lengths.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(found, pa.binary())], names=["anchor_id", "label", "x"])

    rows = vectors.where((F.col("id") % every == 0) & F.col("label").isNotNull() & F.col("v").isNotNull())
    found = rows.mapInArrow(portable(run), "anchor_id bigint, label bigint, x binary").distinct()
    return found.withColumn("anchor", F.xxhash64("anchor_id", "label", "x"))


class Cell:
    """The blocks of one cell, dimension by dimension, in the narrowest numbers whose sums are exact."""

    def __init__(self, table: pa.Table, anchors: list[np.ndarray]):
        counts, dims = table.column("n").to_numpy(), table.column("dims").to_numpy()
        self.dims = max([int(dims.max()), *(len(a) for a in anchors)])
        raw = [np.frombuffer(e.as_buffer(), "<i4").reshape(d, n) for e, d, n in zip(table.column("entries"), dims.tolist(), counts.tolist())]
        top = max((int(np.abs(r).max(initial=0)) for r in raw), default=0) * max((int(np.abs(a).sum()) for a in anchors), default=0)
        self.kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
        ids, labels = (np.concatenate([np.frombuffer(v.as_buffer(), "<i8") for v in table.column(c)]) for c in ("ids", "labels"))
        order = np.argsort(labels, kind="stable")
        x = np.zeros((self.dims, len(ids)), self.kind)
        at = 0
        for r in raw:
            x[: len(r), at : at + r.shape[1]] = r
            at += r.shape[1]
        self.ids, self.labels, self.x = ids[order], labels[order], x[:, order]
        self.bounds: dict = {}

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]).tolist())

    def _bounds(self, among: slice) -> tuple[np.ndarray, np.ndarray]:
        key = (among.start, among.stop)
        if key not in self.bounds:
            self.bounds[key] = self.x[:, among].min(axis=1, initial=0), self.x[:, among].max(axis=1, initial=0)
        return self.bounds[key]

    def scan(self, anchor: np.ndarray, among: slice, dead: np.ndarray, windows: list[tuple[float, float]], places: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, most) of scores the ids and scores of its ``places`` highest rows, ties by id.

        ``among`` are the rows looked at and ``dead`` those of them that take no part.
        """
        ids, x = self.ids[among], self.x[:, among]
        a = np.zeros(self.dims, self.kind)
        a[: len(anchor)] = anchor
        order = np.argsort(-np.abs(a), kind="stable")
        low, high = (a * bound for bound in self._bounds(among))
        # Least and greatest contribution of the dimensions not read yet, after 0, 1, ... of them.
        rest_low, rest_high = (np.append(np.cumsum(v[order][::-1])[::-1], 0) for v in (np.minimum(low, high), np.maximum(low, high)))
        score, alive, done = np.zeros(len(ids), self.kind), None, 0
        for share in READ:
            upto = int(np.ceil(self.dims * share))
            read = order[done:upto]
            score = score + a[read] @ (x[read] if alive is None else x[np.ix_(read, alive)])
            done = upto
            least, most = score + rest_low[upto], score + rest_high[upto]
            bitmap = np.zeros(len(score), bool)
            for lowest, highest in windows:
                inside = (most >= lowest) & (least <= highest)
                if alive is None:
                    inside &= ~dead
                sure = least[inside & (least >= lowest) & (most <= highest)]
                if len(sure) >= places:
                    inside &= most >= np.partition(sure, len(sure) - places)[len(sure) - places]
                bitmap |= inside
            kept = np.flatnonzero(bitmap)
            if alive is None or len(kept) < len(score):
                score, alive = score[kept], kept if alive is None else alive[kept]
        score = score.astype(np.int64)  # whole numbers already
        out = []
        for lowest, highest in windows:
            at = np.flatnonzero((score >= lowest) & (score <= highest))
            best = at[np.lexsort((ids[alive[at]], -score[at]))[:places]]
            out.append((ids[alive[best]], score[best]))
        return out


def _grid(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and anchors with the cells they meet in; each pair of them meets in exactly one."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.col("n").cast("bigint") * F.col("dims")), F.count("*")).first()
    across = max(-(-(size[0] or 0) // CELL), min(size[1], spark.sparkContext.defaultParallelism), 1)
    down = max(-(-(anchors.agg(F.sum(F.length("x").cast("bigint"))).first()[0] or 0) // (4 * CELL_ANCHORS)), 1)
    copies = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    return (
        rows.select(F.pmod("place", F.lit(across)).cast("int").alias("across"), "*").select("*", copies(down, "down")),
        anchors.select(F.pmod("anchor", F.lit(down)).cast("int").alias("down"), "*").select("*", copies(across, "across")),
    )


def _meet(rows: DataFrame, anchors: DataFrame, fn, schema: str) -> DataFrame:
    rows, anchors = _grid(rows, anchors)
    return rows.groupBy("across", "down").cogroup(anchors.groupBy("across", "down")).applyInArrow(portable_pair(fn), schema)


def _anchors(table: pa.Table) -> Iterator[tuple[int, int, int, np.ndarray]]:
    for anchor, anchor_id, label, x in zip(*(table.column(c).to_pylist() for c in ("anchor", "anchor_id", "label", "x"))):
        yield anchor, anchor_id, label, np.frombuffer(x, "<i4")


def _highest(found: DataFrame, by: list[str], places: int, id_col: str, score_col: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score_col).desc(), F.col(id_col))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= places)


def positives(rows: DataFrame, anchors: DataFrame, places: int) -> DataFrame:
    """anchor, anchor_id, rank, positive_id and positive_score of each anchor's highest rows of its label."""
    schema = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            every = list(_anchors(right))
            cell = Cell(left, [a[3] for a in every])
            for anchor, anchor_id, label, x in every:
                among = cell.of_label(label)
                dead = cell.ids[among] == anchor_id
                ((ids, scores),) = cell.scan(x, among, dead, [(-np.inf, np.inf)], places)
                for column, values in zip(out, ([anchor] * len(ids), [anchor_id] * len(ids), ids.tolist(), scores.tolist())):
                    column.extend(values)
        return pa.table(out, schema=schema)

    found = _meet(rows, anchors, run, "anchor bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    return _highest(found, ["anchor_id", "anchor"], places, "positive_id", "positive_score")


def negatives(rows: DataFrame, anchors: DataFrame, places: int, least: int, most: int) -> DataFrame:
    """anchor, anchor_id, place of the positive, negative_id and negative_score of the highest rows of other labels in each window.

    ``anchors`` hold ``scores``, their positives' scores in order; a window reaches from ``least`` to ``most`` percent.
    """
    schema = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            every = list(_anchors(right))
            cell = Cell(left, [a[3] for a in every])
            for (anchor, anchor_id, label, x), scores in zip(every, right.column("scores").to_pylist()):
                dead = np.zeros(len(cell.ids), bool)
                dead[cell.of_label(label)] = True
                different = sorted(set(scores))
                windows = [(-(-least * s // 100), most * s // 100) for s in different]
                found = dict(zip(different, cell.scan(x, slice(None), dead, windows, places)))
                for place, score in enumerate(scores, 1):
                    ids, values = found[score]
                    for column, more in zip(out, ([anchor] * len(ids), [anchor_id] * len(ids), [place] * len(ids), ids.tolist(), values.tolist())):
                        column.extend(more)
        return pa.table(out, schema=schema)

    found = _meet(rows, anchors, run, "anchor bigint, anchor_id bigint, place int, negative_id bigint, negative_score bigint")
    return _highest(found, ["anchor_id", "anchor", "place"], places, "negative_id", "negative_score")


def mine(
    vectors: DataFrame,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: float = 256,
    every: int = 100,
    n_positives: int = 5,
    n_negatives: int = 10,
    least: int = 30,
    most: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Anchors are the rows whose id is divisible by ``every``. A negative's score lies between ``least`` and ``most``
    percent of the positive's, both included; scores are inner products of the integers ``floor(scale * entry)``.
    """
    scratch = Scratch(vectors.sparkSession)
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), vector_column(vectors, vector_col).alias("v"))
    rows = scratch.stage(blocks(base, scale), "negatives-blocks")
    anchors = scratch.stage(anchor_rows(base, scale, every), "negatives-anchors")
    found = scratch.stage(positives(rows, anchors, n_positives), "negatives-positives")
    places = found.groupBy("anchor_id", "anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score", "positive_id"))).alias("positives"))
    asked = scratch.stage(anchors.join(places, ["anchor_id", "anchor"]).withColumn("scores", F.col("positives.positive_score")), "negatives-windows")
    ranked = negatives(rows, asked.select("anchor", "anchor_id", "label", "x", "scores"), n_negatives, least, most)
    named = found.select("anchor", "anchor_id", F.col("rank").alias("place"), "positive_id", "positive_score")
    out = staged(
        ranked.join(named, ["anchor_id", "anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"),
        "negatives",
    )
    scratch.clear()
    return out
