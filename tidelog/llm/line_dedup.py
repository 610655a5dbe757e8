"""Repeated lines over a corpus, kept in levelled sorted runs of line hashes (operator 4, DataFrame functions only).

A run is a table bucketed and sorted by line hash: hash, number of documents that hold the line, the largest
doc_id among them, and whether the batch brought the line first. Documents arrive in batches. Each batch merge-anti-joins
the runs, which tells its new lines from known ones, and becomes a run of level 0; ``FANOUT`` runs of a level are
compacted into one of the next level by merge joins. Runs of one folder share their buckets, so that joining and compacting
them moves no row of theirs. The runs stay in their folder where one is given: later batches are added
to them, in any order of doc_id.

Defined results: null or empty text is one empty line; documents with a null doc_id keep all lines
and count for none; rows that share a doc_id count as one document, and each loses its own lines; ids are numbers, texts or
anything else that sorts; a batch that holds an id again which an earlier call has added counts it again;
an empty table gives no rows.
"""

from __future__ import annotations

import json
import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.shared import Scratch, staged, texts, work_dir
from tidelog.sources.files import Folder

FANOUT = 2
BATCHES = 4
HOT = 1000
STRIPPED = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), string.ascii_uppercase, string.ascii_lowercase)


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def placed_keys(text: Column, min_chars: int) -> Column:
    """Position (from 1) and hash (128 bits) of each line whose key has at least ``min_chars`` code points."""
    placed = F.transform(lines_of(text), lambda x, i: F.struct((i + 1).alias("pos"), x.alias("key")))
    long = F.filter(placed, lambda p: F.char_length(p["key"]) >= min_chars)
    keyed = F.transform(long, lambda p: F.struct(p["pos"], line_key(p["key"]).alias("key")))
    kept = F.filter(keyed, lambda p: F.char_length(p["key"]) >= min_chars)
    return F.transform(kept, lambda p: F.struct(p["pos"], _hashed(p["key"]).alias("h")))


class SortedRuns:
    """The levelled runs of one corpus, in a folder that names them by level."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.folder = Folder(spark, folder or work_dir(spark, "line-runs"))
        names = [n for n in self.folder.names("levels") if n.endswith(".json")]
        found = json.loads(self.folder.read(f"levels/{names[-1]}")) if names else {}
        self.generation, self.levels = len(names), found.get("levels", [])
        self.kind, self.buckets = found.get("kind"), found.get("buckets", 0)

    def _table(self, name: str) -> DataFrame:
        """A run as a bucketed table; its entry in the session's catalog is made where it is missing."""
        if not self.spark.catalog.tableExists(name):
            columns = f"h1 BIGINT, h2 BIGINT, n_docs BIGINT, keeper {self.kind}, fresh BOOLEAN"
            place = f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder.path}/{name}'"
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {place}")
        return self.spark.table(name)

    def merged(self) -> DataFrame | None:
        """All lines of the runs with their counts and keepers."""
        runs = [self._table(n) for level in self.levels for n in level]
        return reduce(_merge, runs) if runs else None

    def add(self, held: DataFrame) -> None:
        """Add a batch of (h1, h2, doc_id), of documents that no batch before held."""
        if not self.kind:
            self.kind, self.buckets = held.schema["doc_id"].dataType.simpleString(), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = held.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        fresh = F.lit(True)
        for k, name in enumerate(n for level in self.levels for n in level):
            # An anti-join that marks what it finds: known lines raise counts, and larger ids replace keepers when runs are merged.
            own = own.join(self._table(name).select("h1", "h2", F.lit(True).alias(f"known{k}")), ["h1", "h2"], "left")
            fresh = fresh & F.col(f"known{k}").isNull()
        self._push(0, self._write(own.select("h1", "h2", "n_docs", "keeper", fresh.alias("fresh"))))
        self._commit()

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = run.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        writer.option("path", f"{self.folder.path}/{name}").saveAsTable(name)
        return name

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, reduce(lambda a, b: self._write(_merge(self._table(a), self._table(b))), full))

    def _commit(self) -> None:
        """Name the runs that count from now on; others are deleted after that."""
        self.generation += 1
        state = {"levels": self.levels, "kind": self.kind, "buckets": self.buckets}
        if not self.folder.put(f"levels/{self.generation:09d}.json", json.dumps(state)):
            raise RuntimeError(f"another writer has added a batch to {self.folder.path}")
        used = {n for level in self.levels for n in level}
        for name in self.folder.names():
            if name.startswith("line_run_") and name not in used:
                self._drop(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.folder.delete(name)

    def forget(self) -> None:
        """Delete the runs and their catalog entries."""
        for name in self.folder.names():
            if name.startswith("line_run_"):
                self._drop(name)
        self.folder.delete()


def _merge(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two runs as one. A join, not a union with an aggregate: the buckets of both then meet where they lie."""
    other = two.select("h1", "h2", F.col("n_docs").alias("_n"), F.col("keeper").alias("_keeper"), F.col("fresh").alias("_fresh"))
    zero, no = F.lit(0), F.lit(False)
    return one.join(other, ["h1", "h2"], "full_outer").select(
        "h1",
        "h2",
        (F.coalesce("n_docs", zero) + F.coalesce("_n", zero)).alias("n_docs"),
        F.greatest("keeper", "_keeper").alias("keeper"),
        (F.coalesce("fresh", no) | F.coalesce("_fresh", no)).alias("fresh"),
    )


def _batches(held: DataFrame, batches: int) -> list[Column]:
    """Conditions on doc_id for batches of like size, of ids of any type that sorts."""
    ids = held.select("doc_id").distinct().repartitionByRange(batches, "doc_id")
    tops = sorted(r["top"] for r in ids.groupBy(F.spark_partition_id().alias("part")).agg(F.max("doc_id").alias("top")).collect())
    # As many batches as asked for, however many ranges Spark has made.
    cuts = [tops[len(tops) * k // batches - 1] for k in range(1, batches) if len(tops) * k // batches]
    edges = [None, *sorted(set(cuts) - {tops[-1]} if tops else ()), None]
    out = []
    for low, high in zip(edges, edges[1:]):
        above = F.lit(True) if low is None else F.col("doc_id") > F.lit(low)
        out.append(above if high is None else above & (F.col("doc_id") <= F.lit(high)))
    return out


def repeated_lines(base: DataFrame, min_chars: int, min_docs: int, batches: int, runs: SortedRuns | None = None) -> DataFrame:
    """doc_id, text_hash and ``gone``, the positions of the lines that the row loses, where there are any."""
    scratch = Scratch(base.sparkSession)
    held = scratch.stage(
        base.where("doc_id IS NOT NULL")
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(placed_keys(F.col("text"), min_chars)).alias("k"))
        .select("doc_id", "text_hash", "k.h.h1", "k.h.h2", "k.pos"),
        "line-keys",
    )
    own = runs is None
    runs = runs or SortedRuns(base.sparkSession)
    for part in _batches(held, batches):
        runs.add(held.where(part))
    repeated = scratch.stage(runs.merged().where(F.col("n_docs") >= min_docs), "repeated-lines")
    total = held.count()
    # Fewer than ``HOT`` lines can have a larger share: a bounded side. The rows of the others meet their lines by hash.
    often = F.col("n_docs") * HOT > total
    hot = F.broadcast(repeated.where(often).select("h1", "h2", "keeper"))
    rare = held.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(repeated.where(~often).select("h1", "h2", "keeper"), ["h1", "h2"])
    met = held.join(hot, ["h1", "h2"]).unionByName(rare)
    lost = staged(met.where("doc_id < keeper").groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone")), "lost-lines")
    scratch.clear()
    if own:
        runs.forget()
    return lost


def _kept(text: Column, gone: Column) -> Column:
    """The lines whose positions are not gone; both steps take time with the number of lines."""
    lines = lines_of(text)
    places = F.array_except(F.sequence(F.lit(1), F.size(lines)), gone)
    return F.when(gone.isNull(), lines).otherwise(F.transform(places, lambda p: F.element_at(lines, p)))


def _with_lost(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lost = lost.select(F.col("doc_id").alias("__lost_id"), F.col("text_hash").alias("__lost_hash"), F.col("gone").alias("__gone"))
    return docs.join(lost, (F.col(id_col) == F.col("__lost_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__lost_hash")), "left")


def drop_repeated_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = BATCHES,
    id_col: str = "doc_id",
    text_col: str = "text",
    runs: SortedRuns | None = None,
) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every document.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents stays only in the
    largest doc_id that holds it. With ``runs`` the documents are added to those that were there before, and count with them.
    """
    base = texts(docs, id_col, text_col)
    lost = repeated_lines(base, min_chars, min_docs, batches, runs)
    return (
        _with_lost(base, lost, "doc_id", "text")
        .select("doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), _kept(F.col("text"), F.col("__gone")).alias("kept"))
        .select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
    )


def without_repeated_lines(
    docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with all their columns and the kept text; a null text stays null."""
    lost = repeated_lines(texts(docs, id_col, text_col), min_chars, min_docs, batches)
    kept = F.array_join(_kept(F.col(text_col), F.col("__gone")), "\n")
    joined = _with_lost(docs, lost, id_col, text_col)
    return joined.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
