"""A versioned log that folds itself, and a table whose upserts find their keys through it.

``FoldingLog`` holds rows by hash bucket of their key. Every batch adds one *run*; a small manifest names the
runs of every bucket. Folding merges the runs of those buckets alone whose newer runs have grown large against
their oldest, writes them as one run, and switches to a manifest that names it. Manifests are numbered and appear
whole: a reader sees one generation or the next, a writer that lost a race fails, and what an interrupted
job wrote is named nowhere. Runs of buckets that were not folded keep their files.

Deletes stay as tombstones, so that an older change that arrives late does not bring a key back. A tombstone
goes once every source partition has been consumed past its log position: nothing older can arrive then.

A run carries Bloom filters of its keys, bucket by bucket, as rows of bit words. A lookup reads only the buckets of
the runs that may hold a key asked for.

What the driver holds is metadata: one entry for each bucket of a run, and one position for each source partition.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidelog.model import DELETED
from tidelog.operators.state import last_of_batch, latest_by_key, merge_upsert
from tidelog.session import staged
from tidelog.sources.files import Folder
from tidelog.sources.write import drop_partitions, stream_id, write_table

BLOOM_BITS, BLOOM_HASHES = 10, 4
BUCKET = "_bucket"


class FoldingLog:
    """Versions of rows by key in a folder.

    ``version`` orders the changes of a key. ``position`` is the column that says where in the source's log a
    change stands (growing with the version of a key), ``source`` the columns that name the source partition; both
    are needed only to forget tombstones. ``sources`` names the partitions that must have been seen for that
    (their values joined by ``/``); without it those seen so far.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: Sequence[str],
        version: Sequence[str],
        buckets: int = 64,
        position: str | None = None,
        source: Sequence[str] = (),
        sources: Sequence[str] = (),
        deleted: str = DELETED,
    ):
        if not keys:
            raise ValueError("a log without key columns cannot fold")
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)
        self.keys, self.version, self.buckets, self.deleted = list(keys), list(version), buckets, deleted
        self.position, self.source, self.sources = position, list(source), list(sources)

    # --- manifests -------------------------------------------------------------------

    def manifest(self) -> dict:
        """The newest generation: ``runs`` (oldest first), the last batch of each stream and the consumed positions."""
        names = [n for n in self.folder.names("manifest") if n.endswith(".json")]
        if not names:
            return {"generation": 0, "schema": None, "runs": [], "batches": {}, "marks": {}}
        return json.loads(self.folder.read(f"manifest/{names[-1]}"))

    def _commit(self, manifest: dict, **changes) -> dict:
        after = {**manifest, **changes, "generation": manifest["generation"] + 1}
        if not self.folder.put(f"manifest/{after['generation']:012d}.json", json.dumps(after)):
            raise RuntimeError(f"another writer has made generation {after['generation']} of {self.path}")
        return after

    # --- runs ------------------------------------------------------------------------

    def bucket(self, keys: Sequence[str | Column] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    def _bloom_bits(self, bits: Column | int) -> Column:
        return F.array(*[F.pmod(F.xxhash64(*self.keys, F.lit(k)), F.lit(bits) if isinstance(bits, int) else bits) for k in range(BLOOM_HASHES)])

    def _write_run(self, rows: DataFrame) -> list[dict]:
        """Write one run; an entry for each of its buckets."""
        name = uuid.uuid4().hex
        write_table(rows.withColumn(BUCKET, self.bucket()), f"{self.path}/runs/{name}", [BUCKET], self.keys, mode="error")
        schema = StructType([*rows.schema.fields, StructField(BUCKET, IntegerType())])
        written = self.spark.read.schema(schema).parquet(f"{self.path}/runs/{name}")
        files = written.groupBy(BUCKET, F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("size"))
        sizes = files.groupBy(BUCKET).agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()  # one row for each bucket
        if not sizes:
            return []
        bits = 64
        while bits < BLOOM_BITS * max(r["n"] for r in sizes):
            bits *= 2
        words = written.select(BUCKET, F.explode(self._bloom_bits(bits)).alias("bit")).groupBy(BUCKET, F.floor(F.col("bit") / 64).alias("word"))
        words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits")).write.parquet(f"{self.path}/blooms/{name}")
        return [{"run": name, "bucket": r[BUCKET], "rows": r["n"], "bytes": r["size"], "bits": bits} for r in sorted(sizes, key=lambda r: r[BUCKET])]

    def _read(self, manifest: dict, entries: Sequence[Mapping]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"]) if manifest["schema"] else None
        if schema is None:
            raise ValueError(f"{self.path} holds no batch yet")
        paths = [f"{self.path}/runs/{e['run']}/{BUCKET}={e['bucket']}" for e in entries]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def append(self, batch: DataFrame, batch_id: int, stream: str = "batch") -> bool:
        """Add a batch; one that was added before changes nothing. Batch ids of a stream grow."""
        manifest = self.manifest()
        if batch_id <= manifest["batches"].get(stream, -1):
            return False
        schema = manifest["schema"] or json.loads(batch.schema.json())
        names = StructType.fromJson(schema).fieldNames()
        rows = staged(batch, "folding-batch")
        marks = dict(manifest["marks"])
        if self.position:
            name = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.source]) if self.source else F.lit("")
            # One row for each source partition.
            for r in rows.groupBy(name.alias("source")).agg(F.max(self.position).alias("upto")).where("upto IS NOT NULL").collect():
                marks[r["source"]] = max(r["upto"], marks.get(r["source"], r["upto"]))
        entries = self._write_run(latest_by_key(rows.select(*names), self.keys, self.version))
        self._commit(manifest, schema=schema, runs=[*manifest["runs"], *entries], batches={**manifest["batches"], stream: batch_id}, marks=marks)
        return True

    def low_mark(self, manifest: dict | None = None) -> int | None:
        """The log position that every source partition has been consumed up to."""
        marks = (manifest or self.manifest())["marks"]
        wanted = self.sources or list(marks)
        return min(marks[s] for s in wanted) if wanted and all(s in marks for s in wanted) else None

    # --- folding ---------------------------------------------------------------------

    def due(self, ratio: float = 0.5, runs: int = 8, manifest: dict | None = None) -> list[int]:
        """Buckets whose newer runs hold at least ``ratio`` of the oldest one's bytes, or that have more than ``runs``."""
        by: dict[int, list[dict]] = {}
        for e in (manifest or self.manifest())["runs"]:
            by.setdefault(e["bucket"], []).append(e)
        newer = lambda es: sum(e["bytes"] for e in es[1:])
        return sorted(b for b, es in by.items() if len(es) > runs or (len(es) > 1 and newer(es) >= ratio * es[0]["bytes"]))

    def fold(self, ratio: float = 0.5, runs: int = 8, buckets: Sequence[int] | None = None) -> list[int]:
        """Merge the runs of the buckets that are due (or of those named) and switch to them."""
        manifest = self.manifest()
        chosen = set(self.due(ratio, runs, manifest) if buckets is None else buckets)
        entries = [e for e in manifest["runs"] if e["bucket"] in chosen]
        if not entries:
            return []
        merged = latest_by_key(self._read(manifest, entries), self.keys, self.version)
        mark = self.low_mark(manifest) if self.position else None
        if mark is not None:
            merged = merged.where((F.col(self.deleted) == 0) | (F.col(self.position) > mark) | F.col(self.position).isNull())
        fresh = self._write_run(merged)
        self._commit(manifest, runs=[*[e for e in manifest["runs"] if e["bucket"] not in chosen], *fresh])
        return sorted(chosen)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete runs and manifests that the last ``keep`` generations do not name. Not while a batch is being written."""
        names = [n for n in self.folder.names("manifest") if n.endswith(".json")]
        used = {e["run"] for n in names[-keep:] for e in json.loads(self.folder.read(f"manifest/{n}"))["runs"]}
        gone = [r for r in self.folder.names("runs") if r not in used]
        for r in gone:
            self.folder.delete(f"runs/{r}")
            self.folder.delete(f"blooms/{r}")
        for n in names[:-keep]:
            self.folder.delete(f"manifest/{n}")
        return gone

    # --- reading ---------------------------------------------------------------------

    def rows(self) -> DataFrame:
        """All stored rows of the newest generation."""
        manifest = self.manifest()
        return self._read(manifest, manifest["runs"])

    def latest(self) -> DataFrame:
        """The last row of each key, tombstones included."""
        return latest_by_key(self.rows(), self.keys, self.version)

    def state(self) -> DataFrame:
        return self.latest().where(F.col(self.deleted) == 0)

    def may_hold(self, keys: DataFrame, manifest: dict | None = None) -> list[dict]:
        """Entries of the manifest whose Bloom filter holds one of the keys."""
        entries = (manifest or self.manifest())["runs"]
        if not entries:
            return []
        listed = self.spark.createDataFrame([(e["run"], e["bucket"], e["bits"]) for e in entries], f"run string, {BUCKET} int, size bigint")
        asked = keys.select(*self.keys).distinct().withColumn(BUCKET, self.bucket()).withColumn("ask", F.xxhash64(*self.keys))
        bits = asked.join(listed, BUCKET).select("run", BUCKET, "ask", F.explode(self._bloom_bits(F.col("size"))).alias("bit"))
        stored = reduce(
            DataFrame.unionByName,
            [self.spark.read.parquet(f"{self.path}/blooms/{r}").withColumn("run", F.lit(r)) for r in dict.fromkeys(e["run"] for e in entries)],
        )
        probes = bits.withColumn("word", F.floor(F.col("bit") / 64)).join(stored, ["run", BUCKET, "word"])
        hit = F.expr("bits & shiftleft(1L, CAST(bit % 64 AS INT))") != 0
        held = probes.where(hit).groupBy("run", BUCKET, "ask").agg(F.count("*").alias("n")).where(F.col("n") >= BLOOM_HASHES)
        found = {(r["run"], r[BUCKET]) for r in held.select("run", BUCKET).distinct().collect()}  # entries of the manifest
        return [e for e in entries if (e["run"], e["bucket"]) in found]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The last row of each of the keys, tombstones included; other buckets and runs are not read."""
        manifest = self.manifest()
        asked = keys.select(*self.keys).distinct()
        named = asked.select(*[F.col(k).alias(f"_asked_{k}") for k in self.keys])
        rows = self._read(manifest, self.may_hold(asked, manifest)).join(named, self.same_key("_asked_"), "left_semi")
        return latest_by_key(rows, self.keys, self.version)

    def same_key(self, prefix: str) -> Column:
        """Equal keys, NULL equal to NULL, where the other side's have a prefix."""
        return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in self.keys])


def folding_sink(log: FoldingLog, ratio: float = 0.5, runs: int = 8):
    """``foreachBatch`` function that appends each batch once and folds what is due."""

    def write(batch: DataFrame, batch_id: int) -> None:
        log.append(batch, batch_id, stream_id(batch) or "batch")
        log.fold(ratio, runs)

    return write


class LocatedTable:
    """A partitioned table and the log that says in which partition each key is.

    An upsert asks the log for the batch's keys, drops changes older than what is there (deleted keys too), and rewrites
    only the partitions that hold a key or receive one. The table itself is not scanned for keys.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str], partition: str, buckets: int = 64,
        position: str | None = None, source: Sequence[str] = (), sources: Sequence[str] = (),
    ):
        self.spark, self.data, self.keys, self.version, self.partition = spark, f"{path.rstrip('/')}/data", list(keys), list(version), partition
        self.places = FoldingLog(spark, f"{path.rstrip('/')}/places", keys, version, buckets, position, source, sources)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.data)

    def create(self, rows: DataFrame) -> None:
        """The first rows, one for each key."""
        write_table(rows, self.data, [self.partition], mode="error")
        self.places.append(self._places(rows), 0, "create")

    def _places(self, rows: DataFrame) -> DataFrame:
        extra = [c for c in (self.places.position, *self.places.source) if c]
        return rows.select(*dict.fromkeys([*self.keys, *self.version, self.partition, DELETED, *extra]))

    def holding(self, parts: Sequence) -> DataFrame:
        """The rows of some partitions; the filter prunes files."""
        named = F.col(self.partition).isin([p for p in parts if p is not None])
        return self.read().where(F.coalesce(named, F.lit(None in parts)))

    def upsert(self, batch: DataFrame, batch_id: int, stream: str = "batch", ratio: float = 0.5) -> list:
        """Apply a batch; the partition values that were rewritten."""
        if batch_id <= self.places.manifest()["batches"].get(stream, -1):
            return []
        changes = staged(batch, "located-batch")
        last = staged(last_of_batch(changes, self.keys, self.version), "located-last")
        old = dict.fromkeys([*self.keys, *self.version, self.partition, DELETED])
        known = self.places.lookup(last).select(*[F.col(c).alias(f"_old_{c}") for c in old])
        newer = F.struct(*self.version) > F.struct(*[f"_old_{v}" for v in self.version])
        fresh = staged(last.join(known, self.places.same_key("_old_"), "left").where(F.col(f"_old_{DELETED}").isNull() | newer), "located-fresh")
        kind = self.read().schema[self.partition].dataType
        left = fresh.where(F.col(f"_old_{DELETED}") == 0).select(F.col(f"_old_{self.partition}").cast(kind).alias("p"))
        into = fresh.where(F.col(DELETED) == 0).select(F.col(self.partition).cast(kind).alias("p"))
        touched = [r["p"] for r in left.union(into).distinct().collect()]  # partition values, not rows
        if touched:
            current = self.holding(touched)
            merged = staged(merge_upsert(current, fresh.select(*last.columns), self.keys, self.version), "located-merged", [self.partition])
            write_table(merged.select(*current.columns), self.data, [self.partition], dynamic=True)
            kept = {r[0] for r in merged.select(self.partition).distinct().collect()}
            drop_partitions(self.spark, self.data, self.partition, [p for p in touched if p not in kept])
        # All changes of the batch count as consumed, stale ones too; the log keeps the newest of each key.
        self.places.append(self._places(changes), batch_id, stream)
        self.places.fold(ratio)
        return touched
