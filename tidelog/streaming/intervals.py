"""Repeated deliveries found by the log positions already taken: exact, without a delay, in bounded state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.session import staged
from tidelog.sources.files import Folder

SPAN_BITS = 20  # of positions that are looked at together: a partition with a third of all rows is many spans


def as_intervals(df: DataFrame, source: Sequence[str], low: str, high: str) -> DataFrame:
    """The fewest disjoint intervals (``lo``, ``hi``, both taken) in each span of each source partition.

    The union of interval sets is the same in any order and grouping, so batches and tasks can be merged freely.
    """
    by = Window.partitionBy(*source, "span").orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.select(*source, "span", F.col(low).alias("lo"), F.col(high).alias("hi"))
    islands = rows.withColumn("new", F.when(F.col("lo") <= reach + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(by))
    return islands.groupBy(*source, "span", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


class TakenPositions:
    """The positions taken so far of every source partition, as intervals in a folder; one state for each batch.

    Contiguous positions make one interval for each 2**``SPAN_BITS`` of them, so the state grows with the gaps. The state of a batch is made
    from that of the batch before: a batch that is delivered again finds what it found the first time.
    """

    def __init__(self, spark: SparkSession, path: str, source: Sequence[str], position: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)
        self.source, self.position = list(source), position

    def _state(self, batch_id: int) -> DataFrame | None:
        done = [int(n[6:]) for n in self.folder.names() if n.startswith("state=") and "_SUCCESS" in self.folder.names(n)]
        before = [n for n in done if n < batch_id]
        return self.spark.read.parquet(f"{self.path}/state={max(before)}") if before else None

    def intervals(self) -> DataFrame | None:
        """source, span, lo and hi of all positions taken."""
        return self._state(1 << 62)

    def fresh(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The rows of a batch whose position was not taken before, each position once; they are taken from now on.

        Rows without a position or a source cannot be told apart and stay.
        """
        named = [F.col(c).isNotNull() for c in (*self.source, self.position)]
        known = named[0]
        for n in named[1:]:
            known = known & n
        sources = [f"_source{i}" for i in range(len(self.source))]
        rows = batch.select(
            *[F.col(c).alias(s) for c, s in zip(self.source, sources)],
            F.col(self.position).cast("bigint").alias("lo"),
            F.struct(*batch.columns).alias("_row"),
            known.alias("_known"),
        )
        span = F.shiftright("lo", SPAN_BITS).alias("span")
        keyed = rows.where("_known").select(*sources, span, "lo", F.lit(None).cast("bigint").alias("hi"), F.lit(1).alias("kind"), "_row")
        before = self._state(batch_id)
        if before is not None:
            old = before.select(*sources, "span", "lo", "hi", F.lit(0).alias("kind"), F.lit(None).cast(keyed.schema["_row"].dataType).alias("_row"))
            keyed = keyed.unionByName(old)
        by = Window.partitionBy(*sources, "span").orderBy("lo", "kind")
        reach = F.last("hi", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        first = F.row_number().over(Window.partitionBy(*sources, "span", "lo", "kind").orderBy("lo", "kind")) == 1
        judged = keyed.withColumns({"_reach": reach, "_first": first})
        free = F.coalesce(F.col("_reach") < F.col("lo"), F.lit(True))
        new = staged(judged.where((F.col("kind") == 1) & F.col("_first") & free).select(*sources, "span", "lo", "_row"), "fresh-rows")
        taken = new.select(*sources, "span", "lo", F.col("lo").alias("hi"))
        if before is not None:
            taken = taken.unionByName(before.select(*sources, "span", "lo", "hi"))
        as_intervals(taken, sources, "lo", "hi").write.mode("overwrite").parquet(f"{self.path}/state={batch_id}")
        for n in self.folder.names():  # the one before this stays for a repeated delivery
            if n.startswith("state=") and int(n[6:]) < batch_id - 1:
                self.folder.delete(n)
        return new.select("_row.*").unionByName(rows.where("NOT _known").select("_row.*"))


def once(taken: TakenPositions, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that hands ``sink`` every position once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(taken.fresh(batch, batch_id), batch_id)

    return write
