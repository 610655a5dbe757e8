"""Daily rollups kept by signed deltas: each batch of changes takes old rows out and puts new ones in."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.bi import day_of
from tidelog.model import DELETED
from tidelog.operators.state import last_of_batch
from tidelog.session import staged
from tidelog.sources.files import Folder
from tidelog.sources.folding import FoldingLog


class DeltaRollup:
    """Sum and count per day of the live rows of a change stream.

    A folding log holds the last row of each key, reduced to what the rollup needs. A batch looks up the rows it
    replaces there, writes -1 for each of these and +1 for each new one, summed by day, and reading adds the increments up. No
    month is read again, neither of the table nor of the rollup. Changes older than what is there count nothing, so
    late and repeated deliveries leave the sums right; batch ids grow.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str], ts: str, amount: str, buckets: int = 64):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)
        self.keys, self.version, self.ts, self.amount = list(keys), list(version), ts, amount
        self.rows = FoldingLog(spark, f"{self.path}/rows", keys, version, buckets)

    def apply(self, batch: DataFrame, batch_id: int, ratio: float = 0.5) -> None:
        manifest = self.rows.manifest()
        if batch_id <= manifest["batches"].get("batch", -1):
            return
        needed = list(dict.fromkeys([*self.keys, *self.version, self.ts, self.amount, DELETED]))
        last = staged(last_of_batch(batch.select(*needed), self.keys, self.version), "rollup-batch")
        old = self.rows.lookup(last) if manifest["schema"] else last.limit(0)
        both = last.join(old.select(*[F.col(c).alias(f"_old_{c}") for c in needed]), self.rows.same_key("_old_"), "left")
        newer = F.struct(*self.version) > F.struct(*[f"_old_{v}" for v in self.version])
        applied = both.where(F.col(f"_old_{DELETED}").isNull() | newer)
        into = F.struct(day_of(self.ts).alias("day"), F.col(self.amount).alias("amount"), F.lit(1).cast("bigint").alias("sign"))
        out = F.struct(day_of(f"_old_{self.ts}").alias("day"), (-F.col(f"_old_{self.amount}")).cast(last.schema[self.amount].dataType).alias("amount"), F.lit(-1).cast("bigint").alias("sign"))
        signed = F.array_compact(F.array(F.when(F.col(DELETED) == 0, into), F.when(F.col(f"_old_{DELETED}") == 0, out)))
        deltas = applied.select(F.inline(signed)).groupBy("day").agg(F.sum("amount").alias("total"), F.sum("sign").alias("n"))
        # The same rows come out of an interrupted batch that is run again: the log has not moved yet.
        deltas.write.mode("overwrite").parquet(f"{self.path}/increments/batch={batch_id}")
        self.rows.append(last, batch_id)
        self.rows.fold(ratio)

    def _base(self) -> dict:
        names = [n for n in self.folder.names("bases") if n.endswith(".json")]
        return json.loads(self.folder.read(f"bases/{names[-1]}")) if names else {"upto": -1}

    def _paths(self) -> list[str]:
        upto = self._base()["upto"]
        taken = self.rows.manifest()["batches"].get("batch", -1)
        later = [n for n in self.folder.names("increments") if n.startswith("batch=") and upto < int(n[6:]) <= taken]
        return [*([f"{self.path}/bases/upto={upto}"] if upto >= 0 else []), *[f"{self.path}/increments/{n}" for n in later]]

    def read(self) -> DataFrame:
        """day, total and n of the days that have rows."""
        paths = self._paths()
        if not paths:
            raise ValueError(f"{self.path} holds no batch yet")
        sums = self.spark.read.parquet(*paths).groupBy("day").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        return sums.where("n <> 0")

    def fold(self) -> None:
        """Add the increments up into one base; what it replaces is deleted once the base is in force."""
        upto, before = self.rows.manifest()["batches"].get("batch", -1), self._base()["upto"]
        if upto <= before:
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/bases/upto={upto}")
        if not self.folder.put(f"bases/{upto:012d}.json", json.dumps({"upto": upto})):
            raise RuntimeError(f"another writer has folded {self.path} up to batch {upto}")
        for n in self.folder.names("increments"):
            if n.startswith("batch=") and int(n[6:]) <= upto:
                self.folder.delete(f"increments/{n}")
        if before >= 0:
            self.folder.delete(f"bases/upto={before}")
