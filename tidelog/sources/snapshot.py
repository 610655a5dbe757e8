"""Chunked snapshots: chunk bounds from the keys themselves, and chunks merged with a log that goes on meanwhile."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 20  # sketch entries for each chunk: a bound is off by at most a 20th of a chunk


def chunk_bounds(df: DataFrame, key: str, chunks: int) -> list:
    """Up to ``chunks`` - 1 ascending keys that cut ``df`` into chunks of like size, however the keys are spread.

    One pass with a quantile sketch: tasks send sketches of a size that the number of chunks bounds, no key
    is sorted. NULL keys are not counted. Keys are numbers, dates or timestamps.
    """
    if chunks < 1:
        raise ValueError("at least one chunk")
    at = [k / chunks for k in range(1, chunks)]
    if not at:
        return []
    found = df.agg(F.percentile_approx(key, at, ACCURACY * chunks)).first()[0]
    return sorted(set(found or []))


def chunk_number(key: str, bounds: Sequence) -> Column:
    """The chunk of a row, from 0: the number of bounds that its key has reached. NULL keys are in chunk 0."""
    if not bounds:
        return F.lit(0)
    # A balanced decision tree: as many comparisons as the bounds have binary digits.
    def cut(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(key) >= F.lit(bounds[middle]), cut(middle + 1, high)).otherwise(cut(low, middle))

    return cut(0, len(bounds))


def chunk_predicates(key: str, bounds: Sequence) -> list[str]:
    """One condition for each chunk, for readers that take conditions; together they hold every row once, NULL keys too."""
    texts = [str(b) if isinstance(b, (int, float)) else f"'{b}'" for b in bounds]
    if not texts:
        return ["1 = 1"]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(texts, texts[1:])]
    return [f"{key} < {texts[0]} OR {key} IS NULL", *inner, f"{key} >= {texts[-1]}"]


def between_marks(
    rows: DataFrame, log: DataFrame, keys: Sequence[str], position: str, low: str = "_low", high: str = "_high"
) -> DataFrame:
    """One log from a snapshot read in chunks while changes went on.

    ``rows`` are the snapshot's rows with the log positions noted before (``low``) and after (``high``) their chunk was
    read; ``log`` holds the changes. A row counts as read at ``high``, unless its key has a change between the marks:
    then the change says what the row may have missed, and the row goes. No lock and no pause of the source are needed.

    A snapshot holds a key once, so the join looks up one row for each change; a hot key's changes are a stream past it.
    """
    seen = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(low).alias("_from"), F.col(high).alias("_upto"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    inside = (F.col(position) > F.col("_from")) & (F.col(position) <= F.col("_upto"))
    changed = log.select(*keys, position).join(seen, same & inside).select(*[F.col(f"_k{i}") for i in range(len(keys))]).distinct()
    kept = rows.join(changed, same, "left_anti")
    kept = kept.withColumn(position, F.col(high).cast(log.schema[position].dataType)).drop(low, high)
    return kept.unionByName(log, allowMissingColumns=True)
