"""Merge semantics: latest version per key, deletes, sign collapse, partial aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import DELETED


def latest_by_key(log: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row with the greatest ``version`` per key.

    ``version`` must order totally (end with an arrival number). ``max_by`` keeps one row per
    key on the map side, so repeated versions of a hot key never travel: one shuffle, of at
    most one row per key and input partition. Filters on keys pass below it.
    """
    if not keys:
        raise ValueError("a table without key columns is append-only and has no current state")
    values = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*values), F.struct(*version)).alias("_row")
    return log.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*log.columns)


def current_state(
    log: DataFrame,
    keys: Sequence[str],
    version: Sequence[str] = ("_version", "arrival"),
    deleted: str | None = DELETED,
    scope: str = "global",
    partition: Sequence[str] = (),
) -> DataFrame:
    """Latest row per key, without keys whose latest row is deleted (``deleted=None`` keeps them).

    The delete flag is tested after the merge: testing it before would bring back the version
    that the delete replaced. ``scope="partition"`` merges within each table partition only,
    which leaves a second live row when a key moved to another partition.
    """
    if scope not in ("global", "partition"):
        raise ValueError(f"unknown scope: {scope}")
    if scope == "partition" and not partition:
        raise ValueError("scope='partition' needs the partition columns")
    by = [*keys, *[p for p in partition if p not in keys]] if scope == "partition" else list(keys)
    merged = latest_by_key(log, by if keys else [], version)
    return merged if deleted is None else merged.where(F.col(deleted) == 0)


def raw_live(log: DataFrame, deleted: str = DELETED) -> DataFrame:
    """Log rows not marked deleted, without merging: old versions count as rows."""
    return log.where(F.col(deleted) == 0)


def collapse_sum(
    df: DataFrame, keys: Sequence[str], measures: Sequence[str], sign: str = "sign", drop_empty: bool = True
) -> DataFrame:
    """``sum(measure * sign)`` per key: cancelled rows fall out whatever order they arrive in."""
    sums = [F.sum(F.col(m) * F.col(sign)).alias(m) for m in measures]
    out = df.groupBy(*keys).agg(*sums, F.sum(sign).alias("_net"))
    return (out.where(F.col("_net") > 0) if drop_empty else out).drop("_net")


def versioned_collapse(
    df: DataFrame, keys: Sequence[str], version: str, sign: str = "sign", order: Sequence[str] = ()
) -> DataFrame:
    """Cancel +1/-1 pairs of the same key and version, then keep the highest live version.

    Rows of one key and version carry equal values; ``order`` breaks ties if they do not.
    """
    values = [c for c in df.columns if c not in (*keys, version, sign)]
    pick = F.max_by(F.struct(*values), F.struct(*(order or values))).alias("_row")
    live = df.groupBy(*keys, version).agg(F.sum(sign).alias("_net"), pick).where(F.col("_net") > 0)
    flat = live.select(*keys, version, "_row.*")
    return latest_by_key(flat, keys, [version])


def summing_merge(parts: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sum partial rows of the same key."""
    return parts.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def agg_state(
    df: DataFrame,
    keys: Sequence[str | Column],
    sums: Mapping[str, Column] | None = None,
    avgs: Mapping[str, Column] | None = None,
    uniqs: Mapping[str, Column] | None = None,
    lg_k: int = 12,
) -> DataFrame:
    """Mergeable partial aggregates: ``<name>__sum``, ``<name>__count``, ``<name>__hll``."""
    aggs: list[Column] = []
    for name, col in (sums or {}).items():
        aggs.append(F.sum(col).alias(f"{name}__sum"))
    for name, col in (avgs or {}).items():
        aggs += [F.sum(col).alias(f"{name}__sum"), F.count(col).alias(f"{name}__count")]
    for name, col in (uniqs or {}).items():
        aggs.append(F.hll_sketch_agg(col, lg_k).alias(f"{name}__hll"))
    return df.groupBy(*keys).agg(*aggs)


def agg_merge(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge partial aggregates of any number of builds and finish them: sum, average, distinct."""
    names = states.columns
    merged = states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in names if c.endswith(("__sum", "__count"))],
        *[F.hll_union_agg(c).alias(c) for c in names if c.endswith("__hll")],
    )
    out: list[Column] = []
    for c in names:
        base = c.rsplit("__", 1)[0]
        if c.endswith("__sum"):
            counted = f"{base}__count"
            out.append(
                F.try_divide(F.col(c).cast("double"), F.col(counted).cast("double")).alias(base)
                if counted in names
                else F.col(c).alias(base)
            )
        elif c.endswith("__hll"):
            out.append(F.hll_sketch_estimate(c).alias(base))
    return merged.select(*keys, *out)


def last_of_batch(batch: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row per key from a batch of changes."""
    return latest_by_key(batch, keys, version)


def merge_upsert(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], version: Sequence[str], deleted: str = DELETED
) -> DataFrame:
    """``target`` after applying a batch of changes by key: last change wins, deletes remove.

    A target that holds the ``version`` columns keeps a row that is newer than the batch's, so a batch
    that is delivered again late changes nothing; without them the batch counts as newer.
    Expressed as one merge over target and batch rather than an anti-join and a union: the
    batch is shuffled once, and a hot key is reduced before the shuffle. Only target columns
    are kept. The target must hold at most one row per key.
    """
    last = last_of_batch(batch, keys, version)
    values = [c for c in target.columns if c not in keys]
    known = [target.schema[v] for v in version] if set(version) <= set(target.columns) else []
    order = [F.col(f.name).cast(f.dataType).alias(f"v{i}") for i, f in enumerate(known)]
    side = lambda n: F.struct(*order, F.lit(n).alias("side")).alias("_side")
    old = target.select(*keys, F.struct(*values).alias("_row"), side(0), F.lit(0).alias("_gone"))
    new = last.select(*keys, F.struct(*values).alias("_row"), side(1), F.col(deleted).cast("int").alias("_gone"))
    merged = old.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct("_row", "_gone"), "_side").alias("_m"))
    return merged.where(F.col("_m._gone") == 0).select(*keys, "_m._row.*").select(*target.columns)
