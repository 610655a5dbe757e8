"""Reconciliation and data quality.

Count frames have ``table_name, source_rows, target_rows``; a table that the target lacks has
NULL target rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.columns import (
    band,
    epoch,
    epoch_of,
    hash_total,
    multiset_sum,
    percent,
    row_hash,
    row_hash64,
    size_text,
    total,
)
from tidelog.operators.dead_letters import first_rows
from tidelog.session import staged

SOURCE, TARGET = "source_rows", "target_rows"


def table_count_diff(source_tables: DataFrame, target_tables: DataFrame) -> DataFrame:
    """Number of tables on each side and whether they agree."""
    out = source_tables.agg(F.count_distinct("table_name").alias("source_tables")).withColumn(
        "target_tables", total(target_tables, F.count_distinct("table_name"))
    )
    return out.withColumn("status", F.when(F.col("source_tables") == F.col("target_tables"), "match").otherwise("mismatch"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact counts of many tables as one job: each branch reads no columns and sends one row."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables to count")
    return out


def compare_counts(inventory: DataFrame, rows: DataFrame, side: str = "side") -> DataFrame:
    """Count frame from an inventory (``table_name, in_target``) and tagged rows of both sides."""
    counted = rows.groupBy("table_name").agg(
        F.count_if(F.col(side) == "src").alias(SOURCE), F.count_if(F.col(side) == "tgt").alias(TARGET)
    )
    zero = F.lit(0).cast("bigint")
    return inventory.join(counted, "table_name", "left").select(
        "table_name",
        F.coalesce(SOURCE, zero).alias(SOURCE),
        F.when(F.col("in_target") == 1, F.coalesce(TARGET, zero)).alias(TARGET),
    )


def count_status(counts: DataFrame) -> DataFrame:
    """OK, MISMATCH or MISSING."""
    status = (
        F.when(F.col(TARGET).isNull(), "MISSING").when(F.col(SOURCE) == F.col(TARGET), "OK").otherwise("MISMATCH")
    )
    return counts.withColumn("status", status)


def count_tolerance(counts: DataFrame) -> DataFrame:
    """Difference with tolerance: matched, minor (below 1 %), major or missing.

    ``diff_percent`` is cut to whole percent and 0 for an empty source, as in the reports this
    follows; ``diff_exact`` is the exact percentage. A missing table counts as missing only
    when the source has rows.
    """
    t = F.coalesce(F.col(TARGET), F.lit(0).cast("bigint"))
    diff = F.col(SOURCE) - t
    whole = F.when(F.col(SOURCE) > 0, F.floor(F.abs(diff) * 100 / F.col(SOURCE))).otherwise(0).cast("bigint")
    level = (
        F.when(F.col(TARGET).isNull() & (F.col(SOURCE) > 0), "missing")
        .when(diff == 0, "matched")
        .when(whole < 1, "minor")
        .otherwise("major")
    )
    return counts.withColumns(
        {"diff": diff, "diff_percent": whole, "diff_exact": percent(F.abs(diff), F.col(SOURCE)), "level": level}
    )


def _synced_percent() -> Column:
    return percent(F.col(TARGET), F.col(SOURCE), 1)


def sync_category4(counts: DataFrame) -> DataFrame:
    """missing, empty, partial or success, with the percentage of partial tables."""
    partial = (F.col(SOURCE) > 0) & (F.col(TARGET) < F.col(SOURCE))
    category = F.when(F.col(TARGET).isNull(), "missing").when(F.col(TARGET) == 0, "empty").when(partial, "partial").otherwise("success")
    return counts.withColumns(
        {"category": category, "synced_percent": F.when((F.col(TARGET) > 0) & partial, _synced_percent())}
    )


def success_rate(categories: DataFrame) -> DataFrame:
    """Share of tables in the success category, rated at 90 and 70 percent."""
    rate = percent(F.count_if(F.col("category") == "success"), F.count("*"), 1)
    out = categories.agg(F.count("*").alias("tables"), rate.alias("success_rate"))
    return out.withColumn("rating", band(F.col("success_rate"), [(90, "good"), (70, "fair")], "poor"))


def sync_category6(counts: DataFrame) -> DataFrame:
    """missing, empty_source, empty_target, overfull, partial or success.

    Rows in the target of an empty source are overfull with no percentage: an expected-empty
    table must be empty on both sides.
    """
    category = (
        F.when(F.col(TARGET).isNull(), "missing")
        .when((F.col(SOURCE) == 0) & (F.col(TARGET) == 0), "empty_source")
        .when(F.col(TARGET) == 0, "empty_target")
        .when(F.col(TARGET) > F.col(SOURCE), "overfull")
        .when(F.col(TARGET) < F.col(SOURCE), "partial")
        .otherwise("success")
    )
    shown = F.col("category").isin("overfull", "partial")
    return counts.withColumn("category", category).withColumn("synced_percent", F.when(shown, _synced_percent()))


def sync_category7(counts: DataFrame, close_percent: float = 95.0, close_rows: int = 100) -> DataFrame:
    """missing, empty_both, empty_target, perfect, overfull, close or partial.

    Close: at least 95.0 percent (rounded to one decimal) or at most 100 rows short.
    """
    close = (_synced_percent() >= close_percent) | (F.col(SOURCE) - F.col(TARGET) <= close_rows)
    category = (
        F.when(F.col(TARGET).isNull(), "missing")
        .when((F.col(SOURCE) == 0) & (F.col(TARGET) == 0), "empty_both")
        .when((F.col(SOURCE) > 0) & (F.col(TARGET) == 0), "empty_target")
        .when(F.col(TARGET) == F.col(SOURCE), "perfect")
        .when(F.col(TARGET) > F.col(SOURCE), "overfull")
        .when(close, "close")
        .otherwise("partial")
    )
    shown = F.col("category").isin("overfull", "close", "partial")
    return counts.withColumn("category", category).withColumn("synced_percent", F.when(shown, _synced_percent()))


def category_topn(categories: DataFrame, n: int | None = None, size: str = SOURCE) -> DataFrame:
    """The ``n`` largest tables of each category (all of them if no limit is given), ranked; ties by name."""
    by = Window.partitionBy("category").orderBy(F.col(size).desc(), "table_name")
    ranked = categories.withColumn("position", F.row_number().over(by))
    return ranked if n is None else ranked.where(F.col("position") <= n)


def sync_totals(counts: DataFrame) -> DataFrame:
    """Totals over tables with source rows: sync percentage and the sum of positive deficits."""
    with_data = counts.where(F.col(SOURCE) > 0)
    t = F.coalesce(F.col(TARGET), F.lit(0).cast("bigint"))
    sums = with_data.agg(
        F.coalesce(F.sum(SOURCE), F.lit(0)).alias(SOURCE),
        F.coalesce(F.sum(t), F.lit(0)).alias(TARGET),
        F.coalesce(F.sum(F.greatest(F.col(SOURCE) - t, F.lit(0).cast("bigint"))), F.lit(0)).alias("missing_rows"),
    )
    return sums.withColumns(
        {
            "sync_percent": percent(F.col(TARGET), F.col(SOURCE), 2),
            "missing_percent": percent(F.col("missing_rows"), F.col(SOURCE), 4),
        }
    )


def missing_breakdown(totals: DataFrame, dlq: DataFrame) -> DataFrame:
    """Missing rows split into those in the dead letters and those possibly in transit."""
    out = totals.withColumn("dlq_rows", total(dlq, F.count("*")))
    transit = F.greatest(F.col("missing_rows") - F.col("dlq_rows"), F.lit(0).cast("bigint"))
    return out.withColumns(
        {
            "in_transit": transit,
            "dlq_percent": percent(F.col("dlq_rows"), F.col(SOURCE), 4),
            "transit_percent": percent(transit, F.col(SOURCE), 4),
        }
    )


def sync_grade(breakdown: DataFrame) -> DataFrame:
    """Grades by sync percentage (99.5, 98, 95) and dead-letter percentage (0.5, 2)."""
    sync = band(F.col("sync_percent"), [(99.5, "EXCELLENT"), (98.0, "GOOD"), (95.0, "ACCEPTABLE")], "NEEDS ATTENTION")
    dlq = band(F.col("dlq_percent"), [(2.0, "RECOVER"), (0.5, "INVESTIGATE")], "ACCEPTABLE")
    return breakdown.withColumns({"sync_grade": sync, "dlq_grade": dlq})


def accuracy_grade(statuses: DataFrame) -> DataFrame:
    """Whole percent of tables that match, graded PASSED (95), WARNING (80) or FAILED (also without tables)."""
    whole = F.floor(F.try_divide(F.count_if(F.col("status") == "OK") * 100, F.count("*"))).cast("bigint")
    out = statuses.agg(F.count("*").alias("tables"), whole.alias("accuracy_percent"))
    return out.withColumn("grade", band(F.col("accuracy_percent"), [(95, "PASSED"), (80, "WARNING")], "FAILED"))


def fingerprint(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), id_col: str | None = None) -> DataFrame:
    """Rows, greatest id and sum of row hashes: equal for equal row multisets in any order.

    NULLs are encoded, and the sum is a decimal that cannot overflow. ``by`` gives one
    fingerprint per group.
    """
    hashed = df.select(*by, *([id_col] if id_col else []), row_hash(cols).alias("_hash"))
    sums = hash_total(F.col("_hash")).alias("hash_sum")
    aggs = [F.count("*").alias("n_rows"), *([F.max(id_col).alias("max_id")] if id_col else []), sums]
    return hashed.groupBy(*by).agg(*aggs) if by else hashed.agg(*aggs)


def _comparable(source: DataFrame, target: DataFrame, cols: Sequence[str]) -> Column:
    """Hash of equal rows on both sides: the fast one when the column types agree, else by text."""
    types = [{c: t for c, t in df.dtypes if c in cols} for df in (source, target)]
    return row_hash64(list(cols)) if types[0] == types[1] else row_hash(cols)


def differing_rows(
    source: DataFrame, target: DataFrame, keys: Sequence[str], cols: Sequence[str], nodes: int = 4096, leaf_rows: int = 64
) -> tuple[DataFrame, DataFrame]:
    """Keys and row hashes of both sides below those leaves of a hash tree that differ.

    The key's hash places a row in one of ``nodes`` nodes, and below it in a leaf of some ``leaf_rows`` rows. Both sides are
    summed by node first. Only nodes that differ are looked into: their rows are summed by leaf, and only rows of differing leaves
    are returned, some ``leaf_rows`` for each difference, however large the tables. Where the nodes are no larger than
    leaves the second step falls away.
    """
    keys = list(keys)
    place, value = _comparable(source, target, keys), _comparable(source, target, cols).alias("_hash")

    def side(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.pmod(place, F.lit(nodes)).cast("int").alias("_node"), F.shiftrightunsigned(place, 12).alias("_rest"), value)

    def compared(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
        sums = [df.groupBy(*by).agg(multiset_sum(F.col("_hash")).alias(n)) for df, n in ((left, "_s"), (right, "_t"))]
        joined = sums[0].join(sums[1], by, "full_outer").where(~F.col("_s").eqNullSafe(F.col("_t")))
        return joined.select(*by, F.greatest(F.coalesce("_s.n", F.lit(0)), F.coalesce("_t.n", F.lit(0))).alias("_n"))

    found = staged(compared(side(source), side(target), ["_node"]), "differing-nodes")
    width = F.greatest(F.lit(1), F.ceil(F.col("_n") / leaf_rows)).alias("_width")
    # At most ``nodes`` rows: the broadcast is bounded.
    differing = F.broadcast(found.select("_node", width))
    inside = [side(df).join(differing, "_node").withColumn("_leaf", F.pmod("_rest", "_width")) for df in (source, target)]
    if (found.agg(F.max("_n")).first()[0] or 0) <= leaf_rows:
        return tuple(df.select(*keys, "_hash") for df in inside)
    leaves = staged(compared(*inside, ["_node", "_leaf"]).select("_node", "_leaf"), "differing-leaves")
    return tuple(df.join(leaves, ["_node", "_leaf"], "left_semi").select(*keys, "_hash") for df in inside)


def checksum_diff(
    source: DataFrame, target: DataFrame, keys: Sequence[str], cols: Sequence[str], nodes: int = 4096, leaf_rows: int = 64
) -> DataFrame:
    """Keys whose rows differ between two sides: ``missing``, ``extra`` or ``changed``.

    Only ``differing_rows`` are compared by key, so a nearly equal pair moves few rows. Repeated keys are
    compared as multisets by count and hash sum, never as pairs.
    """
    keys = list(keys)
    left, right = differing_rows(source, target, keys, cols, nodes, leaf_rows)
    sums = [df.groupBy(*keys).agg(multiset_sum(F.col("_hash")).alias(n)) for df, n in ((left, "_s"), (right, "_t"))]
    joined = sums[0].join(sums[1], keys, "full_outer")
    status = F.when(F.col("_t").isNull(), "missing").when(F.col("_s").isNull(), "extra").otherwise("changed")
    return joined.where(~F.col("_s").eqNullSafe(F.col("_t"))).select(*keys, status.alias("difference"))


def sample_keys(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct keys, the same ones for the same seed: lowest salted md5 first.

    A bound on the md5 keeps all but a few times ``n`` rows from leaving the scan; it is raised until it lets ``n``
    keys through or all, so the result is that of sorting every key.
    """
    salted = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    share = 8 * max(n, 1) / max(df.count(), 1)
    while True:
        low = df if share >= 1 else df.where(salted < f"{int(share * 2**32):08x}")
        found = low.select(*keys).distinct().orderBy(salted, *keys).limit(n)
        if share >= 1:
            return found
        found = staged(found, "sampled-keys")
        if found.count() >= n:
            return found
        share *= 16


def sample_match(
    source: DataFrame, target: DataFrame, keys: Sequence[str], cols: Sequence[str], n: int = 5, seed: int = 0
) -> DataFrame:
    """For ``n`` sampled source keys: is the key in the target, and are all values equal."""
    keys = list(keys)
    # the limit bounds the broadcast side
    chosen = F.broadcast(sample_keys(source, keys, n, seed))

    value = _comparable(source, target, cols).alias("_hash")

    def hashed(df: DataFrame, name: str) -> DataFrame:
        rows = df.join(chosen, keys, "left_semi").select(*keys, value)
        return rows.groupBy(*keys).agg(multiset_sum(F.col("_hash")).alias(name))

    joined = hashed(source, "_s").join(hashed(target, "_t"), keys, "left")
    return joined.select(
        *keys,
        F.col("_t").isNotNull().alias("is_found"),
        F.col("_s").eqNullSafe(F.col("_t")).alias("is_equal"),
    )


def reconcile(
    source: DataFrame, target: DataFrame, cols: Sequence[str], by: Sequence[str] = ("table_name",), alert_percent: float = 0.1
) -> DataFrame:
    """Counts and fingerprints of both sides per table, with an alert above 0.1 % difference.

    A table with equal counts and another fingerprint has status ``values_differ`` and alerts.
    """
    value = _comparable(source, target, cols).alias("_hash")

    def side(df: DataFrame, rows: str, name: str) -> DataFrame:
        hashed = df.select(*by, value)
        return hashed.groupBy(*by).agg(F.count("*").alias(rows), multiset_sum(F.col("_hash")).alias(name))

    s, t = side(source, SOURCE, "_sh"), side(target, TARGET, "_th")
    zero = F.lit(0).cast("bigint")
    joined = s.join(t, list(by), "full_outer").withColumns(
        {SOURCE: F.coalesce(SOURCE, zero), TARGET: F.coalesce(TARGET, zero)}
    )
    gap = percent(F.abs(F.col(SOURCE) - F.col(TARGET)), F.col(SOURCE))
    equal = F.col("_sh").eqNullSafe(F.col("_th"))
    status = F.when(F.col(SOURCE) != F.col(TARGET), "counts_differ").when(~equal, "values_differ").otherwise("equal")
    alert = (status == "values_differ") | (F.coalesce(gap, F.lit(100.0)) > alert_percent) & (status == "counts_differ")
    return joined.select(*by, SOURCE, TARGET, gap.alias("gap_percent"), status.alias("status"), alert.alias("is_alert"))


def pk_nulls(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NULLs per key column, one pass over the table; only columns that have some."""
    counted = df.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in keys])
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("column_name"), F.col(k).alias("null_rows")) for k in keys]))
    return counted.select(pairs).where(F.col("null_rows") > 0)


def duplicate_groups(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Groups of equal rows (over all columns unless named) with more than one member."""
    by = list(cols or df.columns)
    return df.groupBy(*by).agg(F.count("*").alias("n_copies")).where(F.col("n_copies") > 1)


def freshness(df: DataFrame, ts: str, as_of: str, table: str = "table_name") -> DataFrame:
    """Age of the newest row per table: fresh (10 minutes), stale or very_stale (above 1 hour)."""
    newest = df.groupBy(table).agg((epoch_of(as_of) - epoch(F.max(ts))).alias("age_seconds"))
    level = F.when(F.col("age_seconds") > 3600, "very_stale").when(F.col("age_seconds") > 600, "stale").otherwise("fresh")
    return newest.withColumn("level", level)


def quality_grade(tolerance: DataFrame, null_issues: DataFrame, fresh: DataFrame) -> DataFrame:
    """Number of issues (tables off or missing, key columns with NULLs, stale tables), graded."""
    bad = F.count_if(F.col("level") != "matched")
    out = tolerance.agg(bad.alias("count_issues")).withColumns(
        {
            "null_issues": total(null_issues, F.count("*")),
            "stale_issues": total(fresh, F.count_if(F.col("level") != "fresh")),
        }
    )
    issues = F.col("count_issues") + F.col("null_issues") + F.col("stale_issues")
    grade = F.when(issues == 0, "EXCELLENT").when(issues < 5, "GOOD").otherwise("NEEDS ATTENTION")
    return out.withColumns({"issues": issues, "grade": grade})


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """One row per file under ``path``: name and bytes, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("n_bytes"))


def size_report(sizes: DataFrame, top: int | None = None) -> DataFrame:
    """Largest target tables with readable sizes and compression ratio.

    ``sizes`` has ``table_name, source_bytes, target_bytes``, one row or many per table.
    """
    summed = sizes.groupBy("table_name").agg(
        F.sum("source_bytes").alias("source_bytes"), F.sum("target_bytes").alias("target_bytes")
    )
    ratio = F.try_divide(F.col("source_bytes").cast("double"), F.col("target_bytes").cast("double"))
    out = summed.withColumns({"ratio": F.round(ratio, 2), "target_size": size_text(F.col("target_bytes"))})
    return first_rows(out.orderBy(F.col("target_bytes").desc(), "table_name"), top)


def population_stats(counts: DataFrame, rows: str = TARGET) -> DataFrame:
    """Tables with and without rows, and all rows, in one pass."""
    n = F.col(rows)
    return counts.agg(
        F.count("*").alias("tables"),
        F.count_if(n > 0).alias("populated"),
        F.count_if(n == 0).alias("empty"),
        F.sum(n).alias("rows"),
    )
