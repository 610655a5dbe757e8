"""Expression builders. Everything returns a Column and stays inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode(col: Column | str) -> Column:
    """Text form of a value in which NULL and separators cannot be confused.

    ``concat_ws`` drops NULLs and plain concatenation merges ``('a', 'bc')`` with
    ``('ab', 'c')``; a length prefix and a NULL mark keep them apart.
    """
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.length(text).cast("string"), F.lit(":"), text)
    )


def row_md5(cols: Sequence[Column | str]) -> Column:
    return F.md5(F.concat(*[encode(c) for c in cols]))


def row_hash(cols: Sequence[Column | str]) -> Column:
    """The first 32 bits of the row's md5 as a bigint: any engine can compute it."""
    return F.conv(F.substring(row_md5(cols), 1, 8), 16, 10).cast("bigint")


def hash_total(h: Column) -> Column:
    """Exact sum of 32-bit hashes as a decimal, from two bigint sums that cannot overflow
    (a decimal sum would allocate an object per row)."""
    high, low = F.sum(F.shiftright(h, 16)), F.sum(h.bitwiseAND(F.lit(65535).cast("bigint")))
    return high.cast("decimal(20,0)") * F.lit(65536).cast("decimal(6,0)") + low.cast("decimal(20,0)")


def row_hash64(cols: Sequence[str]) -> Column:
    """64-bit row hash for comparisons inside Spark. ``xxhash64`` skips NULLs, so masks of the
    NULL positions, one for each 60 columns, are hashed along."""
    masks = []
    for start in range(0, len(cols), 60):
        mask = F.lit(0).cast("bigint")
        for i, c in enumerate(cols[start : start + 60]):
            mask = mask.bitwiseXOR(F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
        masks.append(mask)
    return F.xxhash64(*cols, *masks)


def multiset_sum(h: Column) -> Column:
    """Count and sum of 64-bit hashes of a group, as a comparable struct. The hash is summed in
    four 16-bit pieces: plain bigint sums, no overflow below 2^47 rows."""
    piece = F.lit(65535).cast("bigint")
    pieces = [F.sum(F.shiftrightunsigned(h, 16 * i).bitwiseAND(piece)).alias(f"s{i}") for i in range(4)]
    return F.struct(F.count(F.lit(1)).alias("n"), *pieces)


def epoch(col: Column | str) -> Column:
    return F.unix_timestamp(F.col(col) if isinstance(col, str) else col)


def epoch_of(text: str) -> Column:
    """Seconds of a fixed instant written as text; read as UTC whatever the session zone is."""
    return F.unix_timestamp(F.expr(f"TIMESTAMP_NTZ '{text}'"))


def instant(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def floor_div(a: Column, b: Column | int) -> Column:
    """Whole quotient, NULL for a divisor of 0."""
    return F.floor(F.try_divide(a, F.lit(b) if isinstance(b, int) else b)).cast("bigint")


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    """``part`` in percent of ``whole``; NULL when ``whole`` is 0.

    With ``digits`` both are counts, and the result is rounded half up in integers, so that
    19.435 never depends on how a double happens to store it.
    """
    if digits is None:
        return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)
    p, w = part.cast("decimal(20,0)"), F.nullif(whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    scaled = F.call_function("div", p * F.lit(2 * 10 ** (digits + 2)) + w, w * F.lit(2))
    return scaled.cast("double") / F.lit(float(10**digits))


def total(df: DataFrame, agg: Column) -> Column:
    """An aggregate over a whole frame as a scalar subquery: no join, no single-task window."""
    return df.agg(agg.alias("_total")).scalar()


def size_text(bytes_col: Column) -> Column:
    """Bytes as text with binary units and two decimals: ``1.50 KiB``."""
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    value = bytes_col.cast("double")
    out = F.format_string("%.2f %s", value / F.lit(float(1024 ** 5)), F.lit(units[5]))
    for power in range(4, -1, -1):
        out = F.when(
            value < F.lit(float(1024 ** (power + 1))),
            F.format_string("%.2f %s", value / F.lit(float(1024**power)), F.lit(units[power])),
        ).otherwise(out)
    return out


def quantity_text(col: Column) -> Column:
    """Counts as text: ``1.50 thousand``, ``2.00 million``."""
    units = ["", " thousand", " million", " billion", " trillion"]
    value = col.cast("double")
    out = F.format_string("%.2f%s", value / F.lit(1000.0**4), F.lit(units[4]))
    for power in range(3, -1, -1):
        out = F.when(
            value < F.lit(1000.0 ** (power + 1)),
            F.format_string("%.2f%s", value / F.lit(1000.0**power), F.lit(units[power])),
        ).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    """``45s``, ``3m 20s``, ``2h 5m``: the two leading units of a duration in seconds."""
    s = seconds.cast("bigint")
    minutes, hours = floor_div(s, 60), floor_div(s, 3600)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(minutes.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(
            F.concat(hours.cast("string"), F.lit("h "), floor_div(s % 3600, 60).cast("string"), F.lit("m"))
        )
    )


def band(value: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """First label whose lower bound is reached: ``band(p, [(99.5, 'A'), (98, 'B')], 'C')``."""
    out = F.lit(last)
    for bound, label in reversed(list(steps)):
        out = F.when(value >= F.lit(bound), F.lit(label)).otherwise(out)
    return out
