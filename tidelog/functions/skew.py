"""Joins and windows that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salt_by: Column | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large frame to a frame with at most one row per key.

    Rows of ``many`` are spread over ``salts`` sub-keys and ``one`` is repeated once per
    sub-key, so a key with a third of all rows is shared by ``salts`` tasks whatever AQE does.
    If AQE finds ``one`` below the broadcast threshold it broadcasts and no salt matters.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join keeps rows of the large side only: {how}")
    spread = salt_by if salt_by is not None else F.xxhash64(*many.columns)
    left = many.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def previous_reading(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], bucket: Column
) -> DataFrame:
    """``lag(values)`` per key in ``order``, as columns ``prev_<name>``.

    A plain ``lag`` puts a key's whole history into one task. Here the window runs per
    (key, bucket); the first row of a bucket takes the last row of the key's bucket before
    it, found over one row per (key, bucket). ``bucket`` must grow with ``order``.
    """
    keys = list(keys)
    cols = [order, *[v for v in values if v != order]]
    tagged = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order)
    here = tagged.withColumns({f"_in_{c}": F.lag(c).over(inner) for c in cols})
    here = here.withColumn("_first", F.row_number().over(inner) == 1)

    last = tagged.groupBy(*keys, "_bucket").agg(F.max(F.struct(*cols)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last.withColumn("_carry", F.lag("_last").over(across)).select(*keys, "_bucket", "_carry")

    joined = here.join(carried, [*keys, "_bucket"], "left")
    out = joined.withColumns(
        {
            f"prev_{c}": F.when(F.col("_first"), F.col(f"_carry.{c}")).otherwise(F.col(f"_in_{c}"))
            for c in cols
        }
    )
    return out.select(*df.columns, *[f"prev_{c}" for c in cols])
