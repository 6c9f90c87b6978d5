"""Running sums and ranks that no single task has to hold: slices of the order first, then rows inside a slice.

The table is written once and then read for each step. Slices are cut at approximate quantiles of a numeric key, as many as its number of rows asks for; a slice's total is one
row, so what comes before it is a sum over at most ``SLICES`` rows a group. Equal keys share a slice, therefore callers count by distinct key first where a key may be very common.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Rows of a slice, about, and slices at most (their edges go through the driver).
SLICE_ROWS, SLICES = 100_000, 65_536


def sliced(df: DataFrame, key: Column) -> DataFrame:
    """``df``, written, with ``_slice``, the number of the slice of each row's key; nulls come first."""
    df = written(df)
    slices = min(SLICES, -(-df.count() // SLICE_ROWS))
    number = key.cast("double")
    if slices < 2:
        return df.withColumn("_slice", F.lit(0).cast("long"))
    found = df.agg(F.percentile_approx(number, F.array(*(F.lit(i / slices) for i in range(1, slices))), F.lit(4 * slices))).first()[0]
    edges = np.unique(np.array(found or [], float))

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.where(x.isna(), 0, np.searchsorted(edges, x.to_numpy(float), side="right")))

    # Not a number is above all numbers, as in Spark's order.
    return df.withColumn("_slice", F.when(F.isnan(number), F.lit(slices).cast("long")).otherwise(place(number)))


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in columns))


def below(df: DataFrame, key: str, sums: list[str], by: list[str] = [], order: list[Column | str] | None = None) -> DataFrame:  # noqa: B006
    """``df`` with ``below_<c>``, the sum of c over the rows of a row's group that come before it, and ``all_<c>``, over the whole group.

    The order is ``order``, which must begin with the numeric ``key`` (that alone by default).
    """
    d = sliced(df, F.col(key))
    group = [*by, "_slice"]
    totals = d.groupBy(*group).agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    whole = Window.partitionBy(*by or [F.lit(0)])
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums), *(F.sum(f"_t_{c}").over(whole).alias(f"all_{c}") for c in sums))
    inside = Window.partitionBy(*group).orderBy(*(order or [key])).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    j = d.join(offsets, _same(d, offsets, group))
    return j.select(*(d[c] for c in df.columns), *((F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"below_{c}") for c in sums), *(F.col(f"all_{c}") for c in sums))


def numbered(df: DataFrame, key: str, by: list[str] = [], order: list[Column | str] | None = None) -> DataFrame:  # noqa: B006
    """``df`` with place (from 1) and all (rows) in each group's order."""
    return below(df.withColumn("_one", F.lit(1).cast("long")), key, ["_one"], by, order).withColumns({"place": F.col("below__one") + 1, "all": F.col("all__one")}).drop("_one", "below__one", "all__one")


def md5_number(key: Column) -> Column:
    """48 bits of a key's md5 as a number, in the order of the digests."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 12), 16, 10).cast("double")
