"""Running sums, running maxima and row numbers that do not need one task per group.

A plain window sends a whole group (or, without ``PARTITION BY``, the whole table) to one task. Here every
group is cut into buckets that follow the sort order. Bucket totals are pre-aggregated, a window runs over
those few totals, and the row-level window only ever sees one (group, bucket).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"
CARRY = "__carry"


# Rows that one slice of a numbering holds, where the slices are cut by the number of rows.
SLICE_ROWS = 250_000


def md5_digits(rows: int) -> int:
    """Hex digits that cut ``rows`` rows into slices of SLICE_ROWS at most, on average; two at least."""
    return max(2, math.ceil(math.log(max(1.0, rows / SLICE_ROWS), 16)))


def md5_bucket(text: Column, digits: int = 2) -> Column:
    """Bucket that follows the order of the md5 hex text: 16**digits equal slices of the hash range."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("int")


def _between(column: str, bounds: Sequence, leaf) -> Column:
    """``leaf(i)`` where ``i`` bounds are at or below the column: a search tree of literals."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return leaf(low)
        middle = (low + high) // 2
        return F.when(F.col(column) < F.lit(bounds[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(bounds))


def quantile_bucket(df: DataFrame, order: str, slices: int | None = None, tie: str | None = None) -> Column:
    """Bucket that follows the order of a numeric column, cut at approximate quantiles.

    There are 64 slices, or as many as SLICE_ROWS asks for. With a numeric ``tie``, rows of an order value that holds
    several slices are cut by the quantiles of the tie. Only the cuts reach the driver. They become literals, so a retried
    task sees the same buckets.
    """
    slices = slices or max(64, math.ceil(df.count() / SLICE_ROWS))
    points = [i / slices for i in range(1, slices)]
    cuts = df.agg(F.percentile_approx(F.col(order), points, 10_000).alias("c")).first()["c"] or []
    bounds = sorted(set(cuts))
    shares = {value: cuts.count(value) + 1 for value in bounds if cuts.count(value) > 1} if tie else {}
    if not shares:
        return _between(order, bounds, F.lit)
    # A frequent value begins at its own bound, and its bucket ends where the next value does.
    finest = max(shares.values())
    points = [i / finest for i in range(1, finest)]
    rows = df.filter(F.col(order).isin(list(shares))).groupBy(order).agg(F.percentile_approx(F.col(tie), points, 10_000).alias("c"))
    inner = {row[order]: sorted(set(row["c"])) for row in rows.collect()}

    def leaf(i: int) -> Column:
        whole = F.lit(i * (finest + 1))
        value = bounds[i - 1] if i else None
        if value not in inner:
            return whole
        within = _between(tie, inner[value], F.lit)
        # Values between this bound and the next come behind all rows of the frequent one.
        return whole + F.when(F.col(order) == F.lit(value), within).otherwise(F.lit(finest))

    return _between(order, bounds, leaf)


def _carried(
    df: DataFrame, group: Sequence[str], bucket: Column, total: Column, combine, many_groups: bool = False
) -> DataFrame:
    """``df`` plus its bucket and the combined totals of all earlier buckets of the same group.

    With ``many_groups`` the totals are never broadcast: keys computed from small columns are estimated too small.
    """
    keyed = df.withColumn(BUCKET, bucket)
    keys = [*group, BUCKET]
    totals = keyed.groupBy(*keys).agg(total.alias("__total"))
    earlier = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, combine(F.col("__total")).over(earlier).alias(CARRY))
    if not group:
        carry = F.broadcast(carry)  # one row per bucket: at most the number of buckets
    elif many_groups:
        carry = carry.hint("merge")
    return keyed.join(carry, keys)


def running_sum(
    df: DataFrame, value: Column, out: str, order: Sequence[Column], bucket: Column, group: Sequence[str] = ()
) -> DataFrame:
    """Inclusive running sum of ``value`` per group in ``order``; group columns must not be null."""
    carried = _carried(df, group, bucket, F.sum(value), F.sum)
    within = Window.partitionBy(*group, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce(F.col(CARRY), F.lit(0)) + F.sum(value).over(within)
    return carried.withColumn(out, total).drop(BUCKET, CARRY)


def row_index(
    df: DataFrame, out: str, order: Sequence[Column], bucket: Column, group: Sequence[str] = ()
) -> DataFrame:
    """Dense 0-based position in ``order``, per group or over the whole table."""
    carried = _carried(df, group, bucket, F.count(F.lit(1)), F.sum)
    within = Window.partitionBy(*group, BUCKET).orderBy(*order)
    position = F.coalesce(F.col(CARRY), F.lit(0)) + F.row_number().over(within) - 1
    return carried.withColumn(out, position.cast("long")).drop(BUCKET, CARRY)


def running_max(
    df: DataFrame,
    value: Column,
    out: str,
    order: Sequence[Column],
    bucket: Column,
    group: Sequence[str] = (),
    before: bool = False,
    many_groups: bool = False,
) -> DataFrame:
    """Running maximum per group in ``order``; ``before=True`` leaves the current row out."""
    carried = _carried(df, group, bucket, F.max(value), F.max, many_groups)
    within = Window.partitionBy(*group, BUCKET).orderBy(*order)
    within = within.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return carried.withColumn(out, F.greatest(F.col(CARRY), F.max(value).over(within))).drop(BUCKET, CARRY)
