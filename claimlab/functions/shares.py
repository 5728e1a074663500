"""Shares, ratios and metric tables over summaries.

The windows here run over summary tables (one row per code, period or state), never over reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def whole_table() -> WindowSpec:
    """Window over all rows of a summary table."""
    return Window.partitionBy(F.lit(0))


def rounded(value: Column, digits: int | None) -> Column:
    """Round unless the caller wants the plain value (`digits=None`)."""
    return value if digits is None else F.round(value, digits)


def percent(part: Column, whole: Column, digits: int | None = 2) -> Column:
    return rounded(F.try_divide(part, whole) * 100, digits)


def share_of_total(column: str, digits: int | None = 2) -> Column:
    """Percentage of a summary column's grand total."""
    return percent(F.col(column), F.sum(column).over(whole_table()), digits)


def share_within(column: str, parents: list[str], digits: int | None = 2) -> Column:
    """Percentage within the parent group; null where a parent key is null."""
    known = F.lit(True)
    for parent in parents:
        known = known & F.col(parent).isNotNull()
    value = percent(F.col(column), F.sum(column).over(Window.partitionBy(*parents)), digits)
    return F.when(known, value)


def ratio(numerator: str, denominator: str, digits: int | None = 2) -> Column:
    return rounded(F.try_divide(F.col(numerator), F.col(denominator)), digits)


def metric_table(one_row: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn a one-row aggregate into (metric, value) rows."""
    columns = columns or one_row.columns
    doubles = one_row.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot([], columns, "metric", "value")


def running_share(column: str, order: str | list[str], digits: int | None = 2) -> Column:
    """Running total of a percentage column in label order."""
    order = [order] if isinstance(order, str) else order
    value = F.sum(column).over(whole_table().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rounded(value, digits)


def year_over_year(column: str, year: str) -> Column:
    """Percentage change from the preceding row in year order."""
    before = F.lag(column).over(whole_table().orderBy(year))
    return (F.try_divide(F.col(column), before) - 1) * 100


def centred_average(column: str, order: str, reach: int = 2) -> Column:
    """Moving average over 2·reach+1 rows; null unless all of them have a value."""
    frame = whole_table().orderBy(order).rowsBetween(-reach, reach)
    return F.when(F.count(column).over(frame) == 2 * reach + 1, F.avg(column).over(frame))


def top_rows(df: DataFrame, n: int, by: str, ties: list[str], ascending: bool = False) -> DataFrame:
    """First n rows by a measure, with a key as tie-break (planned as take-ordered, not a full sort)."""
    first = F.col(by).asc() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(first, *[F.col(t).asc() for t in ties]).limit(n)


def last_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """Last n groups in key order, returned in key order."""
    return df.orderBy(F.col(key).desc()).limit(n).orderBy(key)


def keep_top_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """Rows of the n most frequent non-null groups. The broadcast side has at most n rows."""
    counts = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    top = top_rows(counts, n, "_n", [group]).select(group)
    return df.join(F.broadcast(top), group, "left_semi")


def large_groups(summary: DataFrame, minimum: int, count: str = "count") -> DataFrame:
    """Rows of a summary whose groups have at least `minimum` reports; rows without a count go."""
    return summary.filter(F.col(count) >= minimum)


def aligned(summary: DataFrame, other: DataFrame, keys: list[str], fill: float = 0.0) -> DataFrame:
    """Columns of `other` next to the rows of `summary`; its numbers are `fill` where it lacks the key or the value.

    A null key in `summary` meets a null key in `other`. Keys are expected once in `other`.
    """
    added = [c for c in other.columns if c not in keys]
    if clash := sorted({*added}.intersection(summary.columns)):
        raise ValueError(f"columns of both summaries: {clash}")
    left, right = summary.alias("summary"), other.alias("other")
    same = [F.col(f"summary.`{k}`").eqNullSafe(F.col(f"other.`{k}`")) for k in keys]
    return left.join(right, same, "left").select("summary.*", *[f"other.`{c}`" for c in added]).na.fill(fill, added)


def aligned_ratio(summary: DataFrame, other: DataFrame, keys: list[str], value: str, name: str = "ratio") -> DataFrame:
    """`value` of one summary over that of the other, for keys that both have."""
    return (
        summary.select(*keys, F.col(value).alias("_over"))
        .join(other.select(*keys, F.col(value).alias("_under")), keys)
        .select(*keys, F.try_divide("_over", "_under").alias(name))
    )
