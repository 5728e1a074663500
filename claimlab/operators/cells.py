"""Group statistics with exact order statistics that hold up under skew.

A median or percentile needs all values of a group in order, so the plain aggregate keeps a value map
per group in one task. Here reports first collapse to cells, one row per (keys, flags, value) with a
row count. That aggregation combines on the map side and spreads a hot group over every reducer by
value. All sums, means and shares are then algebraic over cells. For quantiles each value also gets a
bucket from a fixed monotone function, so that

1. bucket counts per group (a bounded histogram) locate the bucket that holds each wanted rank,
2. only the cells of those buckets are put in order, one task per (group, bucket), and where there are at most
   `TARGET_LIMIT` such buckets, only they move again: their hashes filter the cells before the second exchange.

No step gathers a whole group, and every step is exact. The cells are one aggregate with a single
count, so the branches that read them share one exchange and the input is scanned once. That holds as
long as every branch needs the count: ask only for measures and quantiles that are used downstream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = "_value"
ROWS = "_rows"
BUCKET = "_bucket"

CENTRE = "_centre"

#: Buckets per doubling of |value|: values of a bucket differ by 0.02 % at every magnitude, small or large.
BUCKETS_PER_DOUBLING = 4096
#: Wanted (group, bucket) pairs whose hashes a query carries to filter cells; beyond it cells are filtered by the join.
TARGET_LIMIT = 2_000
#: Doublings below 1 down to the smallest double, so that bucket numbers of positive values are positive.
_DOUBLINGS_BELOW_ONE = 1075


def bucket_of(value: Column) -> Column:
    """Monotone bucket of a value that depends on nothing but the value."""
    value = value.cast("double")
    size = F.floor((F.log2(F.abs(value)) + _DOUBLINGS_BELOW_ONE) * BUCKETS_PER_DOUBLING)
    return F.when(value == 0, F.lit(0)).when(value < 0, -size).otherwise(size)


def amount_cells(df: DataFrame, keys: list[str], amount: str, flags: list[str] = ()) -> DataFrame:
    """One row per (keys, flags, amount) with the number of reports that share it; NaN is missing, as null is."""
    value = F.col(amount)
    if isinstance(df.schema[amount].dataType, (T.DoubleType, T.FloatType)):
        value = F.when(~F.isnan(value), value)
    return df.groupBy(*keys, *flags, value.alias(VALUE)).agg(F.count(F.lit(1)).alias(ROWS))


# Measures over cells ---------------------------------------------------------------------------


def rows() -> Column:
    return F.sum(ROWS)


def valued() -> Column:
    """Rows with an amount."""
    return F.coalesce(F.sum(F.when(F.col(VALUE).isNotNull(), F.col(ROWS))), F.lit(0))


def _weighted_sum(expr: Column) -> Column:
    return F.sum(expr * F.col(ROWS))


def total() -> Column:
    """Sum of amounts; a group without amounts totals zero."""
    return F.coalesce(_weighted_sum(F.col(VALUE)), F.lit(0.0))


def mean() -> Column:
    return F.try_divide(_weighted_sum(F.col(VALUE)), valued())


def minimum() -> Column:
    return F.min(VALUE)


def maximum() -> Column:
    return F.max(VALUE)


def stddev() -> Column:
    """Sample standard deviation around the group's mean (column `_centre`); null below two values."""
    n = valued()
    apart = F.col(VALUE) - F.col(CENTRE)
    return F.when(n > 1, F.sqrt(_weighted_sum(apart * apart) / (n - 1)))


def with_centre(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Add each group's mean to its cells, so that squares are taken of differences and nothing cancels.

    The means read the exchange of the cells again, not the input; a null key is a group of its own.
    """
    means = cells.groupBy(*keys).agg(mean().alias(CENTRE))
    if not keys:
        return cells.withColumn(CENTRE, means.scalar())
    means = means.withColumnsRenamed({k: f"_centre_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_centre_{k}")) for k in keys])
    return cells.join(means, on, "left").drop(*[f"_centre_{k}" for k in keys])


def rows_where(condition: Column) -> Column:
    """Rows for which a condition holds."""
    return F.coalesce(F.sum(F.when(condition, F.col(ROWS))), F.lit(0))


def total_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(VALUE) * F.col(ROWS))), F.lit(0.0))


def mean_where(condition: Column) -> Column:
    return F.try_divide(
        F.sum(F.when(condition, F.col(VALUE) * F.col(ROWS))), rows_where(condition & F.col(VALUE).isNotNull())
    )


def share(flag: str) -> Column:
    """Mean of a flag; rows where it is unknown do not count."""
    return F.try_divide(rows_where(F.col(flag)), rows_where(F.col(flag).isNotNull()))


# Quantiles -------------------------------------------------------------------------------------


def cell_quantiles(cells: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per entry of `quantiles`."""
    # Missing values stay in as an empty bucket: a filter here, or a plain equality below, would be
    # pushed under the cell aggregation and cost the shared exchange.
    values = cells.withColumn(BUCKET, bucket_of(F.col(VALUE)))
    histogram = values.groupBy(*keys, BUCKET).agg(
        F.sum(F.when(F.col(VALUE).isNotNull(), F.col(ROWS)).otherwise(0)).alias("_in_bucket")
    )

    group = Window.partitionBy(*(keys or [F.lit(0)]))
    up_to_here = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = histogram.withColumns(
        {
            "_end": F.sum("_in_bucket").over(up_to_here),
            "_size": F.sum("_in_bucket").over(group),
        }
    ).withColumn("_start", F.col("_end") - F.col("_in_bucket"))

    ranks = {name: _ranks(p) for name, p in quantiles.items()}
    wanted = reduce(
        lambda a, b: a | b,
        [_holds(rank) for low, high, _ in ranks.values() for rank in (low, high)],
    )
    targets = placed.filter(wanted).select(
        *[F.col(k).alias(f"_target_{k}") for k in keys], F.col(BUCKET).alias("_target_bucket"), "_start", "_size"
    )
    on = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_target_{k}")) for k in keys],
        F.col(BUCKET).eqNullSafe(F.col("_target_bucket")),
    )
    candidates = values.filter(_may_hold(targets, keys)).join(targets, on)

    in_order = Window.partitionBy(*keys, BUCKET).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, 0)
    ordered = candidates.withColumn("_end", F.col("_start") + F.sum(ROWS).over(in_order)).withColumn(
        "_start", F.col("_end") - F.col(ROWS)
    )
    picks = {}
    for name, (low, high, weight) in ranks.items():
        at_low = F.max(F.when(_holds(low), F.col(VALUE)))
        at_high = F.max(F.when(_holds(high), F.col(VALUE)))
        picks[name] = at_low + (at_high - at_low) * F.max(weight)
    return ordered.groupBy(*keys).agg(*[column.alias(name) for name, column in picks.items()])


def _may_hold(targets: DataFrame, keys: list[str]) -> Column:
    """Whether a cell can lie in a wanted bucket, by the set of their hashes; true for all if there are too many.

    The set comes from a scalar subquery that reads the same exchange. The condition names the row count, so
    that it stays above the cells' aggregation and the exchange below remains one.
    """
    name = F.xxhash64(*[f"_target_{k}" for k in keys], "_target_bucket")
    some = targets.select(name.alias("_name")).limit(TARGET_LIMIT + 1).agg(F.collect_set("_name").alias("_names")).scalar()
    own = F.xxhash64(*keys, BUCKET)
    return F.when(F.col(ROWS) > 0, (F.size(some) > TARGET_LIMIT) | F.array_contains(some, own))


def _ranks(p: float) -> tuple[Column, Column, Column]:
    """Zero-based ranks around a quantile and the interpolation weight of the upper one."""
    position = (F.col("_size") - 1) * F.lit(float(p))
    return F.floor(position), F.ceil(position), position - F.floor(position)


def _holds(rank: Column) -> Column:
    return (F.col("_start") <= rank) & (rank < F.col("_end"))


def group_stats(
    df: DataFrame,
    keys: list[str],
    amount: str,
    measures: dict[str, Column],
    quantiles: dict[str, float] | None = None,
    flags: list[str] = (),
) -> DataFrame:
    """Measures and exact quantiles of an amount per group. A null key is a group of its own."""
    return stats_of_cells(amount_cells(df, keys, amount, flags), keys, measures, quantiles)


def stats_of_cells(
    cells: DataFrame, keys: list[str], measures: dict[str, Column], quantiles: dict[str, float] | None = None
) -> DataFrame:
    """Measures and quantiles of cells.

    Cells and quantile rows of a group meet in one aggregation: it treats null keys as equal, needs no
    join, and measures ignore the quantile rows because those have no value and no row count.
    """
    columns = [column.alias(name) for name, column in measures.items()]
    plain = cells
    if any(CENTRE in str(column) for column in columns):
        cells = with_centre(cells, keys)
    if not quantiles:
        return cells.groupBy(*keys).agg(*columns)
    if not measures:
        return cell_quantiles(plain, keys, quantiles)
    both = cells.unionByName(cell_quantiles(plain, keys, quantiles), allowMissingColumns=True)
    return both.groupBy(*keys).agg(*columns, *[F.max(name).alias(name) for name in quantiles])


def running_totals(values: DataFrame, columns: list[str], bucket: Column | None = None) -> DataFrame:
    """Add `<column>_before`, the sum over all smaller values, and `<column>_all`, the sum over all values.

    `values` has one row per distinct `_value`. Sums go up in three steps: ranges of `BUCKETS_PER_DOUBLING`
    buckets, of which doubles have a fixed number, are the only rows that one task puts in order; then the buckets of each
    range, and then the values of each bucket, by tasks of their own.
    """
    placed = values.withColumn(BUCKET, bucket_of(F.col(VALUE)) if bucket is None else bucket)
    span = F.floor(F.col(BUCKET) / BUCKETS_PER_DOUBLING).alias("_range")
    histogram = placed.groupBy(BUCKET).agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns]).select("*", span)
    all_ranges = Window.partitionBy(F.lit(0))
    lower = all_ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = histogram.groupBy("_range").agg(*[F.sum(f"_sum_{c}").alias(f"_sum_{c}") for c in columns])
    ranges = ranges.select(
        F.col("_range").alias("_in_range"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(lower), F.lit(0)).alias(f"_lower_{c}") for c in columns],
        *[F.sum(f"_sum_{c}").over(all_ranges).alias(f"{c}_all") for c in columns],
    )
    smaller = Window.partitionBy("_range").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = histogram.join(ranges, F.col("_range").eqNullSafe(F.col("_in_range"))).select(
        F.col(BUCKET).alias("_offset_bucket"),
        *[(F.col(f"_lower_{c}") + F.coalesce(F.sum(f"_sum_{c}").over(smaller), F.lit(0))).alias(f"_offset_{c}") for c in columns],
        *[f"{c}_all" for c in columns],
    )
    inside = Window.partitionBy(BUCKET).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(offsets, F.col(BUCKET).eqNullSafe(F.col("_offset_bucket")))
    before = {f"{c}_before": F.col(f"_offset_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}
    return joined.withColumns(before).drop(BUCKET, "_offset_bucket", *[f"_offset_{c}" for c in columns])
