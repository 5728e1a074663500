"""Descriptive statistics, histograms, box plots, pivots, exceedance and rank tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlab.functions import columns as X
from claimlab.functions import labels as L
from claimlab.functions import shares as S
from claimlab.operators import cells as C
from claimlab.operators import features as FT

# Reporting points.
DESCRIBE_PERCENTILES = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 0.999]
TABLE_PERCENTILES = [1, 5, 10, 25, 50, 75, 90, 95, 99, 99.5, 99.9]
#: Every decade that an incident of the 20th or 21st century can fall in.
INCIDENT_DECADES = [f"{year}-{year + 9}" for year in range(1900, 2100, 10)]
EXCEEDANCE_THRESHOLDS = [100_000, 250_000, 500_000, 1_000_000, 2_000_000, 5_000_000]


def describe(df: DataFrame, column: str, percentiles: list[float] = DESCRIBE_PERCENTILES) -> DataFrame:
    """Count, mean, spread, extremes and percentiles as (metric, value) rows."""
    names = {f"{p * 100:g}%": p for p in percentiles}
    stats = C.group_stats(
        df,
        [],
        column,
        {"count": C.valued(), "mean": C.mean(), "std": C.stddev(), "min": C.minimum(), "max": C.maximum()},
        {f"q{i}": p for i, p in enumerate(names.values())},
    )
    renamed = stats.withColumnsRenamed({f"q{i}": name for i, name in enumerate(names)})
    doubles = renamed.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in renamed.columns])
    return doubles.unpivot([], [F.col(f"`{c}`") for c in renamed.columns], "metric", "value")


def percentile_table(df: DataFrame, columns: list[str], points: list[float] = TABLE_PERCENTILES) -> DataFrame:
    """Percentiles of several columns side by side, from one set of cells."""
    long = df.unpivot([], columns, "column", "value")
    stats = C.group_stats(long, ["column"], "value", {}, {f"p{i}": p / 100 for i, p in enumerate(points)})
    by_point = F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.col(f"p{i}").alias("value")) for i, p in enumerate(points)])
    return (
        stats.select("column", F.inline(by_point))
        .groupBy("percentile")
        .pivot("column", columns)
        .agg(F.first("value"))
        .orderBy("percentile")
    )


def shape(df: DataFrame, column: str) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, in one algebraic pass."""
    n = F.col("count").cast("double")
    raw = df.agg(
        F.count(column).alias("count"), F.skewness(column).alias("_g1"), F.kurtosis(column).alias("_g2")
    )
    skew = F.col("_g1") * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    kurtosis = ((n + 1) * F.col("_g2") + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3))
    return raw.select("count", skew.alias("skewness"), kurtosis.alias("kurtosis"))


def centre_and_spread(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value (smallest on ties), interquartile range and total."""
    known = F.when(F.col(C.VALUE).isNotNull(), F.struct(-F.col(C.ROWS), F.col(C.VALUE)))
    stats = C.group_stats(
        df, [], column, {"mode": F.min_by(C.VALUE, known), "total": C.total()}, {"_q1": 0.25, "_q3": 0.75}
    )
    return stats.select("mode", (F.col("_q3") - F.col("_q1")).alias("iqr"), "total")


def histogram(df: DataFrame, column: str, bins: int = 100, cap: float | None = None, log10: bool = False) -> DataFrame:
    """Equal-width bins from minimum to maximum, every bin listed; optionally capped at a quantile or on log scale.

    The cap and the range are single rows, read as scalar subqueries over the shared cells. Values above
    the cap get no bin instead of being filtered, which would give each branch a scan of its own.
    """
    cells = C.amount_cells(df, [], column)
    if log10:
        cells = cells.withColumn(C.VALUE, X.positive_log(F.col(C.VALUE), base10=True))
    value = F.col(C.VALUE)
    if cap is not None:
        value = F.when(value <= C.cell_quantiles(cells, [], {"cap": cap}).scalar(), value)
    # Reading the row count keeps this subquery on the shared cells.
    extent = F.struct(F.min(value).alias("low"), F.max(value).alias("high"), F.sum(C.ROWS).alias("rows"))
    ranged = cells.select(value.alias("_kept"), C.ROWS, cells.agg(extent).scalar().alias("_extent"))
    low, high = F.col("_extent.low"), F.col("_extent.high")
    position = F.floor(F.try_divide(F.col("_kept") - low, high - low) * bins)
    in_range = F.when(high > low, F.least(position, F.lit(bins - 1))).otherwise(0)
    placed = F.when(F.col("_kept").isNotNull(), in_range)
    counts = ranged.groupBy(placed.alias("_bin")).agg(F.sum(C.ROWS).alias("count"))
    every_bin = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    # Null-safe, so that no "bin is not null" filter is pushed under the cells.
    joined = every_bin.join(counts, F.col("bin").eqNullSafe(F.col("_bin")), "left")
    return joined.select("bin", F.coalesce("count", F.lit(0)).alias("count"))


def year_histogram(df: DataFrame, column: str = "LAG_YEARS", first: int = 0, last: int = 34) -> DataFrame:
    """Whole-year bins from `first` up to, and in the last bin including, `last`."""
    within = df.filter(F.col(column).between(first, last))
    counts = within.groupBy(F.least(F.col(column), F.lit(last - 1)).alias("year")).agg(F.count(F.lit(1)).alias("count"))
    years = df.sparkSession.range(first, last).select(F.col("id").cast("int").alias("year"))
    return years.join(counts, "year", "left").select("year", F.coalesce("count", F.lit(0)).alias("count"))


def box_plot(df: DataFrame, group: str, column: str) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers per group, highest median first."""
    cells = C.amount_cells(df.filter(F.col(group).isNotNull()), [group], column)
    quartiles = C.cell_quantiles(cells, [group], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(C.VALUE).between(F.col("q1") - reach, F.col("q3") + reach)
    # Cells meet the small quartile table and shrink at once to one row per group.
    whiskers = (
        cells.join(quartiles, group)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            C.valued().alias("count"),
            F.min(F.when(inside, F.col(C.VALUE))).alias("lower_whisker"),
            F.max(F.when(inside, F.col(C.VALUE))).alias("upper_whisker"),
        )
    )
    return whiskers.orderBy(F.col("median").desc(), group)


def median_by_allegation_and_severity(df: DataFrame) -> DataFrame:
    """Median payment, allegations down and severities across, in severity order."""
    known = FT.complete_cases(df, ["ALGNNATR", "OUTCOME"]).withColumns(
        {
            "allegation": L.lookup(F.col("ALGNNATR"), L.ALLEGATIONS, "Unknown"),
            "outcome": L.lookup(F.col("OUTCOME"), L.OUTCOMES_SHORT, "Unknown"),
        }
    )
    cells = C.group_stats(known, ["allegation", "outcome"], "PAYMENT", {}, {"median": 0.5})
    columns = [*L.OUTCOMES_SHORT.values(), "Unknown"]
    return pivot_summary(cells, "allegation", "outcome", "median", columns)


def pivot_summary(
    summary: DataFrame, rows: str, columns: str, value: str, order: list[str], fill: float | None = None
) -> DataFrame:
    """Spread one column of a summary into fixed, ordered columns; the list saves a job that would find them."""
    wide = summary.groupBy(rows).pivot(columns, order).agg(F.first(value))
    return (wide if fill is None else wide.na.fill(fill, subset=order)).orderBy(rows)


def report_incident_matrix(by_decades: DataFrame, minimum: int = 10) -> DataFrame:
    """Mean payment by report decade (down) and incident decade (across).

    Periods that name no year of the 20th or 21st century and cells below `minimum` reports are left out.
    """
    known = by_decades.filter(F.col("MAL_PERIOD_10Y").rlike("^(19|20)") & (F.col("count") >= minimum))
    return pivot_summary(known, "PERIOD_10Y", "MAL_PERIOD_10Y", "mean_payment_adj", INCIDENT_DECADES)


def exceedance_table(df: DataFrame, column: str, thresholds: list[float] = EXCEEDANCE_THRESHOLDS) -> DataFrame:
    """Count and percentage of positive amounts at or above each threshold, in one pass."""
    positive = df.filter(F.col(column) > 0)
    one_row = positive.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.array(
            *[
                F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col(column) >= t).alias("count"))
                for t in thresholds
            ]
        ).alias("_counts"),
    )
    return (
        one_row.filter(F.col("_rows") > 0)
        .select("_rows", F.inline("_counts"))
        .select("threshold", "count", S.percent(F.col("count"), F.col("_rows"), 4).alias("pct"))
    )


def exceedance_curve(df: DataFrame, column: str) -> DataFrame:
    """Share of amounts strictly above each distinct amount; no row-level sort takes place."""
    cells = C.amount_cells(df.filter(F.col(column).isNotNull()), [], column)
    ranked = C.running_totals(cells, [C.ROWS])
    at_most = F.col(f"{C.ROWS}_before") + F.col(C.ROWS)
    return ranked.select(
        F.col(C.VALUE).alias("amount"),
        F.col(C.ROWS).alias("count"),
        ((1 - at_most / F.col(f"{C.ROWS}_all")) * 100).alias("exceedance_pct"),
    )


def rank_sums(cells: DataFrame, first: Column, second: Column) -> DataFrame:
    """Sizes, U statistic of the first group, and tie term, from cells that carry the group.

    A value of the first group beats every smaller value of the second and half of the equal ones, so
    counts and running counts are enough; neither group is ever sorted as a whole.
    """
    known = F.col(C.VALUE).isNotNull()
    counts = cells.groupBy(C.VALUE).agg(
        C.rows_where(first & known).alias("_a"), C.rows_where(second & known).alias("_b")
    )
    ranked = C.running_totals(counts, ["_a", "_b"])
    tied = (F.col("_a") + F.col("_b")).cast("double")
    return ranked.agg(
        F.coalesce(F.max("_a_all"), F.lit(0)).alias("n_1"),
        F.coalesce(F.max("_b_all"), F.lit(0)).alias("n_2"),
        F.sum(F.col("_a") * (F.col("_b_before") + F.col("_b") / F.lit(2.0))).alias("u_1"),
        F.sum(tied * tied * tied - tied).alias("tie_term"),
    )


def mann_whitney(df: DataFrame, column: str = "PAYMENT") -> DataFrame:
    """Two-sided Mann-Whitney U test of settlements against judgments, with both medians.

    Reports need a payment type and an amount. Without both groups the statistics are null.
    """
    frame = FT.complete_cases(df, ["PAYTYPE", column]).withColumn("_judgment", F.col("PAYTYPE_STR") == "J")
    cells = C.amount_cells(frame, ["_judgment"], column)
    sums = rank_sums(cells, ~F.col("_judgment"), F.col("_judgment"))
    n1, n2 = F.col("n_1").cast("double"), F.col("n_2").cast("double")
    n = n1 + n2
    variance = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("tie_term"), n * (n - 1)))
    both = (F.col("n_1") > 0) & (F.col("n_2") > 0)
    distance = F.abs(F.col("u_1") - n1 * n2 / 2) - 0.5
    test = sums.select(
        F.col("n_1").alias("settlement_n"),
        F.col("n_2").alias("judgment_n"),
        F.when(both, F.col("u_1")).alias("u_statistic"),
        F.when(both & (variance > 0), F.greatest(distance, F.lit(0.0)) / F.sqrt(variance)).alias("z"),
    ).withColumn("p_value", F.when(F.col("z").isNotNull(), F.least(X.normal_tail(F.col("z")), F.lit(1.0))))
    medians = C.cell_quantiles(cells, ["_judgment"], {"_median": 0.5}).select(
        F.when(~F.col("_judgment"), F.col("_median")).alias("settlement_median"),
        F.when(F.col("_judgment"), F.col("_median")).alias("judgment_median"),
    )
    merged = test.unionByName(medians, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def bracket_comparison(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Settlements and judgments over the payment brackets, with running shares; empty brackets are listed."""
    bracket = FT.payment_bracket(F.col("PAYMENT_ADJ"))
    counts = df.groupBy(bracket.alias("bracket")).agg(
        F.count_if(F.col("RESOLUTION_BINARY") == L.NON_JUDGMENT).alias("settlement_count"),
        F.count_if(F.col("RESOLUTION_BINARY") == "Judgment").alias("judgment_count"),
    )
    dim = df.sparkSession.createDataFrame(
        [(i, label) for i, label in enumerate(FT.BRACKET_LABELS)], "bracket_ord int, bracket string"
    )
    sides = ["settlement", "judgment"]
    # Null-safe on purpose: a plain equality would push "bracket is not null", with the whole amount
    # expression in every arm, down to the scan.
    counts = counts.withColumnRenamed("bracket", "_bracket")
    table = dim.join(counts, F.col("bracket").eqNullSafe(F.col("_bracket")), "left").drop("_bracket")
    table = table.na.fill(0, [f"{s}_count" for s in sides])
    table = table.withColumns({f"{s}_pct": S.share_of_total(f"{s}_count", digits) for s in sides})
    return table.withColumns(
        {f"{s}_cumulative_pct": S.running_share(f"{s}_pct", "bracket_ord", digits) for s in sides}
    ).orderBy("bracket_ord")
