"""Grouped payment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlab.functions import columns as X
from claimlab.functions import labels as L
from claimlab.functions import shares as S
from claimlab.operators import cells as C
from claimlab.operators import features as FT
from claimlab.schema import CATASTROPHIC_AMOUNT, PEER_STATES

FLAGS = ["CATASTROPHIC", "IS_JUDGMENT"]


MEDIAN = {"median_payment_adj": 0.5}


def _payment_stats(df: DataFrame, keys: list[str], amount: str, median: bool = True) -> DataFrame:
    """Count, mean, median, total and the two flag shares (fractions) per group."""
    measures = {
        "count": C.rows(),
        "mean_payment_adj": C.mean(),
        "total_payment_adj": C.total(),
        "catastrophic_share": C.share("CATASTROPHIC"),
        "judgment_share": C.share("IS_JUDGMENT"),
    }
    return C.group_stats(df, keys, amount, measures, MEDIAN if median else None, FLAGS)


def _with_dollar_shares(summary: DataFrame, digits: int | None, flags_as_percent: bool) -> DataFrame:
    out = {"pct_of_total_dollars": S.share_of_total("total_payment_adj", digits)}
    if "median_payment_adj" in summary.columns:
        out["mean_to_median_ratio"] = S.ratio("mean_payment_adj", "median_payment_adj", digits)
    if flags_as_percent:
        out |= {f: S.rounded(F.col(f) * 100, digits) for f in ("catastrophic_share", "judgment_share")}
    return summary.withColumns(out)


def period_summary(df: DataFrame, period: str, amount: str = "PAYMENT_ADJ", digits: int | None = 2) -> DataFrame:
    """Payment statistics per period; reports without a period form a group of their own."""
    summary = _payment_stats(df, [period], amount).withColumn("pct", S.share_of_total("count", digits))
    return _with_dollar_shares(summary, digits, True).orderBy(period)


def state_period_mode_summary(
    df: DataFrame,
    state: str = "STATE",
    period: str = "PERIOD_10Y",
    mode: str = "PAYMENT_MODE",
    amount: str = "PAYMENT_ADJ",
    digits: int | None = 2,
    median: bool = True,
) -> DataFrame:
    """Payment statistics per state, period and payment mode; `median=False` saves the ordering work."""
    summary = _payment_stats(df, [state, period, mode], amount, median).withColumn(
        "pct_within_state_period", S.share_within("count", [state, period], digits)
    )
    return _with_dollar_shares(summary, digits, True).orderBy(state, period, mode)


def state_summary(df: DataFrame, amount: str = "PAYMENT_ADJ", digits: int | None = 2) -> DataFrame:
    summary = _payment_stats(df, ["STATE"], amount).withColumn("pct", S.share_of_total("count", digits))
    return _with_dollar_shares(summary, digits, True).orderBy(F.col("count").desc(), "STATE")


def peer_state_comparison(
    df: DataFrame,
    states: list[str] = PEER_STATES,
    period: str = "PERIOD_10Y",
    amount: str = "PAYMENT_ADJ",
    digits: int | None = 2,
    median: bool = True,
) -> DataFrame:
    """Statistics per peer state and period. Flag shares are fractions here, unlike the other summaries."""
    peers = df.filter(F.col("STATE").isin(states))
    stats = _payment_stats(peers, ["STATE", period], amount, median)
    return _with_dollar_shares(stats, digits, False).orderBy("STATE", period)


def extract_states(summary: DataFrame, states: list[str]) -> DataFrame:
    """Rows of a state summary that belong to the given states."""
    return summary.filter(F.col("STATE").isin(states))


def latest_period_skew(peer_summary: DataFrame, period: str = "PERIOD_10Y") -> DataFrame:
    """Mean-to-median ratio per peer state in the latest period, least skewed first."""
    latest = F.max(period).over(S.whole_table())
    return (
        peer_summary.withColumn("_latest", latest)
        .filter(F.col(period) == F.col("_latest"))
        .select("STATE", period, S.ratio("mean_payment_adj", "median_payment_adj", None).alias("mean_to_median"))
        .orderBy("mean_to_median", "STATE")
    )


def report_vs_incident_period(df: DataFrame) -> DataFrame:
    keys = ["PERIOD_10Y", "MAL_PERIOD_10Y"]
    return (
        FT.complete_cases(df, keys)
        .groupBy(*keys)
        .agg(F.avg("PAYMENT_ADJ").alias("mean_payment_adj"), F.count(F.lit(1)).alias("count"))
        .orderBy(*keys)
    )


def state_period_rollup(state_period_mode: DataFrame) -> DataFrame:
    """Second-level roll-up over payment modes: summed counts, unweighted means of means and shares."""
    keys = ["STATE", "PERIOD_10Y"]
    return (
        FT.complete_cases(state_period_mode, keys)
        .groupBy(*keys)
        .agg(
            F.sum("count").alias("total_count"),
            F.avg("mean_payment_adj").alias("avg_mean_payment_adj"),
            F.avg("catastrophic_share").alias("avg_catastrophic_share"),
        )
        .orderBy(*keys)
    )


def resolution_by_state(df: DataFrame, digits: int | None = 2, median: bool = True) -> DataFrame:
    known = df.filter(F.col("STATE").isNotNull())
    stats = C.group_stats(
        known,
        ["STATE", "RESOLUTION_BINARY"],
        "PAYMENT_ADJ",
        {"count": C.rows(), "mean_payment_adj": C.mean(), "total_payment_adj": C.total()},
        MEDIAN if median else None,
    )
    return stats.withColumn("pct_within_state", S.share_within("count", ["STATE"], digits)).orderBy(
        "STATE", "RESOLUTION_BINARY"
    )


def resolution_by_period(df: DataFrame, period: str = "PERIOD_10Y", digits: int | None = 2) -> DataFrame:
    counts = (
        df.filter(F.col(period).isNotNull())
        .groupBy(period, "RESOLUTION_BINARY")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return counts.withColumn("pct_within_period", S.share_within("count", [period], digits)).orderBy(
        period, "RESOLUTION_BINARY"
    )


def payment_mode_distribution(df: DataFrame, groups: list[str] | None = None, digits: int | None = 2) -> DataFrame:
    """Counts and percentages of payment modes, overall or within groups."""
    groups = groups or []
    counts = df.groupBy(*groups, "PAYMENT_MODE").agg(F.count(F.lit(1)).alias("count"))
    pct = S.share_within("count", groups, digits) if groups else S.share_of_total("count", digits)
    return counts.withColumn("pct", pct).orderBy(*groups, "PAYMENT_MODE")


def single_multiple_comparison(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Payment size of single-payment against multiple-payment reports."""
    frame = df.filter(F.col("PAYMENT_MODE").isin("Single Payment", "Multiple Payments"))
    stats = C.group_stats(
        frame,
        ["PAYMENT_MODE"],
        "PAYMENT_ADJ",
        {
            "count": C.rows(),
            "mean_payment_adj": C.mean(),
            "std_payment_adj": C.stddev(),
            "max_payment_adj": C.maximum(),
            "total_payment_adj": C.total(),
        },
        {"median_payment_adj": 0.5},
    )
    return stats.withColumns(
        {
            "pct": S.share_of_total("count", digits),
            "pct_of_total_dollars": S.share_of_total("total_payment_adj", digits),
            "mean_to_median_ratio": S.ratio("mean_payment_adj", "median_payment_adj", digits),
        }
    ).orderBy(F.col("count").desc())


def annual_trend(df: DataFrame, median: bool = True) -> DataFrame:
    """Count and totals, means, medians per report year, nominal and adjusted.

    The inflation factor is fixed within a year, so adjusted statistics are the nominal ones times it. It is the
    frame's own CPI_FACTOR where there is one.
    """
    own_factor = "CPI_FACTOR" in df.columns
    extra = {"_factor": F.max("CPI_FACTOR")} if own_factor else {}
    nominal = C.group_stats(
        df.filter(F.col("ORIGYEAR").isNotNull()),
        ["ORIGYEAR"],
        "PAYMENT",
        {"count": C.rows(), "total_nominal": C.total(), "mean_nominal": C.mean(), **extra},
        {"median_nominal": 0.5} if median else None,
        ["CPI_FACTOR"] if own_factor else [],
    )
    factor = F.col("_factor") if own_factor else X.cpi_factor(F.col("ORIGYEAR"))
    adjusted = {
        "total_adj": F.coalesce(F.col("total_nominal") * factor, F.lit(0.0)),
        "mean_adj": F.col("mean_nominal") * factor,
    }
    if median:
        adjusted["median_adj"] = F.col("median_nominal") * factor
    return nominal.withColumns(adjusted).drop("_factor").orderBy("ORIGYEAR")


def annual_changes(trend: DataFrame) -> DataFrame:
    return trend.select(
        "ORIGYEAR",
        S.year_over_year("count", "ORIGYEAR").alias("pct_chg_count"),
        S.year_over_year("mean_adj", "ORIGYEAR").alias("pct_chg_mean_adj"),
    )


def smoothed_trend(trend: DataFrame) -> DataFrame:
    return trend.select(
        "ORIGYEAR",
        S.centred_average("mean_adj", "ORIGYEAR").alias("rolling_mean_adj"),
        S.centred_average("median_adj", "ORIGYEAR").alias("rolling_median_adj"),
    )


def _amount_summary(df: DataFrame, key: str, extra: dict[str, Column] | None = None, quantiles=None) -> DataFrame:
    measures = {"count": C.rows(), "mean": C.mean(), **(extra or {})}
    return C.group_stats(
        df.filter(F.col(key).isNotNull()), [key], "PAYMENT", measures, {"median": 0.5, **(quantiles or {})}
    )


def state_amounts(df: DataFrame) -> DataFrame:
    """Nominal amounts per state with spread, upper tail and maximum."""
    extra = {"total": C.total(), "std": C.stddev(), "max_payment": C.maximum()}
    return _amount_summary(df, "STATE", extra, {"p95": 0.95}).orderBy(F.col("count").desc(), "STATE")


def license_field_amounts(df: DataFrame) -> DataFrame:
    """Nominal amounts per license field; unknown fields are labelled by code."""
    stats = _amount_summary(df, "LICNFELD", {"total": C.total()})
    labelled = L.with_label(stats, "LICNFELD", "license_field", "label")
    fallback = F.concat(F.lit("Code "), F.col("LICNFELD").cast("string"))
    return labelled.withColumn("label", F.coalesce("label", fallback)).orderBy(F.col("count").desc(), "LICNFELD")


def allegation_amounts(df: DataFrame) -> DataFrame:
    stats = _amount_summary(df, "ALGNNATR", {"total": C.total()})
    return stats.withColumn("label", L.lookup(F.col("ALGNNATR"), L.ALLEGATIONS, "Unknown")).orderBy(
        F.col("count").desc(), "ALGNNATR"
    )


def severity_amounts(df: DataFrame) -> DataFrame:
    labelled = df.filter(F.col("OUTCOME").isNotNull()).withColumn(
        "outcome_label", L.lookup(F.col("OUTCOME"), L.OUTCOMES_LONG, "Unknown")
    )
    # The label comes out of the aggregate, so that a filter on it stays above the exchange both branches share.
    stats = _amount_summary(labelled, "outcome_label", {"_label": F.max("outcome_label")}, {"p75": 0.75, "p95": 0.95})
    return stats.drop("outcome_label").withColumnRenamed("_label", "outcome_label").orderBy("outcome_label")


def injury_only(severity: DataFrame, label: str = "outcome_label") -> DataFrame:
    """Severity rows that name an injury, in severity order (the number before the dash)."""
    return (
        severity.filter(~F.col(label).rlike("Cannot|Unknown"))
        .withColumn("severity_order", F.split_part(F.col(label), F.lit("-"), F.lit(1)).cast("int"))
        .orderBy("severity_order")
    )


def patient_sex_amounts(df: DataFrame) -> DataFrame:
    frame = FT.complete_cases(df, ["PTSEX", "PAYMENT"]).withColumn(
        "sex_label", L.lookup(F.upper(X.stripped(F.col("PTSEX"))), L.SEXES, "Unknown")
    )
    return _amount_summary(frame, "sex_label").orderBy("sex_label")


def _ordered_amounts(df: DataFrame, code: str, table: dict, label: str, order: str) -> DataFrame:
    """Amounts per labelled code in rank order; codes outside the table are dropped."""
    stats = _amount_summary(FT.complete_cases(df, [code, "PAYMENT"]).filter(F.col(code).isin(list(table))), code)
    return (
        stats.withColumns({label: L.lookup(F.col(code), table), order: L.rank_of(F.col(code), table)})
        .drop(code)
        .orderBy(order)
    )


def patient_age_amounts(df: DataFrame) -> DataFrame:
    return _ordered_amounts(df, "PTAGE", L.PATIENT_AGES, "age_group", "age_ord")


def practitioner_age_amounts(df: DataFrame) -> DataFrame:
    return _ordered_amounts(df, "PRACTAGE", L.PRACTITIONER_AGES, "practitioner_age_group", "age_ord")


def resolution_amounts(df: DataFrame, digits: int | None = 1) -> DataFrame:
    """Five-way resolution statistics with the share of reports."""
    frame = FT.with_detailed_resolution(df.filter(F.col("PAYMENT").isNotNull()))
    stats = _amount_summary(frame, "RESOLUTION", {"total": C.total()})
    return stats.withColumn("pct", S.share_of_total("count", digits)).orderBy(F.col("count").desc(), "RESOLUTION")


# Catastrophic payments -------------------------------------------------------------------------


def catastrophic_totals(
    df: DataFrame, amount: str = "PAYMENT", threshold: float = CATASTROPHIC_AMOUNT, years: tuple[int, int] | None = None
) -> DataFrame:
    """Number, dollars and size of payments at or above the threshold, optionally for a span of years."""
    source = FT.year_range(df, *years) if years else df
    large = FT.catastrophic(F.col(C.VALUE), threshold)
    cells = C.amount_cells(source, [], amount)
    totals = C.stats_of_cells(
        cells,
        [],
        {
            "total_claims": C.rows(),
            "total_dollars": C.total(),
            "catastrophic_claims": C.rows_where(large),
            "catastrophic_dollars": C.total_where(large),
            "max_payment": C.maximum(),
            "mean_catastrophic": C.mean_where(large),
        },
    )
    median = C.cell_quantiles(
        cells.withColumn(C.VALUE, F.when(large, F.col(C.VALUE))), [], {"median_catastrophic": 0.5}
    )
    both = totals.unionByName(median, allowMissingColumns=True)
    merged = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return merged.withColumns(
        {
            "claim_share_pct": S.percent(F.col("catastrophic_claims"), F.col("total_claims"), None),
            "dollar_share_pct": S.percent(F.col("catastrophic_dollars"), F.col("total_dollars"), None),
        }
    )


def catastrophic_by_year(df: DataFrame, amount: str = "PAYMENT", threshold: float = CATASTROPHIC_AMOUNT) -> DataFrame:
    large = FT.catastrophic(F.col(amount), threshold)
    yearly = (
        df.filter(F.col("ORIGYEAR").isNotNull())
        .groupBy("ORIGYEAR")
        .agg(
            F.count(F.lit(1)).alias("total_claims"),
            F.count_if(large).alias("cat_claims"),
            F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_dollars"),
            F.coalesce(F.sum(F.when(large, F.col(amount))), F.lit(0.0)).alias("cat_dollars"),
        )
    )
    return yearly.withColumns(
        {
            "cat_pct": S.percent(F.col("cat_claims"), F.col("total_claims"), None),
            "cat_dollar_pct": S.percent(F.col("cat_dollars"), F.col("total_dollars"), None),
        }
    ).orderBy("ORIGYEAR")


def catastrophic_profile(df: DataFrame, states: int = 10, allegations: int = 8) -> DataFrame:
    """Leading states and allegations and the outcome mix of catastrophic payments, tagged by dimension.

    Percentages are of all catastrophic payments with a known value in that dimension.
    """
    large = df.filter(FT.catastrophic(F.col("PAYMENT")))
    labelled = large.select(
        F.col("STATE").alias("state"),
        L.lookup(F.col("ALGNNATR"), L.ALLEGATIONS, F.when(F.col("ALGNNATR").isNotNull(), "Unknown")).alias(
            "allegation"
        ),
        L.lookup(F.col("OUTCOME"), L.OUTCOMES_PLAIN, F.when(F.col("OUTCOME").isNotNull(), "Unknown")).alias("outcome"),
    )
    counts = (
        labelled.unpivot([], ["state", "allegation", "outcome"], "dimension", "label")
        .filter(F.col("label").isNotNull())
        .groupBy("dimension", "label")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("pct", S.share_within("count", ["dimension"], None))
    )
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("count").desc(), "label"))
    kept = F.when(F.col("dimension") == "state", states).when(F.col("dimension") == "allegation", allegations)
    return counts.withColumn("_place", place).filter(kept.isNull() | (F.col("_place") <= kept)).drop("_place")


# Incident-to-report lag ------------------------------------------------------------------------
# A valid lag is one of 51 whole numbers, so the percentile map of a group has a fixed size bound.


def lag_records(df: DataFrame) -> DataFrame:
    return df.filter(F.col("VALID_LAG"))


def lag_summary(df: DataFrame) -> DataFrame:
    lag = F.col("LAG_YEARS")
    return S.metric_table(
        lag_records(df).agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(lag).alias("mean_lag_years"),
            F.median(lag).alias("median_lag_years"),
            F.percentile(lag, F.lit(0.9)).alias("p90_lag_years"),
            F.percentile(lag, F.lit(0.95)).alias("p95_lag_years"),
        )
    )


def lag_summary_extended(df: DataFrame) -> DataFrame:
    lag = F.col("LAG_YEARS")
    points = [25, 50, 75, 90, 95, 99]
    return S.metric_table(
        lag_records(df).agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(lag).alias("mean"),
            F.mode(lag, True).alias("mode"),
            F.stddev_samp(lag).alias("std"),
            F.max(lag).alias("max"),
            *[F.percentile(lag, F.lit(p / 100)).alias(f"p{p}") for p in points],
        )
    )


def lag_by(df: DataFrame, key: str) -> DataFrame:
    """Count, mean and median lag per value of a column."""
    lag = F.col("LAG_YEARS")
    return (
        lag_records(df)
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(lag).alias("mean_lag_years"),
            F.median(lag).alias("median_lag_years"),
        )
    )


def lag_by_severity(df: DataFrame) -> DataFrame:
    labels = {**L.OUTCOMES_SHORT, 10: "10-Cannot Det."}
    labelled = df.filter(F.col("OUTCOME").isNotNull()).withColumn(
        "outcome_label", L.lookup(F.col("OUTCOME"), labels, "Unknown")
    )
    return lag_by(labelled, "outcome_label").orderBy("outcome_label")


def slowest_states(df: DataFrame, minimum: int = 100) -> DataFrame:
    return (
        lag_by(df, "STATE")
        .filter(F.col("count") >= minimum)
        .orderBy(F.col("mean_lag_years").desc(), "STATE")
    )


def payment_by_lag(df: DataFrame, minimum: int = 20) -> DataFrame:
    return _amount_summary(lag_records(df), "LAG_YEARS").filter(F.col("count") >= minimum).orderBy("LAG_YEARS")


# Practitioner attributes -----------------------------------------------------------------------


def experience_amounts(df: DataFrame) -> DataFrame:
    frame = FT.with_experience(df.filter(F.col("PAYMENT").isNotNull()))
    stats = _amount_summary(frame, "EXPERIENCE_BAND", {"total": C.total()})
    bands = {band: band for band in FT.EXPERIENCE_LABELS}
    return stats.withColumn("band_ord", L.rank_of(F.col("EXPERIENCE_BAND"), bands)).orderBy("band_ord")


def license_experience_amounts(df: DataFrame, fields: int = 6) -> DataFrame:
    """The most frequent license fields by experience band."""
    frame = FT.with_experience(df.filter(F.col("PAYMENT").isNotNull()))
    top = S.keep_top_groups(frame, "LICNFELD", fields)
    stats = C.group_stats(
        top, ["LICNFELD", "EXPERIENCE_BAND"], "PAYMENT", {"count": C.rows(), "mean": C.mean()}, {"median": 0.5}
    )
    labelled = L.with_label(stats, "LICNFELD", "license_field", "field_label")
    fallback = F.concat(F.lit("Code "), F.col("LICNFELD").cast("string"))
    return labelled.withColumn("field_label", F.coalesce("field_label", fallback)).orderBy(
        "LICNFELD", "EXPERIENCE_BAND"
    )


def _adverse_frame(df: DataFrame) -> DataFrame:
    return FT.with_adverse_flags(FT.complete_cases(df, ["NPMALRPT", "PAYMENT"]))


# Adverse-action flags and their names.
ADVERSE_FLAG_NAMES = {
    "HAS_LICENSURE": "Licensure Action",
    "HAS_PRIVILEGE": "Clinical Privilege Action",
    "HAS_DEA": "DEA Action",
    "HAS_EXCLUSION": "Medicare/Medicaid Exclusion",
    "HAS_ANY_ADVERSE": "ANY Adverse Action",
}


def adverse_action_rates(df: DataFrame) -> DataFrame:
    wide = _adverse_frame(df).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(flag)).alias(name) for flag, name in ADVERSE_FLAG_NAMES.items()],
    )
    long = wide.unpivot(["_rows"], [f"`{name}`" for name in ADVERSE_FLAG_NAMES.values()], "action", "records")
    return long.select("action", "records", S.percent(F.col("records"), F.col("_rows"), None).alias("pct"))


def adverse_by_report_count(df: DataFrame) -> DataFrame:
    """Adverse-action rates and mean payment per malpractice-report-count band."""
    banded = FT.with_report_count_band(_adverse_frame(df)).filter(F.col("REPORT_COUNT_BAND").isNotNull())

    def pct(flag: str):
        return F.avg(F.col(flag).cast("int")) * 100

    bands = {band: band for band in FT.REPORT_COUNT_LABELS}
    return (
        banded.groupBy("REPORT_COUNT_BAND")
        .agg(
            F.count(F.lit(1)).alias("count"),
            pct("HAS_LICENSURE").alias("pct_licensure"),
            pct("HAS_PRIVILEGE").alias("pct_privilege"),
            pct("HAS_ANY_ADVERSE").alias("pct_any_adverse"),
            F.avg("PAYMENT").alias("mean_payment"),
        )
        .withColumn("band_ord", L.rank_of(F.col("REPORT_COUNT_BAND"), bands))
        .orderBy("band_ord")
    )


def adverse_action_summary(df: DataFrame) -> DataFrame:
    """Per action type: reports with one, share, mean and maximum count."""
    frame = _adverse_frame(df)
    present = {c: label for c, label in L.ADVERSE_ACTIONS.items() if c in df.columns}
    count = {c: F.coalesce(F.col(c), F.lit(0)) for c in present}
    per_action = F.array(
        *[
            F.struct(
                F.lit(label).alias("action"),
                F.count_if(count[c] > 0).alias("records_with"),
                F.avg(count[c]).alias("mean_count"),
                F.max(count[c]).alias("max_count"),
            )
            for c, label in present.items()
        ]
    )
    one_row = frame.agg(F.count(F.lit(1)).alias("_rows"), per_action.alias("_actions"))
    return (
        one_row.select("_rows", F.inline("_actions"))
        .select(
            "action",
            "records_with",
            S.percent(F.col("records_with"), F.col("_rows"), None).alias("pct"),
            "mean_count",
            "max_count",
        )
        .orderBy(F.col("records_with").desc(), "action")
    )


def amounts_by_adverse_flag(df: DataFrame) -> DataFrame:
    return _amount_summary(_adverse_frame(df), "HAS_ANY_ADVERSE", {"std": C.stddev()})


# Settlement and judgment -----------------------------------------------------------------------


def resolution_coverage(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Disclosure of amounts per resolution, with record and dollar shares."""
    stats = C.group_stats(
        df,
        ["RESOLUTION_BINARY"],
        "PAYMENT_ADJ",
        {
            "total_records": C.rows(),
            "has_payment": C.valued(),
            "mean_payment": C.mean(),
            "min_payment": C.minimum(),
            "max_payment": C.maximum(),
            "std_payment": C.stddev(),
            "total_dollars": C.total(),
        },
        {"median_payment": 0.5},
    )
    return stats.withColumns(
        {
            "missing_payment": F.col("total_records") - F.col("has_payment"),
            "coverage_pct": S.percent(F.col("has_payment"), F.col("total_records"), 4),
            "pct_of_all_records": S.share_of_total("total_records", digits),
            "pct_of_all_dollars": S.share_of_total("total_dollars", digits),
        }
    ).orderBy("RESOLUTION_BINARY")


def severity_trend_by_resolution(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Size of payments per decade, separately for settlements and judgments."""
    frame = df.filter(F.col("PERIOD_10Y").isNotNull() & F.col("RESOLUTION_BINARY").isin("Judgment", L.NON_JUDGMENT))
    stats = C.group_stats(
        frame,
        ["RESOLUTION_BINARY", "PERIOD_10Y"],
        "PAYMENT_ADJ",
        {
            "count": C.rows(),
            "mean_payment": C.mean(),
            "pct_catastrophic": C.share("CATASTROPHIC") * 100,
            "total_dollars": C.total(),
        },
        {"median_payment": 0.5},
        ["CATASTROPHIC"],
    )
    return stats.withColumns(
        {
            "pct_catastrophic": S.rounded(F.col("pct_catastrophic"), digits),
            "mean_to_median": S.ratio("mean_payment", "median_payment", digits),
        }
    ).orderBy("RESOLUTION_BINARY", "PERIOD_10Y")


def with_state_totals(state_resolution: DataFrame, digits: int | None = 2) -> DataFrame:
    """Put each state's total next to its resolution rows.

    A window over the summary gives the rows of a join with the totals and computes the summary once.
    """
    total = F.sum("count").over(Window.partitionBy("STATE"))
    return (
        state_resolution.filter(F.col("STATE").isNotNull())
        .withColumn("state_total", total)
        .withColumn("pct_of_state", S.percent(F.col("count"), F.col("state_total"), digits))
    )


def judgment_rate_ranking(state_resolution: DataFrame, minimum: int = 1000, digits: int | None = 2) -> DataFrame:
    """States with enough claims, highest judgment share first."""
    return (
        with_state_totals(state_resolution, digits)
        .filter((F.col("RESOLUTION_BINARY") == "Judgment") & (F.col("state_total") >= minimum))
        .select("STATE", "count", "pct_of_state", "mean_payment_adj", "median_payment_adj", "state_total")
        .orderBy(F.col("pct_of_state").desc(), "STATE")
    )


def judgment_premium(state_resolution: DataFrame, minimum: int = 1000) -> DataFrame:
    """Mean judgment over mean settlement per state, for states in the judgment ranking."""

    def mean_of(resolution: str):
        return F.max(F.when(F.col("RESOLUTION_BINARY") == resolution, F.col("mean_payment_adj")))

    per_state = state_resolution.groupBy("STATE").agg(
        F.try_divide(mean_of("Judgment"), mean_of(L.NON_JUDGMENT)).alias("judgment_premium_ratio"),
        F.sum("count").alias("state_total"),
    )
    return (
        per_state.filter(F.col("judgment_premium_ratio").isNotNull() & (F.col("state_total") >= minimum))
        .select("STATE", "judgment_premium_ratio")
        .orderBy(F.col("judgment_premium_ratio").desc(), "STATE")
    )


def repeat_report_tallies(df: DataFrame, column: str = "NPMALRPT") -> DataFrame:
    """Reports whose practitioner has at least 2, 5 or 10 reports."""
    return S.metric_table(df.agg(*[F.count_if(F.col(column) >= n).alias(f"at_least_{n}") for n in (2, 5, 10)]))


def payment_vs_total(df: DataFrame) -> DataFrame:
    """Report payment against claim total where both are known.

    Both amounts go into one long column, so one set of cells serves both medians.
    """
    both = FT.complete_cases(df, ["PAYMENT", "TOTALPMT"]).select("PAYMENT", "TOTALPMT")
    long = both.unpivot([], ["PAYMENT", "TOTALPMT"], "amount", "value")
    stats = C.group_stats(long, ["amount"], "value", {"records": C.rows(), "mean": C.mean()}, {"median": 0.5})

    def of(amount: str, column: str):
        return F.max(F.when(F.col("amount") == amount, F.col(column)))

    one_row = stats.agg(
        of("PAYMENT", "records").alias("records_with_both"),
        of("PAYMENT", "mean").alias("payment_mean"),
        of("PAYMENT", "median").alias("payment_median"),
        of("TOTALPMT", "mean").alias("total_mean"),
        of("TOTALPMT", "median").alias("total_median"),
    )
    return one_row.withColumns(
        {
            "mean_ratio": S.ratio("total_mean", "payment_mean", None),
            "median_ratio": S.ratio("total_median", "payment_median", None),
        }
    )


def total_source_summary(linked: DataFrame) -> DataFrame:
    """Best claim totals by where they come from."""
    stats = C.group_stats(
        linked,
        ["TOTALPMT_SOURCE"],
        "TOTALPMT_BEST",
        {"count": C.rows(), "mean_total_best": C.mean(), "total_total_best": C.total()},
        {"median_total_best": 0.5},
    )
    return stats.withColumn("pct", S.share_of_total("count", None)).orderBy("TOTALPMT_SOURCE")
