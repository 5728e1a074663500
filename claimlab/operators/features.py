"""Cohorts and derived columns of the payment analyses. Every step is row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlab.functions import columns as X
from claimlab.functions import labels as L
from claimlab.schema import (
    ADVERSE_RECORD_TYPES,
    CATASTROPHIC_AMOUNT,
    PAYMENT_RECORD_TYPES,
    VALID_LAG_YEARS,
)


def payment_records(df: DataFrame) -> DataFrame:
    """Malpractice payment reports of both formats."""
    return df.filter(F.col("RECTYPE").isin(PAYMENT_RECORD_TYPES))


def new_format_records(df: DataFrame) -> DataFrame:
    return df.filter(F.col("RECTYPE") == "P")


def old_format_records(df: DataFrame) -> DataFrame:
    return df.filter(F.col("RECTYPE") == "M")


def adverse_records(df: DataFrame) -> DataFrame:
    return df.filter(F.col("RECTYPE").isin(ADVERSE_RECORD_TYPES))


def cohort_tags(df: DataFrame) -> DataFrame:
    """SEQNO and cohort, one row for each cohort a report belongs to, in one pass."""
    kind = F.col("RECTYPE")
    tags = F.array(
        F.when(kind.isin(PAYMENT_RECORD_TYPES), F.lit("payment")),
        F.when(kind == "P", F.lit("new_format")),
        F.when(kind == "M", F.lit("old_format")),
        F.when(kind.isin(ADVERSE_RECORD_TYPES), F.lit("adverse")),
    )
    return df.select(F.explode(F.array_compact(tags)).alias("cohort"), "SEQNO")


def year_range(df: DataFrame, first: int, last: int, column: str = "ORIGYEAR") -> DataFrame:
    return df.filter(F.col(column).between(first, last))


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in any of the columns that exist."""
    return df.na.drop(subset=[c for c in columns if c in df.columns])


def _state() -> dict[str, Column]:
    source = F.upper(X.stripped(F.coalesce(F.col("WORKSTAT"), F.col("LICNSTAT"), F.col("HOMESTAT"))))
    return {"STATE": F.when(source.isin("", "NAN"), F.lit(None)).otherwise(source)}


def _periods() -> dict[str, Column]:
    return {
        f"{prefix}PERIOD_{width}Y": X.period_label(F.col(year), width)
        for prefix, year in (("", "ORIGYEAR"), ("MAL_", "MALYEAR1"))
        for width in (5, 10)
    }


def _resolution() -> dict[str, Column]:
    code = F.upper(X.stripped(F.col("PAYTYPE")))
    return {
        "PAYTYPE_STR": code,
        "RESOLUTION_BINARY": L.lookup(code, L.RESOLUTIONS, "Other"),
        "IS_JUDGMENT": code == "J",
    }


def _adjusted_amounts(df: DataFrame, factor: Column) -> dict[str, Column]:
    out = {"CPI_FACTOR": factor}
    if "PAYMENT" in df.columns:
        out["PAYMENT_ADJ"] = F.col("PAYMENT") * factor
        out["LOG_PAYMENT_ADJ"] = X.positive_log(F.col("PAYMENT") * factor)
    if "TOTALPMT" in df.columns:
        out["TOTALPMT_ADJ"] = F.col("TOTALPMT") * factor
    return out


def _payment_mode() -> dict[str, Column]:
    code = F.upper(X.stripped(F.col("PAYNUMBR")))
    mode = F.when(F.col("RECTYPE") == "M", "Unavailable Pre-2004").otherwise(
        L.lookup(code, L.PAYMENT_MODES, "Unknown Payment Mode")
    )
    return {"PAYNUMBR_STR": code, "PAYMENT_MODE": mode}


def with_state(df: DataFrame) -> DataFrame:
    """State of a report: work state, else license state, else home state.

    A blank in the first non-null source is missing, not a reason to fall through.
    """
    return df.withColumns(_state())


def with_periods(df: DataFrame) -> DataFrame:
    """Five- and ten-year periods of report year and incident year."""
    return df.withColumns(_periods())


def with_resolution(df: DataFrame) -> DataFrame:
    """Payment type, its binary reading and the judgment flag (null when the type is unknown)."""
    return df.withColumns(_resolution())


def with_detailed_resolution(df: DataFrame) -> DataFrame:
    """Five-way resolution label; reports without a payment type are dropped."""
    known = df.filter(F.col("PAYTYPE").isNotNull())
    return known.withColumn("RESOLUTION", L.lookup(F.upper(X.stripped(F.col("PAYTYPE"))), L.DETAILED_RESOLUTIONS, "Other"))


def with_adjusted_amounts(
    df: DataFrame,
    factors: list[float] | None = None,
    first_year: int = L.CPI_FIRST_YEAR,
    year_column: str = "ORIGYEAR",
) -> DataFrame:
    """Inflation-adjusted amounts and the log of positive adjusted payments."""
    return df.withColumns(_adjusted_amounts(df, X.cpi_factor(F.col(year_column), factors, first_year)))


def catastrophic(amount: Column, threshold: float = CATASTROPHIC_AMOUNT) -> Column:
    """Amount at or above the threshold; a missing amount is not catastrophic."""
    return F.coalesce(amount >= threshold, F.lit(False))


def with_lag_and_flags(df: DataFrame) -> DataFrame:
    """Years from incident to report, the valid-lag flag, and quality flags."""
    lag = F.col("ORIGYEAR") - F.col("MALYEAR1")
    return df.withColumns(
        {
            "LAG_YEARS": lag,
            "VALID_LAG": lag.between(*VALID_LAG_YEARS),
            "CATASTROPHIC": catastrophic(F.col("PAYMENT_ADJ")),
            "MISSING_STATE": F.col("STATE").isNull(),
            "MISSING_ALLEGATION": F.col("ALGNNATR").isNull(),
            "MISSING_OUTCOME": F.col("OUTCOME").isNull(),
        }
    )


def with_payment_mode(df: DataFrame) -> DataFrame:
    """Payment mode label; the old format never recorded it."""
    return df.withColumns(_payment_mode())


def with_common_features(df: DataFrame) -> DataFrame:
    """The feature pipeline over cleaned claims: payment cohort plus all derived columns.

    Independent columns share one projection, and the lag and flags that build on them a second one.
    """
    claims = payment_records(df)
    direct = _state() | _periods() | _resolution() | _payment_mode()
    direct |= _adjusted_amounts(claims, X.cpi_factor(F.col("ORIGYEAR")))
    return claims.withColumns(direct).transform(with_lag_and_flags)


# Experience bands in years.
EXPERIENCE_EDGES = [0, 6, 11, 16, 21, 26, 31, 36, 41]
EXPERIENCE_LABELS = ["0-5", "6-10", "11-15", "16-20", "21-25", "26-30", "31-35", "36-40", "41+"]


def with_experience(df: DataFrame) -> DataFrame:
    """Years of experience from the middle of the graduation decade, kept within 0..60, and its band."""
    years = F.col("ORIGYEAR") - (F.col("GRAD") + 5)
    return (
        df.withColumn("YEARS_EXPERIENCE", years)
        .filter(F.col("YEARS_EXPERIENCE").between(0, 60))
        .withColumn(
            "EXPERIENCE_BAND", X.bin_left_closed(F.col("YEARS_EXPERIENCE"), EXPERIENCE_EDGES, EXPERIENCE_LABELS)
        )
    )


# Malpractice-report-count bands.
REPORT_COUNT_EDGES = [0, 1, 2, 3, 5, 10]
REPORT_COUNT_LABELS = ["1", "2", "3", "4-5", "6-10", "11+"]


def with_report_count_band(df: DataFrame) -> DataFrame:
    count = F.coalesce(F.col("NPMALRPT"), F.lit(0))
    return df.withColumn("REPORT_COUNT_BAND", X.bin_right_closed(count, REPORT_COUNT_EDGES, REPORT_COUNT_LABELS))


def with_adverse_flags(df: DataFrame) -> DataFrame:
    """Flags for each tracked kind of adverse action and for any of them."""
    return df.withColumns(
        {
            "HAS_LICENSURE": X.positive("NPLICRPT"),
            "HAS_PRIVILEGE": X.positive("NPCLPRPT"),
            "HAS_DEA": X.positive("NPDEARPT"),
            "HAS_EXCLUSION": X.positive("NPEXCRPT"),
            "HAS_ANY_ADVERSE": X.any_positive(["NPLICRPT", "NPCLPRPT", "NPDEARPT", "NPEXCRPT"]),
        }
    )


# Payment size brackets.
BRACKET_EDGES = [0, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_000_000, 5_000_000]
BRACKET_LABELS = [
    "<$25K", "$25-50K", "$50-100K", "$100-250K", "$250-500K", "$500K-1M", "$1-2M", "$2-5M", ">$5M",
]


def payment_bracket(amount: Column) -> Column:
    return X.bin_right_closed(amount, BRACKET_EDGES, BRACKET_LABELS)
