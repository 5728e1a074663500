"""Source profile and missingness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlab.functions import columns as X
from claimlab.functions import shares as S
from claimlab.operators import cells as C
from claimlab.schema import DECLARED_KINDS, PAYMENT_RECORD_TYPES, RECORD_CLASSES


def _missing(column: str):
    return F.count_if(F.col(column).isNull())


def _missing_rate(column: str):
    return F.avg(F.col(column).isNull().cast("int")) * 100


def dataset_extent(df: DataFrame) -> DataFrame:
    """Rows, columns, report-year range, and the payment / other split."""
    is_payment = F.col("RECTYPE").isin(PAYMENT_RECORD_TYPES)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.min("ORIGYEAR").alias("first_year"),
        F.max("ORIGYEAR").alias("last_year"),
        F.count_if(is_payment).alias("payment_reports"),
        F.count_if(~F.coalesce(is_payment, F.lit(False))).alias("other_reports"),
    )


def _exact_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    per_value = as_text.unpivot([], columns, "column", "_value").groupBy("column", "_value").agg(
        F.count(F.lit(1)).alias("_n")
    )
    is_null = F.col("_value").isNull()
    return per_value.groupBy("column").agg(
        F.coalesce(F.sum(F.when(~is_null, F.col("_n"))), F.lit(0)).alias("non_null"),
        F.coalesce(F.sum(F.when(is_null, F.col("_n"))), F.lit(0)).alias("null_count"),
        F.count_if(~is_null).alias("nunique"),
    )


def _sketched_counts(df: DataFrame, columns: list[str], error: float) -> DataFrame:
    profiles = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.col(c)).alias("non_null"),
                _missing(c).alias("null_count"),
                F.approx_count_distinct(F.col(c).cast("string"), error).alias("nunique"),
            ).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    return profiles.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(columns))])))


def column_profile(
    df: DataFrame, columns: list[str] | None = None, digits: int | None = 2, distinct_error: float | None = None
) -> DataFrame:
    """Type, null counts and distinct count of each column; unknown names are ignored.

    Distinct counts are exact by default: columns are unpivoted to (column, value) and counted per distinct value
    first. That combines on the map side and spreads each column over all reducers, so no task holds a column's
    distinct values. With `distinct_error`, a relative standard deviation, they are estimated from mergeable
    sketches of fixed size, one a column, and nothing else moves.
    """
    columns = [c for c in (columns or df.columns) if c in df.columns]
    if distinct_error is None:
        counted = _exact_counts(df, columns)
    else:
        counted = _sketched_counts(df, columns, distinct_error)
    types = F.create_map(
        *[F.lit(x) for c in columns for x in (c, df.schema[c].dataType.simpleString())]
    )
    return counted.select(
        "column",
        F.try_element_at(types, F.col("column")).alias("dtype"),
        "non_null",
        "null_count",
        S.percent(F.col("null_count"), F.col("null_count") + F.col("non_null"), digits).alias("null_pct"),
        "nunique",
    ).orderBy(F.col("null_pct").desc(), "column")


def record_type_counts(df: DataFrame, digits: int | None = 2) -> DataFrame:
    counts = df.groupBy("RECTYPE").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("pct", S.share_of_total("count", digits)).orderBy(F.col("count").desc(), "RECTYPE")


def value_counts(
    df: DataFrame, column: str, keep_null: bool = True, limit: int | None = None, by_value: bool = False
) -> DataFrame:
    """Counts per value, most frequent first or in value order, optionally the first `limit` only."""
    source = df if keep_null else df.filter(F.col(column).isNotNull())
    counts = source.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    order = [F.col(column).asc()] if by_value else [F.col("count").desc(), F.col(column).asc()]
    ordered = counts.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def record_class_breakdown(df: DataFrame, digits: int | None = 1) -> DataFrame:
    """Counts of the known record classes; a class without rows is listed with zero."""
    classes = df.sparkSession.createDataFrame(list(RECORD_CLASSES.items()), "RECTYPE string, label string")
    counts = df.groupBy("RECTYPE").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(S.whole_table())
    counts = counts.withColumn("pct", S.percent(F.col("count"), total, digits))
    return classes.join(counts, "RECTYPE", "left").select(
        "RECTYPE",
        "label",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("pct", F.lit(0.0)).alias("pct"),
    )


def type_conformity(raw: DataFrame) -> DataFrame:
    """How many raw values fail their declared kind, per column, in one pass.

    A value fails if cleaning would lose it; blank text is missing, not wrong. Read with `typed=False` to have
    whole-number columns as text, since a typed column has no wrong values left.
    """
    known = [c for c in raw.columns if c in DECLARED_KINDS]

    def failures(column: str):
        value = F.col(column)
        kind = DECLARED_KINDS[column]
        if kind == "String" or not isinstance(raw.schema[column].dataType, T.StringType):
            return F.count_if(F.lit(False))
        cleaned = X.currency(value) if kind == "Dollar" else X.number(value)
        return F.count_if((X.stripped(value) != "") & cleaned.isNull())

    counts = raw.agg(*[failures(c).alias(c) for c in known]).unpivot([], known, "column", "invalid_values")
    spec = raw.sparkSession.createDataFrame([(c, DECLARED_KINDS[c]) for c in known], "column string, declared string")
    return spec.join(counts, "column").select(
        "column",
        "declared",
        "invalid_values",
        F.when(F.col("invalid_values") == 0, "OK").otherwise("ISSUE").alias("status"),
    )


def missingness_by_record_type(df: DataFrame, columns: list[str], digits: int | None = 2) -> DataFrame:
    """Missing count and percentage per record type and column, in long form."""
    columns = [c for c in columns if c in df.columns]
    wide = df.groupBy("RECTYPE").agg(F.count(F.lit(1)).alias("_rows"), *[_missing(c).alias(c) for c in columns])
    long = wide.unpivot(["RECTYPE", "_rows"], columns, "column", "missing_count")
    return long.select(
        "RECTYPE",
        "column",
        "missing_count",
        S.percent(F.col("missing_count"), F.col("_rows"), digits).alias("missing_pct"),
    ).orderBy("column", "RECTYPE")


def missingness_matrix(df: DataFrame, group: str, columns: list[str], as_counts: bool = False) -> DataFrame:
    """One row per group, one column per input column, holding missing percentages or counts."""
    measure = _missing if as_counts else _missing_rate
    return df.groupBy(group).agg(*[measure(c).alias(c) for c in columns if c in df.columns])


def missing_overview(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing count and percentage per column over all rows, one pass."""
    columns = [c for c in (columns or df.columns) if c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[_missing(c).alias(c) for c in columns])
    return wide.unpivot(["_rows"], columns, "column", "missing_count").select(
        "column", "missing_count", S.percent(F.col("missing_count"), F.col("_rows"), None).alias("missing_pct")
    )


def missing_rate_by(df: DataFrame, column: str, group: str = "ORIGYEAR") -> DataFrame:
    return df.groupBy(group).agg(_missing_rate(column).alias("missing_pct")).orderBy(group)


def missing_breakdown(df: DataFrame, missing: str, by: str, limit: int | None = None) -> DataFrame:
    """Among rows without `missing`, counts per value of another column."""
    return value_counts(df.filter(F.col(missing).isNull()), by, limit=limit)


def fallback_coverage(df: DataFrame, missing: str, fallbacks: list[str]) -> DataFrame:
    """Where `missing` is null, how often each fallback column is present."""
    without = df.filter(F.col(missing).isNull())
    wide = without.agg(F.count(F.lit(1)).alias("missing_rows"), *[F.count(c).alias(c) for c in fallbacks])
    return wide.unpivot(["missing_rows"], fallbacks, "fallback", "present").select(
        "fallback", "missing_rows", "present", S.percent(F.col("present"), F.col("missing_rows"), None).alias("pct")
    )


def amounts_by_presence(df: DataFrame, column: str, amount: str = "PAYMENT") -> DataFrame:
    """Amounts of rows with and without a value in a column."""
    flagged = df.withColumn("is_missing", F.col(column).isNull())
    return C.group_stats(
        flagged, ["is_missing"], amount, {"count": C.rows(), "mean": C.mean()}, {"median": 0.5}
    )


def cohort_baseline(df: DataFrame) -> DataFrame:
    """Headline metrics of the payment cohort as (metric, value) rows.

    States join the cell key, so counting them is one more reading of the same cells.
    """
    stats = C.group_stats(
        df,
        [],
        "PAYMENT_ADJ",
        {
            "malpractice_rows": C.rows(),
            "states_with_data": F.count_distinct("STATE"),
            "mean_payment_adj": C.mean(),
            "catastrophic_share_pct": C.share("CATASTROPHIC") * 100,
            "judgment_share_pct": C.share("IS_JUDGMENT") * 100,
        },
        {"median_payment_adj": 0.5},
        ["CATASTROPHIC", "IS_JUDGMENT", "STATE"],
    )
    return S.metric_table(stats)


def feature_quality(df: DataFrame) -> DataFrame:
    """Coverage of derived features as (metric, value) rows."""

    def pct(condition):
        return F.avg(condition.cast("int")) * 100

    return S.metric_table(
        df.agg(
            pct(F.col("MISSING_STATE")).alias("missing_state_pct"),
            pct(F.col("MISSING_ALLEGATION")).alias("missing_allegation_pct"),
            pct(F.col("MISSING_OUTCOME")).alias("missing_outcome_pct"),
            pct(~F.col("PAYMENT_MODE").isin("Unknown Payment Mode", "Unavailable Pre-2004")).alias(
                "payment_mode_known_pct"
            ),
            pct(F.col("TOTALPMT_ADJ").isNotNull()).alias("observed_totalpmt_pct"),
        )
    )
