"""Practitioner profiles.

Every profile groups by (practitioner, code) before it groups by practitioner. The first step combines on
the map side; the second sees at most one row per code, so a practitioner with very many reports is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlab.functions import columns as X
from claimlab.functions import shares as S
from claimlab.schema import CATASTROPHIC_AMOUNT


def _partial(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("PAYMENT_ADJ").alias("_paid"),
        F.count("PAYMENT_ADJ").alias("_paid_rows"),
        F.min("ORIGYEAR").alias("_first"),
        F.max("ORIGYEAR").alias("_last"),
    )


def _totals(records: str, total: str, mean: str) -> list[Column]:
    """Practitioner-level measures from the partial rows, under the caller's names."""
    return [
        F.sum("_rows").alias(records),
        F.coalesce(F.sum("_paid"), F.lit(0.0)).alias(total),
        F.try_divide(F.sum("_paid"), F.sum("_paid_rows")).alias(mean),
        F.min("_first").alias("min_year"),
        F.max("_last").alias("max_year"),
    ]


def state_mobility(df: DataFrame) -> DataFrame:
    """States, reports, dollars and years of each practitioner, and whether they appear in several states."""
    parts = _partial(df.filter(F.col("PRACTNUM").isNotNull()), ["PRACTNUM", "STATE"])
    return (
        parts.groupBy("PRACTNUM")
        .agg(
            F.count("STATE").alias("unique_states"),
            *_totals("record_count", "total_payment_adj", "mean_payment_adj"),
        )
        .withColumns(
            {
                "multi_state_practitioner": F.col("unique_states") >= 2,
                "years_spanned": F.col("max_year") - F.col("min_year"),
            }
        )
    )


def state_pairs(df: DataFrame, n: int = 15) -> DataFrame:
    """State pairs that share the most practitioners.

    Practitioners with the same set of states are counted together first, so pairs are formed once per
    distinct set and not once per practitioner.
    """
    present = df.filter(F.col("PRACTNUM").isNotNull() & F.col("STATE").isNotNull())
    state_sets = (
        present.select("PRACTNUM", "STATE")
        .distinct()
        .groupBy("PRACTNUM")
        .agg(F.array_sort(F.collect_set("STATE")).alias("states"))
        .filter(F.size("states") >= 2)
        .groupBy("states")
        .agg(F.count(F.lit(1)).alias("_practitioners"))
    )
    pairs = state_sets.select(
        "states", "_practitioners", F.posexplode("states").alias("_position", "state_1")
    ).select(
        "state_1",
        F.explode(F.slice("states", F.col("_position") + 2, F.size("states"))).alias("state_2"),
        "_practitioners",
    )
    counted = pairs.groupBy("state_1", "state_2").agg(F.sum("_practitioners").alias("shared_practitioners"))
    return S.top_rows(counted, n, "shared_practitioners", ["state_1", "state_2"])


def mobility_metrics(mobility: DataFrame) -> DataFrame:
    multi = F.col("multi_state_practitioner")
    return S.metric_table(
        mobility.agg(
            F.count(F.lit(1)).alias("practitioners_total"),
            F.count_if(multi).alias("multi_state_practitioners"),
            (F.avg(multi.cast("int")) * 100).alias("multi_state_share_pct"),
            F.avg(F.when(~multi, F.col("mean_payment_adj"))).alias("mean_payment_single_state"),
            F.avg(F.when(multi, F.col("mean_payment_adj"))).alias("mean_payment_multi_state"),
        )
    )


def mobility_comparison(mobility: DataFrame) -> DataFrame:
    """Single- against multi-state practitioners."""
    return (
        mobility.groupBy("multi_state_practitioner")
        .agg(
            F.count(F.lit(1)).alias("practitioners"),
            F.avg("record_count").alias("mean_record_count"),
            F.avg("total_payment_adj").alias("mean_total_payment_adj"),
            F.avg("years_spanned").alias("mean_years_spanned"),
        )
        .withColumns(
            {
                "label": F.when(F.col("multi_state_practitioner"), "Multi-State").otherwise("Single-State"),
                "pct_of_practitioners": S.share_of_total("practitioners", None),
            }
        )
    )


def multi_payment_profile(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Practitioners with multiple-payment reports: how many, how much, over which years and states.

    The share denominator is one scalar over the partial rows, so the reports are read once and the practitioner
    table is never gathered.
    """
    frame = df.filter((F.col("PAYMENT_MODE") == "Multiple Payments") & F.col("PRACTNUM").isNotNull())
    parts = _partial(frame, ["PRACTNUM", "STATE"])
    # The subquery asks for every column of the partial rows, else its exchange would be another one.
    others = [F.max(c).alias(c) for c in parts.columns if c not in ("PRACTNUM", "STATE", "_paid")]
    whole = F.struct(F.coalesce(F.sum("_paid"), F.lit(0.0)).alias("_paid"), *others)
    grand_total = parts.agg(whole.alias("_whole")).scalar().getField("_paid")
    return (
        parts.groupBy("PRACTNUM")
        .agg(
            *_totals("report_count", "total_payment_adj", "mean_payment_adj"),
            F.count("STATE").alias("state_count"),
        )
        .withColumns(
            {
                "years_spanned": F.col("max_year") - F.col("min_year"),
                "pct_of_total_dollars": S.percent(F.col("total_payment_adj"), grand_total, digits),
            }
        )
    )


def by_report_count(profile: DataFrame) -> DataFrame:
    """Most reports first, then most dollars (a range-partitioned sort)."""
    return profile.orderBy(F.col("report_count").desc(), F.col("total_payment_adj").desc(), "PRACTNUM")


def classify_profiles(profile: DataFrame) -> DataFrame:
    """Behaviour class of multi-payment practitioners: clustered reports first, then size, then spread."""
    reports, years = F.col("report_count"), F.col("years_spanned")
    return profile.withColumn(
        "practitioner_profile",
        F.when((reports >= 3) & (years <= 1), "Batch Reporter")
        .when((F.col("mean_payment_adj") >= CATASTROPHIC_AMOUNT) & (reports <= 3), "Catastrophic Event")
        .when((reports >= 3) & (years >= 3), "Chronic Repeater")
        .otherwise("Moderate Repeater"),
    )


def profile_mix(classified: DataFrame) -> DataFrame:
    return (
        classified.groupBy("practitioner_profile")
        .agg(F.count(F.lit(1)).alias("practitioners"), F.avg("total_payment_adj").alias("mean_total_payment_adj"))
        .withColumn("pct", S.share_of_total("practitioners", None))
        .orderBy("practitioner_profile")
    )


def allegation_diversity(df: DataFrame) -> DataFrame:
    """Distinct allegations and states of each practitioner, with the sorted allegation list."""
    known = df.filter(F.col("PRACTNUM").isNotNull() & F.col("ALGNNATR").isNotNull())
    parts = _partial(known, ["PRACTNUM", "ALGNNATR", "STATE"])
    return (
        parts.groupBy("PRACTNUM")
        .agg(
            F.array_sort(F.collect_set("ALGNNATR")).alias("allegation_list"),
            F.size(F.collect_set("STATE")).cast("long").alias("unique_states"),
            *_totals("total_records", "total_payment", "mean_payment"),
        )
        .withColumn("unique_allegations", F.size("allegation_list").cast("long"))
        .withColumns(
            {
                "years_spanned": F.col("max_year") - F.col("min_year"),
                "allegation_profile": F.when(F.col("unique_allegations") == 1, "Single Allegation Type").otherwise(
                    "Multiple Allegation Types"
                ),
            }
        )
    )


def diversity_comparison(diversity: DataFrame, digits: int | None = 1) -> DataFrame:
    return (
        diversity.groupBy("allegation_profile")
        .agg(
            F.count(F.lit(1)).alias("practitioners"),
            F.avg("total_records").alias("mean_records"),
            F.avg("unique_allegations").alias("mean_unique_allegations"),
            F.avg("total_payment").alias("mean_total_payment"),
            F.avg("mean_payment").alias("mean_payment_per_record"),
            F.avg("years_spanned").alias("mean_years_spanned"),
            F.avg("unique_states").alias("mean_unique_states"),
        )
        .withColumn("pct_of_practitioners", S.share_of_total("practitioners", digits))
    )


def diversity_distribution(diversity: DataFrame, digits: int | None = 2) -> DataFrame:
    """Practitioners per number of distinct allegations, with running share of the rounded percentages."""
    counts = diversity.groupBy(F.col("unique_allegations").alias("unique_allegation_types")).agg(
        F.count(F.lit(1)).alias("practitioner_count")
    )
    return (
        counts.withColumn("pct", S.share_of_total("practitioner_count", digits))
        .withColumn("cumulative_pct", S.running_share("pct", "unique_allegation_types", digits))
        .orderBy("unique_allegation_types")
    )


def top_coded_diversity(diversity: DataFrame, limit: int = 6) -> DataFrame:
    """Practitioners per number of distinct allegations, with all counts from `limit` up in one class."""
    coded = X.top_code(F.col("unique_allegations"), limit)
    return diversity.groupBy(coded.alias("allegation_types")).agg(F.count(F.lit(1)).alias("practitioner_count"))


def most_diverse(diversity: DataFrame, minimum: int = 3, n: int = 20) -> DataFrame:
    many = diversity.filter(F.col("unique_allegations") >= minimum)
    return S.top_rows(many, n, "unique_allegations", ["PRACTNUM"])


def drill_down(df: DataFrame, diversity: DataFrame, minimum: int = 3) -> DataFrame:
    """Reports of the practitioner with the most distinct allegations; the broadcast side is one row."""
    top = most_diverse(diversity, minimum, 1).select("PRACTNUM")
    columns = ["PRACTNUM", "ALGNNATR", "STATE", "ORIGYEAR", "MALYEAR1", "PAYMENT_ADJ", "PAYTYPE_STR"]
    return df.join(F.broadcast(top), "PRACTNUM", "left_semi").select(*columns).orderBy("ORIGYEAR")
