"""Payment episodes: linking reports that describe one claim, and rebuilding missing claim totals.

No claim id exists in the data, so an episode is the set of reports that agree on a tier's key columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlab.functions import columns as X
from claimlab.functions import shares as S
from claimlab.operators import cells as C
from claimlab.schema import TIER_KEYS, TIER_SPAN_LIMIT

# Columns whose distinct count an episode reports.
_COUNTED = {
    "practitioner_count": "PRACTNUM",
    "state_count": "STATE",
    "allegation_count": "ALGNNATR",
    "paytype_count": "PAYTYPE_STR",
    "reptype_count": "REPTYPE",
}
WINDOW_YEARS = 3


def _check_tier(tier: str) -> None:
    if tier not in TIER_KEYS:
        raise ValueError(f"unknown linkage tier {tier!r}; expected one of {sorted(TIER_KEYS)}")


def linkage_frame(df: DataFrame) -> DataFrame:
    """Featured reports with integer keys and the three-year report window."""
    integers = {c: F.col(c).cast("int") for c in ("MALYEAR1", "MALYEAR2", "ALGNNATR", "ORIGYEAR")}
    return df.withColumns(
        {
            "PRACTNUM": F.col("PRACTNUM").cast("long"),
            **integers,
            "ORIGYEAR_WINDOW": X.floor_to(F.col("ORIGYEAR"), WINDOW_YEARS),
        }
    )


def _episode_key(keys: list[str]):
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in keys])


def with_episode_key(df: DataFrame, tier: str = "strict") -> DataFrame:
    """Add the readable episode key and the tier name; missing parts read `NA`."""
    _check_tier(tier)
    return linkage_frame(df).withColumns({"EPISODE_KEY": _episode_key(TIER_KEYS[tier]), "LINKAGE_TIER": F.lit(tier)})


def _grouped_episodes(df: DataFrame, tier: str) -> DataFrame:
    """One row per episode with its typed key columns.

    A key column is constant within its episode. The other counted columns join a first grouping, so a
    large episode (say, all reports with no known key) is combined on the map side and spread by those
    columns, and the second grouping sees a handful of code combinations per episode. Grouping on typed
    columns keeps a missing part apart from a real code `NA`.
    """
    _check_tier(tier)
    keys = TIER_KEYS[tier]
    others = [c for c in _COUNTED.values() if c not in keys]
    parts = (
        linkage_frame(df)
        .groupBy(*keys, *others)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.min("ORIGYEAR").alias("_first"),
            F.max("ORIGYEAR").alias("_last"),
            F.sum("PAYMENT_ADJ").alias("_paid"),
            F.max("TOTALPMT_ADJ").alias("_total"),
            F.count("TOTALPMT_ADJ").alias("_totals"),
        )
    )

    def distinct(column: str):
        if column in keys:
            return F.max(F.col(column).isNotNull().cast("long"))
        return F.size(F.collect_set(column)).cast("long")

    return parts.groupBy(*keys).agg(
        F.sum("_rows").alias("record_count"),
        *[distinct(column).alias(name) for name, column in _COUNTED.items()],
        F.min("_first").alias("min_origyear"),
        F.max("_last").alias("max_origyear"),
        F.coalesce(F.sum("_paid"), F.lit(0.0)).alias("payment_sum_adj"),
        F.max("_total").alias("totalpmt_max_adj"),
        F.sum("_totals").alias("totalpmt_non_null"),
    )


def _flagged(episodes: DataFrame, span_limit: int | Column) -> DataFrame:
    varied = [F.col(c) > 1 for c in _COUNTED if c != "reptype_count"]
    span = F.col("origyear_span")
    return (
        episodes.withColumn("origyear_span", F.col("max_origyear") - F.col("min_origyear"))
        .withColumn("ambiguous_episode", reduce(lambda a, b: a | b, varied) | (span > span_limit))
        .withColumn("reconstruction_eligible", ~F.col("ambiguous_episode") & (F.col("record_count") >= 1))
    )


_KEY_PREFIX = "_key_"


def _episodes_with_keys(df: DataFrame, tier: str) -> DataFrame:
    return _flagged(_grouped_episodes(df, tier), TIER_SPAN_LIMIT[tier])


def payment_episodes(df: DataFrame, tier: str = "strict") -> DataFrame:
    """Episodes with their readable key, size, spread, summed payments, and ambiguity flags."""
    episodes = _episodes_with_keys(df, tier).withColumns(
        {"EPISODE_KEY": _episode_key(TIER_KEYS[tier]), "linkage_tier": F.lit(tier)}
    )
    front = ["EPISODE_KEY", "linkage_tier"]
    return episodes.select(*front, *[c for c in episodes.columns if c not in front + TIER_KEYS[tier]])


def validate_episodes(episodes: DataFrame) -> DataFrame:
    """Episodes with an observed total, and how far the summed payments are from it."""
    error = F.abs(F.col("payment_sum_adj") - F.col("totalpmt_max_adj"))
    relative = F.try_divide(error, F.col("totalpmt_max_adj"))

    def within(limit: float):
        return F.coalesce(F.col("absolute_pct_error") <= limit, F.lit(False))

    return (
        episodes.filter(F.col("totalpmt_non_null") > 0)
        .withColumns({"absolute_error": error, "absolute_pct_error": relative})
        .withColumns({"within_10pct": within(0.10), "within_25pct": within(0.25)})
    )


def validation_metrics(validation: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Linkage quality, one row for each value of `keys`; no row when nothing could be validated."""
    flags = ["within_10pct", "within_25pct", "ambiguous_episode"]
    return C.group_stats(
        validation,
        list(keys),
        "absolute_pct_error",
        {
            "episodes_validated": C.rows(),
            "mean_abs_pct_error": C.mean(),
            "share_within_10pct": C.share("within_10pct"),
            "share_within_25pct": C.share("within_25pct"),
            "ambiguous_share": C.share("ambiguous_episode"),
        },
        {"median_abs_pct_error": 0.5},
        flags,
    ).filter(F.col("episodes_validated") > 0)


def tier_episodes(df: DataFrame, tiers: list[str]) -> DataFrame:
    """Episodes of several tiers at once, told apart by `tier`: their sizes, spreads and sums, without keys.

    Every report becomes one row a tier, with the columns that are no key there left out, and states of (count,
    sum, least, largest, distinct codes) merge: first by key and counted codes, which spreads a large episode, then
    by key. So all tiers come from one read of the reports and two exchanges.
    """
    for tier in tiers:
        _check_tier(tier)
    keys = sorted({k for tier in tiers for k in TIER_KEYS[tier]})
    counted = list(_COUNTED.values())
    versions = [
        F.struct(F.lit(tier).alias("tier"), *[F.when(F.lit(k in TIER_KEYS[tier]), F.col(k)).alias(f"_key_{k}") for k in keys])
        for tier in tiers
    ]
    rows = linkage_frame(df).select(*counted, "ORIGYEAR", "PAYMENT_ADJ", "TOTALPMT_ADJ", F.inline(F.array(*versions)))
    masked = [f"_key_{k}" for k in keys]
    parts = rows.groupBy("tier", *masked, *counted).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("ORIGYEAR").alias("_first"),
        F.max("ORIGYEAR").alias("_last"),
        F.sum("PAYMENT_ADJ").alias("_paid"),
        F.max("TOTALPMT_ADJ").alias("_total"),
        F.count("TOTALPMT_ADJ").alias("_totals"),
    )
    episodes = parts.groupBy("tier", *masked).agg(
        F.sum("_rows").alias("record_count"),
        *[F.size(F.collect_set(column)).cast("long").alias(name) for name, column in _COUNTED.items()],
        F.min("_first").alias("min_origyear"),
        F.max("_last").alias("max_origyear"),
        F.coalesce(F.sum("_paid"), F.lit(0.0)).alias("payment_sum_adj"),
        F.max("_total").alias("totalpmt_max_adj"),
        F.sum("_totals").alias("totalpmt_non_null"),
    )
    limit = reduce(lambda other, tier: other.when(F.col("tier") == tier, TIER_SPAN_LIMIT[tier]), tiers, F)
    return _flagged(episodes.drop(*masked), limit)


def compare_tiers(df: DataFrame, tiers: list[str] = ("strict", "moderate")) -> DataFrame:
    """Validation metrics of several tiers, one tagged row each; no row for a tier without an observed total."""
    return validation_metrics(validate_episodes(tier_episodes(df, list(tiers))), ["tier"])


def with_best_total(df: DataFrame, tier: str = "strict", episodes_of: DataFrame | None = None) -> DataFrame:
    """Attach episode totals to reports and choose the best claim total with its source.

    The observed total wins; otherwise the summed payments of an eligible episode; otherwise unresolved.
    `episodes_of` supplies the reports that define the episodes (default: the same reports). Episodes
    hold one row per key, so a large episode skews the report side only, which adaptive skew-join
    splitting divides over tasks.
    """
    frame = with_episode_key(df, tier)
    keys = TIER_KEYS[tier]
    episodes = _episodes_with_keys(df if episodes_of is None else episodes_of, tier).select(
        *[F.col(k).alias(_KEY_PREFIX + k) for k in keys],
        F.col("payment_sum_adj").alias("EPISODE_PAYMENT_SUM_ADJ"),
        "reconstruction_eligible",
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(_KEY_PREFIX + k)) for k in keys])
    joined = frame.join(episodes, same, "left").drop(*[_KEY_PREFIX + k for k in keys])
    observed = F.col("TOTALPMT_ADJ").isNotNull()
    rebuilt = F.coalesce(F.col("reconstruction_eligible"), F.lit(False)) & F.col("EPISODE_PAYMENT_SUM_ADJ").isNotNull()
    return joined.withColumns(
        {
            "TOTALPMT_BEST": F.when(observed, F.col("TOTALPMT_ADJ")).when(rebuilt, F.col("EPISODE_PAYMENT_SUM_ADJ")),
            "TOTALPMT_SOURCE": F.when(observed, "observed").when(rebuilt, "reconstructed").otherwise("unresolved"),
        }
    )


def best_matches(validation: DataFrame, n: int = 20) -> DataFrame:
    """Episodes whose summed payments come closest to the observed total."""
    known = validation.filter(F.col("absolute_pct_error").isNotNull())
    return S.top_rows(known, n, "absolute_pct_error", ["EPISODE_KEY"], ascending=True)
