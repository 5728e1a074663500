"""Queries over payment episodes, rebuilt totals and practitioners."""

from __future__ import annotations

from claimlab.operators import audit
from claimlab.operators import linkage as K
from claimlab.operators import practitioners as P
from claimlab.operators import summaries as A
from claimlab.plans.base import LINKED_SQL, Query, episodes_sql, validation_sql

EPISODE_R4 = "payment_sum_adj totalpmt_max_adj"

_MEASURES = """count(*) AS record_count, coalesce(sum(PAYMENT_ADJ), 0) AS total_payment_adj, avg(PAYMENT_ADJ) AS mean_payment_adj,
  min(ORIGYEAR) AS min_year, max(ORIGYEAR) AS max_year, max(ORIGYEAR) - min(ORIGYEAR) AS years_spanned"""

MOBILITY_SQL = f"""
SELECT *, unique_states >= 2 AS multi_state_practitioner
FROM (SELECT PRACTNUM, count(DISTINCT STATE) AS unique_states, {_MEASURES} FROM feat
      WHERE PRACTNUM IS NOT NULL GROUP BY PRACTNUM) AS m
"""
PROFILE_SQL = f"""
SELECT *, total_payment_adj * 100.0 / sum(total_payment_adj) OVER () AS pct_of_total_dollars
FROM (SELECT PRACTNUM, count(DISTINCT STATE) AS state_count, {_MEASURES.replace('record_count', 'report_count')} FROM feat
      WHERE PAYMENT_MODE = 'Multiple Payments' AND PRACTNUM IS NOT NULL GROUP BY PRACTNUM) AS p
"""
CLASS_SQL = f"""
SELECT *, CASE WHEN report_count >= 3 AND years_spanned <= 1 THEN 'Batch Reporter'
  WHEN mean_payment_adj >= 1000000 AND report_count <= 3 THEN 'Catastrophic Event'
  WHEN report_count >= 3 AND years_spanned >= 3 THEN 'Chronic Repeater' ELSE 'Moderate Repeater' END AS practitioner_profile
FROM ({PROFILE_SQL}) AS profile
"""
DIVERSITY_SQL = """
SELECT *, CASE WHEN unique_allegations = 1 THEN 'Single Allegation Type' ELSE 'Multiple Allegation Types' END AS allegation_profile
FROM (SELECT PRACTNUM, count(*) AS total_records, count(DISTINCT ALGNNATR) AS unique_allegations,
  count(DISTINCT STATE) AS unique_states, list_sort(list(DISTINCT ALGNNATR)) AS allegation_list,
  coalesce(sum(PAYMENT_ADJ), 0) AS total_payment, avg(PAYMENT_ADJ) AS mean_payment, min(ORIGYEAR) AS min_year,
  max(ORIGYEAR) AS max_year, max(ORIGYEAR) - min(ORIGYEAR) AS years_spanned
  FROM feat WHERE PRACTNUM IS NOT NULL AND ALGNNATR IS NOT NULL GROUP BY PRACTNUM) AS d
"""


def _validation(c, tier="strict"):
    return K.validate_episodes(K.payment_episodes(c.new, tier))


_METRICS_SQL = """SELECT count(*) AS episodes_validated, median(absolute_pct_error) AS median_abs_pct_error,
  avg(absolute_pct_error) AS mean_abs_pct_error, avg(CAST(within_10pct AS DOUBLE)) AS share_within_10pct,
  avg(CAST(within_25pct AS DOUBLE)) AS share_within_25pct, avg(CAST(ambiguous_episode AS DOUBLE)) AS ambiguous_share"""
METRICS_R4 = "median_abs_pct_error mean_abs_pct_error share_within_10pct share_within_25pct ambiguous_share"
VALIDATION_R4 = f"{EPISODE_R4} absolute_error absolute_pct_error"


QUERIES = [
    Query(
        "k01_linkage_frame",
        lambda c: K.linkage_frame(c.feat).select("SEQNO", "PRACTNUM", "ORIGYEAR", "ORIGYEAR_WINDOW"),
        "SELECT SEQNO, PRACTNUM, ORIGYEAR, CAST(ORIGYEAR - ORIGYEAR % 3 AS INTEGER) AS ORIGYEAR_WINDOW FROM feat",
    ),
    Query(
        "k02_episode_keys",
        lambda c: K.with_episode_key(c.feat, "moderate").select("SEQNO", "EPISODE_KEY", "LINKAGE_TIER"),
        """SELECT SEQNO, CAST(PRACTNUM AS VARCHAR) || '|' || coalesce(STATE, 'NA') || '|' || coalesce(CAST(MALYEAR1 AS VARCHAR), 'NA')
        || '|' || coalesce(CAST(ALGNNATR AS VARCHAR), 'NA') || '|' || CAST(ORIGYEAR - ORIGYEAR % 3 AS VARCHAR) AS EPISODE_KEY,
        'moderate' AS LINKAGE_TIER FROM feat""",
    ),
    Query(
        "k03_k04_episodes_strict",
        lambda c: K.payment_episodes(c.feat, "strict"),
        episodes_sql("strict"),
        r4=EPISODE_R4,
    ),
    Query(
        "k03_k04_episodes_moderate",
        lambda c: K.payment_episodes(c.feat, "moderate"),
        episodes_sql("moderate"),
        r4=EPISODE_R4,
    ),
    Query(
        "k03_k04_episodes_exploratory",
        lambda c: K.payment_episodes(c.feat, "exploratory"),
        episodes_sql("exploratory"),
        r4=EPISODE_R4,
    ),
    Query("k05_validation", _validation, validation_sql("strict"), r4=VALIDATION_R4),
    Query(
        "k06_validation_metrics",
        lambda c: K.validation_metrics(_validation(c, "exploratory")),
        f"{_METRICS_SQL} FROM ({validation_sql('exploratory')}) AS m",
        r4=METRICS_R4,
    ),
    Query(
        "k07_compare_tiers",
        lambda c: K.compare_tiers(c.new),
        " UNION ALL ".join(
            f"{_METRICS_SQL}, '{tier}' AS tier FROM ({validation_sql(tier)}) AS m" for tier in ("strict", "moderate")
        ),
        r4=METRICS_R4,
    ),
    Query(
        "k08_j01_best_totals",
        lambda c: c.linked.select(
            "SEQNO", "EPISODE_KEY", "EPISODE_PAYMENT_SUM_ADJ", "reconstruction_eligible", "TOTALPMT_BEST", "TOTALPMT_SOURCE"
        ),
        f"""SELECT SEQNO, EPISODE_KEY, EPISODE_PAYMENT_SUM_ADJ, reconstruction_eligible, TOTALPMT_BEST, TOTALPMT_SOURCE
        FROM ({LINKED_SQL}) AS l""",
        r4="EPISODE_PAYMENT_SUM_ADJ TOTALPMT_BEST",
    ),
    Query(
        "k09_ambiguous_counts",
        lambda c: audit.value_counts(K.payment_episodes(c.new), "ambiguous_episode"),
        f"SELECT ambiguous_episode, count(*) AS count FROM ({episodes_sql('strict', 'p_feat')}) AS e GROUP BY ambiguous_episode",
    ),
    Query(
        "k09_source_counts",
        lambda c: audit.value_counts(c.linked, "TOTALPMT_SOURCE"),
        f"SELECT TOTALPMT_SOURCE, count(*) AS count FROM ({LINKED_SQL}) AS l GROUP BY TOTALPMT_SOURCE",
    ),
    Query(
        "k09_best_matches",
        lambda c: K.best_matches(_validation(c)).select("EPISODE_KEY", "absolute_pct_error"),
        f"""SELECT EPISODE_KEY, absolute_pct_error FROM ({validation_sql('strict')}) AS v WHERE absolute_pct_error IS NOT NULL
        ORDER BY absolute_pct_error, EPISODE_KEY LIMIT 20""",
        r4="absolute_pct_error",
    ),
    Query(
        "a45_total_sources",
        lambda c: A.total_source_summary(c.linked),
        f"""SELECT TOTALPMT_SOURCE, count(*) AS count, avg(TOTALPMT_BEST) AS mean_total_best, median(TOTALPMT_BEST) AS median_total_best,
        coalesce(sum(TOTALPMT_BEST), 0) AS total_total_best, count(*) * 100.0 / sum(count(*)) OVER () AS pct
        FROM ({LINKED_SQL}) AS l GROUP BY TOTALPMT_SOURCE""",
        r4="mean_total_best median_total_best pct",
        r2="total_total_best",
    ),
    Query(
        "p01_state_mobility",
        lambda c: P.state_mobility(c.feat),
        MOBILITY_SQL,
        r4="mean_payment_adj",
        r2="total_payment_adj",
    ),
    Query(
        "p02_state_pairs",
        lambda c: P.state_pairs(c.feat, 20),
        """WITH present AS (SELECT DISTINCT PRACTNUM, STATE FROM feat WHERE PRACTNUM IS NOT NULL AND STATE IS NOT NULL);;
        SELECT a.STATE AS state_1, b.STATE AS state_2, count(*) AS shared_practitioners
        FROM present AS a JOIN present AS b ON a.PRACTNUM = b.PRACTNUM AND a.STATE < b.STATE
        GROUP BY a.STATE, b.STATE ORDER BY shared_practitioners DESC, state_1, state_2 LIMIT 20""",
    ),
    Query(
        "p03_mobility_metrics",
        lambda c: P.mobility_metrics(P.state_mobility(c.feat)),
        f"""UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS practitioners_total,
          CAST(count(*) FILTER (WHERE multi_state_practitioner) AS DOUBLE) AS multi_state_practitioners,
          avg(CAST(multi_state_practitioner AS INTEGER)) * 100 AS multi_state_share_pct,
          avg(mean_payment_adj) FILTER (WHERE NOT multi_state_practitioner) AS mean_payment_single_state,
          avg(mean_payment_adj) FILTER (WHERE multi_state_practitioner) AS mean_payment_multi_state FROM ({MOBILITY_SQL}) AS m)
        ON COLUMNS(*) INTO NAME metric VALUE value""",
        r4="value",
    ),
    Query(
        "p04_mobility_comparison",
        lambda c: P.mobility_comparison(P.state_mobility(c.feat)),
        f"""SELECT multi_state_practitioner, count(*) AS practitioners, avg(record_count) AS mean_record_count,
        avg(total_payment_adj) AS mean_total_payment_adj, avg(years_spanned) AS mean_years_spanned,
        CASE WHEN multi_state_practitioner THEN 'Multi-State' ELSE 'Single-State' END AS label,
        count(*) * 100.0 / sum(count(*)) OVER () AS pct_of_practitioners FROM ({MOBILITY_SQL}) AS m GROUP BY multi_state_practitioner""",
        r4="mean_record_count mean_total_payment_adj mean_years_spanned pct_of_practitioners",
    ),
    Query(
        "p05_multi_payment_profile",
        lambda c: P.multi_payment_profile(c.feat, digits=None),
        PROFILE_SQL,
        r4="mean_payment_adj pct_of_total_dollars",
        r2="total_payment_adj",
    ),
    Query(
        "w08_profile_order",
        lambda c: P.by_report_count(P.multi_payment_profile(c.feat, digits=None)).select("PRACTNUM", "report_count"),
        f"""SELECT PRACTNUM, report_count FROM ({PROFILE_SQL}) AS p
        ORDER BY report_count DESC, total_payment_adj DESC, PRACTNUM""",
    ),
    Query(
        "p06_classified_profiles",
        lambda c: P.classify_profiles(P.multi_payment_profile(c.feat, digits=None)).select(
            "PRACTNUM", "report_count", "practitioner_profile"
        ),
        f"SELECT PRACTNUM, report_count, practitioner_profile FROM ({CLASS_SQL}) AS c",
    ),
    Query(
        "p07_profile_mix",
        lambda c: P.profile_mix(P.classify_profiles(P.multi_payment_profile(c.feat, digits=None))),
        f"""SELECT practitioner_profile, count(*) AS practitioners, avg(total_payment_adj) AS mean_total_payment_adj,
        count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM ({CLASS_SQL}) AS c GROUP BY practitioner_profile""",
        r4="mean_total_payment_adj pct",
    ),
    Query(
        "p08_allegation_diversity",
        lambda c: P.allegation_diversity(c.feat),
        DIVERSITY_SQL,
        r4="mean_payment",
        r2="total_payment",
    ),
    Query(
        "p09_diversity_comparison",
        lambda c: P.diversity_comparison(P.allegation_diversity(c.feat), digits=None),
        f"""SELECT allegation_profile, count(*) AS practitioners, avg(total_records) AS mean_records,
        avg(unique_allegations) AS mean_unique_allegations, avg(total_payment) AS mean_total_payment,
        avg(mean_payment) AS mean_payment_per_record, avg(years_spanned) AS mean_years_spanned,
        avg(unique_states) AS mean_unique_states, count(*) * 100.0 / sum(count(*)) OVER () AS pct_of_practitioners
        FROM ({DIVERSITY_SQL}) AS d GROUP BY allegation_profile""",
        r4="mean_records mean_unique_allegations mean_total_payment mean_payment_per_record mean_years_spanned mean_unique_states pct_of_practitioners",
    ),
    Query(
        "p10_diversity_distribution",
        lambda c: P.diversity_distribution(P.allegation_diversity(c.feat), digits=4),
        f"""SELECT *, sum(pct) OVER (ORDER BY unique_allegation_types ROWS UNBOUNDED PRECEDING) AS cumulative_pct
        FROM (SELECT unique_allegations AS unique_allegation_types, count(*) AS practitioner_count,
          round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM ({DIVERSITY_SQL}) AS d GROUP BY unique_allegations) AS s""",
        r4="pct cumulative_pct",
    ),
    Query(
        "p10_top_coded_diversity",
        lambda c: P.top_coded_diversity(P.allegation_diversity(c.feat)),
        f"""SELECT CASE WHEN unique_allegations >= 6 THEN '6+' ELSE CAST(unique_allegations AS VARCHAR) END AS allegation_types,
        count(*) AS practitioner_count FROM ({DIVERSITY_SQL}) AS d GROUP BY allegation_types""",
    ),
    Query(
        "p11_most_diverse",
        lambda c: P.most_diverse(P.allegation_diversity(c.feat)).select(
            "PRACTNUM", "total_records", "unique_allegations", "allegation_list", "unique_states", "total_payment"
        ),
        f"""SELECT PRACTNUM, total_records, unique_allegations, allegation_list, unique_states, total_payment
        FROM ({DIVERSITY_SQL}) AS d WHERE unique_allegations >= 3 ORDER BY unique_allegations DESC, PRACTNUM LIMIT 20""",
        r2="total_payment",
    ),
    Query(
        "p12_drill_down",
        lambda c: P.drill_down(c.feat, P.allegation_diversity(c.feat)),
        f"""SELECT PRACTNUM, ALGNNATR, STATE, ORIGYEAR, MALYEAR1, PAYMENT_ADJ, PAYTYPE_STR FROM feat WHERE PRACTNUM =
        (SELECT PRACTNUM FROM ({DIVERSITY_SQL}) AS d WHERE unique_allegations >= 3
         ORDER BY unique_allegations DESC, PRACTNUM LIMIT 1)""",
        r4="PAYMENT_ADJ",
    ),
]
