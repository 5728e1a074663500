"""Queries over grouped summaries, windows and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlab.functions import labels as L
from claimlab.functions import shares as S
from claimlab.functions.labels import CPI_FACTORS, CPI_FIRST_YEAR
from claimlab.operators import audit, features
from claimlab.operators import summaries as A
from claimlab.operators.distributions import INCIDENT_DECADES, pivot_summary, report_incident_matrix
from claimlab.plans.base import PAYMENT_R4, Query, case_sql, payment_stats_sql
from claimlab.plans.source_queries import EXPERIENCE_SQL, REPORT_BAND_SQL

PEERS = "'WI', 'MN', 'IA', 'IL', 'MI', 'IN', 'OH'"
#: Report decades from the first report year to the last one with an inflation factor.
DECADES = [
    f"{year}-{year + 9}" for year in range(CPI_FIRST_YEAR // 10 * 10, CPI_FIRST_YEAR + len(CPI_FACTORS), 10)
]
MODES = ["Single Payment", "Multiple Payments", "Unknown Payment Mode"]


def _rates(extra: str = "") -> str:
    return f"""SELECT * REPLACE (catastrophic_share * 100 AS catastrophic_share, judgment_share * 100 AS judgment_share),
  {extra} total_payment_adj * 100.0 / sum(total_payment_adj) OVER () AS pct_of_total_dollars,
  mean_payment_adj / median_payment_adj AS mean_to_median_ratio"""


def _by_period_sql(period: str, where: str = "true") -> str:
    return f"""{_rates('count * 100.0 / sum(count) OVER () AS pct,')}
    FROM (SELECT {period}, {payment_stats_sql()} FROM feat WHERE {where} GROUP BY {period}) AS s"""


STATE_PERIOD_MODE_SQL = f"""
{_rates('''CASE WHEN STATE IS NOT NULL AND PERIOD_10Y IS NOT NULL
  THEN count * 100.0 / sum(count) OVER (PARTITION BY STATE, PERIOD_10Y) END AS pct_within_state_period,''')}
FROM (SELECT STATE, PERIOD_10Y, PAYMENT_MODE, {payment_stats_sql()} FROM {{source}}
      GROUP BY STATE, PERIOD_10Y, PAYMENT_MODE) AS s
"""
STATE_SQL = f"""{_rates('count * 100.0 / sum(count) OVER () AS pct,')}
FROM (SELECT STATE, {payment_stats_sql()} FROM feat GROUP BY STATE) AS s"""
PEER_SQL = f"""SELECT *, total_payment_adj * 100.0 / sum(total_payment_adj) OVER () AS pct_of_total_dollars,
  mean_payment_adj / median_payment_adj AS mean_to_median_ratio
FROM (SELECT STATE, PERIOD_10Y, {payment_stats_sql()} FROM feat WHERE STATE IN ({PEERS}) GROUP BY STATE, PERIOD_10Y) AS s"""
RATES_R4 = f"{PAYMENT_R4} pct_of_total_dollars mean_to_median_ratio"

STATE_RESOLUTION_SQL = """
SELECT *, count * 100.0 / sum(count) OVER (PARTITION BY STATE) AS pct_within_state
FROM (SELECT STATE, RESOLUTION_BINARY, count(*) AS count, avg(PAYMENT_ADJ) AS mean_payment_adj,
        median(PAYMENT_ADJ) AS median_payment_adj, coalesce(sum(PAYMENT_ADJ), 0) AS total_payment_adj
      FROM feat WHERE STATE IS NOT NULL GROUP BY STATE, RESOLUTION_BINARY) AS s
"""
STATE_RESOLUTION_R4 = "mean_payment_adj median_payment_adj pct_within_state"

ANNUAL_SQL = """SELECT ORIGYEAR, count(*) AS count, coalesce(sum(PAYMENT), 0) AS total_nominal, avg(PAYMENT) AS mean_nominal,
  median(PAYMENT) AS median_nominal, coalesce(sum(PAYMENT_ADJ), 0) AS total_adj, avg(PAYMENT_ADJ) AS mean_adj,
  median(PAYMENT_ADJ) AS median_adj FROM feat GROUP BY ORIGYEAR"""

# Five states stay as they are and the rest become four, so that a minimum of 1000 claims keeps some and drops some.
_MERGED_STATE = """CASE WHEN STATE IN ('NY', 'CA', 'PA', 'FL', 'TX') THEN STATE WHEN STATE < 'IN' THEN 'CO'
  WHEN STATE < 'MI' THEN 'LA' WHEN STATE < 'NC' THEN 'MO' WHEN STATE IS NOT NULL THEN 'OH' END"""
MERGED_SQL = f"merged AS (SELECT * REPLACE ({_MERGED_STATE} AS STATE) FROM feat)"


def _merged(c):
    return c.feat.withColumn("STATE", F.expr(_MERGED_STATE))


def _amounts_sql(key: str, source: str = "feat", extra: str = "", where: str = "") -> str:
    return f"""SELECT {key}, count(*) AS count, avg(PAYMENT) AS mean, median(PAYMENT) AS median{extra}
    FROM {source} WHERE {key} IS NOT NULL {where} GROUP BY {key}"""


TOTAL = ", coalesce(sum(PAYMENT), 0) AS total"
SPREAD = f"{TOTAL}, stddev_samp(PAYMENT) AS std, max(PAYMENT) AS max_payment, quantile_cont(PAYMENT, 0.95) AS p95"


def _lag_sql(key: str, source: str = "feat") -> str:
    return f"""SELECT {key}, count(*) AS count, avg(LAG_YEARS) AS mean_lag_years, median(LAG_YEARS) AS median_lag_years
    FROM {source} WHERE VALID_LAG AND {key} IS NOT NULL GROUP BY {key}"""


LAG_R4 = "mean_lag_years median_lag_years"

CATASTROPHIC_SQL = """
SELECT *, catastrophic_claims * 100.0 / total_claims AS claim_share_pct,
  catastrophic_dollars * 100.0 / total_dollars AS dollar_share_pct
FROM (SELECT count(*) AS total_claims, sum(PAYMENT) AS total_dollars,
  count(*) FILTER (WHERE PAYMENT >= 1000000) AS catastrophic_claims,
  sum(PAYMENT) FILTER (WHERE PAYMENT >= 1000000) AS catastrophic_dollars, max(PAYMENT) AS max_payment,
  avg(PAYMENT) FILTER (WHERE PAYMENT >= 1000000) AS mean_catastrophic,
  median(PAYMENT) FILTER (WHERE PAYMENT >= 1000000) AS median_catastrophic
  FROM feat WHERE {where}) AS t
"""
CATASTROPHIC_R4 = "mean_catastrophic median_catastrophic claim_share_pct dollar_share_pct"

_ADVERSE_SOURCE = """(SELECT *, NPLICRPT > 0 AS lic, NPCLPRPT > 0 AS priv, NPDEARPT > 0 AS dea, NPEXCRPT > 0 AS excl,
  NPLICRPT + NPCLPRPT + NPDEARPT + NPEXCRPT > 0 AS HAS_ANY_ADVERSE FROM feat
  WHERE NPMALRPT IS NOT NULL AND PAYMENT IS NOT NULL) AS adverse"""

_LICENSES = {10: "Allopathic Physician (MD)", 20: "Osteopathic Physician (DO)", 30: "Dentist", 100: "Registered Nurse", 603: "Chiropractor"}


def _tagged_metrics(c):
    """Metric tables of two cohorts under one another, tagged."""
    old, new = features.old_format_records(c.feat), c.new
    return (
        audit.cohort_baseline(old)
        .withColumn("cohort", F.lit("old"))
        .unionByName(audit.cohort_baseline(new).withColumn("cohort", F.lit("new")))
    )


_BASELINE = """SELECT '{tag}' AS cohort, CAST(count(*) AS DOUBLE) AS malpractice_rows,
  CAST(count(DISTINCT STATE) AS DOUBLE) AS states_with_data, avg(PAYMENT_ADJ) AS mean_payment_adj,
  median(PAYMENT_ADJ) AS median_payment_adj, avg(CAST(CATASTROPHIC AS DOUBLE)) * 100 AS catastrophic_share_pct,
  avg(CAST(IS_JUDGMENT AS DOUBLE)) * 100 AS judgment_share_pct FROM feat WHERE RECTYPE = '{type}'"""


def _license_label_sql(column: str) -> str:
    return case_sql(column, _LICENSES, f"'Code ' || CAST({column} AS VARCHAR)")


QUERIES = [
    Query(
        "a01_period_summary",
        lambda c: A.period_summary(c.feat, "PERIOD_10Y", digits=None),
        _by_period_sql("PERIOD_10Y"),
        r4=f"{RATES_R4} pct",
        r2="total_payment_adj",
    ),
    Query(
        "a01_period_summary_5y",
        lambda c: A.period_summary(c.feat, "PERIOD_5Y", digits=None),
        _by_period_sql("PERIOD_5Y"),
        r4=f"{RATES_R4} pct",
        r2="total_payment_adj",
    ),
    Query(
        "a01_incident_period_summary",
        lambda c: A.period_summary(features.complete_cases(c.feat, ["MAL_PERIOD_10Y"]), "MAL_PERIOD_10Y", digits=None),
        _by_period_sql("MAL_PERIOD_10Y", "MAL_PERIOD_10Y IS NOT NULL"),
        r4=f"{RATES_R4} pct",
        r2="total_payment_adj",
    ),
    Query(
        "a02_state_period_mode",
        lambda c: A.state_period_mode_summary(c.new, digits=None),
        STATE_PERIOD_MODE_SQL.format(source="p_feat"),
        r4=f"{RATES_R4} pct_within_state_period",
        r2="total_payment_adj",
    ),
    Query(
        "a03_state_summary",
        lambda c: A.state_summary(c.feat, digits=None),
        STATE_SQL,
        r4=f"{RATES_R4} pct",
        r2="total_payment_adj",
    ),
    Query(
        "a04_peer_state_comparison",
        lambda c: A.peer_state_comparison(c.feat, digits=None),
        PEER_SQL,
        r4=RATES_R4,
        r2="total_payment_adj",
    ),
    Query(
        "a05_focal_state",
        lambda c: A.extract_states(A.peer_state_comparison(c.feat, digits=None), ["WI"]),
        f"SELECT * FROM ({PEER_SQL}) AS p WHERE STATE = 'WI'",
        r4=RATES_R4,
        r2="total_payment_adj",
    ),
    Query(
        "a05_peer_modes",
        lambda c: A.extract_states(A.state_period_mode_summary(c.new, digits=None), PEERS.replace("'", "").split(", ")),
        f"SELECT * FROM ({STATE_PERIOD_MODE_SQL.format(source='p_feat')}) AS s WHERE STATE IN ({PEERS})",
        r4=f"{RATES_R4} pct_within_state_period",
        r2="total_payment_adj",
    ),
    Query(
        "a06_latest_period_skew",
        lambda c: A.latest_period_skew(A.peer_state_comparison(c.feat)),
        f"""SELECT STATE, PERIOD_10Y, mean_payment_adj / median_payment_adj AS mean_to_median FROM ({PEER_SQL}) AS p
        WHERE PERIOD_10Y = (SELECT max(PERIOD_10Y) FROM feat WHERE STATE IN ({PEERS}))""",
        r4="mean_to_median",
    ),
    Query(
        "a07_report_vs_incident",
        lambda c: A.report_vs_incident_period(c.feat),
        """SELECT PERIOD_10Y, MAL_PERIOD_10Y, avg(PAYMENT_ADJ) AS mean_payment_adj, count(*) AS count FROM feat
        WHERE MAL_PERIOD_10Y IS NOT NULL GROUP BY PERIOD_10Y, MAL_PERIOD_10Y""",
        r4="mean_payment_adj",
    ),
    Query(
        "a08_state_period_rollup",
        lambda c: A.state_period_rollup(A.state_period_mode_summary(c.new, digits=None, median=False)),
        """SELECT STATE, PERIOD_10Y, CAST(sum(count) AS BIGINT) AS total_count, avg(mean_payment_adj) AS avg_mean_payment_adj,
        avg(catastrophic_share) * 100 AS avg_catastrophic_share
        FROM (SELECT STATE, PERIOD_10Y, PAYMENT_MODE, count(*) AS count, avg(PAYMENT_ADJ) AS mean_payment_adj,
          avg(CAST(CATASTROPHIC AS DOUBLE)) AS catastrophic_share FROM p_feat WHERE STATE IS NOT NULL
          GROUP BY STATE, PERIOD_10Y, PAYMENT_MODE) AS s GROUP BY STATE, PERIOD_10Y""",
        r4="avg_mean_payment_adj",
        r2="avg_catastrophic_share",
    ),
    Query(
        "a09_resolution_by_state",
        lambda c: A.resolution_by_state(c.feat, digits=None),
        STATE_RESOLUTION_SQL,
        r4=STATE_RESOLUTION_R4,
        r2="total_payment_adj",
    ),
    Query(
        "a10_resolution_by_period",
        lambda c: A.resolution_by_period(c.feat, digits=None),
        """SELECT PERIOD_10Y, RESOLUTION_BINARY, count(*) AS count,
        count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY PERIOD_10Y) AS pct_within_period
        FROM feat GROUP BY PERIOD_10Y, RESOLUTION_BINARY""",
        r4="pct_within_period",
    ),
    Query(
        "a11_payment_modes",
        lambda c: A.payment_mode_distribution(c.feat, digits=None),
        """SELECT PAYMENT_MODE, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS pct
        FROM feat GROUP BY PAYMENT_MODE""",
        r4="pct",
    ),
    Query(
        "a11_payment_modes_by_period",
        lambda c: A.payment_mode_distribution(c.new, ["PERIOD_10Y"], digits=None),
        """SELECT PERIOD_10Y, PAYMENT_MODE, count(*) AS count,
        count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY PERIOD_10Y) AS pct FROM p_feat GROUP BY PERIOD_10Y, PAYMENT_MODE""",
        r4="pct",
    ),
    Query(
        "a12_single_multiple",
        lambda c: A.single_multiple_comparison(c.feat, digits=None),
        """SELECT *, count * 100.0 / sum(count) OVER () AS pct,
          total_payment_adj * 100.0 / sum(total_payment_adj) OVER () AS pct_of_total_dollars,
          mean_payment_adj / median_payment_adj AS mean_to_median_ratio
        FROM (SELECT PAYMENT_MODE, count(*) AS count, avg(PAYMENT_ADJ) AS mean_payment_adj,
          median(PAYMENT_ADJ) AS median_payment_adj, stddev_samp(PAYMENT_ADJ) AS std_payment_adj,
          max(PAYMENT_ADJ) AS max_payment_adj, sum(PAYMENT_ADJ) AS total_payment_adj FROM feat
          WHERE PAYMENT_MODE IN ('Single Payment', 'Multiple Payments') GROUP BY PAYMENT_MODE) AS s""",
        r4="mean_payment_adj median_payment_adj pct pct_of_total_dollars mean_to_median_ratio",
        r2="std_payment_adj max_payment_adj total_payment_adj",
    ),
    Query(
        "a13_annual_trend",
        lambda c: A.annual_trend(c.feat),
        ANNUAL_SQL,
        r4="mean_nominal median_nominal mean_adj median_adj",
        r2="total_nominal total_adj",
    ),
    Query(
        "a14_state_amounts",
        lambda c: A.state_amounts(c.feat),
        _amounts_sql("STATE", extra=SPREAD),
        r4="mean median p95",
        r2="total std max_payment",
    ),
    Query(
        "a15_license_field_amounts",
        lambda c: A.license_field_amounts(c.feat),
        f"SELECT *, {_license_label_sql('LICNFELD')} AS label FROM ({_amounts_sql('LICNFELD', extra=TOTAL)}) AS s",
        r4="mean median",
        r2="total",
    ),
    Query(
        "a16_allegation_amounts",
        lambda c: A.allegation_amounts(c.feat),
        f"""SELECT *, {case_sql('ALGNNATR', L.ALLEGATIONS, "'Unknown'")} AS label
        FROM ({_amounts_sql('ALGNNATR', extra=TOTAL)}) AS s""",
        r4="mean median",
        r2="total",
    ),
    Query(
        "a17_severity_amounts",
        lambda c: A.severity_amounts(c.feat),
        f"""SELECT {case_sql('OUTCOME', L.OUTCOMES_LONG, "'Unknown'")} AS outcome_label, * EXCLUDE (OUTCOME)
        FROM ({_amounts_sql('OUTCOME', extra=', quantile_cont(PAYMENT, 0.75) AS p75, quantile_cont(PAYMENT, 0.95) AS p95')}) AS s""",
        r4="mean median p75 p95",
    ),
    Query(
        "f21_label_predicates",
        lambda c: A.injury_only(A.severity_amounts(c.feat)),
        f"""SELECT {case_sql('OUTCOME', L.OUTCOMES_LONG)} AS outcome_label, OUTCOME AS severity_order, * EXCLUDE (OUTCOME)
        FROM ({_amounts_sql('OUTCOME', extra=', quantile_cont(PAYMENT, 0.75) AS p75, quantile_cont(PAYMENT, 0.95) AS p95')}) AS s
        WHERE OUTCOME BETWEEN 1 AND 9""",
        r4="mean median p75 p95",
    ),
    Query(
        "f24_minimum_sample",
        lambda c: S.large_groups(A.state_amounts(_merged(c)), 1000),
        f"WITH {MERGED_SQL};; SELECT * FROM ({_amounts_sql('STATE', 'merged', SPREAD)}) AS s WHERE count >= 1000",
        r4="mean median p95",
        r2="total std max_payment",
    ),
    Query(
        "a18_patient_sex_amounts",
        lambda c: A.patient_sex_amounts(c.feat),
        f"""SELECT {case_sql('PTSEX', L.SEXES, "'Unknown'")} AS sex_label, * EXCLUDE (PTSEX)
        FROM ({_amounts_sql('PTSEX', where='AND PAYMENT IS NOT NULL')}) AS s""",
        r4="mean median",
    ),
    Query(
        "a19_patient_age_amounts",
        lambda c: A.patient_age_amounts(c.feat),
        f"""SELECT {case_sql('PTAGE', L.PATIENT_AGES)} AS age_group,
        {case_sql('PTAGE', {k: i for i, k in enumerate(L.PATIENT_AGES, 1)})} AS age_ord, * EXCLUDE (PTAGE)
        FROM ({_amounts_sql('PTAGE', where='AND PAYMENT IS NOT NULL')}) AS s WHERE age_group IS NOT NULL""",
        r4="mean median",
    ),
    Query(
        "a20_resolution_amounts",
        lambda c: A.resolution_amounts(c.feat, digits=None),
        f"""SELECT {case_sql('PAYTYPE', L.DETAILED_RESOLUTIONS)} AS RESOLUTION, * EXCLUDE (PAYTYPE),
        count * 100.0 / sum(count) OVER () AS pct
        FROM ({_amounts_sql('PAYTYPE', extra=TOTAL, where='AND PAYMENT IS NOT NULL')}) AS s""",
        r4="mean median pct",
        r2="total",
    ),
    Query(
        "a21_catastrophic_totals",
        lambda c: A.catastrophic_totals(c.feat),
        CATASTROPHIC_SQL.format(where="true"),
        r4=CATASTROPHIC_R4,
        r2="total_dollars catastrophic_dollars",
    ),
    Query(
        "a22_catastrophic_window",
        lambda c: A.catastrophic_totals(c.feat, years=(2004, 2010)),
        CATASTROPHIC_SQL.format(where="ORIGYEAR BETWEEN 2004 AND 2010"),
        r4=CATASTROPHIC_R4,
        r2="total_dollars catastrophic_dollars",
    ),
    Query(
        "a23_catastrophic_by_year",
        lambda c: A.catastrophic_by_year(c.feat),
        """SELECT *, cat_claims * 100.0 / total_claims AS cat_pct, cat_dollars * 100.0 / nullif(total_dollars, 0) AS cat_dollar_pct
        FROM (SELECT ORIGYEAR, count(*) AS total_claims, count(*) FILTER (WHERE PAYMENT >= 1000000) AS cat_claims,
          coalesce(sum(PAYMENT), 0) AS total_dollars,
          coalesce(sum(PAYMENT) FILTER (WHERE PAYMENT >= 1000000), 0) AS cat_dollars FROM feat GROUP BY ORIGYEAR) AS s""",
        r4="cat_pct cat_dollar_pct",
        r2="total_dollars cat_dollars",
    ),
    Query(
        "a24_catastrophic_profile",
        lambda c: A.catastrophic_profile(c.feat),
        f"""SELECT dimension, label, count, pct FROM (
          SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY count DESC, label) AS place,
            count * 100.0 / sum(count) OVER (PARTITION BY dimension) AS pct
          FROM (SELECT 'state' AS dimension, STATE AS label, count(*) AS count FROM feat
              WHERE PAYMENT >= 1000000 AND STATE IS NOT NULL GROUP BY STATE
            UNION ALL SELECT 'allegation', {case_sql('ALGNNATR', L.ALLEGATIONS, "'Unknown'")}, count(*) FROM feat
              WHERE PAYMENT >= 1000000 AND ALGNNATR IS NOT NULL GROUP BY ALGNNATR
            UNION ALL SELECT 'outcome', {case_sql('OUTCOME', L.OUTCOMES_PLAIN, "'Unknown'")}, count(*) FROM feat
              WHERE PAYMENT >= 1000000 AND OUTCOME IS NOT NULL GROUP BY OUTCOME) AS u) AS r
        WHERE place <= CASE dimension WHEN 'state' THEN 10 WHEN 'allegation' THEN 8 ELSE 1000 END""",
        r4="pct",
    ),
    Query(
        "a25_lag_summary",
        lambda c: A.lag_summary(c.feat),
        """UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS rows, avg(LAG_YEARS) AS mean_lag_years,
          CAST(median(LAG_YEARS) AS DOUBLE) AS median_lag_years, quantile_cont(CAST(LAG_YEARS AS DOUBLE), 0.9) AS p90_lag_years,
          quantile_cont(CAST(LAG_YEARS AS DOUBLE), 0.95) AS p95_lag_years FROM feat WHERE VALID_LAG)
        ON COLUMNS(*) INTO NAME metric VALUE value""",
        r4="value",
    ),
    Query(
        "a25_lag_summary_extended",
        lambda c: A.lag_summary_extended(c.feat),
        """UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS rows, avg(LAG_YEARS) AS mean,
          CAST((SELECT LAG_YEARS FROM feat WHERE VALID_LAG GROUP BY LAG_YEARS ORDER BY count(*) DESC, LAG_YEARS LIMIT 1) AS DOUBLE) AS mode,
          stddev_samp(LAG_YEARS) AS std, CAST(max(LAG_YEARS) AS DOUBLE) AS max, """
        + ", ".join(f"quantile_cont(CAST(LAG_YEARS AS DOUBLE), {p / 100}) AS p{p}" for p in (25, 50, 75, 90, 95, 99))
        + " FROM feat WHERE VALID_LAG) ON COLUMNS(*) INTO NAME metric VALUE value",
        r4="value",
    ),
    Query("a26_lag_by_resolution", lambda c: A.lag_by(c.feat, "RESOLUTION_BINARY"), _lag_sql("RESOLUTION_BINARY"), r4=LAG_R4),
    Query("a27_lag_by_decade", lambda c: A.lag_by(c.feat, "PERIOD_10Y"), _lag_sql("PERIOD_10Y"), r4=LAG_R4),
    Query("a28_lag_by_year", lambda c: A.lag_by(c.feat, "ORIGYEAR"), _lag_sql("ORIGYEAR"), r4=LAG_R4),
    Query(
        "a29_lag_by_severity",
        lambda c: A.lag_by_severity(c.feat),
        f"""SELECT {case_sql('OUTCOME', {**L.OUTCOMES_SHORT, 10: '10-Cannot Det.'}, "'Unknown'")} AS outcome_label,
        * EXCLUDE (OUTCOME) FROM ({_lag_sql('OUTCOME')}) AS s""",
        r4=LAG_R4,
    ),
    Query(
        "a30_slowest_states",
        lambda c: A.slowest_states(c.feat),
        f"SELECT * FROM ({_lag_sql('STATE')}) AS s WHERE count >= 100",
        r4=LAG_R4,
    ),
    Query(
        "a31_payment_by_lag",
        lambda c: A.payment_by_lag(c.feat),
        f"SELECT * FROM ({_amounts_sql('LAG_YEARS', where='AND VALID_LAG')}) AS s WHERE count >= 20",
        r4="mean median",
    ),
    Query(
        "a32_experience_amounts",
        lambda c: A.experience_amounts(c.feat),
        f"""SELECT *, CASE EXPERIENCE_BAND {' '.join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(features.EXPERIENCE_LABELS, 1))} END AS band_ord
        FROM ({_amounts_sql('EXPERIENCE_BAND', f"({EXPERIENCE_SQL.format(source='feat')}) AS e", TOTAL, 'AND PAYMENT IS NOT NULL')}) AS s""",
        r4="mean median",
        r2="total",
    ),
    Query(
        "a33_practitioner_age_amounts",
        lambda c: A.practitioner_age_amounts(c.feat),
        f"""SELECT {case_sql('PRACTAGE', L.PRACTITIONER_AGES)} AS practitioner_age_group,
        {case_sql('PRACTAGE', {k: i for i, k in enumerate(L.PRACTITIONER_AGES, 1)})} AS age_ord, * EXCLUDE (PRACTAGE)
        FROM ({_amounts_sql('PRACTAGE', where='AND PAYMENT IS NOT NULL')}) AS s""",
        r4="mean median",
    ),
    Query(
        "a34_license_experience_amounts",
        lambda c: A.license_experience_amounts(c.feat),
        f"""WITH experienced AS (SELECT * FROM ({EXPERIENCE_SQL.format(source='feat')}) AS e WHERE PAYMENT IS NOT NULL),
        top_fields AS (SELECT LICNFELD FROM experienced GROUP BY LICNFELD ORDER BY count(*) DESC, LICNFELD LIMIT 6);;
        SELECT LICNFELD, EXPERIENCE_BAND, count(*) AS count, avg(PAYMENT) AS mean, median(PAYMENT) AS median,
          {_license_label_sql('LICNFELD')} AS field_label
        FROM experienced WHERE LICNFELD IN (SELECT LICNFELD FROM top_fields) GROUP BY LICNFELD, EXPERIENCE_BAND""",
        r4="mean median",
    ),
    Query(
        "a35_adverse_action_rates",
        lambda c: A.adverse_action_rates(c.feat),
        " UNION ALL ".join(
            f"""SELECT '{name}' AS action, count(*) FILTER (WHERE {flag}) AS records,
            count(*) FILTER (WHERE {flag}) * 100.0 / count(*) AS pct FROM {_ADVERSE_SOURCE}"""
            for flag, name in zip(["lic", "priv", "dea", "excl", "HAS_ANY_ADVERSE"], A.ADVERSE_FLAG_NAMES.values())
        ),
        r4="pct",
    ),
    Query(
        "a36_adverse_by_report_count",
        lambda c: A.adverse_by_report_count(c.feat),
        f"""SELECT *, CASE REPORT_COUNT_BAND {' '.join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(features.REPORT_COUNT_LABELS, 1))} END AS band_ord
        FROM (SELECT {REPORT_BAND_SQL} AS REPORT_COUNT_BAND, count(*) AS count, avg(CAST(lic AS INTEGER)) * 100 AS pct_licensure,
          avg(CAST(priv AS INTEGER)) * 100 AS pct_privilege, avg(CAST(HAS_ANY_ADVERSE AS INTEGER)) * 100 AS pct_any_adverse,
          avg(PAYMENT) AS mean_payment FROM {_ADVERSE_SOURCE} GROUP BY REPORT_COUNT_BAND) AS s WHERE REPORT_COUNT_BAND IS NOT NULL""",
        r4="pct_licensure pct_privilege pct_any_adverse mean_payment",
    ),
    Query(
        "a37_adverse_action_summary",
        lambda c: A.adverse_action_summary(c.feat),
        " UNION ALL ".join(
            f"""SELECT '{label}' AS action, count(*) FILTER (WHERE {column} > 0) AS records_with,
            count(*) FILTER (WHERE {column} > 0) * 100.0 / count(*) AS pct, avg({column}) AS mean_count, max({column}) AS max_count
            FROM {_ADVERSE_SOURCE}"""
            for column, label in L.ADVERSE_ACTIONS.items()
        ),
        r4="pct mean_count",
    ),
    Query(
        "a38_amounts_by_adverse_flag",
        lambda c: A.amounts_by_adverse_flag(c.feat),
        _amounts_sql("HAS_ANY_ADVERSE", _ADVERSE_SOURCE, ", stddev_samp(PAYMENT) AS std"),
        r4="mean median",
        r2="std",
    ),
    Query(
        "a39_resolution_coverage",
        lambda c: A.resolution_coverage(c.feat, digits=None),
        """SELECT *, total_records - has_payment AS missing_payment, has_payment * 100.0 / total_records AS coverage_pct,
          total_records * 100.0 / sum(total_records) OVER () AS pct_of_all_records,
          total_dollars * 100.0 / sum(total_dollars) OVER () AS pct_of_all_dollars
        FROM (SELECT RESOLUTION_BINARY, count(*) AS total_records, count(PAYMENT_ADJ) AS has_payment,
          avg(PAYMENT_ADJ) AS mean_payment, median(PAYMENT_ADJ) AS median_payment, min(PAYMENT_ADJ) AS min_payment,
          max(PAYMENT_ADJ) AS max_payment, stddev_samp(PAYMENT_ADJ) AS std_payment, coalesce(sum(PAYMENT_ADJ), 0) AS total_dollars
          FROM feat GROUP BY RESOLUTION_BINARY) AS s""",
        r4="mean_payment median_payment coverage_pct pct_of_all_records pct_of_all_dollars min_payment max_payment",
        r2="std_payment total_dollars",
    ),
    Query(
        "a40_severity_trend_by_resolution",
        lambda c: A.severity_trend_by_resolution(c.feat, digits=None),
        """SELECT *, mean_payment / median_payment AS mean_to_median
        FROM (SELECT RESOLUTION_BINARY, PERIOD_10Y, count(*) AS count, avg(PAYMENT_ADJ) AS mean_payment,
          median(PAYMENT_ADJ) AS median_payment, avg(CAST(CATASTROPHIC AS DOUBLE)) * 100 AS pct_catastrophic,
          coalesce(sum(PAYMENT_ADJ), 0) AS total_dollars FROM feat WHERE RESOLUTION_BINARY <> 'Other'
          GROUP BY RESOLUTION_BINARY, PERIOD_10Y) AS s""",
        r4="mean_payment median_payment pct_catastrophic mean_to_median",
        r2="total_dollars",
    ),
    Query(
        "a41_judgment_rate_ranking",
        lambda c: A.judgment_rate_ranking(A.resolution_by_state(_merged(c)), digits=None),
        f"""WITH {MERGED_SQL};; SELECT STATE, count, count * 100.0 / state_total AS pct_of_state, mean_payment_adj, median_payment_adj, state_total
        FROM (SELECT *, CAST(sum(count) OVER (PARTITION BY STATE) AS BIGINT) AS state_total
          FROM ({STATE_RESOLUTION_SQL.replace('FROM feat', 'FROM merged')}) AS s) AS t
        WHERE RESOLUTION_BINARY = 'Judgment' AND state_total >= 1000""",
        r4="pct_of_state mean_payment_adj median_payment_adj",
    ),
    Query(
        "a42_judgment_premium",
        lambda c: A.judgment_premium(A.resolution_by_state(_merged(c), median=False)),
        f"""WITH {MERGED_SQL};; SELECT STATE, avg(PAYMENT_ADJ) FILTER (WHERE RESOLUTION_BINARY = 'Judgment')
          / avg(PAYMENT_ADJ) FILTER (WHERE RESOLUTION_BINARY = 'Settlement/Non-Judgment') AS judgment_premium_ratio
        FROM merged WHERE STATE IS NOT NULL GROUP BY STATE HAVING count(*) >= 1000
          AND count(PAYMENT_ADJ) FILTER (WHERE RESOLUTION_BINARY = 'Judgment') > 0""",
        r4="judgment_premium_ratio",
    ),
    Query(
        "a43_repeat_report_counts",
        lambda c: audit.value_counts(c.feat, "NPMALRPT", keep_null=False, by_value=True),
        "SELECT NPMALRPT, count(*) AS count FROM feat WHERE NPMALRPT IS NOT NULL GROUP BY NPMALRPT",
    ),
    Query(
        "a43_repeat_report_tallies",
        lambda c: A.repeat_report_tallies(c.feat),
        " UNION ALL ".join(
            f"SELECT 'at_least_{n}' AS metric, CAST(count(*) FILTER (WHERE NPMALRPT >= {n}) AS DOUBLE) AS value FROM feat"
            for n in (2, 5, 10)
        ),
    ),
    Query(
        "a44_payment_vs_total",
        lambda c: A.payment_vs_total(c.feat),
        """SELECT *, total_mean / payment_mean AS mean_ratio, total_median / payment_median AS median_ratio
        FROM (SELECT count(*) AS records_with_both, avg(PAYMENT) AS payment_mean, median(PAYMENT) AS payment_median,
          avg(TOTALPMT) AS total_mean, median(TOTALPMT) AS total_median FROM feat
          WHERE PAYMENT IS NOT NULL AND TOTALPMT IS NOT NULL) AS s""",
        r4="payment_mean payment_median total_mean total_median mean_ratio median_ratio",
    ),
    # Windows, ranking and shares
    Query(
        "w01_share_of_total",
        lambda c: audit.value_counts(c.feat, "ALGNNATR").withColumn("pct", S.share_of_total("count", None)),
        "SELECT ALGNNATR, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM feat GROUP BY ALGNNATR",
        r4="pct",
    ),
    Query(
        "w02_share_within_parent",
        lambda c: c.feat.groupBy("STATE", "PTSEX")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("pct", S.share_within("count", ["STATE"], None)),
        """SELECT STATE, PTSEX, count(*) AS count,
        CASE WHEN STATE IS NOT NULL THEN count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY STATE) END AS pct
        FROM feat GROUP BY STATE, PTSEX""",
        r4="pct",
    ),
    Query(
        "w03_annual_changes",
        lambda c: A.annual_changes(A.annual_trend(c.feat, median=False)),
        f"""SELECT ORIGYEAR, (count * 1.0 / lag(count) OVER (ORDER BY ORIGYEAR) - 1) * 100 AS pct_chg_count,
        (mean_adj / lag(mean_adj) OVER (ORDER BY ORIGYEAR) - 1) * 100 AS pct_chg_mean_adj FROM ({ANNUAL_SQL}) AS t""",
        r4="pct_chg_count pct_chg_mean_adj",
    ),
    Query(
        "w04_smoothed_trend",
        lambda c: A.smoothed_trend(A.annual_trend(c.feat)),
        f"""SELECT ORIGYEAR, CASE WHEN count(mean_adj) OVER w = 5 THEN avg(mean_adj) OVER w END AS rolling_mean_adj,
        CASE WHEN count(median_adj) OVER w = 5 THEN avg(median_adj) OVER w END AS rolling_median_adj
        FROM ({ANNUAL_SQL}) AS t WINDOW w AS (ORDER BY ORIGYEAR ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
        r4="rolling_mean_adj rolling_median_adj",
    ),
    Query(
        "w05_running_share",
        lambda c: audit.value_counts(c.feat, "NPMALRPT")
        .withColumn("pct", S.share_of_total("count", 4))
        .withColumn("cumulative_pct", S.running_share("pct", "NPMALRPT", 4)),
        """SELECT *, sum(pct) OVER (ORDER BY NPMALRPT ROWS UNBOUNDED PRECEDING) AS cumulative_pct
        FROM (SELECT NPMALRPT, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct
          FROM feat GROUP BY NPMALRPT) AS s""",
        r4="pct cumulative_pct",
    ),
    Query(
        "w07_top_states_by_mean",
        lambda c: S.top_rows(A.state_amounts(c.feat).filter(F.col("count") >= 100), 20, "mean", ["STATE"]),
        f"""SELECT * FROM ({_amounts_sql('STATE', extra=SPREAD)}) AS s WHERE count >= 100
        ORDER BY mean DESC, STATE LIMIT 20""",
        r4="mean median p95",
        r2="total std max_payment",
    ),
    Query(
        "w09_rows_of_top_groups",
        lambda c: S.keep_top_groups(c.feat, "STATE", 10).select("SEQNO", "STATE"),
        """SELECT SEQNO, STATE FROM feat WHERE STATE IN
        (SELECT STATE FROM feat WHERE STATE IS NOT NULL GROUP BY STATE ORDER BY count(*) DESC, STATE LIMIT 10)""",
    ),
    Query(
        "w10_last_years",
        lambda c: S.last_rows(audit.missing_rate_by(c.new, "WORKSTAT"), 10, "ORIGYEAR"),
        """SELECT * FROM (SELECT ORIGYEAR, avg(CAST(WORKSTAT IS NULL AS INTEGER)) * 100 AS missing_pct FROM p_feat
        GROUP BY ORIGYEAR ORDER BY ORIGYEAR DESC LIMIT 10) AS s""",
        r4="missing_pct",
    ),
    # Joins
    Query(
        "j02_join_parent_totals",
        lambda c: A.with_state_totals(A.resolution_by_state(c.feat, median=False), None).select(
            "STATE", "RESOLUTION_BINARY", "count", "state_total", "pct_of_state"
        ),
        f"""SELECT STATE, RESOLUTION_BINARY, count, CAST(sum(count) OVER (PARTITION BY STATE) AS BIGINT) AS state_total,
        pct_within_state AS pct_of_state FROM ({STATE_RESOLUTION_SQL}) AS s""",
        r4="pct_of_state",
    ),
    Query(
        "j03_lookup_join",
        lambda c: L.with_label(c.feat.select("SEQNO", "PAYTYPE"), "PAYTYPE", "resolution", "RESOLUTION"),
        f"SELECT SEQNO, PAYTYPE, {case_sql('PAYTYPE', L.DETAILED_RESOLUTIONS)} AS RESOLUTION FROM feat",
    ),
    Query(
        "j04_aligned_join",
        lambda c: S.aligned(
            c.feat.groupBy("ORIGYEAR").agg(F.count(F.lit(1)).alias("claims")),
            c.feat.filter(F.col("PAYMENT") >= 2_000_000).groupBy("ORIGYEAR").agg(F.sum("PAYMENT").alias("dollars")),
            ["ORIGYEAR"],
        ),
        """SELECT ORIGYEAR, count(*) AS claims, coalesce(sum(PAYMENT) FILTER (WHERE PAYMENT >= 2000000), 0) AS dollars
        FROM feat GROUP BY ORIGYEAR""",
        r2="dollars",
    ),
    Query(
        "j04_aligned_ratio",
        lambda c: S.aligned_ratio(
            c.feat.filter("PAYMENT >= 500000").groupBy("STATE").agg(F.avg("PAYMENT_ADJ").alias("mean")),
            c.feat.groupBy("STATE").agg(F.avg("PAYMENT_ADJ").alias("mean")),
            ["STATE"],
            "mean",
        ),
        """SELECT STATE, avg(PAYMENT_ADJ) FILTER (WHERE PAYMENT >= 500000) / avg(PAYMENT_ADJ) AS ratio
        FROM feat WHERE STATE IS NOT NULL GROUP BY STATE HAVING count(*) FILTER (WHERE PAYMENT >= 500000) > 0""",
        r4="ratio",
    ),
    Query(
        "j05_tagged_union",
        _tagged_metrics,
        f"""UNPIVOT ({_BASELINE.format(tag='old', type='M')} UNION ALL {_BASELINE.format(tag='new', type='P')})
        ON COLUMNS(* EXCLUDE (cohort)) INTO NAME metric VALUE value""",
        r4="value",
    ),
    Query(
        "j06_membership_filter",
        lambda c: A.extract_states(c.feat, PEERS.replace("'", "").split(", ")).select("SEQNO", "STATE"),
        f"SELECT SEQNO, STATE FROM feat WHERE STATE IN ({PEERS})",
    ),
    Query(
        "d08_pivot_peer_periods",
        lambda c: pivot_summary(
            A.peer_state_comparison(c.feat, median=False), "STATE", "PERIOD_10Y", "mean_payment_adj", DECADES
        ),
        f"""PIVOT (SELECT STATE, PERIOD_10Y, mean_payment_adj FROM ({PEER_SQL}) AS p)
        ON PERIOD_10Y IN ({', '.join(repr(d) for d in DECADES)}) USING first(mean_payment_adj) GROUP BY STATE""",
        r4=" ".join(DECADES),
    ),
    Query(
        "d08_report_incident_matrix",
        lambda c: report_incident_matrix(A.report_vs_incident_period(c.feat)),
        f"""PIVOT (SELECT * FROM (SELECT PERIOD_10Y, MAL_PERIOD_10Y, avg(PAYMENT_ADJ) AS mean_payment_adj, count(*) AS n
          FROM feat WHERE MAL_PERIOD_10Y IS NOT NULL AND PERIOD_10Y IS NOT NULL GROUP BY PERIOD_10Y, MAL_PERIOD_10Y) AS p
          WHERE n >= 10 AND regexp_matches(MAL_PERIOD_10Y, '^(19|20)'))
        ON MAL_PERIOD_10Y IN ({', '.join(repr(d) for d in INCIDENT_DECADES)}) USING first(mean_payment_adj) GROUP BY PERIOD_10Y""",
        r4=" ".join(INCIDENT_DECADES),
    ),
    Query(
        "d08_pivot_mode_shares",
        lambda c: pivot_summary(
            A.payment_mode_distribution(c.new, ["PERIOD_10Y"], digits=None), "PERIOD_10Y", "PAYMENT_MODE", "pct",
            MODES, fill=0.0,
        ).toDF("PERIOD_10Y", "single", "multiple", "unknown"),
        """SELECT PERIOD_10Y, count(*) FILTER (WHERE PAYMENT_MODE = 'Single Payment') * 100.0 / count(*) AS single,
        count(*) FILTER (WHERE PAYMENT_MODE = 'Multiple Payments') * 100.0 / count(*) AS multiple,
        count(*) FILTER (WHERE PAYMENT_MODE = 'Unknown Payment Mode') * 100.0 / count(*) AS unknown
        FROM p_feat GROUP BY PERIOD_10Y""",
        r4="single multiple unknown",
    ),
]
