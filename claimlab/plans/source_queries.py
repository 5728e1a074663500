"""Queries over sources, audit, cleaning and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlab.functions import columns as X
from claimlab.functions import labels as L
from claimlab.functions.recovery import new_folder
from claimlab.operators import audit, cleaning, features
from claimlab.plans.base import CODES, COUNTRIES, INTEGERS, Query, case_sql
from claimlab.schema import CLAIMS_SCHEMA, DECLARED_KINDS
from claimlab.sources.claims_csv import parse_claims_lines, read_claims_csv

KEY_COLUMNS = (
    "RECTYPE ORIGYEAR MALYEAR1 PAYMENT TOTALPMT PAYNUMBR PAYTYPE WORKSTAT LICNSTAT HOMESTAT PRACTNUM ALGNNATR OUTCOME"
).split()
MISSINGNESS_COLUMNS = "TOTALPMT OUTCOME PTSEX PTAGE WORKSTAT PAYNUMBR ALGNNATR PAYTYPE".split()
PAYMENT_GAPS = "PAYMENT TOTALPMT ALGNNATR OUTCOME MALYEAR1 PAYTYPE PRACTAGE PTAGE PTSEX WORKSTAT".split()

# Raw columns of the sample claims, in their order there.
SAMPLE_COLUMNS = CLAIMS_SCHEMA.names
_RAW_TYPES = {f.name: f.dataType.simpleString() for f in CLAIMS_SCHEMA}


def _profile_sql(table: str, columns: list[str], types: dict[str, str]) -> str:
    rows = [
        f"""SELECT '{c}' AS "column", '{types[c]}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS null_count,
        (count(*) - count({c})) * 100.0 / count(*) AS null_pct, count(DISTINCT {c}) AS nunique FROM {table}"""
        for c in columns
    ]
    return " UNION ALL ".join(rows)


def _missing_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        (count(*) - count({c})) * 100.0 / count(*) AS missing_pct FROM {table}"""
        for c in columns
    )


def _declared_ok(column: str) -> str:
    return (
        f"""SELECT '{column}' AS "column", '{DECLARED_KINDS[column]}' AS declared,
        count(*) FILTER (WHERE {_bad(column)}) AS invalid_values FROM claims"""
    )


def _bad(column: str) -> str:
    if DECLARED_KINDS[column] == "String" or _RAW_TYPES[column] != "string":
        return "false"
    value = f"replace(replace({column}, '$', ''), ',', '')" if DECLARED_KINDS[column] == "Dollar" else column
    return f"trim({column}) <> '' AND TRY_CAST({value} AS DOUBLE) IS NULL"


def _csv_round_trip(c):
    """Claims written as CSV lines and parsed back with the declared schema."""
    ddl_order = [f for f in CLAIMS_SCHEMA if f.name in c.raw.columns]
    lines = c.raw.select(F.to_csv(F.struct(*[F.col(f.name) for f in ddl_order]), {"nullValue": ""}).alias("line"))
    schema = type(CLAIMS_SCHEMA)(ddl_order)
    return parse_claims_lines(lines, "line", schema).select("SEQNO", "RECTYPE", "ORIGYEAR", "PAYMENT", "TOTALPMT", "PRACTNUM")


def _several_files(c):
    """Claims written as CSV files in three column orders, one of them without a column, and read back together."""
    names = c.raw.columns
    orders = [names, names[::-1], [n for n in names[5:] + names[:5] if n != "PTAGE"]]
    folder = new_folder(c.spark, "claims-csv")
    for part, order in enumerate(orders):
        rows = c.raw.filter(F.col("SEQNO") % 3 == part).select(*order)
        rows.write.option("header", True).csv(f"{folder}/{part}")
    read = read_claims_csv(c.spark, folder)
    return read.select("SEQNO", "RECTYPE", "ORIGYEAR", "PRACTAGE", "PAYMENT", "TOTALPMT", "PTAGE", "PRACTNUM", "NPCTMRPT")


_COHORT_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS cohort, SEQNO FROM clean WHERE RECTYPE IN ({types})"
    for name, types in [
        ("payment", "'M', 'P'"), ("new_format", "'P'"), ("old_format", "'M'"), ("adverse", "'A', 'C'"),
    ]
)


def _labels(c):
    """Every label lookup at row level, next to the record id."""
    df = c.clean.select(
        "SEQNO",
        "LICNFELD",
        L.lookup(F.col("ALGNNATR"), L.ALLEGATIONS, "Unknown").alias("allegation"),
        L.lookup(F.col("OUTCOME"), L.OUTCOMES_LONG, "Unknown").alias("outcome_long"),
        L.lookup(F.col("OUTCOME"), L.OUTCOMES_SHORT, "Unknown").alias("outcome_short"),
        L.lookup(F.col("OUTCOME"), L.OUTCOMES_PLAIN, "Unknown").alias("outcome_plain"),
        L.lookup(F.col("PTSEX"), L.SEXES, "Unknown").alias("sex"),
        L.lookup(F.col("PTAGE"), L.PATIENT_AGES).alias("patient_age"),
        L.lookup(F.col("PRACTAGE"), L.PRACTITIONER_AGES).alias("practitioner_age"),
    )
    labelled = L.with_label(df, "LICNFELD", "license_field", "license_field")
    fallback = F.concat(F.lit("Code "), F.col("LICNFELD").cast("string"))
    return labelled.withColumn("license_field", F.coalesce("license_field", fallback))


_LABELS_SQL = f"""
SELECT SEQNO, LICNFELD,
  {case_sql('ALGNNATR', L.ALLEGATIONS, "'Unknown'")} AS allegation,
  {case_sql('OUTCOME', L.OUTCOMES_LONG, "'Unknown'")} AS outcome_long,
  {case_sql('OUTCOME', L.OUTCOMES_SHORT, "'Unknown'")} AS outcome_short,
  {case_sql('OUTCOME', L.OUTCOMES_PLAIN, "'Unknown'")} AS outcome_plain,
  {case_sql('PTSEX', L.SEXES, "'Unknown'")} AS sex,
  {case_sql('PTAGE', L.PATIENT_AGES)} AS patient_age,
  {case_sql('PRACTAGE', L.PRACTITIONER_AGES)} AS practitioner_age,
  CASE LICNFELD WHEN 10 THEN 'Allopathic Physician (MD)' WHEN 20 THEN 'Osteopathic Physician (DO)'
    WHEN 30 THEN 'Dentist' WHEN 100 THEN 'Registered Nurse' WHEN 603 THEN 'Chiropractor' END AS license_field
FROM clean
"""


def _experience(c):
    return features.with_experience(c.clean).select("SEQNO", "YEARS_EXPERIENCE", "EXPERIENCE_BAND")


def _bins_sql(value: str, edges: list, labels: list[str], closed: str) -> str:
    low, high = (">=", "<") if closed == "left" else (">", "<=")
    arms = []
    for i, label in enumerate(labels):
        upper = f" AND {value} {high} {edges[i + 1]}" if i + 1 < len(edges) else ""
        arms.append(f"WHEN {value} {low} {edges[i]}{upper} THEN '{label}'")
    return f"CASE {' '.join(arms)} END"


EXPERIENCE_SQL = f"""
SELECT *, {_bins_sql('YEARS_EXPERIENCE', features.EXPERIENCE_EDGES, features.EXPERIENCE_LABELS, 'left')} AS EXPERIENCE_BAND
FROM (SELECT *, ORIGYEAR - (GRAD + 5) AS YEARS_EXPERIENCE FROM {{source}}) AS aged
WHERE YEARS_EXPERIENCE BETWEEN 0 AND 60
"""
REPORT_BAND_SQL = _bins_sql(
    "coalesce(NPMALRPT, 0)", features.REPORT_COUNT_EDGES, features.REPORT_COUNT_LABELS, "right"
)
BRACKET_SQL = _bins_sql("PAYMENT_ADJ", features.BRACKET_EDGES, features.BRACKET_LABELS, "right")

FEATURE_COLUMNS = (
    "SEQNO RECTYPE STATE PERIOD_5Y PERIOD_10Y MAL_PERIOD_5Y MAL_PERIOD_10Y PAYTYPE_STR RESOLUTION_BINARY IS_JUDGMENT "
    "CPI_FACTOR PAYMENT PAYMENT_ADJ LOG_PAYMENT_ADJ TOTALPMT TOTALPMT_ADJ LAG_YEARS VALID_LAG CATASTROPHIC "
    "MISSING_STATE MISSING_ALLEGATION MISSING_OUTCOME PAYNUMBR_STR PAYMENT_MODE"
).split()


def _select(*names: str):
    return ", ".join(names)


_CLEAN_TYPES = {f.name: f.dataType.simpleString() for f in CLAIMS_SCHEMA} | {
    c: "int" for c in INTEGERS
} | {"PAYMENT": "double", "TOTALPMT": "double", "AALENGTH": "double"}


QUERIES = [
    Query(
        "s01_claims_csv_lines",
        _csv_round_trip,
        "SELECT SEQNO, RECTYPE, ORIGYEAR, nullif(PAYMENT, '') AS PAYMENT, TOTALPMT, PRACTNUM FROM claims",
    ),
    Query(
        "s01_claims_csv_files",
        _several_files,
        """SELECT SEQNO, RECTYPE, ORIGYEAR, PRACTAGE, nullif(PAYMENT, '') AS PAYMENT, TOTALPMT,
        CASE WHEN SEQNO % 3 <> 2 THEN PTAGE END AS PTAGE, PRACTNUM, NPCTMRPT FROM claims""",
    ),
    Query(
        "s02_dataset_extent",
        lambda c: audit.dataset_extent(c.raw),
        f"""SELECT count(*) AS row_count, CAST({len(SAMPLE_COLUMNS)} AS INTEGER) AS column_count, min(ORIGYEAR) AS first_year,
        max(ORIGYEAR) AS last_year, count(*) FILTER (WHERE RECTYPE IN ('M', 'P')) AS payment_reports,
        count(*) FILTER (WHERE RECTYPE NOT IN ('M', 'P')) AS other_reports FROM claims""",
    ),
    Query(
        "s03_column_profile",
        lambda c: audit.column_profile(c.raw, digits=None),
        _profile_sql("claims", SAMPLE_COLUMNS, _RAW_TYPES),
        r4="null_pct",
    ),
    Query(
        "s04_key_column_profile",
        lambda c: audit.column_profile(c.clean, [*KEY_COLUMNS, "NOT_A_COLUMN"], digits=None),
        _profile_sql("clean", KEY_COLUMNS, _CLEAN_TYPES),
        r4="null_pct",
    ),
    Query(
        "s05_record_type_counts",
        lambda c: audit.record_type_counts(c.raw, digits=None),
        "SELECT RECTYPE, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM claims GROUP BY RECTYPE",
        r4="pct",
    ),
    Query(
        "s06_value_counts",
        lambda c: audit.value_counts(c.feat, "PAYTYPE"),
        "SELECT PAYTYPE, count(*) AS count FROM feat GROUP BY PAYTYPE",
    ),
    Query(
        "s06_value_counts_top",
        lambda c: audit.value_counts(c.feat, "ALGNNATR", keep_null=False, limit=5),
        """SELECT ALGNNATR, count(*) AS count FROM feat WHERE ALGNNATR IS NOT NULL GROUP BY ALGNNATR
        ORDER BY count DESC, ALGNNATR LIMIT 5""",
    ),
    Query(
        "s07_distinct_values",
        lambda c: audit.distinct_values(c.clean, "OUTCOME"),
        "SELECT DISTINCT OUTCOME FROM clean",
    ),
    Query(
        "s08_record_class_breakdown",
        lambda c: audit.record_class_breakdown(c.raw, digits=None),
        """SELECT d.RECTYPE, d.label, coalesce(n, 0) AS count, coalesce(n * 100.0 / sum(n) OVER (), 0) AS pct
        FROM (VALUES ('M', 'Malpractice (old format, pre-2004)'), ('P', 'Malpractice (new format, post-2004)'),
          ('A', 'Adverse Action (old format, pre-1999)'), ('C', 'Adverse Action (CAAR, post-1999)')) AS d(RECTYPE, label)
        LEFT JOIN (SELECT RECTYPE, count(*) AS n FROM claims GROUP BY RECTYPE) AS k
        ON d.RECTYPE = k.RECTYPE""",
        r4="pct",
    ),
    Query(
        "s09_type_conformity",
        lambda c: audit.type_conformity(c.raw),
        "SELECT *, CASE WHEN invalid_values = 0 THEN 'OK' ELSE 'ISSUE' END AS status FROM ("
        + " UNION ALL ".join(_declared_ok(c) for c in SAMPLE_COLUMNS)
        + ") AS audit",
    ),
    Query(
        "s10_missingness_by_record_type",
        lambda c: audit.missingness_by_record_type(c.clean, MISSINGNESS_COLUMNS, digits=None),
        " UNION ALL ".join(
            f"""SELECT RECTYPE, '{c}' AS "column", count(*) - count({c}) AS missing_count,
            (count(*) - count({c})) * 100.0 / count(*) AS missing_pct FROM clean GROUP BY RECTYPE"""
            for c in MISSINGNESS_COLUMNS
        ),
        r4="missing_pct",
    ),
    Query(
        "s11_missingness_matrix",
        lambda c: audit.missingness_matrix(features.payment_records(c.clean), "RECTYPE", MISSINGNESS_COLUMNS),
        "SELECT RECTYPE, "
        + ", ".join(f"avg(CAST({c} IS NULL AS INTEGER)) * 100 AS {c}" for c in MISSINGNESS_COLUMNS)
        + " FROM clean WHERE RECTYPE IN ('M', 'P') GROUP BY RECTYPE",
        r4=" ".join(MISSINGNESS_COLUMNS),
    ),
    Query(
        "s11_missingness_counts",
        lambda c: audit.missingness_matrix(
            features.payment_records(c.clean), "RECTYPE", ["OUTCOME", "TOTALPMT", "PTSEX", "PTAGE", "WORKSTAT"], True
        ),
        "SELECT RECTYPE, "
        + ", ".join(f"count(*) - count({c}) AS {c}" for c in ["OUTCOME", "TOTALPMT", "PTSEX", "PTAGE", "WORKSTAT"])
        + " FROM clean WHERE RECTYPE IN ('M', 'P') GROUP BY RECTYPE",
    ),
    Query(
        "s12_missing_overview",
        lambda c: audit.missing_overview(features.payment_records(c.clean), PAYMENT_GAPS),
        _missing_sql("feat", PAYMENT_GAPS),
        r4="missing_pct",
    ),
    Query(
        "s12_missing_overview_adverse",
        lambda c: audit.missing_overview(features.adverse_records(c.clean)),
        _missing_sql("(SELECT * FROM clean WHERE RECTYPE IN ('A', 'C')) AS adverse", SAMPLE_COLUMNS),
        r4="missing_pct",
    ),
    Query(
        "s13_missing_rate_by_year",
        lambda c: audit.missing_rate_by(c.new, "WORKSTAT"),
        "SELECT ORIGYEAR, avg(CAST(WORKSTAT IS NULL AS INTEGER)) * 100 AS missing_pct FROM p_feat GROUP BY ORIGYEAR",
        r4="missing_pct",
    ),
    Query(
        "s14_missing_breakdown",
        lambda c: audit.missing_breakdown(c.new, "PTAGE", "PTSEX"),
        "SELECT PTSEX, count(*) AS count FROM p_feat WHERE PTAGE IS NULL GROUP BY PTSEX",
    ),
    Query(
        "s14_missing_state_by_type",
        lambda c: audit.missing_breakdown(c.new, "WORKSTAT", "TYPE"),
        "SELECT TYPE, count(*) AS count FROM p_feat WHERE WORKSTAT IS NULL GROUP BY TYPE",
    ),
    Query(
        "s15_fallback_coverage",
        lambda c: audit.fallback_coverage(c.new, "WORKSTAT", ["LICNSTAT", "HOMESTAT"]),
        " UNION ALL ".join(
            f"""SELECT '{c}' AS fallback, count(*) AS missing_rows, count({c}) AS present,
            count({c}) * 100.0 / count(*) AS pct FROM p_feat WHERE WORKSTAT IS NULL"""
            for c in ["LICNSTAT", "HOMESTAT"]
        ),
        r4="pct",
    ),
    Query(
        "s16_amounts_by_presence",
        lambda c: audit.amounts_by_presence(c.new, "WORKSTAT"),
        """SELECT WORKSTAT IS NULL AS is_missing, count(*) AS count, avg(PAYMENT) AS mean, median(PAYMENT) AS median
        FROM p_feat GROUP BY is_missing""",
        r4="mean median",
    ),
    Query(
        "s17_cohort_baseline",
        lambda c: audit.cohort_baseline(c.feat),
        """UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS malpractice_rows, CAST(count(DISTINCT STATE) AS DOUBLE) AS states_with_data,
          avg(PAYMENT_ADJ) AS mean_payment_adj, median(PAYMENT_ADJ) AS median_payment_adj,
          avg(CAST(CATASTROPHIC AS DOUBLE)) * 100 AS catastrophic_share_pct,
          avg(CAST(IS_JUDGMENT AS DOUBLE)) * 100 AS judgment_share_pct FROM feat)
        ON COLUMNS(*) INTO NAME metric VALUE value""",
        r4="value",
    ),
    Query(
        "s18_feature_quality",
        lambda c: audit.feature_quality(c.feat),
        """UNPIVOT (SELECT avg(CAST(MISSING_STATE AS DOUBLE)) * 100 AS missing_state_pct,
          avg(CAST(MISSING_ALLEGATION AS DOUBLE)) * 100 AS missing_allegation_pct,
          avg(CAST(MISSING_OUTCOME AS DOUBLE)) * 100 AS missing_outcome_pct,
          avg(CAST(PAYMENT_MODE NOT IN ('Unknown Payment Mode', 'Unavailable Pre-2004') AS DOUBLE)) * 100 AS payment_mode_known_pct,
          avg(CAST(TOTALPMT_ADJ IS NOT NULL AS DOUBLE)) * 100 AS observed_totalpmt_pct FROM feat)
        ON COLUMNS(*) INTO NAME metric VALUE value""",
        r4="value",
    ),
    Query(
        "c01_currency",
        lambda c: cleaning.clean_currency(c.raw).select("SEQNO", "PAYMENT", "TOTALPMT"),
        "SELECT SEQNO, PAYMENT, TOTALPMT FROM clean",
    ),
    Query(
        "c02_coded_integers",
        lambda c: cleaning.clean_coded_integers(c.raw).select("SEQNO", *INTEGERS, "AALENGTH", "PRACTNUM"),
        f"SELECT SEQNO, {_select(*INTEGERS)}, AALENGTH, PRACTNUM FROM clean",
    ),
    Query(
        "c03_code_strings",
        lambda c: cleaning.clean_code_strings(c.raw).select("SEQNO", *CODES),
        f"SELECT SEQNO, {_select(*CODES)} FROM clean",
    ),
    Query("c04_clean_claims", lambda c: c.clean, f"SELECT {_select(*SAMPLE_COLUMNS)} FROM clean"),
    Query(
        "c05_countries",
        lambda c: cleaning.clean_countries(c.raw).select("SEQNO", *COUNTRIES),
        """SELECT SEQNO, CASE WHEN SEQNO % 3 = 1 THEN 'USA' END AS WORKCTRY,
        CASE WHEN SEQNO % 4 <> 0 THEN 'CANADA' END AS HOMECTRY FROM claims""",
    ),
    Query("f01_cohorts", lambda c: features.cohort_tags(c.clean), _COHORT_SQL),
    Query(
        "f02_state",
        lambda c: features.with_state(c.clean).select("SEQNO", "STATE"),
        "SELECT SEQNO, upper(trim(coalesce(WORKSTAT, LICNSTAT, HOMESTAT))) AS STATE FROM clean",
    ),
    Query(
        "f03_f04_periods",
        lambda c: features.with_periods(c.clean).select(
            "SEQNO", "PERIOD_5Y", "PERIOD_10Y", "MAL_PERIOD_5Y", "MAL_PERIOD_10Y"
        ),
        "SELECT SEQNO, "
        + ", ".join(
            f"CAST({y} - {y} % {w} AS VARCHAR) || '-' || CAST({y} - {y} % {w} + {w - 1} AS VARCHAR) AS {p}PERIOD_{w}Y"
            for p, y in (("", "ORIGYEAR"), ("MAL_", "MALYEAR1"))
            for w in (5, 10)
        )
        + " FROM clean",
    ),
    Query(
        "f05_resolution",
        lambda c: features.with_resolution(c.clean).select("SEQNO", "PAYTYPE_STR", "RESOLUTION_BINARY", "IS_JUDGMENT"),
        """SELECT SEQNO, PAYTYPE AS PAYTYPE_STR, CASE WHEN PAYTYPE = 'J' THEN 'Judgment'
        WHEN PAYTYPE IN ('S', 'U', 'B', 'O') THEN 'Settlement/Non-Judgment' ELSE 'Other' END AS RESOLUTION_BINARY,
        PAYTYPE = 'J' AS IS_JUDGMENT FROM clean""",
    ),
    Query(
        "f06_detailed_resolution",
        lambda c: features.with_detailed_resolution(c.clean).select("SEQNO", "RESOLUTION"),
        f"SELECT SEQNO, {case_sql('PAYTYPE', L.DETAILED_RESOLUTIONS, repr('Other'))} AS RESOLUTION FROM clean WHERE PAYTYPE IS NOT NULL",
    ),
    Query(
        "f07_f08_adjusted_amounts",
        lambda c: features.with_adjusted_amounts(features.payment_records(c.clean)).select(
            "SEQNO",
            "CPI_FACTOR",
            "PAYMENT_ADJ",
            "TOTALPMT_ADJ",
            "LOG_PAYMENT_ADJ",
            X.positive_log(F.col("PAYMENT"), base10=True).alias("LOG10_PAYMENT"),
        ),
        """SELECT SEQNO, CPI_FACTOR, PAYMENT_ADJ, TOTALPMT_ADJ, LOG_PAYMENT_ADJ,
        CASE WHEN PAYMENT > 0 THEN log10(PAYMENT) END AS LOG10_PAYMENT FROM feat""",
        r4="LOG_PAYMENT_ADJ LOG10_PAYMENT PAYMENT_ADJ TOTALPMT_ADJ",
    ),
    Query(
        "f09_f11_lag_and_flags",
        lambda c: c.feat.select(
            "SEQNO", "LAG_YEARS", "VALID_LAG", "CATASTROPHIC", "MISSING_STATE", "MISSING_ALLEGATION", "MISSING_OUTCOME",
            features.catastrophic(F.col("PAYMENT")).alias("CATASTROPHIC_NOMINAL"),
        ),
        """SELECT SEQNO, LAG_YEARS, VALID_LAG, CATASTROPHIC, MISSING_STATE, MISSING_ALLEGATION, MISSING_OUTCOME,
        coalesce(PAYMENT >= 1000000, false) AS CATASTROPHIC_NOMINAL FROM feat""",
    ),
    Query(
        "f12_common_features",
        lambda c: c.feat.select(*FEATURE_COLUMNS),
        f"SELECT {_select(*FEATURE_COLUMNS)} FROM feat",
        r4="LOG_PAYMENT_ADJ PAYMENT_ADJ TOTALPMT_ADJ",
    ),
    Query(
        "f13_payment_mode",
        lambda c: features.with_payment_mode(c.clean).select("SEQNO", "PAYNUMBR_STR", "PAYMENT_MODE"),
        """SELECT SEQNO, PAYNUMBR AS PAYNUMBR_STR, CASE WHEN RECTYPE = 'M' THEN 'Unavailable Pre-2004'
        WHEN PAYNUMBR = 'S' THEN 'Single Payment' WHEN PAYNUMBR = 'M' THEN 'Multiple Payments'
        ELSE 'Unknown Payment Mode' END AS PAYMENT_MODE FROM clean""",
    ),
    Query("f14_labels", _labels, _LABELS_SQL),
    Query(
        "f15_ordered_categories",
        lambda c: c.clean.select(
            "SEQNO",
            L.rank_of(F.col("PTAGE"), L.PATIENT_AGES).alias("PTAGE_ORD"),
            L.rank_of(F.col("PRACTAGE"), L.PRACTITIONER_AGES).alias("PRACTAGE_ORD"),
        ),
        f"""SELECT SEQNO, {case_sql('PTAGE', {k: i for i, k in enumerate(L.PATIENT_AGES, 1)})} AS PTAGE_ORD,
        {case_sql('PRACTAGE', {k: i for i, k in enumerate(L.PRACTITIONER_AGES, 1)})} AS PRACTAGE_ORD FROM clean""",
    ),
    Query(
        "f16_f17_experience",
        _experience,
        f"SELECT SEQNO, YEARS_EXPERIENCE, EXPERIENCE_BAND FROM ({EXPERIENCE_SQL.format(source='clean')}) AS e",
    ),
    Query(
        "f18_right_closed_bins",
        lambda c: features.with_report_count_band(c.feat).select(
            "SEQNO", "REPORT_COUNT_BAND", features.payment_bracket(F.col("PAYMENT_ADJ")).alias("BRACKET")
        ),
        f"SELECT SEQNO, {REPORT_BAND_SQL} AS REPORT_COUNT_BAND, {BRACKET_SQL} AS BRACKET FROM feat",
    ),
    Query(
        "f19_adverse_flags",
        lambda c: features.with_adverse_flags(c.clean).select(
            "SEQNO", "HAS_LICENSURE", "HAS_PRIVILEGE", "HAS_DEA", "HAS_EXCLUSION", "HAS_ANY_ADVERSE"
        ),
        """SELECT SEQNO, NPLICRPT > 0 AS HAS_LICENSURE, NPCLPRPT > 0 AS HAS_PRIVILEGE, NPDEARPT > 0 AS HAS_DEA,
        NPEXCRPT > 0 AS HAS_EXCLUSION, NPLICRPT + NPCLPRPT + NPDEARPT + NPEXCRPT > 0 AS HAS_ANY_ADVERSE FROM clean""",
    ),
    Query(
        "f20_top_coding",
        lambda c: c.clean.select("SEQNO", X.top_code(F.col("NPMALRPT"), 6).alias("REPORTS")),
        "SELECT SEQNO, CASE WHEN NPMALRPT >= 6 THEN '6+' ELSE CAST(NPMALRPT AS VARCHAR) END AS REPORTS FROM clean",
    ),
    Query(
        "f22_complete_cases",
        lambda c: features.complete_cases(c.clean, ["PAYTYPE", "PAYMENT", "NOT_A_COLUMN"]).select("SEQNO"),
        "SELECT SEQNO FROM clean WHERE PAYTYPE IS NOT NULL AND PAYMENT IS NOT NULL",
    ),
    Query(
        "f23_year_range",
        lambda c: features.year_range(c.clean, 2004, 2010).select("SEQNO", "ORIGYEAR"),
        "SELECT SEQNO, ORIGYEAR FROM clean WHERE ORIGYEAR BETWEEN 2004 AND 2010",
    ),
]
