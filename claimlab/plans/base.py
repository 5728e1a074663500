"""Registered queries: a DataFrame function next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlab.functions.labels import CPI_FACTORS, CPI_FIRST_YEAR
from claimlab.operators import features, linkage
from claimlab.operators.cleaning import clean_claims
from claimlab.sources.sample_claims import CLAIMS_SQL, sample_claims


class Claims:
    """The stages of the sample claims that queries start from; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def raw(self) -> DataFrame:
        return sample_claims(self.spark, self.sf_dir)

    @cached_property
    def clean(self) -> DataFrame:
        return clean_claims(self.raw)

    @cached_property
    def feat(self) -> DataFrame:
        return features.with_common_features(self.clean)

    @cached_property
    def new(self) -> DataFrame:
        return features.new_format_records(self.feat)

    @cached_property
    def linked(self) -> DataFrame:
        return linkage.with_best_total(self.feat)


@dataclass(frozen=True)
class Query:
    """`r4` and `r2` name the double columns compared at 4 and 2 decimals (engines add in different orders).

    Means of cent amounts often end exactly halfway between two decimals, so both sides add the same small
    offset, far above the summation error, before they round.
    """

    key: str
    build: Callable[[Claims], DataFrame]
    sql: str | None = None
    r4: str = ""
    r2: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        result = self.build(Claims(spark, sf_dir))
        rounded = {
            c: F.round(F.col(f"`{c}`").cast("double") + F.lit(offset), digits)
            for names, digits, offset in self._rounding()
            for c in names.split()
        }
        return result.withColumns(rounded) if rounded else result

    def _rounding(self):
        return (self.r4, 4, 1e-7), (self.r2, 2, 1e-3)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        rounded = [
            f'round(CAST("{c}" AS DOUBLE) + {offset:.7f}, {digits}) AS "{c}"'
            for names, digits, offset in self._rounding()
            for c in names.split()
        ]
        replace = f" REPLACE ({', '.join(rounded)})" if rounded else ""
        body = self.sql.strip()
        local = kind = ""
        if body.startswith("WITH "):
            # A query's own CTEs end at the marker and join the shared ones.
            local, body = body[5:].split(";;")
            if local.startswith("RECURSIVE "):
                kind, local = "RECURSIVE ", local[10:]
            local = ", " + local.strip()
        return f"WITH {kind}{SHARED_CTES}{local}\nSELECT *{replace} FROM (\n{body.strip()}\n) AS result"


def _code(column: str) -> str:
    return (
        f"CASE WHEN upper(trim({column})) IN ('', 'NAN', 'NONE') THEN NULL ELSE upper(trim({column})) END AS {column}"
    )


def _integer(column: str) -> str:
    return f"CAST(round_even(TRY_CAST({column} AS DOUBLE), 0) AS INTEGER) AS {column}"


def _dollars(column: str) -> str:
    return f"TRY_CAST(nullif(replace(replace({column}, '$', ''), ',', ''), '') AS DOUBLE) AS {column}"


CODES = (
    "RECTYPE WORKSTAT HOMESTAT LICNSTAT PAYNUMBR PAYTYPE PYRRLTNS PTSEX PTTYPE AALENTYP "
    "BASISCD1 BASISCD2 BASISCD3 BASISCD4 BASISCD5"
).split()
INTEGERS = (
    "PRACTAGE GRAD ALGNNATR ALEGATN1 ALEGATN2 OUTCOME MALYEAR1 MALYEAR2 NUMBPRSN PTAGE AAYEAR "
    "AACLASS1 AACLASS2 AACLASS3 AACLASS4 AACLASS5 AAEFYEAR AASIGYR FUNDPYMT"
).split()
COUNTRIES = ["WORKCTRY", "HOMECTRY"]


def period_sql(year: str, width: int) -> str:
    start = f"CAST(floor({year} / {width}.0) * {width} AS INTEGER)"
    return f"CAST({start} AS VARCHAR) || '-' || CAST({start} + {width - 1} AS VARCHAR)"


def case_sql(column: str, table: dict, default: str = "NULL", quote: bool = False) -> str:
    def literal(value):
        return f"'{value}'" if isinstance(value, str) else str(value)

    arms = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


_CPI = case_sql("ORIGYEAR", {CPI_FIRST_YEAR + i: f for i, f in enumerate(CPI_FACTORS)})

CLEAN_SQL = (
    "SELECT * REPLACE ("
    + ", ".join(
        [_dollars(c) for c in ("PAYMENT", "TOTALPMT")]
        + [_integer(c) for c in INTEGERS]
        + [_code(c) for c in CODES]
        + [f"nullif({c}, 'nan') AS {c}" for c in COUNTRIES]
        + ["TRY_CAST(AALENGTH AS DOUBLE) AS AALENGTH"]
    )
    + ") FROM claims"
)

FEAT_SQL = f"""
SELECT *,
  CASE WHEN state_source IN ('', 'NAN') THEN NULL ELSE state_source END AS STATE,
  {period_sql('ORIGYEAR', 5)} AS PERIOD_5Y,
  {period_sql('ORIGYEAR', 10)} AS PERIOD_10Y,
  {period_sql('MALYEAR1', 5)} AS MAL_PERIOD_5Y,
  {period_sql('MALYEAR1', 10)} AS MAL_PERIOD_10Y,
  PAYTYPE AS PAYTYPE_STR,
  CASE WHEN PAYTYPE = 'J' THEN 'Judgment' WHEN PAYTYPE IN ('S', 'U', 'B', 'O') THEN 'Settlement/Non-Judgment'
       ELSE 'Other' END AS RESOLUTION_BINARY,
  PAYTYPE = 'J' AS IS_JUDGMENT,
  PAYMENT * CPI_FACTOR AS PAYMENT_ADJ,
  CASE WHEN PAYMENT * CPI_FACTOR > 0 THEN ln(PAYMENT * CPI_FACTOR) END AS LOG_PAYMENT_ADJ,
  TOTALPMT * CPI_FACTOR AS TOTALPMT_ADJ,
  ORIGYEAR - MALYEAR1 AS LAG_YEARS,
  ORIGYEAR - MALYEAR1 BETWEEN 0 AND 50 AS VALID_LAG,
  coalesce(PAYMENT * CPI_FACTOR >= 1000000, false) AS CATASTROPHIC,
  (CASE WHEN state_source IN ('', 'NAN') THEN NULL ELSE state_source END) IS NULL AS MISSING_STATE,
  ALGNNATR IS NULL AS MISSING_ALLEGATION,
  OUTCOME IS NULL AS MISSING_OUTCOME,
  PAYNUMBR AS PAYNUMBR_STR,
  CASE WHEN RECTYPE = 'M' THEN 'Unavailable Pre-2004' WHEN PAYNUMBR = 'S' THEN 'Single Payment'
       WHEN PAYNUMBR = 'M' THEN 'Multiple Payments' ELSE 'Unknown Payment Mode' END AS PAYMENT_MODE
FROM (
  SELECT *, upper(trim(coalesce(WORKSTAT, LICNSTAT, HOMESTAT))) AS state_source,
    CAST({_CPI} AS DOUBLE) AS CPI_FACTOR
  FROM clean WHERE RECTYPE IN ('M', 'P')
) AS sourced
"""


def _key_sql(columns: list[str]) -> str:
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'NA')" for c in columns)


# Key columns and the largest span of years of each tier.
_TIERS = {
    "strict": (["PRACTNUM", "STATE", "MALYEAR1", "MALYEAR2", "ALGNNATR", "PAYTYPE_STR"], 3),
    "moderate": (["PRACTNUM", "STATE", "MALYEAR1", "ALGNNATR", "ORIGYEAR_WINDOW"], 5),
    "exploratory": (["PRACTNUM", "STATE", "MALYEAR1"], 7),
}


def episodes_sql(tier: str, source: str = "feat") -> str:
    keys, span = _TIERS[tier]
    return f"""
SELECT *, NOT ambiguous_episode AND record_count >= 1 AS reconstruction_eligible
FROM (
  SELECT *, max_origyear - min_origyear AS origyear_span,
    practitioner_count > 1 OR state_count > 1 OR allegation_count > 1 OR paytype_count > 1
      OR max_origyear - min_origyear > {span} AS ambiguous_episode
  FROM (
    SELECT {_key_sql(keys)} AS EPISODE_KEY, '{tier}' AS linkage_tier,
      count(*) AS record_count,
      count(DISTINCT PRACTNUM) AS practitioner_count,
      count(DISTINCT STATE) AS state_count,
      count(DISTINCT ALGNNATR) AS allegation_count,
      count(DISTINCT PAYTYPE_STR) AS paytype_count,
      count(DISTINCT REPTYPE) AS reptype_count,
      min(ORIGYEAR) AS min_origyear, max(ORIGYEAR) AS max_origyear,
      coalesce(sum(PAYMENT_ADJ), 0) AS payment_sum_adj,
      max(TOTALPMT_ADJ) AS totalpmt_max_adj,
      count(TOTALPMT_ADJ) AS totalpmt_non_null
    FROM (SELECT *, CAST(floor(ORIGYEAR / 3.0) * 3 AS INTEGER) AS ORIGYEAR_WINDOW FROM {source}) AS windowed
    GROUP BY EPISODE_KEY
  ) AS grouped
) AS flagged
"""


def validation_sql(tier: str, source: str = "p_feat") -> str:
    return f"""
SELECT *, coalesce(absolute_pct_error <= 0.10, false) AS within_10pct,
  coalesce(absolute_pct_error <= 0.25, false) AS within_25pct
FROM (
  SELECT *, abs(payment_sum_adj - totalpmt_max_adj) AS absolute_error,
    abs(payment_sum_adj - totalpmt_max_adj) / nullif(totalpmt_max_adj, 0) AS absolute_pct_error
  FROM ({episodes_sql(tier, source)}) AS e WHERE totalpmt_non_null > 0
) AS v
"""


LINKED_SQL = f"""
SELECT f.*, e.payment_sum_adj AS EPISODE_PAYMENT_SUM_ADJ, e.reconstruction_eligible,
  CASE WHEN f.TOTALPMT_ADJ IS NOT NULL THEN f.TOTALPMT_ADJ
       WHEN e.reconstruction_eligible THEN e.payment_sum_adj END AS TOTALPMT_BEST,
  CASE WHEN f.TOTALPMT_ADJ IS NOT NULL THEN 'observed'
       WHEN e.reconstruction_eligible THEN 'reconstructed' ELSE 'unresolved' END AS TOTALPMT_SOURCE
FROM (SELECT *, {_key_sql(_TIERS['strict'][0])} AS EPISODE_KEY FROM feat) AS f
LEFT JOIN ({episodes_sql('strict')}) AS e ON f.EPISODE_KEY = e.EPISODE_KEY
"""

SHARED_CTES = f"""
claims AS ({CLAIMS_SQL.format(orders='orders', customer='customer')}),
clean AS ({CLEAN_SQL}),
feat AS ({FEAT_SQL}),
p_feat AS (SELECT * FROM feat WHERE RECTYPE = 'P')
"""


def payment_stats_sql(amount: str = "PAYMENT_ADJ") -> str:
    return f"""count(*) AS count, avg({amount}) AS mean_payment_adj, median({amount}) AS median_payment_adj,
  coalesce(sum({amount}), 0) AS total_payment_adj, avg(CAST(CATASTROPHIC AS DOUBLE)) AS catastrophic_share,
  avg(CAST(IS_JUDGMENT AS DOUBLE)) AS judgment_share"""


PAYMENT_R4 = "mean_payment_adj median_payment_adj catastrophic_share judgment_share"
