"""Claims derived from the shared test tables: one claim per order.

The projection is one SQL text that both Spark and the SQL oracle run, so every check starts from
the same rows. `{orders}` and `{customer}` name the input tables. All columns of the layout are there, some of them
with values that cleaning has to refuse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STATES = "NY CA PA FL TX IL WI MN IA MI IN OH NJ MO KS GA MA WA AZ CO VA NC TN LA AK".split()


def _state(position: str) -> str:
    """The state at a position of the list; all codes have two letters."""
    return f"substr('{''.join(STATES)}', CAST(2 * {position} + 1 AS INT), 2)"


CLAIMS_SQL = f"""
SELECT
  k AS SEQNO,
  rectype AS RECTYPE,
  CAST(CASE WHEN k % 50 = 2 THEN 102 ELSE 301 END AS INT) AS REPTYPE,
  CAST(origyear AS INT) AS ORIGYEAR,
  CASE WHEN k % 5 = 0 THEN NULL ELSE work_state END AS WORKSTAT,
  CASE WHEN k % 3 = 0 THEN 'nan' WHEN k % 3 = 1 THEN 'USA' END AS WORKCTRY,
  CASE WHEN k % 75 = 0 THEN NULL ELSE home_state END AS HOMESTAT,
  CASE WHEN k % 4 <> 0 THEN 'CANADA' END AS HOMECTRY,
  CASE WHEN k % 25 = 0 THEN NULL ELSE lower(work_state) END AS LICNSTAT,
  CAST(CASE cu % 7 WHEN 3 THEN 20 WHEN 4 THEN 30 WHEN 5 THEN 100 WHEN 6 THEN 603 ELSE 10 END AS INT) AS LICNFELD,
  CASE WHEN k % 31 = 0 THEN NULL WHEN k % 127 = 0 THEN 'retired' ELSE CAST(20 + 10 * (cu % 6) AS VARCHAR(20)) END AS PRACTAGE,
  CAST(1960 + 10 * (cu % 6) AS VARCHAR(20)) AS GRAD,
  CASE WHEN mal AND k % 83 <> 0 THEN CASE WHEN nature = 0 THEN '1' ELSE CAST(10 * nature AS VARCHAR(20)) END END AS ALGNNATR,
  CASE WHEN mal AND k % 3 = 0 THEN CAST(100 + k % 9 AS VARCHAR(20)) END AS ALEGATN1,
  CASE WHEN mal AND k % 45 = 9 THEN 'unclear' WHEN mal AND k % 9 = 0 THEN CAST(100 + k % 7 AS VARCHAR(20)) END AS ALEGATN2,
  CASE WHEN rectype = 'P' THEN CAST(1 + k % 10 AS VARCHAR(20)) END AS OUTCOME,
  CASE WHEN NOT mal OR k % 89 = 0 THEN NULL
       WHEN k % 97 = 0 THEN '3999'
       ELSE CAST(base - 3 + k % 2 AS VARCHAR(20)) END AS MALYEAR1,
  CASE WHEN NOT mal OR k % 4 = 0 THEN NULL ELSE CAST(base - 3 + k % 2 AS VARCHAR(20)) END AS MALYEAR2,
  CASE WHEN NOT mal THEN NULL
       WHEN k % 79 = 0 THEN ''
       WHEN amt >= 1000 THEN '$' || CAST(CAST((amt - amt % 1000) / 1000 AS BIGINT) AS VARCHAR(20))
                             || ',' || lpad(CAST(amt % 1000 AS VARCHAR(20)), 3, '0')
       ELSE '$' || CAST(amt AS VARCHAR(20)) END AS PAYMENT,
  CASE WHEN rectype = 'P'
       THEN CASE WHEN k % 223 = 0 THEN '$unknown' ELSE '$' || CAST(CASE WHEN pn = 'M' AND amt * 2 >= 1000 THEN amt * 2 ELSE amt END AS VARCHAR(20)) END
       END AS TOTALPMT,
  CASE WHEN rectype = 'P' THEN CASE WHEN k % 7 = 0 THEN ' ' || lower(pn) ELSE pn END END AS PAYNUMBR,
  CASE WHEN rectype = 'P' THEN CASE WHEN k % 53 = 0 THEN '2 or 3' ELSE CAST(1 + k % 4 AS VARCHAR(20)) END END AS NUMBPRSN,
  CASE WHEN NOT mal OR k % 103 = 0 THEN NULL
       WHEN k % 37 = 0 THEN 'J' WHEN k % 17 = 0 THEN 'U'
       WHEN k % 41 = 0 THEN 'B' WHEN k % 101 = 0 THEN 'O' ELSE 'S' END AS PAYTYPE,
  CASE WHEN rectype = 'P' THEN CASE k % 4 WHEN 0 THEN ' i ' WHEN 1 THEN 'P' WHEN 2 THEN 'none' ELSE 'G' END END AS PYRRLTNS,
  CASE WHEN rectype <> 'P' OR k % 29 = 0 THEN NULL
       WHEN k % 12 < 3 THEN CAST(k % 12 - 1 AS VARCHAR(20))
       ELSE CAST(10 * (k % 12 - 2) AS VARCHAR(20)) END AS PTAGE,
  CASE WHEN rectype <> 'P' THEN NULL WHEN k % 9 = 0 THEN 'U' WHEN k % 2 = 0 THEN 'F' ELSE 'M' END AS PTSEX,
  CASE WHEN rectype = 'P' THEN CASE WHEN k % 2 = 0 THEN 'I' WHEN k % 3 = 0 THEN 'nan' ELSE 'o' END END AS PTTYPE,
  CASE WHEN NOT mal THEN CAST(base + k % 6 AS VARCHAR(20)) || CASE WHEN cu % 3 = 0 THEN '.0' ELSE '' END END AS AAYEAR,
  CASE WHEN mal THEN NULL WHEN cu % 7 = 0 THEN 'N/A' ELSE CAST(1100 + 5 * (cu % 40) AS VARCHAR(20)) END AS AACLASS1,
  CASE WHEN NOT mal AND cu % 2 = 0 THEN CAST(1100 + 5 * (cu % 9) AS VARCHAR(20)) END AS AACLASS2,
  CASE WHEN NOT mal AND cu % 4 = 0 THEN CAST(1100 + 5 * (cu % 7) AS VARCHAR(20)) END AS AACLASS3,
  CASE WHEN NOT mal AND cu % 8 = 0 THEN CAST(1100 + 5 * (cu % 5) AS VARCHAR(20)) END AS AACLASS4,
  CASE WHEN NOT mal AND cu % 16 = 0 THEN CAST(1100 + 5 * (cu % 3) AS VARCHAR(20)) END AS AACLASS5,
  CASE WHEN NOT mal THEN CASE WHEN cu % 3 = 0 THEN ' a5 ' ELSE 'F' || CAST(cu % 10 AS VARCHAR(20)) END END AS BASISCD1,
  CASE WHEN NOT mal AND cu % 2 = 0 THEN '1' || CAST(cu % 10 AS VARCHAR(20)) END AS BASISCD2,
  CASE WHEN NOT mal AND cu % 4 = 0 THEN 'd' || CAST(cu % 10 AS VARCHAR(20)) END AS BASISCD3,
  CASE WHEN NOT mal AND cu % 8 = 0 THEN 'None' WHEN NOT mal THEN '' END AS BASISCD4,
  CASE WHEN NOT mal AND cu % 16 = 0 THEN 'E1' END AS BASISCD5,
  CASE WHEN NOT mal THEN CASE cu % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'i' ELSE '' END END AS AALENTYP,
  CASE WHEN mal OR cu % 3 = 1 THEN NULL WHEN cu % 11 = 0 THEN 'indefinite'
       ELSE CAST(cu % 36 AS VARCHAR(20)) || '.5' END AS AALENGTH,
  CASE WHEN NOT mal THEN CAST(origyear AS VARCHAR(20)) END AS AAEFYEAR,
  CASE WHEN NOT mal AND cu % 5 <> 0 THEN CAST(origyear - k % 2 AS VARCHAR(20)) END AS AASIGYR,
  CAST(1 + cu % 3 AS INT) AS TYPE,
  cu AS PRACTNUM,
  CAST(0 AS INT) AS ACCRRPTS,
  CAST(1 + cu % 12 AS INT) AS NPMALRPT,
  CAST(CASE WHEN cu % 6 = 0 THEN 1 + cu % 3 ELSE 0 END AS INT) AS NPLICRPT,
  CAST(CASE WHEN cu % 19 = 0 THEN 1 ELSE 0 END AS INT) AS NPCLPRPT,
  CAST(CASE WHEN cu % 97 = 0 THEN 1 ELSE 0 END AS INT) AS NPPSMRPT,
  CAST(CASE WHEN cu % 83 = 0 THEN 1 ELSE 0 END AS INT) AS NPDEARPT,
  CAST(CASE WHEN cu % 29 = 0 THEN 2 ELSE 0 END AS INT) AS NPEXCRPT,
  CAST(CASE WHEN cu % 211 = 0 THEN 1 ELSE 0 END AS INT) AS NPGARPT,
  CAST(CASE WHEN cu % 301 = 0 THEN 1 ELSE 0 END AS INT) AS NPCTMRPT,
  CASE WHEN rectype = 'P' THEN CASE WHEN cu % 61 = 0 THEN 'x' ELSE CAST(k % 2 AS VARCHAR(20)) END END AS FUNDPYMT
FROM (
  SELECT *, rectype IN ('M', 'P') AS mal, (cu + CASE WHEN cu % 4 = 0 THEN k % 4 ELSE k % 2 END) % 11 AS nature,
    {_state('si')} AS work_state, {_state('nk')} AS home_state
  FROM (
    SELECT *,
      CASE WHEN k % 10 = 0 THEN 'C' WHEN k % 20 = 1 THEN 'A' WHEN origyear < 2004 THEN 'M' ELSE 'P' END AS rectype
    FROM (
      SELECT o_orderkey AS k, o_custkey AS cu,
        CAST(c_nationkey AS BIGINT) AS nk,
        1990 + (o_custkey * 7) % 30 AS base,
        1990 + (o_custkey * 7) % 30 + o_orderkey % 6 AS origyear,
        CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderkey % 13 = 0 THEN 8 ELSE 1 END AS amt,
        (CAST(c_nationkey AS BIGINT) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) % 25 AS si,
        CASE WHEN o_orderkey % 20 < 17 THEN 'S' WHEN o_orderkey % 20 < 19 THEN 'M' ELSE 'U' END AS pn
      FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
    ) AS joined
  ) AS typed
) AS flagged
"""


def sample_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw claims over the whole `orders` and `customer` tables of a scale-factor folder."""
    return spark.sql(
        CLAIMS_SQL,
        orders=spark.read.parquet(f"{sf_dir}/orders.parquet"),
        customer=spark.read.parquet(f"{sf_dir}/customer.parquet"),
    )
