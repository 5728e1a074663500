"""Number parsing, the CSV reader, spread and order statistics on unusual values."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from claimlab.functions import columns as X
from claimlab.operators import audit, cleaning, summaries
from claimlab.operators import cells as C
from claimlab.operators.distributions import pivot_summary, report_incident_matrix
from claimlab.schema import CLAIMS_SCHEMA
from claimlab.sources.claims_csv import malformed_lines, read_claims_csv


@pytest.mark.parametrize(
    "text, value",
    [("12", 12.0), (" -1.5e2 ", -150.0), (".5", 0.5), ("3.", 3.0), ("\t7\n", 7.0)]
    + [(t, None) for t in ("0x1p3", "1d", "nan", "Infinity", "1,2", "", " ", "1 2", "e5", "--1")],
)
def test_number_takes_plain_decimals_only(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(X.number(F.col("t"))).first()[0]
    assert got == value


def test_codes_lose_white_space_of_any_kind(spark):
    rows = [("\tJ ",), ("\u00a0s\u2003",), (" \n",), ("nan",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.code_string(F.col("t"))).collect()]
    assert got == ["J", "S", None, None]


def _write(folder, lines):
    (folder / "claims.csv").write_text("\n".join(lines) + "\n")
    return str(folder / "claims.csv")


def test_reader_goes_by_header_name(spark, tmp_path):
    path = _write(tmp_path, ["PAYMENT,PRACTNUM,extra,SEQNO,NPMALRPT", '"$1,234",9.0,x,1,2.0', ",12,y,2,bad"])
    rows = read_claims_csv(spark, path).orderBy("SEQNO").collect()
    assert rows[0].asDict().keys() == {f.name for f in CLAIMS_SCHEMA}
    assert (rows[0].PRACTNUM, rows[0].NPMALRPT, rows[0].PAYMENT, rows[0].RECTYPE) == (9, 2, "$1,234", None)
    assert (rows[1].PRACTNUM, rows[1].NPMALRPT, rows[1].PAYMENT) == (12, None, None)
    text = read_claims_csv(spark, path, typed=False)
    found = {r.column: r for r in audit.type_conformity(text).collect()}
    assert (found["NPMALRPT"].invalid_values, found["NPMALRPT"].status) == (1, "ISSUE")
    assert found["PRACTNUM"].status == found["PAYMENT"].status == "OK"
    clean = cleaning.clean_claims(text).orderBy("SEQNO").collect()
    assert [(r.PRACTNUM, r.PAYMENT) for r in clean] == [(9, 1234.0), (12, None)]


def test_conformity_and_cleaning_agree(spark):
    values = ["1d", "nan", "Infinity", "0x1p3", "5", " ", None, "$3"]
    frame = spark.createDataFrame([(v, v) for v in values], "PTAGE string, PAYMENT string")
    found = {r.column: r.invalid_values for r in audit.type_conformity(frame).collect()}
    assert found == {"PTAGE": 5, "PAYMENT": 4}


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_spread_of_large_close_values(spark, keys):
    rows = [("a", 1e9 + i) for i in range(3)] + ([("b", 5.0), (None, 1.0), (None, 3.0)] if keys else [])
    frame = spark.createDataFrame(rows, "g string, v double")
    got = C.group_stats(frame, keys, "v", {"std": C.stddev(), "n": C.valued()}, {"median": 0.5}).collect()
    by_key = {r["g"] if keys else None: r for r in got}
    assert by_key["a" if keys else None]["std"] == pytest.approx(1.0)
    assert by_key["a" if keys else None]["median"] == 1e9 + 1
    if keys:
        assert by_key["b"]["std"] is None and by_key[None]["std"] == pytest.approx(math.sqrt(2))


def test_nan_is_missing(spark):
    frame = spark.createDataFrame([(v,) for v in (5.0, -3.0, math.nan, 0.0, 7.0)], "v double")
    got = C.group_stats(frame, [], "v", {"n": C.valued(), "mean": C.mean()}, {"median": 0.5}).first()
    assert (got["n"], got["mean"], got["median"]) == (4, 2.25, 2.5)


def test_small_values_spread_over_buckets(spark):
    frame = spark.range(100_000).select((F.col("id") * 1e-9).alias("v"))
    share = frame.groupBy(C.bucket_of(F.col("v"))).count().agg(F.max("count")).first()[0]
    assert share < 200
    signed = [-5.0, -1e-300, -1e-310, 0.0, 1e-310, 2e-3, 2.1e-3, 1.0, 1e300]
    order = spark.createDataFrame([(v,) for v in signed], "v double").select("v", C.bucket_of(F.col("v")).alias("b")).collect()
    assert [r.b for r in order] == sorted(r.b for r in order) and order[3].b == 0
    values = [r.v for r in frame.limit(1001).collect()]
    got = C.group_stats(frame.limit(1001), [], "v", {}, {"q": 0.5}).first()["q"]
    assert got == pytest.approx(statistics.median(values))


def test_annual_trend_uses_the_factors_of_the_frame(spark):
    rows = [(2020, 100.0, 3.0), (2020, 300.0, 3.0)]
    frame = spark.createDataFrame(rows, "ORIGYEAR int, PAYMENT double, CPI_FACTOR double")
    got = summaries.annual_trend(frame).first()
    assert (got.mean_adj, got.total_adj, got.median_adj) == (600.0, 1200.0, 600.0)


def test_report_incident_matrix(spark):
    rows = [("2000-2009", "1990-1999", 5.0, 10), ("2000-2009", "2000-2009", 7.0, 9), ("2010-2019", "3990-3999", 1.0, 50)]
    long = spark.createDataFrame(rows, "PERIOD_10Y string, MAL_PERIOD_10Y string, mean_payment_adj double, count long")
    got = report_incident_matrix(long).collect()
    assert len(got) == 1 and got[0]["1990-1999"] == 5.0 and got[0]["2000-2009"] is None
    assert pivot_summary(long, "PERIOD_10Y", "MAL_PERIOD_10Y", "count", ["3990-3999"]).count() == 2


def test_files_with_their_own_headers(spark, tmp_path):
    """Column order, missing and unknown columns differ by file; lines with a wrong number of cells are kept apart."""
    (tmp_path / "a.csv").write_text('SEQNO,RECTYPE,PAYMENT\n1,M,"$1,000"\n2,P,$5,extra\n3\n')
    (tmp_path / "b part.csv").write_text("PAYMENT,OTHER,SEQNO\n$7,x,4\n,y,5\n")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "c.csv").write_text("RECTYPE,SEQNO\r\nA,6\r\n")
    (tmp_path / "more" / "d.csv").write_text("RECTYPE,SEQNO\n")
    rows = read_claims_csv(spark, str(tmp_path)).select("SEQNO", "RECTYPE", "PAYMENT").collect()
    assert sorted(map(tuple, rows)) == [(1, "M", "$1,000"), (4, None, "$7"), (5, None, None), (6, "A", None)]
    assert sorted(r.SEQNO for r in read_claims_csv(spark, str(tmp_path)).select("SEQNO").collect()) == [1, 4, 5, 6]
    bad = malformed_lines(spark, str(tmp_path)).collect()
    assert sorted(r.line for r in bad) == ["2,P,$5,extra", "3"] and all(r.file.endswith("a.csv") for r in bad)
    (tmp_path / "more" / "e.csv").write_text("SEQNO,SEQNO\n1,2\n")
    with pytest.raises(ValueError):
        read_claims_csv(spark, str(tmp_path))
