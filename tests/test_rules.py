"""Edge rules on small hand-made frames."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlab.functions import columns as X
from claimlab.functions import labels as L
from claimlab.functions import shares as S
from claimlab.operators import audit, cleaning, distributions, features, linkage, practitioners, summaries
from claimlab.operators import cells as C
from claimlab.schema import CLAIMS_SCHEMA
from claimlab.sources.claims_csv import read_claims_csv
from claimlab.sources.sample_claims import sample_claims


def values(df, column=None):
    return [row[column or 0] for row in df.collect()]


def test_currency(spark):
    texts = ["$3500", "$1,234", "", "nan", "abc", None, "1d", "Infinity", " $7 "]
    df = spark.createDataFrame([(t,) for t in texts], "PAYMENT string")
    assert values(cleaning.clean_currency(df)) == [3500.0, 1234.0, None, None, None, None, None, None, 7.0]


def test_numbers_and_white_space_follow_the_patterns(spark):
    """The expressions without regular expressions against the rules written as such."""
    cells = ["1", "-2.5", "+.5", "5.", "1e3", "1E-2", ".", "", "e5", "1d", "2F", "0x1p3", "0X5", "NaN", "inf", "-Infinity", "1_0", "1 2", "--1"]
    cells += ["\u0661", "\x1c5", "5\x00", "\x075\x07", "1e400", "1e-400", "12345678901234567890", "1,5", "$3", "1e", "1e+", "abc", None]
    cells += [f"{a}7{b}" for a in ["\xa0", "\u3000", "\u2003\t", "\x85"] for b in ["", " \n", "\u2028"]] + ["a\u00a0", "\u200b1", "\x1f"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    plain = F.regexp_replace("c", r"(?U)^\s+|\s+$", "")
    wanted = F.when(F.rlike(plain, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), plain.try_cast("double"))
    rows = df.select("c", plain.alias("p"), X.stripped(F.col("c")).alias("q"), wanted.alias("a"), X.number(F.col("c")).alias("b")).collect()
    assert [(r.c, r.p, r.a) for r in rows] == [(r.c, r.q, r.b) for r in rows]


def test_coded_integers_round_half_to_even(spark):
    df = spark.createDataFrame([("2.5",), ("3.5",), ("-1.5",), ("x",), (None,), ("nan",)], "GRAD string")
    assert values(cleaning.clean_coded_integers(df)) == [2, 4, -2, None, None, None]


def test_action_length_keeps_decimals(spark):
    df = spark.createDataFrame([("0.5",), ("2",)], "AALENGTH string")
    assert values(cleaning.clean_claims(df)) == [0.5, 2.0]


def test_code_strings(spark):
    df = spark.createDataFrame([(" j ",), ("NaN",), ("none",), ("",), (None,)], "PAYTYPE string")
    assert values(cleaning.clean_code_strings(df)) == ["J", None, None, None, None]


def test_state_fallback(spark):
    rows = [("wi", "MN", "IA"), (None, " mn ", "IA"), (None, None, "ia"), (None, None, None), ("", "MN", "IA")]
    df = spark.createDataFrame(rows, "WORKSTAT string, LICNSTAT string, HOMESTAT string")
    assert values(features.with_state(df), "STATE") == ["WI", "MN", "IA", None, None]


def test_periods(spark):
    df = spark.createDataFrame([(y,) for y in (1990, 1994, 1995, 3999, -3, None)], "y int")
    labels = ["1990-1994", "1990-1994", "1995-1999", "3995-3999", "-5--1", None]
    assert values(df.select(X.period_label(F.col("y"), 5))) == labels


def test_cpi_and_logs(spark):
    rows = [(1989, 10.0), (1990, 100.0), (2025, 100.0), (2026, 10.0), (1990, 0.0), (1990, -5.0)]
    df = features.with_adjusted_amounts(spark.createDataFrame(rows, "ORIGYEAR int, PAYMENT double"))
    adjusted = values(df, "PAYMENT_ADJ")
    assert [a is None for a in adjusted] == [True, False, False, True, False, False]
    assert [a for a in adjusted if a is not None] == pytest.approx([232.0, 95.0, 0.0, -11.6])
    assert values(df, "LOG_PAYMENT_ADJ")[1] == pytest.approx(math.log(232.0))
    assert values(df, "LOG_PAYMENT_ADJ")[4:] == [None, None]


def test_valid_lag_bounds(spark):
    rows = [(2000, 2001), (2000, 2000), (2000, 1950), (2000, 1949), (2000, None)]
    schema = "ORIGYEAR int, MALYEAR1 int, PAYMENT_ADJ double, STATE string, ALGNNATR int, OUTCOME int"
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], schema)
    flagged = features.with_lag_and_flags(df)
    assert values(flagged, "VALID_LAG") == [False, True, True, False, None]
    assert values(flagged, "CATASTROPHIC") == [False] * 5


def test_shares_ignore_null_parent(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), (None, "x", 6)], "parent string, g string, count int")
    out = {(r.parent, r.g): r.p for r in df.withColumn("p", S.share_within("count", ["parent"])).collect()}
    assert out == {("a", "x"): 75.0, ("a", "y"): 25.0, (None, "x"): None}
    assert sum(values(df.select(S.share_of_total("count", None)))) == pytest.approx(100)


def test_group_stats_null_rules(spark):
    rows = [("a", 1.0, True), ("a", 2.0, None), ("a", None, False), ("b", None, None), (None, 4.0, True)]
    df = spark.createDataFrame(rows, "k string, v double, f boolean")
    measures = {"n": C.rows(), "valued": C.valued(), "total": C.total(), "mean": C.mean(), "share": C.share("f")}
    out = {r.k: tuple(r)[1:] for r in C.group_stats(df, ["k"], "v", measures, {"m": 0.5}, ["f"]).collect()}
    assert out == {
        "a": (3, 2, 3.0, 1.5, 0.5, 1.5),
        "b": (1, 0, 0.0, None, None, None),
        None: (1, 1, 4.0, 4.0, 1.0, 4.0),
    }


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_match_plain_percentiles_with_a_hot_group(spark, keys):
    """One group holds most rows, with ties, negatives, tiny and huge values and nulls."""
    n = F.col("id")
    df = spark.range(30000).select(
        F.when(n % 10 < 7, "hot").when(n % 10 < 9, "warm").alias("g"),
        F.when(n % 97 == 0, None)
        .when(n % 5 == 0, F.lit(100.0))
        .when(n % 7 == 0, -(n * 13 % 1009).cast("double"))
        .when(n % 11 == 0, F.exp(n % 50))
        .otherwise((n * 7919 % 10007) / 64)
        .alias("v"),
    )
    points = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    plain = df.groupBy(*keys).agg(
        F.stddev_samp("v").alias("sd"), *[F.percentile("v", F.lit(p)).alias(k) for k, p in points.items()]
    )
    ours = C.group_stats(df, keys, "v", {"sd": C.stddev()}, points).select(*plain.columns)
    left = sorted(ours.collect(), key=lambda r: str(r[0]))
    right = sorted(plain.collect(), key=lambda r: str(r[0]))
    assert len(left) == len(right)
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            assert x == y or x == pytest.approx(y, rel=1e-9)


def test_running_totals(spark):
    df = spark.createDataFrame([(float(v), v % 3 + 1) for v in range(-20, 200)], f"{C.VALUE} double, n long")
    rows = sorted(C.running_totals(df, ["n"]).collect())
    before = 0
    for row in rows:
        assert row["n_before"] == before
        before += row["n"]
    assert {r["n_all"] for r in rows} == {before}


def test_right_closed_brackets(spark):
    df = spark.createDataFrame([(0.0,), (25000.0,), (25000.01,), (5e6,), (5000001.0,), (None,)], "x double")
    labels = [None, "<$25K", "$25-50K", "$2-5M", ">$5M", None]
    assert values(df.select(features.payment_bracket(F.col("x")))) == labels


def test_left_closed_bands(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,), (6,), (41,), (None,)], "x int")
    banded = df.select(X.bin_left_closed(F.col("x"), features.EXPERIENCE_EDGES, features.EXPERIENCE_LABELS))
    assert values(banded) == [None, "0-5", "0-5", "6-10", "41+", None]


def test_moving_average_needs_all_five(spark):
    df = spark.createDataFrame([(y, float(y)) for y in range(7)], "y int, v double")
    out = {r.y: r.a for r in df.withColumn("a", S.centred_average("v", "y")).collect()}
    assert out == {0: None, 1: None, 2: 2.0, 3: 3.0, 4: 4.0, 5: None, 6: None}


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (2.0,), (None,), (None,), (None,)], "v double")
    assert distributions.centre_and_spread(df, "v").first()["mode"] == 1.0


def _episode_rows(spark, rows):
    schema = (
        "SEQNO long, PRACTNUM long, STATE string, MALYEAR1 int, MALYEAR2 int, ALGNNATR int, PAYTYPE_STR string, "
        "REPTYPE int, ORIGYEAR int, PAYMENT_ADJ double, TOTALPMT_ADJ double"
    )
    return spark.createDataFrame(rows, schema)


def test_episodes_keep_missing_apart_from_code_na(spark):
    rows = [
        (1, 7, None, 2000, None, 1, "S", 301, 2001, 10.0, None),
        (2, 7, "NA", 2000, None, 1, "S", 301, 2001, 20.0, None),
        (3, None, None, None, None, None, None, 301, 2001, 5.0, None),
        (4, None, None, None, None, None, None, 102, 2004, None, None),
        (5, 8, "WI", 2000, None, 1, "S", 301, 2001, 1.0, 2.0),
        (6, 8, "WI", 2000, None, 1, "S", 301, 2005, 1.0, 2.0),
    ]
    df = _episode_rows(spark, rows)
    episodes = linkage.payment_episodes(df).collect()
    assert len(episodes) == 4
    by_size = {(e["payment_sum_adj"], e["record_count"]): e for e in episodes}
    unknown = by_size[(5.0, 2)]
    assert unknown["practitioner_count"] == 0 and unknown["reptype_count"] == 2
    assert unknown["origyear_span"] == 3 and not unknown["ambiguous_episode"]
    assert by_size[(2.0, 2)]["ambiguous_episode"] and not by_size[(2.0, 2)]["reconstruction_eligible"]
    best = {r["SEQNO"]: (r["TOTALPMT_BEST"], r["TOTALPMT_SOURCE"]) for r in linkage.with_best_total(df).collect()}
    assert best[1] == (10.0, "reconstructed") and best[2] == (20.0, "reconstructed")
    assert best[4] == (5.0, "reconstructed") and best[5] == (2.0, "observed")
    sources = {source for _, source in best.values()}
    assert len(best) == len(rows) and sources <= {"observed", "reconstructed", "unresolved"}


def test_unknown_tier_is_refused(spark):
    with pytest.raises(ValueError):
        linkage.payment_episodes(_episode_rows(spark, []), "loose")


def test_validation_limits_and_empty_input(spark):
    schema = "payment_sum_adj double, totalpmt_max_adj double, totalpmt_non_null long, ambiguous_episode boolean"
    rows = [(110.0, 100.0, 1, False), (125.0, 100.0, 1, False), (5.0, 0.0, 1, True), (5.0, None, 0, False)]
    checked = linkage.validate_episodes(spark.createDataFrame(rows, schema))
    assert values(checked, "within_10pct") == [True, False, False]
    assert values(checked, "within_25pct") == [True, True, False]
    metrics = linkage.validation_metrics(checked).first()
    assert metrics["episodes_validated"] == 3 and metrics["share_within_10pct"] == pytest.approx(1 / 3)
    empty = linkage.validate_episodes(spark.createDataFrame([], schema))
    assert linkage.validation_metrics(empty).count() == 0


def test_profile_classes_later_rule_wins(spark):
    rows = [(5, 0, 10.0), (3, 1, 2e6), (3, 5, 2e6), (4, 5, 2e6), (2, 4, 10.0)]
    df = spark.createDataFrame(rows, "report_count long, years_spanned int, mean_payment_adj double")
    assert values(practitioners.classify_profiles(df), "practitioner_profile") == [
        "Batch Reporter", "Batch Reporter", "Catastrophic Event", "Chronic Repeater", "Moderate Repeater",
    ]


def test_state_pairs(spark):
    rows = [(1, "WI"), (1, "MN"), (1, "MN"), (1, "IA"), (2, "WI"), (2, "MN"), (3, "WI"), (4, None), (4, "OH")]
    pairs = practitioners.state_pairs(spark.createDataFrame(rows, "PRACTNUM long, STATE string"))
    assert [tuple(r) for r in pairs.collect()] == [("MN", "WI", 2), ("IA", "MN", 1), ("IA", "WI", 1)]


def test_rank_sums_against_all_pairs(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 9.0], [2.0, 2.0, 3.0, 9.0, 9.0, 10.0]
    df = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b], "v double, first boolean")
    cells = C.amount_cells(df, ["first"], "v")
    one = distributions.rank_sums(cells, F.col("first"), ~F.col("first")).first()
    two = distributions.rank_sums(cells, ~F.col("first"), F.col("first")).first()
    brute = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert one["u_1"] == brute and one["u_1"] + two["u_1"] == len(a) * len(b)


def test_mann_whitney_without_judgments(spark):
    df = spark.createDataFrame([("S", "S", 1.0), ("S", "S", 2.0)], "PAYTYPE string, PAYTYPE_STR string, PAYMENT double")
    row = distributions.mann_whitney(df).first()
    assert (row["settlement_n"], row["judgment_n"], row["u_statistic"], row["p_value"]) == (2, 0, None, None)


def test_exceedance_curve_is_non_increasing(spark):
    df = spark.range(1, 500).select((F.col("id") * 37 % 101).cast("double").alias("v"))
    curve = [r["exceedance_pct"] for r in sorted(distributions.exceedance_curve(df, "v").collect())]
    assert all(a >= b for a, b in zip(curve, curve[1:])) and curve[-1] == 0


def test_column_profile_ignores_unknown_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    rows = [tuple(r) for r in audit.column_profile(df, ["y", "x", "z"]).collect()]
    assert rows == [("y", "string", 1, 2, 66.67, 1), ("x", "int", 3, 0, 0.0, 2)]


def test_label_tables(spark):
    df = spark.createDataFrame([(603,), (11,)], "LICNFELD int")
    assert values(L.with_label(df, "LICNFELD", "license_field", "label"), "label") == ["Chiropractor", None]
    assert len(L.CPI_FACTORS) == 36


def test_csv_reader(spark, tmp_path):
    header = ",".join(f.name for f in CLAIMS_SCHEMA)
    cells = {"SEQNO": "1", "RECTYPE": "P", "ORIGYEAR": "2005", "PAYMENT": '"$1,000"', "TOTALPMT": "$3500", "PRACTNUM": "9"}
    line = ",".join(cells.get(f.name, "") for f in CLAIMS_SCHEMA)
    (tmp_path / "claims.csv").write_text(f"{header}\n{line}\n")
    df = read_claims_csv(spark, str(tmp_path / "claims.csv"))
    assert df.schema == T.StructType(CLAIMS_SCHEMA.fields)
    row = cleaning.clean_claims(df).first()
    assert (row["PAYMENT"], row["TOTALPMT"], row["PRACTNUM"], row["OUTCOME"]) == (1000.0, 3500.0, 9, None)


def test_payment_modes(spark):
    rows = [("M", "S"), ("P", " s"), ("P", "M"), ("P", "X"), ("P", None)]
    df = features.with_payment_mode(spark.createDataFrame(rows, "RECTYPE string, PAYNUMBR string"))
    assert values(df, "PAYMENT_MODE") == [
        "Unavailable Pre-2004", "Single Payment", "Multiple Payments", "Unknown Payment Mode", "Unknown Payment Mode",
    ]


def test_linkage_accounts_for_every_report(spark, sf_dir):
    from claimlab.plans.base import Claims

    claims = Claims(spark, sf_dir)
    total = claims.feat.count()
    assert claims.linked.count() == total
    for tier in ("strict", "moderate", "exploratory"):
        episodes = linkage.payment_episodes(claims.feat, tier)
        assert episodes.agg(F.sum("record_count")).first()[0] == total
    summary = summaries.period_summary(claims.feat, "PERIOD_10Y", digits=None)
    assert summary.agg(F.sum("pct")).first()[0] == pytest.approx(100)


@pytest.mark.parametrize("error", [0.05, 0.01])
def test_sketched_profile_differs_in_distinct_counts_only_and_little(spark, error):
    df = spark.range(60_000).selectExpr("id", "id % 7 AS few", "IF(id % 3 = 0, NULL, id % 20000) AS some", "CAST(NULL AS STRING) AS none")
    exact = {r.column: r for r in audit.column_profile(df).collect()}
    found = {r.column: r for r in audit.column_profile(df, distinct_error=error).collect()}
    assert audit.column_profile(df, distinct_error=error).schema.names == audit.column_profile(df).schema.names
    assert found.keys() == exact.keys() == {"id", "few", "some", "none"}
    for column, row in found.items():
        assert row[1:5] == exact[column][1:5]
        assert abs(row.nunique - exact[column].nunique) <= 4 * error * exact[column].nunique
    assert found["none"].nunique == 0
    empty = audit.column_profile(df.limit(0), distinct_error=error).collect()
    assert {(r.column, r.non_null, r.null_count, r.nunique) for r in empty} == {(c, 0, 0, 0) for c in exact}


def test_aligned_summaries(spark):
    """Absent keys and null values are filled, null keys meet, clashing names are an error, empty tables stay whole."""
    counts = spark.createDataFrame([(1, 10), (2, 20), (None, 3)], "y int, n long")
    dollars = spark.createDataFrame([(1, 5.0), (None, 7.0), (9, 1.0)], "y int, d double")
    assert {(r.y, r.n, r.d) for r in S.aligned(counts, dollars, ["y"]).collect()} == {(1, 10, 5.0), (2, 20, 0.0), (None, 3, 7.0)}
    assert {r.d for r in S.aligned(counts, dollars.limit(0), ["y"]).collect()} == {0.0}
    assert S.aligned(counts.limit(0), dollars, ["y"]).collect() == []
    with pytest.raises(ValueError):
        S.aligned(counts, counts, ["y"])
    over = spark.createDataFrame([(1, 6.0), (2, 1.0), (3, 4.0)], "y int, d double")
    under = spark.createDataFrame([(1, 3.0), (3, 0.0), (4, 1.0)], "y int, d double")
    assert {(r.y, r.ratio) for r in S.aligned_ratio(over, under, ["y"], "d").collect()} == {(1, 2.0), (3, None)}


def test_large_groups(spark):
    summary = spark.createDataFrame([("a", 999), ("b", 1000), (None, 2000), ("c", None)], "k string, count long")
    assert {r.k for r in S.large_groups(summary, 1000).collect()} == {"b", None}
    assert S.large_groups(summary.limit(0), 1).collect() == []


def test_sample_has_every_column_and_values_that_cleaning_refuses(spark, sf_dir):
    claims = sample_claims(spark, sf_dir)
    assert claims.columns == CLAIMS_SCHEMA.names
    invalid = {r.column: r.invalid_values for r in audit.type_conformity(claims).collect()}
    refused = {column for column, count in invalid.items() if count}
    assert refused == {"PRACTAGE", "ALEGATN2", "TOTALPMT", "NUMBPRSN", "AACLASS1", "AALENGTH", "FUNDPYMT"}
