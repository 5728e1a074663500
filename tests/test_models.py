"""Models on generated data with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from claimlab.operators import models as M


def test_metrics_against_hand_count(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.2), (0, 0.1)]
    got = M.classifier_metrics(spark.createDataFrame(rows, "label int, score double")).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap = 1 / 3 * 1 + 1 / 3 * (2 / 3) + 1 / 3 * (3 / 5)
    assert got["roc_auc"] == pytest.approx(auc) and got["average_precision"] == pytest.approx(ap)
    assert got["test_rows"] == len(rows)


def _regression_frame(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        a, b = "12"[i % 2], "ABC"[i % 3]
        mean = 0.5 + (1.0 if a == "2" else 0) + {"A": 0, "B": -0.5, "C": 0.25}[b]
        rows.append((a, b, mean + rng.gauss(0, 0.3), math.exp(mean) * rng.gammavariate(4, 0.25)))
    return spark.createDataFrame(rows, "OUTCOME string, STATE string, LOG_PAYMENT_ADJ double, PAYMENT_ADJ double")


@pytest.mark.parametrize("fit", [M.log_payment_model, M.gamma_payment_model])
def test_regressions_recover_coefficients(spark, fit):
    table = {r["term"]: r["coef"] for r in fit(_regression_frame(spark), ["OUTCOME", "STATE"]).collect()}
    assert table == {
        "OUTCOME_2": pytest.approx(1.0, abs=0.1),
        "STATE_B": pytest.approx(-0.5, abs=0.1),
        "STATE_C": pytest.approx(0.25, abs=0.1),
        "Intercept": pytest.approx(0.5, abs=0.1),
    }


def test_severity_fits_rank_the_true_distribution_first(spark):
    rng = random.Random(5)
    weibull = [rng.weibullvariate(1000.0, 0.7) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in weibull], "PAYMENT_ADJ double")
    fits = {r["distribution"]: r for r in M.fit_severity_distributions(df).collect()}
    assert min(fits.values(), key=lambda r: r["aic"])["distribution"] == "weibull"
    assert fits["weibull"]["shape"] == pytest.approx(0.7, rel=0.05)
    assert fits["weibull"]["scale"] == pytest.approx(1000.0, rel=0.07)
    mean = sum(weibull) / len(weibull)
    assert fits["exponential"]["scale"] == pytest.approx(mean)
    logs = [math.log(v) for v in weibull]
    mu = sum(logs) / len(logs)
    sigma = math.sqrt(sum((x - mu) ** 2 for x in logs) / len(logs))
    assert fits["lognormal"]["shape"] == pytest.approx(sigma)
    assert M.fit_severity_distributions(df.filter("PAYMENT_ADJ < 0")).count() == 0


def test_classifier_finds_signal_and_split_is_stable(spark):
    df = spark.range(1, 4001).select(
        F.col("id").alias("SEQNO"),
        F.when(F.col("id") % 50 != 0, (F.col("id") * 7 % 10).cast("int")).alias("OUTCOME"),
        F.when(F.col("id") % 3 == 0, "WI").when(F.col("id") % 3 == 1, "MN").alias("STATE"),
        ((F.col("id") * 7 % 10 > 7) & (F.col("id") % 3 != 2)).alias("CATASTROPHIC"),
    )
    _, scored = M.fit_catastrophic_classifier(df, ["OUTCOME", "STATE"])
    metrics = M.classifier_metrics(scored).first()
    assert metrics["roc_auc"] > 0.9
    train, test = M.split_rows(df)
    assert train.count() + test.count() == 4000 and metrics["test_rows"] == test.count()
    assert 0.22 < test.count() / 4000 < 0.28
