"""Queries over descriptive statistics, shape tables, rank tests and models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from claimlab.functions import labels as L
from claimlab.functions.columns import ERFC_COEFFICIENTS
from claimlab.operators import distributions as D
from claimlab.operators import features
from claimlab.operators import models as M
from claimlab.operators import summaries as A
from claimlab.plans.base import Query, case_sql
from claimlab.plans.source_queries import BRACKET_SQL

_POINTS = {f"{p * 100:g}%": p for p in D.DESCRIBE_PERCENTILES}


def _describe_sql(column: str, source: str) -> str:
    points = ", ".join(f'quantile_cont({column}, {p}) AS "{name}"' for name, p in _POINTS.items())
    return f"""UNPIVOT (SELECT CAST(count({column}) AS DOUBLE) AS count, avg({column}) AS mean, stddev_samp({column}) AS std,
      min({column}) AS min, max({column}) AS max, {points} FROM {source}) ON COLUMNS(*) INTO NAME metric VALUE value"""


def _histogram_sql(value: str, where: str, bins: int) -> str:
    return f"""WITH vals AS (SELECT {value} AS v FROM feat WHERE {where}),
    bounds AS (SELECT min(v) AS low, max(v) AS high FROM vals),
    binned AS (SELECT CAST(least(floor((v - low) / (high - low) * {bins}), {bins - 1}) AS BIGINT) AS bin, count(*) AS n
      FROM vals, bounds GROUP BY 1);;
    SELECT CAST(r.bin AS BIGINT) AS bin, coalesce(n, 0) AS count FROM range({bins}) AS r(bin) LEFT JOIN binned AS b ON r.bin = b.bin"""


def _erfc_sql(x: str) -> str:
    poly = str(ERFC_COEFFICIENTS[-1])
    for coefficient in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"({coefficient} + t * {poly})"
    return f"t * exp(-({x}) * ({x}) + {poly})"


_MANN_WHITNEY_SQL = f"""WITH paid AS (SELECT PAYMENT, PAYTYPE = 'J' AS judged FROM feat WHERE PAYTYPE IS NOT NULL AND PAYMENT IS NOT NULL),
ties AS (SELECT PAYMENT, count(*) AS t, count(*) FILTER (WHERE NOT judged) AS a FROM paid GROUP BY PAYMENT),
ranked AS (SELECT *, sum(t) OVER (ORDER BY PAYMENT ROWS UNBOUNDED PRECEDING) - t + (t + 1) / 2.0 AS mid_rank FROM ties),
sums AS (SELECT CAST(sum(a) AS DOUBLE) AS n1, CAST(sum(t - a) AS DOUBLE) AS n2,
  CAST(sum(a * mid_rank) AS DOUBLE) - CAST(sum(a) AS DOUBLE) * (CAST(sum(a) AS DOUBLE) + 1) / 2 AS u,
  sum(CAST(t AS DOUBLE) * t * t - t) AS tie_term FROM ranked),
scored AS (SELECT *, greatest(abs(u - n1 * n2 / 2) - 0.5, 0)
  / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - tie_term / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM sums),
tail AS (SELECT *, 1 / (1 + 0.5 * (z / sqrt(2))) AS t FROM scored);;
SELECT CAST(n1 AS BIGINT) AS settlement_n, CAST(n2 AS BIGINT) AS judgment_n, u AS u_statistic, z,
  {_erfc_sql('z / sqrt(2)')} AS p_value,
  (SELECT median(PAYMENT) FROM paid WHERE NOT judged) AS settlement_median,
  (SELECT median(PAYMENT) FROM paid WHERE judged) AS judgment_median FROM tail"""


def _box_sql(group: str, column: str, where: str = "true") -> str:
    return f"""WITH quartiles AS (SELECT {group}, count({column}) AS count, quantile_cont({column}, 0.25) AS q1,
      median({column}) AS median, quantile_cont({column}, 0.75) AS q3 FROM feat WHERE {group} IS NOT NULL AND {where} GROUP BY {group});;
    SELECT q.{group}, any_value(count) AS count, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
      min({column}) FILTER (WHERE {column} >= q1 - 1.5 * (q3 - q1) AND {column} <= q3 + 1.5 * (q3 - q1)) AS lower_whisker,
      max({column}) FILTER (WHERE {column} >= q1 - 1.5 * (q3 - q1) AND {column} <= q3 + 1.5 * (q3 - q1)) AS upper_whisker
    FROM quartiles AS q JOIN feat AS f ON q.{group} = f.{group} WHERE {where.replace('LAG_YEARS', 'f.LAG_YEARS')} GROUP BY q.{group}"""


BOX_R4 = "q1 median q3 lower_whisker upper_whisker"
_SEVERITY_WHERE = " AND ".join(f"{c} IS NOT NULL" for c in M.SEVERITY_COLUMNS) + " AND PAYMENT_ADJ > 0"
_BUCKET_SQL = "CAST(SEQNO % 2147483648 AS BIGINT) * 2654435761 % 4294967296 / 4294967296.0"


def _split_counts(c):
    part = F.when(M.is_test_row(), "test").otherwise("train")
    return c.new.groupBy(part.alias("part"), "CATASTROPHIC").agg(F.count(F.lit(1)).alias("rows"))


def _severity_score(c):
    """Injury severity as a plain score for catastrophic payments, on the test rows."""
    _, test = M.split_rows(features.complete_cases(c.new, ["OUTCOME", "PRACTAGE"]))
    score = (F.col("OUTCOME") * 100 + F.col("PRACTAGE")).cast("double") / 1100
    return M.classifier_metrics(test.select(F.col("CATASTROPHIC").cast("int").alias("label"), score.alias("score")))


_SCORE_SQL = f"""WITH scored AS (SELECT CAST(CATASTROPHIC AS INTEGER) AS label, (OUTCOME * 100 + PRACTAGE) / 1100.0 AS score FROM p_feat
  WHERE OUTCOME IS NOT NULL AND PRACTAGE IS NOT NULL AND {_BUCKET_SQL} < 0.25),
steps AS (SELECT score, sum(label) AS hits, count(*) - sum(label) AS misses FROM scored GROUP BY score),
ranked AS (SELECT *, sum(hits) OVER w AS hits_here, sum(misses) OVER w AS misses_here, sum(hits) OVER () AS p, sum(misses) OVER () AS n
  FROM steps WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING));;
SELECT CAST(sum(misses * (hits_here - hits / 2.0)) AS DOUBLE) / CAST(any_value(p) * any_value(n) AS DOUBLE) AS roc_auc,
  sum(CAST(hits AS DOUBLE) * CAST(hits_here AS DOUBLE) / CAST(hits_here + misses_here AS DOUBLE)) / any_value(p) AS average_precision,
  CAST(sum(hits + misses) AS BIGINT) AS test_rows FROM ranked"""


def _model_input(c):
    return M.model_frame(M.severity_frame(c.new), ["SEQNO", "OUTCOME", "STATE", "PAYMENT_ADJ"])


def _preprocessed(c):
    """Imputed, scaled and encoded training rows, reduced to their dimension and column means."""
    frame = M.model_frame(c.new, ["OUTCOME", "LAG_YEARS", "RESOLUTION_BINARY"])
    names = ["OUTCOME", "LAG_YEARS", "RESOLUTION_BINARY"]
    filled = frame.na.fill(M.fill_missing(frame, names))
    data = M.preprocessing(filled, names).fit(filled).transform(filled)
    scaled, hot = vector_to_array("_scaled"), vector_to_array("RESOLUTION_BINARY_hot")
    return data.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("OUTCOME").alias("outcome_sum"),
        F.sum("LAG_YEARS").alias("lag_sum"),
        *[F.sum(scaled[i]).alias(f"scaled_sum_{i}") for i in (0, 1)],
        *[F.sum(scaled[i] * scaled[i]).alias(f"scaled_squares_{i}") for i in (0, 1)],
        F.sum(scaled[0] * scaled[1]).alias("scaled_product"),
        *[F.sum(F.get(hot, F.lit(i))).alias(f"hot_{i}") for i in (0, 1, 2)],
    )


_PREPROCESSED_SQL = """WITH filled AS (
  SELECT CAST(coalesce(OUTCOME, (SELECT median(OUTCOME) FROM p_feat)) AS DOUBLE) AS o,
    CAST(coalesce(LAG_YEARS, (SELECT median(LAG_YEARS) FROM p_feat)) AS DOUBLE) AS l,
    coalesce(RESOLUTION_BINARY, (SELECT mode(RESOLUTION_BINARY) FROM p_feat)) AS r FROM p_feat),
codes AS (SELECT r, row_number() OVER (ORDER BY count(*) DESC, r) - 1 AS slot, CAST(count(*) AS DOUBLE) AS n FROM filled GROUP BY r);;
SELECT count(*) AS rows, sum(o) AS outcome_sum, sum(l) AS lag_sum, CAST(0 AS DOUBLE) AS scaled_sum_0, CAST(0 AS DOUBLE) AS scaled_sum_1,
  CAST(count(*) - 1 AS DOUBLE) AS scaled_squares_0, CAST(count(*) - 1 AS DOUBLE) AS scaled_squares_1,
  corr(o, l) * (count(*) - 1) AS scaled_product,
  (SELECT n FROM codes WHERE slot = 0) AS hot_0, (SELECT n FROM codes WHERE slot = 1) AS hot_1, (SELECT n FROM codes WHERE slot = 2) AS hot_2
FROM filled"""

_TERM_ROWS = " UNION ALL ".join(
    f"""SELECT '{t}' AS term, CAST({t} AS VARCHAR) AS level, count(*) AS rows, {{measure}} FROM p_feat
    WHERE {_SEVERITY_WHERE} GROUP BY {t}"""
    for t in M.SEVERITY_TERMS
)

#: Training rows with the missing lags filled, then a row for each slot of the classifier.
_EQUATIONS_SQL = f"""WITH train AS (SELECT *, CAST(CATASTROPHIC AS INTEGER) AS y FROM p_feat WHERE {_SEVERITY_WHERE} AND {_BUCKET_SQL} >= 0.25);;
SELECT slot, rows, CAST(positives AS BIGINT) AS positives, CAST(0 AS DOUBLE) AS residual FROM (
  SELECT 'STATE=' || STATE AS slot, count(*) AS rows, sum(y) AS positives FROM train GROUP BY STATE
  UNION ALL SELECT 'RESOLUTION_BINARY=' || RESOLUTION_BINARY, count(*), sum(y) FROM train GROUP BY RESOLUTION_BINARY
  UNION ALL SELECT unnest(['OUTCOME', 'PRACTAGE', 'LAG_YEARS', 'ALGNNATR', 'Intercept']), n, p
    FROM (SELECT count(*) AS n, sum(y) AS p FROM train) AS t) AS slots"""

_DIGAMMA_SQL = """(ln(x + 8) - 0.5 / (x + 8) - 1 / (12 * (x + 8) ** 2) + 1 / (120 * (x + 8) ** 4) - 1 / (252 * (x + 8) ** 6)
  - list_sum(list_transform(range(0, 8), lambda i: 1 / (x + i))))"""


def _bisected(name: str, start: str, slope: str) -> str:
    """A recursive table that halves (low, high) around the root of a falling function of `mid` and `x`, its exponential, 60 times."""
    return f"""{name} AS (
  SELECT 0 AS i, CAST({start[0]} AS DOUBLE) AS low, CAST({start[1]} AS DOUBLE) AS high FROM m
  UNION ALL
  SELECT i + 1, CASE WHEN slope > 0 THEN mid ELSE low END, CASE WHEN slope > 0 THEN high ELSE mid END FROM (
    SELECT i, low, high, mid, {slope} AS slope FROM (SELECT *, (low + high) / 2 AS mid, exp((low + high) / 2) AS x FROM {name}, m) AS halved
  ) AS tried WHERE i < 60
)"""


_POWERS = "list_transform(logs, lambda l: exp(x * (l - max_log)))"
_FITS_SQL = f"""WITH RECURSIVE paid AS (
  SELECT PAYMENT_ADJ AS v, ln(PAYMENT_ADJ) AS l, CAST(count(*) AS DOUBLE) AS n FROM feat
  WHERE PAYMENT_MODE = 'Single Payment' AND PAYMENT_ADJ > 0 GROUP BY PAYMENT_ADJ),
m AS (SELECT list(v ORDER BY v) AS vals, list(l ORDER BY v) AS logs, list(n ORDER BY v) AS counts, sum(n) AS total, sum(n * v) / sum(n) AS mean,
  sum(n * l) / sum(n) AS mean_log, sum(n * l * l) / sum(n) AS mean_log2, max(l) AS max_log FROM paid),
{_bisected('gamma_root', ('-20', '20'), f'mid - {_DIGAMMA_SQL} - ln(mean) + mean_log')},
{_bisected('weibull_root', ('ln(0.02)', 'ln(50)'), f'1 / x + mean_log - list_dot_product(counts, list_transform(list_zip({_POWERS}, logs), lambda p: p[1] * p[2])) / list_dot_product(counts, {_POWERS})')},
{_bisected('lomax_root', ('ln(mean) - 12', 'ln(mean) + 12'), '(total / list_dot_product(counts, list_transform(vals, lambda v: ln(1 + v / x))) + 1) * list_dot_product(counts, list_transform(vals, lambda v: v / (x + v))) - total')},
sigma AS (SELECT sqrt(mean_log2 - mean_log * mean_log) AS s FROM m),
gamma_fit AS (SELECT exp((low + high) / 2) AS k, mean / exp((low + high) / 2) AS theta FROM gamma_root, m WHERE i = 60),
weibull_fit AS (SELECT x AS k, ln(list_dot_product(counts, {_POWERS}) / total) + x * max_log AS log_power
  FROM (SELECT exp((low + high) / 2) AS x FROM weibull_root WHERE i = 60) AS w, m),
lomax_fit AS (SELECT x, list_dot_product(counts, list_transform(vals, lambda v: ln(1 + v / x))) AS t
  FROM (SELECT exp((low + high) / 2) AS x FROM lomax_root WHERE i = 60) AS w, m),
fits AS (
  SELECT 'exponential' AS distribution, CAST(NULL AS DOUBLE) AS shape, mean AS scale, -total * (ln(mean) + 1) AS log_likelihood, 1 AS free, total FROM m
  UNION ALL SELECT 'lognormal', s, exp(mean_log), -total * (mean_log + ln(s) + 0.5 * ln(2 * pi()) + 0.5), 2, total FROM m, sigma
  UNION ALL SELECT 'gamma', k, theta, total * ((k - 1) * mean_log - mean / theta - lgamma(k) - k * ln(theta)), 2, total FROM m, gamma_fit
  UNION ALL SELECT 'weibull', k, exp(log_power / k), total * (ln(k) - log_power + (k - 1) * mean_log - 1), 2, total FROM m, weibull_fit
  UNION ALL SELECT 'lomax', total / t, x, total * ln(total / t) - total * ln(x) - (total / t + 1) * t, 2, total FROM m, lomax_fit
);;
SELECT distribution, {{measures}} FROM (SELECT *, 2 * free - 2 * log_likelihood AS aic, ln(total) * free - 2 * log_likelihood AS bic FROM fits) AS f"""
_FIT_COLUMNS = ["shape", "scale", "log_likelihood", "aic", "bic"]
_FITS_SQL = _FITS_SQL.format(
    measures=", ".join(
        f"round({c} / pow(10, floor(log10(abs({c})))), 4) AS {c}, CAST(floor(log10(abs({c}))) AS INTEGER) AS {c}_exponent"
        for c in _FIT_COLUMNS
    )
)


def _four_digits(fits):
    """Every figure as a number between 1 and 10 with four decimals, and its power of ten."""
    power = {c: F.floor(F.log10(F.abs(F.col(c)))) for c in _FIT_COLUMNS}
    figures = [(F.round(F.col(c) / F.pow(F.lit(10.0), power[c]), 4)).alias(c) for c in _FIT_COLUMNS]
    return fits.select("distribution", *figures, *[power[c].cast("int").alias(f"{c}_exponent") for c in _FIT_COLUMNS])


QUERIES = [
    Query("d01_describe_payment", lambda c: D.describe(c.feat, "PAYMENT"), _describe_sql("PAYMENT", "feat"), r2="value"),
    Query("d01_describe_total", lambda c: D.describe(c.feat, "TOTALPMT"), _describe_sql("TOTALPMT", "feat"), r2="value"),
    Query(
        "d02_percentile_table",
        lambda c: D.percentile_table(c.feat, ["PAYMENT", "TOTALPMT"]),
        " UNION ALL ".join(
            f"""SELECT CAST({p} AS DOUBLE) AS percentile, quantile_cont(PAYMENT, {p / 100}) AS PAYMENT,
            quantile_cont(TOTALPMT, {p / 100}) AS TOTALPMT FROM feat"""
            for p in D.TABLE_PERCENTILES
        ),
        r2="PAYMENT TOTALPMT",
    ),
    Query(
        "d03_shape",
        lambda c: D.shape(c.feat, "PAYMENT"),
        "SELECT count(PAYMENT) AS count, skewness(PAYMENT) AS skewness, kurtosis(PAYMENT) AS kurtosis FROM feat",
        r4="skewness kurtosis",
    ),
    Query(
        "d04_centre_and_spread",
        lambda c: D.centre_and_spread(c.feat, "PAYMENT"),
        """SELECT (SELECT PAYMENT FROM feat WHERE PAYMENT IS NOT NULL GROUP BY PAYMENT ORDER BY count(*) DESC, PAYMENT LIMIT 1) AS mode,
        quantile_cont(PAYMENT, 0.75) - quantile_cont(PAYMENT, 0.25) AS iqr, sum(PAYMENT) AS total FROM feat""",
        r4="iqr",
        r2="mode total",
    ),
    Query(
        "d05_histogram_capped",
        lambda c: D.histogram(c.feat, "PAYMENT", cap=0.99),
        _histogram_sql("PAYMENT", "PAYMENT <= (SELECT quantile_cont(PAYMENT, 0.99) FROM feat)", 100),
    ),
    Query(
        "d05_histogram_log10",
        lambda c: D.histogram(c.feat, "PAYMENT", log10=True),
        _histogram_sql("log10(PAYMENT)", "PAYMENT > 0", 100),
    ),
    Query(
        "d05_histogram_years",
        lambda c: D.year_histogram(A.lag_records(c.feat)),
        """SELECT CAST(r.year AS INTEGER) AS year, coalesce(n, 0) AS count FROM range(34) AS r(year)
        LEFT JOIN (SELECT least(LAG_YEARS, 33) AS year, count(*) AS n FROM feat WHERE VALID_LAG AND LAG_YEARS <= 34 GROUP BY 1) AS b
        ON r.year = b.year""",
    ),
    Query(
        "d06_box_plot_state",
        lambda c: D.box_plot(c.feat, "STATE", "PAYMENT"),
        _box_sql("STATE", "PAYMENT"),
        r4=BOX_R4,
    ),
    Query(
        "d06_box_plot_lag",
        lambda c: D.box_plot(c.feat.filter(F.col("LAG_YEARS").between(0, 20)), "RESOLUTION_BINARY", "LAG_YEARS"),
        _box_sql("RESOLUTION_BINARY", "LAG_YEARS", "LAG_YEARS BETWEEN 0 AND 20"),
        r4=BOX_R4,
    ),
    Query(
        "d07_median_pivot",
        lambda c: D.median_by_allegation_and_severity(c.feat),
        "SELECT "
        + case_sql("ALGNNATR", L.ALLEGATIONS, "'Unknown'")
        + " AS allegation, "
        + ", ".join(f'median(PAYMENT) FILTER (WHERE OUTCOME = {k}) AS "{v}"' for k, v in L.OUTCOMES_SHORT.items())
        + ', median(PAYMENT) FILTER (WHERE OUTCOME NOT BETWEEN 1 AND 10) AS "Unknown" FROM feat'
        + " WHERE ALGNNATR IS NOT NULL AND OUTCOME IS NOT NULL GROUP BY ALGNNATR",
    ),
    Query(
        "d09_exceedance_table",
        lambda c: D.exceedance_table(c.feat.filter(F.col("PAYMENT_MODE") == "Single Payment"), "PAYMENT_ADJ"),
        " UNION ALL ".join(
            f"""SELECT CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (WHERE PAYMENT_ADJ >= {t}) AS count,
            count(*) FILTER (WHERE PAYMENT_ADJ >= {t}) * 100.0 / count(*) AS pct
            FROM feat WHERE PAYMENT_MODE = 'Single Payment' AND PAYMENT_ADJ > 0"""
            for t in D.EXCEEDANCE_THRESHOLDS
        ),
        r4="pct",
    ),
    Query(
        "w06_exceedance_curve",
        lambda c: D.exceedance_curve(c.feat.filter(F.col("PAYMENT_MODE") == "Single Payment"), "PAYMENT_ADJ"),
        """SELECT PAYMENT_ADJ AS amount, count(*) AS count,
        (1 - sum(count(*)) OVER (ORDER BY PAYMENT_ADJ ROWS UNBOUNDED PRECEDING) / sum(count(*)) OVER ()) * 100 AS exceedance_pct
        FROM feat WHERE PAYMENT_MODE = 'Single Payment' AND PAYMENT_ADJ IS NOT NULL GROUP BY PAYMENT_ADJ""",
        r4="amount exceedance_pct",
    ),
    Query(
        "d10_mann_whitney",
        lambda c: D.mann_whitney(c.feat),
        _MANN_WHITNEY_SQL,
        r4="u_statistic z p_value settlement_median judgment_median",
    ),
    Query(
        "d11_bracket_comparison",
        lambda c: D.bracket_comparison(c.feat, digits=4),
        f"""WITH counted AS (SELECT bracket_ord, bracket, coalesce(s, 0) AS settlement_count, coalesce(j, 0) AS judgment_count
          FROM (VALUES {', '.join(f"({i}, '{b}')" for i, b in enumerate(features.BRACKET_LABELS))}) AS d(bracket_ord, bracket)
          LEFT JOIN (SELECT {BRACKET_SQL} AS b, count(*) FILTER (WHERE RESOLUTION_BINARY = 'Settlement/Non-Judgment') AS s,
            count(*) FILTER (WHERE RESOLUTION_BINARY = 'Judgment') AS j FROM feat GROUP BY 1) AS k ON d.bracket = k.b),
        shares AS (SELECT *, round(settlement_count * 100.0 / sum(settlement_count) OVER (), 4) AS settlement_pct,
          round(judgment_count * 100.0 / sum(judgment_count) OVER (), 4) AS judgment_pct FROM counted);;
        SELECT *, sum(settlement_pct) OVER w AS settlement_cumulative_pct, sum(judgment_pct) OVER w AS judgment_cumulative_pct
        FROM shares WINDOW w AS (ORDER BY bracket_ord ROWS UNBOUNDED PRECEDING)""",
        r4="settlement_pct judgment_pct settlement_cumulative_pct judgment_cumulative_pct",
    ),
    Query(
        "m01_model_frame",
        _model_input,
        f"""SELECT CAST(SEQNO AS DOUBLE) AS SEQNO, CAST(OUTCOME AS DOUBLE) AS OUTCOME, STATE, PAYMENT_ADJ FROM p_feat
        WHERE {_SEVERITY_WHERE}""",
        r4="PAYMENT_ADJ",
    ),
    Query(
        "m02_severity_frame",
        lambda c: M.severity_frame(c.new).select("SEQNO", "LOG_PAYMENT_ADJ"),
        f"SELECT SEQNO, LOG_PAYMENT_ADJ FROM p_feat WHERE {_SEVERITY_WHERE}",
        r4="LOG_PAYMENT_ADJ",
    ),
    Query("m03_log_payment_model", lambda c: M.log_payment_model(M.severity_frame(c.new))),
    Query("m04_gamma_payment_model", lambda c: M.gamma_payment_model(M.severity_frame(c.new))),
    Query(
        "m05_train_test_split",
        _split_counts,
        f"""SELECT CASE WHEN {_BUCKET_SQL} < 0.25 THEN 'test' ELSE 'train' END AS part, CATASTROPHIC, count(*) AS rows
        FROM p_feat GROUP BY 1, CATASTROPHIC""",
    ),
    Query(
        "m03_log_payment_balance",
        lambda c: M.fit_balance(M.severity_frame(c.new), "LOG_PAYMENT_ADJ", M.SEVERITY_TERMS, **M.LOG_PAYMENT).drop("ratio"),
        _TERM_ROWS.format(measure="sum(LOG_PAYMENT_ADJ) AS observed, sum(LOG_PAYMENT_ADJ) AS fitted"),
        r2="observed fitted",
    ),
    Query(
        "m04_gamma_payment_balance",
        lambda c: M.fit_balance(M.severity_frame(c.new), "PAYMENT_ADJ", M.SEVERITY_TERMS, **M.GAMMA_PAYMENT).drop(
            "observed", "fitted"
        ),
        _TERM_ROWS.format(measure="CAST(count(*) AS DOUBLE) AS ratio"),
        r2="ratio",
    ),
    Query(
        "m07_classifier_equations",
        lambda c: M.classifier_equations(M.severity_frame(c.new)),
        _EQUATIONS_SQL,
        r4="residual",
    ),
    Query(
        "m06_preprocessing",
        _preprocessed,
        _PREPROCESSED_SQL,
        r4="scaled_sum_0 scaled_sum_1 scaled_squares_0 scaled_squares_1 scaled_product",
    ),
    Query(
        "m07_catastrophic_classifier",
        lambda c: M.classifier_metrics(M.fit_catastrophic_classifier(M.severity_frame(c.new))[1]),
    ),
    Query("m08_classifier_metrics", _severity_score, _SCORE_SQL, r4="roc_auc average_precision"),
    Query(
        "m09_severity_distributions",
        lambda c: _four_digits(M.fit_severity_distributions(c.feat.filter(F.col("PAYMENT_MODE") == "Single Payment"))),
        _FITS_SQL,
    ),
    Query(
        "m10_lag_frame",
        lambda c: M.lag_frame(c.feat).select("SEQNO", "LAG_YEARS"),
        "SELECT SEQNO, LAG_YEARS FROM feat WHERE VALID_LAG",
    ),
]
