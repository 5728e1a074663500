"""Severity regressions, the catastrophic-payment classifier, its metrics, and severity distributions.

Fits run as Spark ML jobs or as a few wide aggregates; only coefficient-sized results reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    OneHotEncoder,
    RFormula,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlab.functions import columns as X
from claimlab.functions.recovery import checkpointed
from claimlab.operators import cells as C
from claimlab.operators import features as FT

# Columns that the models read.
SEVERITY_COLUMNS = ["OUTCOME", "PRACTAGE", "STATE", "PERIOD_10Y", "RESOLUTION_BINARY", "ALGNNATR"]
SEVERITY_TERMS = ["OUTCOME", "RESOLUTION_BINARY", "PERIOD_10Y", "STATE"]
CATASTROPHIC_FEATURES = ["OUTCOME", "PRACTAGE", "LAG_YEARS", "STATE", "RESOLUTION_BINARY", "ALGNNATR"]
TEST_SHARE = 0.25


# Frames ----------------------------------------------------------------------------------------


def model_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Integers as doubles, codes as text; missing stays missing."""
    columns = columns or df.columns

    def typed(name: str) -> Column:
        kind = df.schema[name].dataType
        if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
            return F.col(name).cast("double").alias(name)
        return F.col(name)

    return df.select(*[typed(c) for c in columns])


def severity_frame(df: DataFrame, required: list[str] = SEVERITY_COLUMNS) -> DataFrame:
    """Reports with every covariate and a positive adjusted payment."""
    return FT.complete_cases(df, [*required, "PAYMENT_ADJ"]).filter(F.col("PAYMENT_ADJ") > 0)


def lag_frame(df: DataFrame) -> DataFrame:
    """Reports with a valid lag."""
    return df.filter(F.col("VALID_LAG") & F.col("LAG_YEARS").isNotNull())


def is_test_row(test_share: float = TEST_SHARE) -> Column:
    """Whether a hash of the record id puts a row into the test part."""
    return X.row_bucket(F.col("SEQNO")) < test_share


def split_rows(df: DataFrame, test_share: float = TEST_SHARE) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the record id: repeatable, without a shuffle, alike in every class."""
    return df.filter(~is_test_row(test_share)), df.filter(is_test_row(test_share))


# Regressions -----------------------------------------------------------------------------------


_MAX_ITERATIONS = 2000


def term_cells(df: DataFrame, response: str, terms: list[str]) -> DataFrame:
    """One row per combination of levels with its rows and the sums of the response and of its square.

    Terms are bounded code sets, so this is a small table however many reports there are. It holds all that a
    fit needs: coefficients follow from means weighted by rows, and the dispersion from the squares.
    """
    levels = [F.col(t).cast("string").alias(t) for t in terms]
    known = df.filter(F.col(response).isNotNull())
    cells = known.groupBy(*levels).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(response).alias("_sum"), F.sum(F.col(response) * F.col(response)).alias("_sum2")
    )
    return checkpointed(cells.withColumn("cell_mean", F.col("_sum") / F.col("_rows")))


def _fitted_cells(cells: DataFrame, terms: list[str], **family):
    """The fitted model, the names of its coefficients, and the cells with their fitted means."""
    formula = RFormula(
        formula=f"cell_mean ~ {' + '.join(terms)}",
        featuresCol="features",
        labelCol="label",
        stringIndexerOrderType="alphabetDesc",
    ).fit(cells)
    data = formula.transform(cells)
    model = GeneralizedLinearRegression(maxIter=_MAX_ITERATIONS, tol=1e-10, weightCol="_rows", **family).fit(data)
    if model.summary.numIterations >= _MAX_ITERATIONS:
        raise RuntimeError(f"the fit has not converged in {_MAX_ITERATIONS} iterations")
    attributes = data.schema["features"].metadata["ml_attr"]["attrs"]
    names = [
        a["name"] for a in sorted((a for group in attributes.values() for a in group), key=lambda a: a["idx"])
    ]
    return model, names, model.transform(data).withColumnRenamed("prediction", "_fitted")


def _coefficient_table(df: DataFrame, response: str, terms: list[str], **family) -> DataFrame:
    """Fit response ~ terms with every term categorical; first level in text order is the reference level.

    The input is read once. Standard errors are those of the row-level fit: the dispersion is taken over the
    rows' own squares instead of the cells' means.
    """
    model, names, cells = _fitted_cells(term_cells(df, response, terms), terms, **family)
    apart = F.col("_sum2") - 2 * F.col("_fitted") * F.col("_sum") + F.col("_rows") * F.col("_fitted") * F.col("_fitted")
    variance = F.col("_fitted") * F.col("_fitted") if family["family"] == "gamma" else F.lit(1.0)
    pearson, rows = cells.agg(F.sum(apart / variance), F.sum("_rows")).first()
    summary = model.summary
    free = rows - len(names) - 1
    scale = math.sqrt(pearson / free / summary.dispersion) if free > 0 and summary.dispersion > 0 else float("nan")
    coefficients = [*map(float, model.coefficients), float(model.intercept)]
    errors = [e * scale for e in map(float, summary.coefficientStandardErrors)]
    t_values = [c / e if e else float("nan") for c, e in zip(coefficients, errors)]
    table = list(zip([*names, "Intercept"], coefficients, errors, t_values, [t_tail(t, free) for t in t_values]))
    return df.sparkSession.createDataFrame(
        table, "term string, coef double, std_err double, t_value double, p_value double"
    )


def t_tail(t: float, free: int) -> float:
    """Two-sided tail of Student's distribution: the incomplete beta function at free / (free + t^2)."""
    if not math.isfinite(t) or free <= 0:
        return float("nan")
    x, a, b = free / (free + t * t), free / 2, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    # The continued fraction converges fast below the mean; above it the complement is used.
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _beta_fraction(1 - x, b, a) / b
    return front * _beta_fraction(x, a, b) / a


def _beta_fraction(x: float, a: float, b: float, terms: int = 500) -> float:
    value = 1.0
    for m in range(terms, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1.0 + odd / (1.0 + even / value)
    return 1.0 / value


def fit_balance(df: DataFrame, response: str, terms: list[str], **family) -> DataFrame:
    """Per level of each term: rows, sum of the response, sum of fitted values, and sum of response over fitted.

    At the optimum the fitted sum equals the observed one for a linear model, and the last column equals the rows
    for a gamma model with log link.
    """
    _, _, cells = _fitted_cells(term_cells(df, response, terms), terms, **family)
    levels = F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("level")) for t in terms])
    return (
        cells.select("_rows", "_sum", "_fitted", F.inline(levels))
        .groupBy("term", "level")
        .agg(
            F.sum("_rows").alias("rows"),
            F.sum("_sum").alias("observed"),
            F.sum(F.col("_rows") * F.col("_fitted")).alias("fitted"),
            F.sum(F.col("_sum") / F.col("_fitted")).alias("ratio"),
        )
    )


LOG_PAYMENT = {"family": "gaussian", "link": "identity"}
GAMMA_PAYMENT = {"family": "gamma", "link": "log"}


def log_payment_model(df: DataFrame, terms: list[str] = SEVERITY_TERMS) -> DataFrame:
    """Linear model of the log adjusted payment: coefficient table."""
    return _coefficient_table(df, "LOG_PAYMENT_ADJ", terms, **LOG_PAYMENT)


def gamma_payment_model(df: DataFrame, terms: list[str] = SEVERITY_TERMS) -> DataFrame:
    """Gamma model of the adjusted payment with log link: coefficient table."""
    return _coefficient_table(df, "PAYMENT_ADJ", terms, **GAMMA_PAYMENT)


# Classifier ------------------------------------------------------------------------------------


def preprocessing(frame: DataFrame, features: list[str]) -> Pipeline:
    """Scaled numbers and one-hot codes; missing values arrive filled by `fill_missing`."""
    text = [c for c in features if isinstance(frame.schema[c].dataType, T.StringType)]
    numbers = [c for c in features if c not in text]
    stages = []
    vectors = []
    if numbers:
        stages += [
            VectorAssembler(inputCols=numbers, outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        ]
        vectors.append("_scaled")
    if text:
        stages += [
            StringIndexer(inputCols=text, outputCols=[f"{c}_index" for c in text], handleInvalid="keep"),
            OneHotEncoder(
                inputCols=[f"{c}_index" for c in text],
                outputCols=[f"{c}_hot" for c in text],
                dropLast=True,
            ),
        ]
        vectors += [f"{c}_hot" for c in text]
    stages.append(VectorAssembler(inputCols=vectors, outputCol="features"))
    return Pipeline(stages=stages)


def fill_missing(train: DataFrame, features: list[str]) -> dict[str, str | float]:
    """What missing values become: the exact median of a number, the most frequent code of a text column."""
    return fill_medians(train, features) | fill_frequent(train, features)


def fill_medians(train: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact median of each number column in the training rows."""
    numbers = [c for c in features if not isinstance(train.schema[c].dataType, T.StringType)]
    if not numbers:
        return {}
    values = train.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "column", "amount")
    medians = C.group_stats(values, ["column"], "amount", {}, {"median": 0.5})
    return {row["column"]: row["median"] for row in medians.collect() if row["median"] is not None}


def fill_frequent(train: DataFrame, features: list[str]) -> dict[str, str]:
    """Most frequent code of each text column in the training rows (smallest on ties)."""
    text = [c for c in features if isinstance(train.schema[c].dataType, T.StringType)]
    if not text:
        return {}
    counts = (
        train.select(*text)
        .unpivot([], text, "column", "code")
        .filter(F.col("code").isNotNull())
        .groupBy("column", "code")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("column").agg(F.min_by("code", F.struct(-F.col("n"), F.col("code"))).alias("code"))
    return {row["column"]: row["code"] for row in best.collect()}


def classifier_cells(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row per combination of feature values, label and part of the split, with its reports.

    Features are bounded codes, so this is a small table however many reports there are, and the one read of
    the reports. It is written to the checkpoint folder, as the passes of the fit all start from it.
    """
    frame = model_frame(df.filter(F.col(target).isNotNull()), ["SEQNO", *features, target])
    label, tested = F.col(target).cast("int").alias("label"), is_test_row().alias("tested")
    return checkpointed(frame.groupBy(*features, label, tested).agg(F.count(F.lit(1)).alias(C.ROWS)))


@dataclass(frozen=True)
class Classifier:
    """A fitted logistic model: how columns become slots, and each slot's coefficient."""

    fill: dict[str, str | float]
    centres: dict[str, float]
    spreads: dict[str, float]
    levels: dict[str, list[str]]
    coefficients: list[float]
    intercept: float
    class_weights: dict[int, float]
    penalty: float

    @property
    def slots(self) -> list[str]:
        """Names of the slots in the order of the coefficients: scaled numbers, then levels of codes."""
        return [*self.centres, *(f"{c}={level}" for c, levels in self.levels.items() for level in levels)]

    def values(self) -> list[Column]:
        """The slots' values, from rows with missing values filled."""
        numbers = [(F.col(c) - F.lit(m)) / F.lit(self.spreads[c]) for c, m in self.centres.items()]
        return numbers + [(F.col(c) == F.lit(v)).cast("double") for c, levels in self.levels.items() for v in levels]

    def filled(self, df: DataFrame) -> DataFrame:
        return df.na.fill(self.fill) if self.fill else df

    def scored(self, df: DataFrame) -> DataFrame:
        """Add `score`, the probability of the positive class; a code without a slot adds nothing."""
        filled = self.filled(df)
        terms = [F.lit(b) * F.coalesce(x, F.lit(0.0)) for b, x in zip(self.coefficients, self.values())]
        margin = reduce(lambda x, y: x + y, terms, F.lit(self.intercept))
        return filled.withColumn("score", 1 / (1 + F.exp(-margin)))

    def weight(self) -> Column:
        return F.when(F.col("label") == 1, F.lit(self.class_weights.get(1, 1.0))).otherwise(F.lit(self.class_weights.get(0, 1.0)))


def _filled_levels(train: DataFrame, features: list[str]) -> dict[str, str | float]:
    """What missing values become, from cells: the median of a number, the most frequent code of a text column."""
    text = [c for c in features if isinstance(train.schema[c].dataType, T.StringType)]
    numbers = [c for c in features if c not in text]
    fill: dict[str, str | float] = {}
    if numbers:
        values = train.select(C.ROWS, *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(C.ROWS, numbers, "column", C.VALUE)
        cells = values.groupBy("column", C.VALUE).agg(F.sum(C.ROWS).alias(C.ROWS))
        medians = C.cell_quantiles(cells, ["column"], {"median": 0.5}).collect()
        fill |= {row["column"]: row["median"] for row in medians if row["median"] is not None}
    if text:
        counts = train.select(C.ROWS, *text).unpivot(C.ROWS, text, "column", "code").filter(F.col("code").isNotNull())
        counts = counts.groupBy("column", "code").agg(F.sum(C.ROWS).alias("n"))
        best = counts.groupBy("column").agg(F.min_by("code", F.struct(-F.col("n"), F.col("code"))).alias("code"))
        fill |= {row["column"]: row["code"] for row in best.collect()}
    return fill


def fit_classifier_cells(cells: DataFrame, features: list[str]) -> Classifier:
    """Class-balanced logistic model with a unit penalty on every coefficient, fitted on weighted cells."""
    train = cells.filter(~F.col("tested"))
    text = [c for c in features if isinstance(cells.schema[c].dataType, T.StringType)]
    numbers = [c for c in features if c not in text]
    fill = _filled_levels(train, features)
    filled = train.na.fill(fill) if fill else train
    w = F.col(C.ROWS)
    classes = {row["label"]: row["n"] for row in train.groupBy("label").agg(F.sum(w).alias("n")).collect()}
    rows = sum(classes.values())
    if not rows:
        raise ValueError("there is no training row")
    weights = {label: rows / (len(classes) * n) for label, n in classes.items()}
    centres, spreads = {}, {}
    if numbers:
        means = filled.agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in numbers]).first().asDict()
        centres = {c: means[c] if means[c] is not None else 0.0 for c in numbers}
        apart = {c: F.col(c) - F.lit(centres[c]) for c in numbers}
        squares = filled.agg(*[F.sum(w * apart[c] * apart[c]).alias(c) for c in numbers]).first().asDict()
        spreads = {c: math.sqrt((squares[c] or 0.0) / max(rows - 1, 1)) or 1.0 for c in numbers}
    levels = {}
    if text:
        # Levels are code lists; a code that only test rows have gets no slot.
        found = filled.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in text]).first().asDict()
        levels = {c: list(found[c]) for c in text}
    model = Classifier(fill, centres, spreads, levels, [], 0.0, weights, 1.0)
    slots = F.array(*model.values()) if model.slots else F.array().cast("array<double>")
    data = filled.select(array_to_vector(slots).alias("features"), "label", (model.weight() * w).alias("_weight"))
    # Balanced weights sum to the number of training rows; unit penalty strength spreads over them.
    fitted = LogisticRegression(
        weightCol="_weight", maxIter=_MAX_ITERATIONS, tol=1e-8, regParam=model.penalty / rows, elasticNetParam=0.0,
        standardization=False,
    ).fit(data)
    if fitted.summary.totalIterations >= _MAX_ITERATIONS:
        raise RuntimeError(f"the fit has not converged in {_MAX_ITERATIONS} iterations")
    return replace(model, coefficients=[float(b) for b in fitted.coefficients], intercept=float(fitted.intercept))


def fit_catastrophic_classifier(
    df: DataFrame, features: list[str] = CATASTROPHIC_FEATURES, target: str = "CATASTROPHIC"
) -> tuple[Classifier, DataFrame]:
    """Class-balanced logistic model of catastrophic payments and its scores on the test part.

    The second result has a row per (label, score) with its reports (`_rows`), which is all that the metrics
    need; `Classifier.scored` scores any rows that have the features. The reports are read once.
    """
    cells = classifier_cells(df, features, target)
    model = fit_classifier_cells(cells, features)
    scored = model.scored(cells.filter("tested")).groupBy("label", "score").agg(F.sum(C.ROWS).alias(C.ROWS))
    return model, scored


def classifier_equations(
    df: DataFrame, features: list[str] = CATASTROPHIC_FEATURES, target: str = "CATASTROPHIC"
) -> DataFrame:
    """One row per slot and one for the intercept: training rows and positives behind it, and its score equation.

    At the optimum the weighted sum of (label - score) times the slot's value equals the penalty times the
    coefficient; `residual` is the difference per training row, without its sign. A level's rows and positives are
    those with the level, a number's and the intercept's are all.
    """
    cells = classifier_cells(df, features, target)
    model = fit_classifier_cells(cells, features)
    train = model.scored(cells.filter("not tested")).withColumn("_error", model.weight() * F.col(C.ROWS) * (F.col("label") - F.col("score")))
    names, values = [*model.slots, "Intercept"], [*model.values(), F.lit(1.0)]
    penalised = [model.penalty * b for b in model.coefficients] + [0.0]
    numbers = len(model.centres)
    rows = F.sum(C.ROWS)
    parts = [
        F.struct(
            F.lit(name).alias("slot"),
            (rows if i < numbers or name == "Intercept" else F.sum(F.col(C.ROWS) * x).cast("long")).alias("rows"),
            F.coalesce(
                F.sum(F.col(C.ROWS) * F.col("label") * (1 if i < numbers or name == "Intercept" else x)).cast("long"), F.lit(0).cast("long")
            ).alias("positives"),
            F.abs((F.sum(F.col("_error") * x) - F.lit(b)) / rows).alias("residual"),
        )
        for i, (name, x, b) in enumerate(zip(names, values, penalised))
    ]
    return train.agg(F.array(*parts).alias("_parts")).select(F.inline("_parts"))


def classifier_metrics(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC-AUC, average precision and row count of scored rows; `_rows`, if there, says how many a row is.

    Both follow from counts per distinct score and running counts from the highest score down.
    Average precision sums precision times the recall gained at each score, without interpolation.
    """
    n = F.col(C.ROWS) if C.ROWS in scored.columns else F.lit(1).cast("long")
    counts = (
        scored.groupBy((-F.col(score)).alias(C.VALUE))
        .agg(F.coalesce(F.sum(F.col(label).cast("long") * n), F.lit(0)).alias("_hits"), F.sum(n).alias("_n"))
        .withColumn("_misses", F.col("_n") - F.col("_hits"))
    )
    ranked = C.running_totals(counts, ["_hits", "_misses"])
    hits_to_here = F.col("_hits_before") + F.col("_hits")
    misses_to_here = F.col("_misses_before") + F.col("_misses")
    precision = hits_to_here / (hits_to_here + misses_to_here)
    positives, negatives = F.max("_hits_all").cast("double"), F.max("_misses_all").cast("double")
    beaten = F.sum(F.col("_misses") * (F.col("_hits_before") + F.col("_hits") / F.lit(2.0)))
    return ranked.agg(
        F.try_divide(beaten, positives * negatives).alias("roc_auc"),
        F.try_divide(F.sum(F.col("_hits") * precision), positives).alias("average_precision"),
        F.sum("_n").alias("test_rows"),
    )


# Severity distributions ------------------------------------------------------------------------

_TRIALS = 33
_MOVES = 4


def fit_severity_distributions(df: DataFrame, column: str = "PAYMENT_ADJ", rounds: int = 9) -> DataFrame:
    """Maximum-likelihood fits of five severity distributions, ranked by AIC and BIC.

    Location is zero. The data enter as (value, count) cells. Two fits are the root of the derivative of their
    profile likelihood; each round evaluates it at all trial values in one aggregate, so a fit takes a few passes.
    """
    positive = df.filter(F.col(column) > 0)
    cells = checkpointed(C.amount_cells(positive, [], column).withColumn("_log", F.ln(C.VALUE)))
    w = F.col(C.ROWS)
    base = cells.agg(
        F.sum(w).alias("n"),
        F.sum(w * F.col(C.VALUE)).alias("sum"),
        F.sum(w * F.col("_log")).alias("sum_log"),
        F.sum(w * F.col("_log") * F.col("_log")).alias("sum_log2"),
        F.max("_log").alias("max_log"),
    ).first()
    schema = "distribution string, shape double, scale double, log_likelihood double, aic double, bic double"
    if not base["n"]:
        return df.sparkSession.createDataFrame([], schema)
    n, mean, mean_log = float(base["n"]), base["sum"] / base["n"], base["sum_log"] / base["n"]
    fits = [
        ("exponential", None, mean, -n * (math.log(mean) + 1), 1),
        _gamma_fit(n, mean, mean_log),
        _lognormal_fit(n, mean_log, base["sum_log2"] / n),
        _weibull_fit(cells, n, mean_log, base["max_log"], rounds),
        _lomax_fit(cells, n, mean, rounds),
    ]
    rows = [
        (name, shape, scale, like, 2 * k - 2 * like, math.log(n) * k - 2 * like) for name, shape, scale, like, k in fits
    ]
    return df.sparkSession.createDataFrame(rows, schema).orderBy("aic", "bic")


def _digamma(x: float) -> float:
    shift = 0.0
    while x < 8:
        shift -= 1 / x
        x += 1
    y = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def _gamma_fit(n: float, mean: float, mean_log: float):
    """Shape from log(shape) - digamma(shape) = log(mean) - mean log, by bisection on the log scale."""
    target = math.log(mean) - mean_log
    low, high = -20.0, 20.0
    for _ in range(200):
        middle = (low + high) / 2
        if middle - _digamma(math.exp(middle)) > target:
            low = middle
        else:
            high = middle
    shape = math.exp((low + high) / 2)
    scale = mean / shape
    like = n * ((shape - 1) * mean_log - mean / scale - math.lgamma(shape) - shape * math.log(scale))
    return "gamma", shape, scale, like, 2


def _lognormal_fit(n: float, mean_log: float, mean_log2: float):
    sigma = math.sqrt(max(mean_log2 - mean_log * mean_log, 1e-300))
    like = n * (-mean_log - math.log(sigma) - 0.5 * math.log(2 * math.pi) - 0.5)
    return "lognormal", sigma, math.exp(mean_log), like, 2


def _root(evaluate, low: float, high: float, rounds: int) -> float:
    """Where a function changes sign once: a grid per round, then the step that holds the change.

    A range without a change moves towards it, at most `_MOVES` times; then there is no root, which is an error.
    """
    moves = 0
    while rounds:
        step = (high - low) / (_TRIALS - 1)
        grid = [low + step * i for i in range(_TRIALS)]
        values = evaluate(grid)
        if (values[0] > 0) == (values[-1] > 0):
            moves += 1
            if moves > _MOVES:
                raise RuntimeError("the likelihood has no maximum in the range that was searched")
            # Derivatives fall, so values above zero say that the root is higher.
            width = high - low
            low, high = (high, high + width) if values[0] > 0 else (low - width, low)
            continue
        after = next(i for i, v in enumerate(values) if (v > 0) != (values[0] > 0))
        low, high = grid[after - 1], grid[after]
        rounds -= 1
    return (low + high) / 2


def _sums(cells: DataFrame, terms: list, grid: list[float]) -> list[tuple[float, ...]]:
    """Weighted sums over cells of each term per grid point, in one aggregate."""
    trials = F.array(*[F.lit(g) for g in grid])
    per_trial = cells.select(C.ROWS, C.VALUE, "_log", F.posexplode(trials).alias("_trial", "_at"))
    wanted = [F.sum(F.col(C.ROWS) * term(F.col("_at"))).alias(f"_sum_{i}") for i, term in enumerate(terms)]
    by_trial = {row["_trial"]: tuple(row)[1:] for row in per_trial.groupBy("_trial").agg(*wanted).collect()}
    return [by_trial[i] for i in range(len(grid))]


def _weibull_fit(cells: DataFrame, n: float, mean_log: float, max_log: float, rounds: int):
    """Root over the log shape; powers are taken relative to the largest value to stay finite."""

    def power(at):
        return F.exp(F.exp(at) * (F.col("_log") - max_log))

    def sums(grid):
        return _sums(cells, [power, lambda at: power(at) * F.col("_log")], grid)

    def slope(grid):
        return [1 / math.exp(at) + mean_log - logs / total for at, (total, logs) in zip(grid, sums(grid))]

    at = _root(slope, math.log(0.02), math.log(50.0), rounds)
    shape = math.exp(at)
    log_mean_power = math.log(sums([at])[0][0] / n) + shape * max_log
    like = n * (at - log_mean_power + (shape - 1) * mean_log - 1)
    return "weibull", shape, math.exp(log_mean_power / shape), like, 2


def _lomax_fit(cells: DataFrame, n: float, mean: float, rounds: int):
    """Root over the log scale; the shape has a closed form for each scale."""
    terms = [
        lambda at: F.log1p(F.col(C.VALUE) / F.exp(at)),
        lambda at: F.col(C.VALUE) / (F.exp(at) + F.col(C.VALUE)),
    ]

    def slope(grid):
        return [(n / logs + 1) * shares - n for logs, shares in _sums(cells, terms, grid)]

    at = _root(slope, math.log(mean) - 12, math.log(mean) + 12, rounds)
    total = _sums(cells, terms, [at])[0][0]
    shape = n / total
    return "lomax", shape, math.exp(at), n * math.log(shape) - n * at - (shape + 1) * total, 2
