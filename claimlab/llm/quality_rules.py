"""Quality rules whose cutoffs are chosen on labelled documents so that few good ones are rejected.

Base measures of a text are exact counts over its words, lines and three-word windows. A rule rejects a text
when a ratio of these is above (or below) a cutoff. For each stratum and rule, candidate cutoffs are tested
from the most lenient one on: with n labelled good documents of the stratum, of which k would be rejected, the
exact binomial upper bound of the false rejection rate at level `delta / (strata * rules)` has to stay within
`alpha`. The walk stops at the first cutoff that fails, so each rule of a stratum counts as one test however
fine the grid is, and the division by strata and rules corrects for all of them together: with probability
1 - delta every cutoff that passes falsely rejects at most a share alpha of its stratum's good documents. As
that holds for all of them at once, the best may be picked freely: the one that rejects most bad labelled
documents, where a good one counts as much as `WEIGHT` bad ones. A rule for which that is no gain, or without
a cutoff that passes, rejects nothing there.

Thresholds come from counts in a fixed grid over all labelled documents; only the grid's counts, strata times
rules times `STEPS`, reach the driver.

Defined results: null and empty texts have no words, so they fail the base rules; null lang is a stratum of its
own; repeated labels of a document count once each; a document without label takes no part in the choice; an
empty table gives no row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlab.llm import common

MIN_WORDS = 50
REPEAT_PERCENT = 50
ALPHA = 0.02
DELTA = 0.05
STEPS = 64
WEIGHT = 4
WINDOW = 3
_ROWS = 500
_SYMBOLS = b"#*$%&|<>"
_MEASURES = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_lines:bigint>"
)


@dataclass(frozen=True)
class Rule:
    """Rejects texts whose measure lies above the cutoff; candidates are `STEPS` equal steps from `most` down to 0."""

    name: str
    measure: str
    most: float


RULES = (
    Rule("symbols", "n_symbols / word_chars", 0.64),
    Rule("repeated_lines", "n_dup_lines / n_lines", 1.0),
    Rule("repeated_words", "n_repeat_words / n_words", 0.64),
    Rule("long_words", "word_chars / n_words", 32.0),
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(window))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0
    for at, one in enumerate(windows):
        if counts[one] > 1:
            total += at + window - max(at, covered)
            covered = at + window
    return total


def measured(text: bytes | None) -> tuple[int, ...]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    spaces = len(text) - sum(map(len, words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    chars = len(text.decode("utf-8", "surrogatepass")) - spaces
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _measured_batches(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [field.split(":")[0] for field in _MEASURES[len("struct<") : -1].split(",")]
    common.keep_nothing()
    for batch in texts:
        parts = (batch.slice(at, _ROWS).cast(pa.large_binary()) for at in range(0, len(batch), _ROWS))
        rows = [measured(text) for part in parts for text in part.to_pylist()]
        columns = list(zip(*rows)) or [[]] * len(names)
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
    common.keep_nothing()


def measures(text: str) -> Column:
    """The base measures of each text, as a struct."""
    return F.arrow_udf(_measured_batches, _MEASURES)(text)


def base_failed(at: str = "") -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return F.expr(f"{at}n_words < {MIN_WORDS} OR 100 * {at}n_repeat_words > {REPEAT_PERCENT} * {at}n_words")


def _ratio(rule: Rule, at: str = "") -> Column:
    top, bottom = rule.measure.split(" / ")
    return F.expr(f"coalesce({at}{top} / nullif({at}{bottom}, 0), 0.0D)")


def _stratum(column: str = "lang") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("\0none"))


def at_most(k: int, n: int, rate: float) -> float:
    """P(at most k of n) for independent trials of the given rate."""
    if rate <= 0 or k >= n:
        return 1.0
    if rate >= 1:
        return 0.0
    log_p, log_q = math.log(rate), math.log1p(-rate)
    terms = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q
        for i in range(k + 1)
    ]
    high = max(terms)
    return min(1.0, math.exp(high) * math.fsum(math.exp(t - high) for t in terms))


def rate_bound(k: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a rate after k of n: the rate at which at most k has probability `level`."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if at_most(k, n, middle) > level else (low, middle)
    return high


def chosen_cutoffs(
    counts: dict[tuple[str, str], dict[int, tuple[int, int]]], alpha: float, delta: float, steps: int = STEPS
) -> dict[tuple[str, str], float | None]:
    """Cutoffs by stratum and rule.

    `counts` has the good and bad documents of each grid cell: cell c holds measures above c / steps of the
    rule's range and up to (c + 1) / steps; cell `steps` holds all beyond. A cutoff at step s rejects the cells
    from s on.
    """
    level = delta / max(1, len(counts))
    cutoffs: dict[tuple[str, str], float | None] = {}
    by_name = {rule.name: rule for rule in RULES}
    for key, cells in counts.items():
        n = sum(good for good, _ in cells.values())
        rejected = bad_rejected = most = 0
        cutoffs[key] = None
        for step in range(steps, 0, -1):
            good, bad = cells.get(step, (0, 0))
            rejected, bad_rejected = rejected + good, bad_rejected + bad
            if rate_bound(rejected, n, level) > alpha:
                break
            if bad_rejected - WEIGHT * rejected > most:
                most = bad_rejected - WEIGHT * rejected
                cutoffs[key] = step * by_name[key[1]].most / steps
    return cutoffs


def fitted_cutoffs(
    measures_and_labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA
) -> dict[tuple[str, str], float | None]:
    """Cutoffs from labelled rows (stratum, quality and the measures); rows that fail the base rules take no part."""
    rows = measures_and_labels.where("quality in (0, 1)").where(~base_failed())
    cells = F.array(
        *(
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.least(F.greatest(F.ceil(_ratio(rule) * STEPS / rule.most) - 1, F.lit(0)), F.lit(STEPS))
                .cast("int")
                .alias("cell"),
            )
            for rule in RULES
        )
    )
    rows = rows.select("stratum", "quality", F.inline(cells)).groupBy("stratum", "rule", "cell")
    rows = rows.agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    counts: dict[tuple[str, str], dict[int, tuple[int, int]]] = {}
    for row in rows.toLocalIterator():
        counts.setdefault((row.stratum, row.rule), {})[row.cell] = row.good, row.bad
    return chosen_cutoffs(counts, alpha, delta)


def accepted(cutoffs: dict[tuple[str, str], float | None], stratum: Column, at: str = "") -> Column:
    """Whether no rule of the stratum rejects; a stratum without cutoffs accepts."""
    verdict = F.lit(True)
    for rule in RULES:
        held = {key[0]: cutoff for key, cutoff in cutoffs.items() if key[1] == rule.name and cutoff is not None}
        if held:
            limits = F.create_map(*(F.lit(x) for pair in sorted(held.items()) for x in pair))
            limit = F.try_element_at(limits, stratum)
            verdict = verdict & (limit.isNull() | (_ratio(rule, at) <= limit))
    return verdict


def judged(documents: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document; the texts are read once."""
    narrow = documents.select(F.col("doc_id").cast("long"), _stratum().alias("stratum"), measures("text").alias("m"))
    narrow = common.saved(narrow.select("doc_id", "stratum", "m.*"))
    cutoffs = fitted_cutoffs(narrow.join(labels.select("doc_id", "quality"), "doc_id"), alpha, delta)
    failed = base_failed()
    return narrow.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & accepted(cutoffs, F.col("stratum"))
    )


def kept_documents(documents: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents, all their columns, that neither the base rules nor the fitted cutoffs reject."""
    known = labels.select(F.col("doc_id").alias("labelled"), "quality")
    sample = documents.select("doc_id", _stratum().alias("stratum"), measures("text").alias("m"))
    sample = sample.select("doc_id", "stratum", "m.*").join(known, F.col("doc_id") == F.col("labelled"))
    cutoffs = fitted_cutoffs(sample, alpha, delta)
    marked, name, columns = common.with_text_result(documents, _MEASURES, _measured_batches)
    verdict = ~base_failed(f"{name}.") & accepted(cutoffs, _stratum(), f"{name}.")
    return marked.where(verdict).select(*columns)


def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    verdicts = judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return verdicts.drop("stratum", "n_lines")


_RATIOS = " UNION ALL ".join(
    f"SELECT doc_id, stratum, '{r.name}' AS rule, coalesce({r.measure.replace(' / ', ' / nullif(')}, 0), 0.0) AS ratio, "
    f"CAST({r.most} AS DOUBLE) AS most FROM measured"
    for r in RULES
)

SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, chr(0) || 'none') AS stratum, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i,
    unnest(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) AS w
  FROM texts WHERE len(words) >= 3
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(3) AS r(k) GROUP BY doc_id
), measured AS (
  SELECT t.doc_id, t.stratum, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    len(words) < {MIN_WORDS} OR 100 * coalesce(c.n, 0) > {REPEAT_PERCENT} * len(words) AS base_failed
  FROM texts AS t LEFT JOIN covered AS c ON c.doc_id = t.doc_id
), ratios AS ({_RATIOS}), cells AS (
  SELECT r.stratum, r.rule, r.most, least(greatest(ceil(ratio * {STEPS} / r.most) - 1, 0), {STEPS}) AS cell,
    count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad
  FROM ratios AS r JOIN measured AS m ON m.doc_id = r.doc_id AND NOT m.base_failed
  JOIN labels AS l ON l.doc_id = r.doc_id WHERE quality IN (0, 1) GROUP BY ALL
), walked AS (
  SELECT c.stratum, c.rule, c.most, s.step, CAST(sum(good) AS BIGINT) AS n,
    CAST(coalesce(sum(good) FILTER (WHERE cell >= step), 0) AS BIGINT) AS k,
    CAST(coalesce(sum(bad) FILTER (WHERE cell >= step), 0) AS BIGINT) AS hit
  FROM cells AS c, range(1, {STEPS + 1}) AS s(step) GROUP BY c.stratum, c.rule, c.most, s.step
), tested AS (
  SELECT w.*, (SELECT count(*) FROM (SELECT DISTINCT stratum, rule FROM cells) AS d) AS tests,
    (SELECT sum(exp(lgamma(w.n + 1) - lgamma(i + 1) - lgamma(w.n - i + 1) + i * ln({ALPHA}) + (w.n - i) * ln(1 - {ALPHA})))
     FROM range(0, w.k + 1) AS r(i)) AS tail
  FROM walked AS w WHERE k < n
), cutoffs AS (
  SELECT stratum, rule, arg_max(step * most / {STEPS}, (hit - {WEIGHT} * k) * 1000 + step) AS cutoff
  FROM tested WHERE tail <= {DELTA} / tests AND hit - {WEIGHT} * k > 0 GROUP BY stratum, rule
), rejected AS (
  SELECT DISTINCT r.doc_id FROM ratios AS r JOIN cutoffs AS c ON c.stratum = r.stratum AND c.rule = r.rule WHERE ratio > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM measured
"""
