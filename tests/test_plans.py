"""Plan properties: one scan for shared cells, no row-level Python, no cross joins, hot keys split."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from claimlab.operators import cells as C
from claimlab.operators import linkage
from claimlab.plans.registry import ALL

FITTED = {"m03_log_payment_model", "m04_gamma_payment_model", "m07_catastrophic_classifier", "m07_classifier_equations", "m09_severity_distributions"}


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def final_plan(df) -> str:
    """What ran: the plan and those of its subqueries, without the parts that show them as first planned."""
    kept, hidden = [], None
    for line in plan_of(df).splitlines():
        # Text constants of white space break lines, so only lines that begin a node count.
        node = re.match(r"[ :]*(\+-|:-)", line)
        if hidden is not None and (node is None or node.start(1) > hidden):
            continue
        hidden = node.start(1) if "== Initial Plan ==" in line else None
        kept.append(line)
    return "\n".join(kept)


@pytest.fixture
def static_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_python_and_no_cross_joins(static_plans, sf_dir):
    for key in ALL.keys() - FITTED:
        plan = plan_of(ALL[key].run(static_plans, sf_dir))
        for forbidden in ("EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
            assert forbidden not in plan, (key, forbidden)


@pytest.mark.parametrize(
    "key",
    [
        "s17_cohort_baseline", "a01_period_summary", "a02_state_period_mode", "a03_state_summary", "a14_state_amounts",
        "a21_catastrophic_totals", "a39_resolution_coverage", "d01_describe_payment", "d02_percentile_table",
        "d05_histogram_capped", "d06_box_plot_state", "d07_median_pivot", "d10_mann_whitney", "w06_exceedance_curve",
    ],
)
def test_branches_share_one_scan(static_plans, sf_dir, key):
    plan = plan_of(ALL[key].run(static_plans, sf_dir))
    assert plan.count("orders.parquet") == 1, key
    assert "ReusedExchange" in plan, key


@pytest.mark.parametrize("key", ["a03_state_summary", "a14_state_amounts", "f21_label_predicates", "p05_multi_payment_profile", "f01_cohorts", "k07_compare_tiers"])
def test_one_scan_in_the_plan_that_ran(spark, sf_dir, key):
    """With adaptive execution on, after the query has run."""
    df = ALL[key].run(spark, sf_dir)
    df.collect()
    assert final_plan(df).count("orders.parquet") == 1, key


def test_second_exchange_carries_wanted_buckets_only(spark, sf_dir):
    """The join that orders cells reads cells that the set of wanted buckets has filtered, and little else."""
    n = F.col("id")
    df = spark.range(0, 400_000).select((n % 3).alias("k"), (n * 7919 % 100_003 + 1).cast("double").alias("v"))
    cells = C.amount_cells(df, ["k"], "v")
    found = C.cell_quantiles(cells, ["k"], {"median": 0.5, "p90": 0.9})
    rows = {r["k"]: (r["median"], r["p90"]) for r in found.collect()}
    for k in range(3):
        wanted = df.where(F.col("k") == k).agg(F.percentile("v", [0.5, 0.9])).first()[0]
        assert rows[k] == tuple(wanted)
    plan = final_plan(found)
    assert plan.count("Range (0, 400000") == 1
    assert re.search(r"Exchange hashpartitioning\(k#\w+, _bucket#\w+, \d+\)[^\n]*\n(.*\n){1,4}?.*Filter .*array_contains", plan)
    values = cells.withColumn(C.BUCKET, C.bucket_of(F.col(C.VALUE)))
    targets = values.where(F.col(C.VALUE).between(50_000, 50_010)).select(F.col("k").alias("_target_k"), F.col(C.BUCKET).alias("_target_bucket"))
    moved = values.filter(C._may_hold(targets.distinct(), ["k"])).count()
    assert 0 < moved < 0.01 * cells.count()
    many = values.select(F.col("k").alias("_target_k"), F.col(C.BUCKET).alias("_target_bucket")).distinct()
    assert many.count() > C.TARGET_LIMIT and values.filter(C._may_hold(many, ["k"])).count() == cells.count()


def test_scan_reads_needed_columns_only(static_plans, sf_dir):
    plan = plan_of(ALL["a28_lag_by_year"].run(static_plans, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_hot_episode_is_split_over_tasks(spark):
    """Half of all reports share the episode without any known key."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        n = F.col("id")
        known = n % 2 == 0

        def when_known(column):
            return F.when(known, column)

        df = spark.range(0, 120000, 1, 8).select(
            n.alias("SEQNO"),
            when_known(n).alias("PRACTNUM"),
            when_known(F.lit("WI")).alias("STATE"),
            when_known((n % 30 + 1990).cast("int")).alias("MALYEAR1"),
            F.lit(None).cast("int").alias("MALYEAR2"),
            when_known((n % 7).cast("int")).alias("ALGNNATR"),
            when_known(F.lit("S")).alias("PAYTYPE_STR"),
            F.lit(301).alias("REPTYPE"),
            F.lit(2001).alias("ORIGYEAR"),
            F.lit(1.0).alias("PAYMENT_ADJ"),
            F.lit(None).cast("double").alias("TOTALPMT_ADJ"),
        )
        linked = linkage.with_best_total(df).select("SEQNO", "TOTALPMT_BEST", "TOTALPMT_SOURCE")
        rows = linked.collect()
        plan = plan_of(linked)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert "skew=true" in plan
    assert len(rows) == 120000 and sum(r["TOTALPMT_BEST"] == 60000.0 for r in rows) == 60000
