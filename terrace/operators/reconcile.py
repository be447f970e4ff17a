"""Comparing totals of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators.lineage import Run
from terrace.sources.tables import overwrite_partitions, read_table

WARN_LIMIT = 5  # fixed value: largest difference that is only a warning


def _side_by_side(left: DataFrame, left_value: Column, right: DataFrame, right_value: Column) -> DataFrame:
    """Two global aggregates as one row, without a join."""
    a = left.agg(left_value.alias("a")).select("a", F.lit(None).alias("b"))
    b = right.agg(right_value.alias("b")).select(F.lit(None).alias("a"), "b")
    return a.unionByName(b).agg(F.max("a").alias("a"), F.max("b").alias("b"))


def reconcile_counts(
    source: DataFrame,
    target: DataFrame,
    check_name: str,
    source_table: str,
    target_table: str,
    warn_limit: int = WARN_LIMIT,
    symmetric: bool = False,
    run: Run = Run(),
) -> DataFrame:
    """One log row: PASS when the row counts agree, WARN up to ``warn_limit`` rows lost, else FAIL.

    A target with more rows than its source has a negative delta, which is a WARN unless
    ``symmetric`` asks for the absolute difference.
    """
    rows = F.count(F.lit(1))
    delta = F.col("a") - F.col("b")
    gap = F.abs(delta) if symmetric else delta
    status = F.when(delta == 0, "PASS").when(gap <= warn_limit, "WARN").otherwise("FAIL")
    return _side_by_side(source, rows, target, rows).select(
        F.lit(check_name).alias("check_name"),
        F.lit(source_table).alias("source_table"),
        F.lit(target_table).alias("target_table"),
        F.col("a").alias("source_count"),
        F.col("b").alias("target_count"),
        delta.alias("delta"),
        status.alias("status"),
        run.now().alias("checked_at"),
    )


def reconcile_totals(
    child: DataFrame,
    child_expr: str,
    parent: DataFrame,
    parent_expr: str,
    name: str,
    tolerance: float | str = 0,
) -> DataFrame:
    """One row: does an aggregate of a table match one of its parent within ``tolerance``?

    A NULL on one side only is a failure; NULL on both sides (two empty tables) passes.
    """
    pair = _side_by_side(child, F.expr(child_expr), parent, F.expr(parent_expr))
    gap = F.abs(F.col("a") - F.col("b"))
    same = F.coalesce(gap <= F.lit(tolerance), F.col("a").eqNullSafe(F.col("b")))
    return pair.select(
        F.lit(name).alias("name"),
        F.col("a").alias("child_value"),
        F.col("b").alias("parent_value"),
        gap.alias("difference"),
        F.when(same, "PASS").otherwise("FAIL").alias("status"),
    )


def append_log(rows: DataFrame, log: str, run_key: str) -> None:
    """Add a run's rows to the log, in place of what an earlier attempt at the same run has left there.

    The log is a parquet folder with a partition for each run; other runs are neither read nor written.
    """
    overwrite_partitions(rows.withColumn("_run", F.lit(run_key)), log, ("_run",))


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return read_table(spark, log)
