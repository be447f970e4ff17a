"""Data-quality checks: one scan for all row-wise checks of a table."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.operators.columns import ColumnSpec, normalise, quoted
from terrace.operators.lineage import Run

# What a check looks at, and the quality dimension it belongs to.
SCOPES = {
    "range": "cell",
    "regex": "cell",
    "recency": "column",
    "row_count": "table",
    "custom_sql": "table",
    "not_null": "cell",
    "accepted_values": "cell",
    "unique": "column",
    "relationships": "column",
    "cardinality": "column",
    "monotonic": "column",
}
DIMENSIONS = {
    "not_null": "completeness",
    "unique": "uniqueness",
    "accepted_values": "validity",
    "relationships": "consistency",
    "monotonic": "consistency",
}
DEFAULT_DIMENSION = "accuracy"
SEVERITIES = ("warn", "error")

#: Relative error of the sketch that counts distinct values.
CARDINALITY_ERROR = 0.02

_REF = re.compile(r"\{\{\s*ref\(\s*['\"](\w+)['\"]\s*\)\s*\}\}")


def column_checks(model: str, columns: Mapping[str, ColumnSpec]) -> list[dict[str, Any]]:
    """Checks implied by ``required``, ``unique`` and ``accepted_values`` in column specifications."""
    checks = []
    for name, raw in columns.items():
        spec = normalise(raw)
        base = {"column": name, "severity": "error"}
        if spec.get("required"):
            checks.append({**base, "type": "not_null", "name": f"{model}_{name}_not_null"})
        if spec.get("unique"):
            checks.append({**base, "type": "unique", "name": f"{model}_{name}_unique"})
        if spec.get("accepted_values"):
            checks.append(
                {
                    **base,
                    "type": "accepted_values",
                    "name": f"{model}_{name}_accepted_values",
                    "values": spec["accepted_values"],
                }
            )
    return checks


def _row_wise(check: Mapping[str, Any], run: Run) -> Column | None:
    """The failure count of a check as an aggregate over one scan, or None if it needs its own."""
    kind = check["type"]
    column = F.col(quoted(check["column"])) if check.get("column") else None
    if kind == "range":
        bounds = []
        if "min" in check:
            bounds.append(column < F.lit(check["min"]))
        if "max" in check:
            bounds.append(column > F.lit(check["max"]))
        return F.count_if(reduce(lambda a, b: a | b, bounds)) if bounds else F.lit(0)
    if kind == "recency":
        cutoff = run.now() - F.expr(f"interval '{check.get('max_age', '24 hours')}'")
        return F.when(F.max(column).cast("timestamp") < cutoff, 1).otherwise(0)
    if kind == "row_count":
        return F.when(F.count(F.lit(1)) < F.lit(int(check.get("min", 1))), 1).otherwise(0)
    if kind == "regex":
        return F.count_if(column.isNotNull() & ~column.rlike(check.get("pattern", ".*")))
    if kind == "not_null":
        return F.count_if(column.isNull())
    if kind == "cardinality":
        # a sketch of a few kilobytes for each task, off by CARDINALITY_ERROR at most as a rule
        distinct = F.approx_count_distinct(column, CARDINALITY_ERROR)
        outside = F.lit(False)
        if "min" in check:
            outside |= distinct < F.lit(int(check["min"]))
        if "max" in check:
            outside |= distinct > F.lit(int(check["max"]))
        return F.when(outside, 1).otherwise(0)
    if kind == "accepted_values":
        return F.count_if(column.isNotNull() & ~column.isin(list(check["values"])))
    return None


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    """One row: how many distinct non-null values occur more than once. Values are counted per task
    before the shuffle, so a hot value travels as one row per task."""
    value = F.col(quoted(column)).alias("value")
    counts = df.select(value).where("value is not null").groupBy("value").count()
    return counts.agg(F.count_if(F.col("count") > 1).alias("failures"))


def falls(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """One row: how often a value is smaller than the one before it in the order of another column.

    Rows are range-sorted by the order and then the value, so that neither equal places nor a hot one count or
    gather. Every range is passed once and leaves its own falls and its border values; what falls from one range to
    the next is seen on the borders, a row for each range. Rows without a value or a place are left out.
    """
    pair = df.select(F.col(quoted(order_by)).alias("place"), F.col(quoted(column)).alias("value")).dropna()
    schema = f"range int, first {pair.dtypes[1][1]}, last {pair.dtypes[1][1]}, falls long"

    def run(batches):
        first = last = None
        count = 0
        for batch in batches:
            values = batch.column(0)
            if not len(values):
                continue
            if last is not None and values[0].as_py() < last:
                count += 1
            first = values[0].as_py() if last is None else first
            last = values[-1].as_py()
            count += pc.sum(pc.less(values.slice(1), values.slice(0, len(values) - 1))).as_py() or 0
        if last is not None:
            kind = values.type
            arrays = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], kind), pa.array([last], kind), pa.array([count], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["range", "first", "last", "falls"])

    ordered = pair.repartitionByRange("place", "value").sortWithinPartitions("place", "value")
    ranges = ordered.select("value").mapInArrow(run, schema)
    # a window without partitions over one row for each range
    before = F.lag("last").over(Window.orderBy("range"))
    borders = ranges.withColumn("border", (F.col("first") < before).cast("long"))
    return borders.agg(F.coalesce(F.sum("falls") + F.sum(F.coalesce("border", F.lit(0))), F.lit(0)).alias("failures"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """One row: how many child rows have a non-null key without a parent. Keys of both sides are
    reduced per task first, so the join sees each key once and a hot key costs nothing."""
    keys = (
        child.select(F.col(quoted(column)).alias("key")).where("key is not null").groupBy("key").count()
    )
    parents = parent.select(F.col(quoted(parent_column)).alias("key")).distinct()
    return keys.join(parents, "key", "left_anti").agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("failures")
    )


def _separate(
    df: DataFrame, model: str, check: Mapping[str, Any], tables: Mapping[str, DataFrame]
) -> DataFrame:
    kind = check["type"]
    if kind == "unique":
        return duplicate_values(df, check["column"])
    if kind == "monotonic":
        return falls(df, check["column"], check["order_by"])
    if kind == "relationships":
        return orphans(df, check["column"], tables[check["to"]], check["field"])
    # custom_sql names tables as {name} or {{ ref('name') }}; its one value is the number of failures
    frames = {**tables, model: df}
    query = _REF.sub(r"{\1}", check.get("sql", "SELECT 0"))
    used = {n: frame for n, frame in frames.items() if "{" + n + "}" in query}
    # all other braces, in literals and patterns, are text
    query = re.sub(r"\{(\w+)\}|[{}]", lambda m: m[0] if m[1] in used else m[0].replace("{", "{{").replace("}", "}}"), query)
    return df.sparkSession.sql(query, **used).toDF("failures")


def run_checks(
    df: DataFrame,
    model: str,
    checks: Sequence[Mapping[str, Any]],
    tables: Mapping[str, DataFrame] | None = None,
    run: Run = Run(),
) -> DataFrame:
    """One row per check: name, type, scope, severity, dimension, failures, status.

    All row-wise checks share one aggregate, hence one scan of only the columns they use. ``unique``,
    ``relationships``, ``monotonic`` and ``custom_sql`` each add their own small plan. ``tables`` holds the parents.
    """
    fused: list[tuple[Mapping[str, Any], Column]] = []
    separate: list[tuple[Mapping[str, Any], DataFrame]] = []
    for check in checks:
        if check["type"] not in SCOPES:
            raise ValueError(f"unknown check type: {check['type']!r}")
        if check.get("severity", "warn") not in SEVERITIES:
            raise ValueError(f"unknown severity: {check['severity']!r}")
        count = _row_wise(check, run)
        if count is not None:
            fused.append((check, count))
        else:
            separate.append((check, _separate(df, model, check, tables or {})))

    results = []
    if fused:
        names = [f"c{i}" for i in range(len(fused))]
        counts = df.agg(*[c.cast("long").alias(n) for n, (_, c) in zip(names, fused)])
        rows = [_result(model, check, F.col(n)) for n, (check, _) in zip(names, fused)]
        results.append(counts.select(F.inline(F.array(*rows))))
    for check, one_row in separate:
        count = F.col("failures").cast("long")
        results.append(one_row.select(F.inline(F.array(_result(model, check, count)))))
    if not results:
        raise ValueError("no checks given")
    return reduce(DataFrame.unionByName, results)


def check_model(
    df: DataFrame,
    model: str,
    spec: Mapping[str, Any],
    tables: Mapping[str, DataFrame] | None = None,
    run: Run = Run(),
) -> DataFrame:
    """Run what a model specification asks for: its columns' constraints and its ``checks``."""
    checks = [*column_checks(model, spec["columns"]), *spec.get("checks", [])]
    return run_checks(df, model, checks, tables, run)


def _result(model: str, check: Mapping[str, Any], failures: Column) -> Column:
    kind, severity = check["type"], check.get("severity", "warn")
    return F.struct(
        F.lit(check.get("name", f"{model}_{kind}")).alias("name"),
        F.lit(kind).alias("type"),
        F.lit(SCOPES[kind]).alias("scope"),
        F.lit(severity).alias("severity"),
        F.lit(DIMENSIONS.get(kind, DEFAULT_DIMENSION)).alias("dimension"),
        failures.alias("failures"),
        F.when(failures == 0, "PASS").otherwise("FAIL" if severity == "error" else "WARN").alias("status"),
    )


def dimension_summary(results: DataFrame) -> DataFrame:
    """How many checks of each quality dimension ended in each status."""
    return results.groupBy("dimension", "status").agg(F.count(F.lit(1)).alias("checks"))
