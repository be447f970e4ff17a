"""Typed contracts: the schema a model promises and the rows that break it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.functions.casts import unconvertible
from terrace.operators.columns import ColumnSpec, normalise, quoted
from terrace.operators.lineage import LINEAGE_DDL
from terrace.types import spark_type

SHOWN_ROWS = 10  # fixed value: bad rows quoted in an error message


def contract_schema(columns: Mapping[str, ColumnSpec], lineage: bool = False) -> T.StructType:
    """Schema of a model; undeclared types are strings and only required columns are not nullable."""
    fields = []
    for name, raw in columns.items():
        spec = normalise(raw)
        fields.append(
            T.StructField(name, spark_type(spec.get("type", "string")), not spec.get("required", False))
        )
    if lineage:
        fields.append(T.StructField("_lineage", T.DataType.fromDDL(LINEAGE_DDL), False))
    return T.StructType(fields)


def typed_frame(spark: SparkSession, columns: Mapping[str, ColumnSpec], rows: Iterable[Any]) -> DataFrame:
    """A DataFrame with the contract's schema from rows at hand; meant for small reference data."""
    return spark.createDataFrame(list(rows), contract_schema(columns))


def managed_frame(spark: SparkSession, columns: Mapping[str, ColumnSpec], lineage: bool = False) -> DataFrame:
    """The empty, typed table that a task will append to."""
    return spark.createDataFrame([], contract_schema(columns, lineage))


def _problem(df: DataFrame, name: str, spec: dict[str, Any]) -> list[Column]:
    if name not in df.columns:
        return [F.lit(f"{name}: missing column")] if spec.get("required") else []
    column = F.col(quoted(name))
    problems = []
    if spec.get("required"):
        problems.append(F.when(column.isNull(), F.lit(f"{name}: required value is missing")))
    target = spark_type(spec.get("type", "string"))
    if df.schema[name].dataType != target:
        bad = unconvertible(column, df.schema[name].dataType, target)
        problems.append(F.when(bad, F.lit(f"{name}: not a {target.simpleString()}")))
    return problems


def with_errors(df: DataFrame, columns: Mapping[str, ColumnSpec]) -> DataFrame:
    """Append ``_errors``: what each row breaks, an empty array for good rows. No shuffle."""
    problems = [p for name, raw in columns.items() for p in _problem(df, name, normalise(raw))]
    none = F.array().cast("array<string>")
    return df.withColumn("_errors", F.array_compact(F.array(*problems)) if problems else none)


def bad_rows(df: DataFrame, columns: Mapping[str, ColumnSpec]) -> DataFrame:
    return with_errors(df, columns).where(F.size("_errors") > 0)


def require_valid(df: DataFrame, columns: Mapping[str, ColumnSpec], model: str) -> DataFrame:
    """Raise when any row breaks the contract, quoting the first few; otherwise return ``df``."""
    bad = bad_rows(df, columns)
    total = bad.count()
    if total:
        shown = [", ".join(r["_errors"]) for r in bad.select("_errors").limit(SHOWN_ROWS).collect()]
        lines = [f"{total} invalid rows in '{model}':", *[f"  {line}" for line in shown]]
        if total > SHOWN_ROWS:
            lines.append(f"  ... and {total - SHOWN_ROWS} more")
        raise ValueError("\n".join(lines))
    return df


def conform(df: DataFrame, columns: Mapping[str, ColumnSpec], keep: Iterable[str] = ()) -> DataFrame:
    """Project to the contract's columns and types, in its order, and the columns to keep."""
    fields = contract_schema(columns).fields
    typed = [F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in fields]
    return df.select(*typed, *[F.col(quoted(k)) for k in keep])


def apply_udf(
    df: DataFrame, columns: Mapping[str, ColumnSpec], name: str, function: Callable[[Column], Column]
) -> DataFrame:
    """Replace a contracted column by a function of it; the result keeps the contract's type."""
    if name not in columns:
        raise ValueError(f"column {name!r} is not in the contract: {sorted(columns)}")
    changed = df.withColumn(name, function(df[quoted(name)]))
    declared = normalise(columns[name]).get("type")
    if declared and changed.schema[name].dataType != spark_type(declared):
        raise ValueError(
            f"column {name!r} became {changed.schema[name].dataType.simpleString()}, "
            f"the contract says {spark_type(declared).simpleString()}"
        )
    return changed


def transform(
    df: DataFrame, columns: Mapping[str, ColumnSpec], function: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Apply a transformation whose output must hold all required columns of the contract; this is
    known from the plan's schema, before any job runs."""
    result = df.transform(function)
    required = {n for n, spec in columns.items() if normalise(spec).get("required")}
    missing = required - set(result.columns)
    if missing:
        raise ValueError(f"the result lacks required columns: {sorted(missing)}")
    return result
