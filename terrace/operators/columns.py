"""Column specifications compiled to Spark columns.

A specification is a dict with any of the keys ``type``, ``cast``, ``on_bad``, ``expr``, ``udf``,
``from``, ``source_column``, ``required``, ``unique``, ``accepted_values``. A bare string stands for
``{"type": ...}`` and ``None`` for an empty one.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.casts import lenient_cast
from terrace.types import spark_type

ColumnSpec = dict[str, Any] | str | None


def normalise(spec: ColumnSpec) -> dict[str, Any]:
    if spec is None:
        return {}
    if isinstance(spec, str):
        return {"type": spec}
    return spec


def is_computed(spec: ColumnSpec) -> bool:
    spec = normalise(spec)
    return "udf" in spec or "expr" in spec


def source_name(name: str, spec: ColumnSpec) -> str:
    return normalise(spec).get("source_column", name)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def source_column(name: str, spec: ColumnSpec) -> Column:
    """The untouched source column behind an output column."""
    spec = normalise(spec)
    reference = quoted(source_name(name, spec))
    if spec.get("from"):
        reference = f"{quoted(spec['from'])}.{reference}"
    return F.col(reference)


def compile_column(name: str, spec: ColumnSpec, inputs: DataFrame | None = None) -> Column:
    """``udf`` wins over ``expr``, ``expr`` over the source column; ``cast`` applies to whatever
    won, so a declared type on a computed column is only enforced on request. ``on_bad="null"``
    turns unconvertible values into NULL instead of an error; knowing the ``inputs`` it is compiled
    for makes that cheaper."""
    spec = normalise(spec)
    if is_computed(spec):
        column = F.expr(spec["udf"] if "udf" in spec else spec["expr"])
    else:
        column = source_column(name, spec)
    if spec.get("cast") and "type" in spec:
        target = spark_type(spec["type"])
        if spec.get("on_bad") != "null":
            column = column.cast(target)
        elif inputs is None or is_computed(spec):
            column = column.try_cast(target)
        else:
            column = lenient_cast(column, inputs.select(column).schema[0].dataType, target)
    return column.alias(name)


def compile_columns(
    columns: dict[str, ColumnSpec], inputs: DataFrame | None = None
) -> list[Column]:
    """Columns in declared order; later ones may use earlier names as lateral aliases, and a source
    column of the same name wins."""
    return [compile_column(name, spec, inputs) for name, spec in columns.items()]
