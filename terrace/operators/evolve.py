"""Schema changes applied to stored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from terrace.functions.casts import lenient_cast, unconvertible
from terrace.operators.columns import compile_column, normalise, quoted
from terrace.sources.versions import drop_version, publish, write_version
from terrace.types import spark_type

Change = Mapping[str, Any]


def _add(df: DataFrame, name: str, raw: Any) -> DataFrame:
    spec = normalise(raw)
    if "expr" in spec or "udf" in spec:
        return df.withColumn(name, compile_column(name, spec))
    return df.withColumn(name, F.lit(None).cast(spark_type(spec.get("type", "string"))))


def apply_change(df: DataFrame, change: Change) -> DataFrame:
    """Add, then remove, rename and retype. Names that are not there are left alone; a renamed
    column keeps its place."""
    for name, spec in change.get("add_columns", {}).items():
        df = _add(df, name, spec)
    df = df.drop(*change.get("remove_columns", []))
    renames = {a: b for a, b in change.get("rename_columns", {}).items() if a in df.columns}
    df = df.withColumnsRenamed(renames)
    for name, target in change.get("change_type", {}).items():
        if name in df.columns:
            column, kind = F.col(quoted(name)), spark_type(target.get("to", "string"))
            if target.get("on_bad") == "null":
                df = df.withColumn(name, lenient_cast(column, df.schema[name].dataType, kind))
            else:
                df = df.withColumn(name, column.cast(kind))
    return df


def evolve(df: DataFrame, changes: Sequence[Change]) -> DataFrame:
    return reduce(apply_change, changes, df)


def evolve_tables(
    tables: Mapping[str, DataFrame], changes: Sequence[Change]
) -> dict[str, DataFrame]:
    """Apply changes that name their table in ``model``; an unknown table is an error."""
    result = dict(tables)
    for change in changes:
        if change["model"] not in result:
            raise ValueError(f"unknown table: {change['model']!r}")
        result[change["model"]] = apply_change(result[change["model"]], change)
    return result


def retype_losses(df: DataFrame, change: Change) -> DataFrame:
    """One row per retyped column: how many values its new type cannot hold. One scan."""
    targets = {n: t for n, t in change.get("change_type", {}).items() if n in df.columns}
    counts = []
    for name, target in targets.items():
        kind = spark_type(target.get("to", "string"))
        lost = unconvertible(F.col(quoted(name)), df.schema[name].dataType, kind)
        counts.append(
            F.struct(F.lit(name).alias("column"), F.count_if(lost).alias("unconvertible"))
        )
    if not counts:
        raise ValueError("the change retypes no column of this table")
    return df.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def with_losses(df: DataFrame, changes: Sequence[Change]) -> tuple[DataFrame, dict[str, str]]:
    """The evolved rows, in which values that a new type cannot hold are NULL, with a column that tells so for each
    retyped one; and which column each of those speaks of."""
    lost: dict[str, str] = {}
    for change in changes:
        rest = {k: v for k, v in change.items() if k != "change_type"}
        df = apply_change(df, rest)
        for name, target in change.get("change_type", {}).items():
            if name not in df.columns:
                continue
            kind, source = spark_type(target.get("to", "string")), df.schema[name].dataType
            mark = f"__lost_{len(lost)}"
            lost[mark] = name
            df = df.withColumn(mark, unconvertible(F.col(quoted(name)), source, kind))
            df = df.withColumn(name, lenient_cast(F.col(quoted(name)), source, kind))
    return df, lost


class LostValues(ValueError):
    """A change would lose values; ``counts`` says how many of which column."""

    def __init__(self, table: str, counts: Mapping[str, int]) -> None:
        self.counts = dict(counts)
        super().__init__(f"{table} stays as it is, values would be lost: {self.counts}")


def evolve_stored(
    spark: SparkSession, table: str, changes: Sequence[Change], allow_losses: bool = False,
    partition_by: Sequence[str] = (),
) -> dict[str, int]:
    """Apply changes to a stored table and return how many values each retyped column has lost.

    The next version is written and its losses are counted in the same pass. It is only published if nothing is
    lost, or on request; otherwise the table stays as it is and the version goes.
    """
    rows, lost = with_losses(spark.table(table), changes)
    counted = Observation()
    if lost:
        rows = rows.observe(counted, *[F.count_if(m).alias(m) for m in lost]).drop(*lost)
    version = write_version(rows, table, partition_by)
    counts: dict[str, int] = {}
    for mark, name in lost.items():
        counts[name] = counts.get(name, 0) + counted.get[mark]
    if any(counts.values()) and not allow_losses:
        drop_version(spark, version)
        raise LostValues(table, {n: c for n, c in counts.items() if c})
    publish(spark, table, version)
    return counts


def describe(df: DataFrame, changes: Sequence[Change]) -> list[str]:
    """What the changes would do, from the plan's schema alone; nothing is read or written."""
    lines = []
    for change in changes:
        after = apply_change(df, change)
        renames = {a: b for a, b in change.get("rename_columns", {}).items() if a in df.columns}
        before_types = {f.name: f.dataType.simpleString() for f in df.schema}
        after_types = {f.name: f.dataType.simpleString() for f in after.schema}
        named = {renames.get(n, n): t for n, t in before_types.items()}
        lines += [f"add column '{n}' {t}" for n, t in after_types.items() if n not in named]
        lines += [f"remove column '{n}'" for n in named if n not in after_types]
        lines += [f"rename '{a}' to '{b}'" for a, b in renames.items() if b in after_types]
        lines += [
            f"retype '{n}': {named[n]} to {t}"
            for n, t in after_types.items()
            if n in named and named[n] != t
        ]
        df = after
    return lines
