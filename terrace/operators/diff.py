"""Keyed comparison of two snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators.columns import quoted


def _plain(value: Column, kind: T.DataType) -> Column:
    """The value with every map as its sorted entries; maps have no order."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _plain(v, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [_plain(value.getField(f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.struct(_plain(e["key"], kind.keyType).alias("key"), _plain(e["value"], kind.valueType).alias("value")),
        )
        return F.array_sort(entries, lambda a, b: _by_text(a["key"], b["key"]))
    return value


def _by_text(a: Column, b: Column) -> Column:
    a, b = F.to_json(F.struct(a)), F.to_json(F.struct(b))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def _digest(df: DataFrame, name: str, kind: T.DataType) -> Column:
    """64-bit hash of a value in the type both sides share. Hashing leaves out nulls inside of arrays and
    structs, so nested values are hashed as JSON that keeps them."""
    column = F.col(quoted(name))
    column = column if df.schema[name].dataType == kind else column.cast(kind)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        column = F.to_json(F.struct(_plain(column, kind).alias("v")), {"ignoreNullFields": "false"})
    return F.xxhash64(column)


def _common_types(old: DataFrame, new: DataFrame, names: Sequence[str]) -> dict[str, T.DataType]:
    """The type that Spark finds for both sides of each column; text where there is none."""
    found = {}
    for name in names:
        try:
            both = old.select(quoted(name)).unionByName(new.select(quoted(name)))
            found[name] = both.schema[name].dataType
        except AnalysisException:
            found[name] = T.StringType()
    return found


def snapshot_diff(
    old: DataFrame, new: DataFrame, keys: Sequence[str], keep_unchanged: bool = True
) -> DataFrame:
    """Keys with a status and the changed columns.

    ``added``/``removed`` keys exist on one side only; a key on both sides is ``unchanged`` when all
    its columns hold the same values, else ``modified``. Columns on one side only count as changed.
    A repeated key whose rows only differ as a whole is ``modified`` without naming a column.

    Values are hashed in the scan, and one aggregate replaces the join: each column keeps the signed
    sum of its hash halves, zero when both sides agree. It needs one shuffle of fixed-width rows, is
    combined per task first, so a hot key travels as one row per task, and compares repeated keys as
    multisets instead of pairing their rows.
    """
    shared = [c for c in old.columns if c in new.columns and c not in keys]
    kinds = _common_types(old, new, shared)
    one_sided = [c for c in [*old.columns, *new.columns] if (c in old.columns) != (c in new.columns)]

    def hashed(df: DataFrame, sign: int) -> DataFrame:
        digests = [_digest(df, c, kinds[c]) for c in shared]
        digests.append(F.xxhash64(*digests) if digests else F.lit(0).cast("long"))
        return df.select(
            *[F.col(quoted(k)) for k in keys],
            F.lit(sign).alias("__side"),
            *[d.alias(f"__h{i}") for i, d in enumerate(digests)],
        )

    side = F.col("__side")
    sums = []
    for i in range(len(shared) + 1):  # the last one stands for the whole row
        h = F.col(f"__h{i}")
        high, low = F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))
        sums += [F.sum(side * high).alias(f"__high{i}"), F.sum(side * low).alias(f"__low{i}")]
    grouped = (
        hashed(old, -1)
        .unionByName(hashed(new, 1))
        .groupBy(*[F.col(quoted(k)) for k in keys])
        .agg(
            F.count_if(side < 0).alias("__old"),
            F.count_if(side > 0).alias("__new"),
            *sums,
        )
    )
    both = (F.col("__old") > 0) & (F.col("__new") > 0)

    def differs(i: int) -> Column:
        return (F.col(f"__high{i}") != 0) | (F.col(f"__low{i}") != 0)

    differing = [F.when(differs(i), F.lit(c)) for i, c in enumerate(shared)]
    differing += [F.lit(c) for c in one_sided]
    changed = F.array_compact(F.array(*differing)) if differing else F.array().cast("array<string>")
    changed = F.when(both, changed).otherwise(F.array().cast("array<string>"))
    status = (
        F.when(F.col("__old") == 0, "added")
        .when(F.col("__new") == 0, "removed")
        .when((F.size("changed_columns") > 0) | differs(len(shared)), "modified")
        .otherwise("unchanged")
    )
    result = grouped.withColumn("changed_columns", changed).select(
        *[F.col(quoted(k)) for k in keys], status.alias("status"), "changed_columns"
    )
    return result if keep_unchanged else result.where("status <> 'unchanged'")


def diff_summary(diff: DataFrame) -> DataFrame:
    """Number of keys per status."""
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("keys"))
