"""Size checks in front of every broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Most bytes of rows that may be broadcast on request; Spark's own limit is 8 GB.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# Bytes of a row besides its values, at least.
ROW_BYTES = 16


def _width(field: T.StructField) -> Column:
    """Bytes of a value in a row, about."""
    column = F.col("`" + field.name.replace("`", "``") + "`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 8
    return F.lit(16 if isinstance(field.dataType, T.DecimalType) else 8)


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that a plan reads, or None where the session does not show its plans."""
    if not hasattr(df, "_jdf"):
        return None
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def measured_bytes(df: DataFrame, limit: int) -> int:
    """Bytes of the rows themselves, by a small job that stops once they are certainly more than ``limit``."""
    some = df.limit(limit // ROW_BYTES + 1)
    row = sum((_width(f) for f in df.schema.fields), F.lit(ROW_BYTES))
    return some.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Whether the rows are known to fit. Compressed files and estimates are no bound on them: what reads more than
    ``limit`` bytes is refused unseen, the rest is measured."""
    read = input_bytes(df)
    return (read is None or read <= limit) and measured_bytes(df, limit) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when it is known to be small; otherwise return it as it is, which
    leaves a shuffle join that AQE may still convert or split by what it measures."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df
