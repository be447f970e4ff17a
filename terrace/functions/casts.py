"""Lenient casts that stay cheap on bad data.

``try_cast`` raises and catches an exception inside the task for many of the values it turns into
NULL, some fifty times the cost of a good value. Values that certainly fail are sorted out with a
comparison first; whatever is left is decided by ``try_cast`` itself, so results are the same.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits of the integer types, and the texts Spark reads as booleans.
INTEGER_BITS = {T.ByteType(): 8, T.ShortType(): 16, T.IntegerType(): 32, T.LongType(): 64}
BOOLEAN_TEXT = r"(?i)^[\s\p{Cntrl}]*(t|true|y|yes|1|f|false|n|no|0)[\s\p{Cntrl}]*$"
NOT_IN_INTEGERS = r"[^0-9+\-\s\p{Cntrl}]"


def _hopeless(column: Column, source: T.DataType, target: T.DataType) -> Column | None:
    """A cheap condition that only holds for values the cast cannot convert, or None."""
    if isinstance(source, T.StringType):
        if target in INTEGER_BITS:
            return column.rlike(NOT_IN_INTEGERS)
        if isinstance(target, T.BooleanType):
            return ~column.rlike(BOOLEAN_TEXT)
        return None
    if not isinstance(source, T.NumericType):
        return None
    if target in INTEGER_BITS:
        limit = 2 ** (INTEGER_BITS[target] - 1)
    elif isinstance(target, T.DecimalType):
        limit = 10 ** (target.precision - target.scale)
    else:
        return None
    if isinstance(source, (T.FloatType, T.DoubleType)):
        # doubles are compared one part in 2^40 beyond the limit: rounding near it is not decided here
        beyond = F.lit(float(limit) * (1 + 2.0**-40) + 1)
        return (column.cast("double") >= beyond) | (column.cast("double") <= -beyond)
    if limit >= 10**37:
        return None
    beyond = F.lit(Decimal(limit) + 1).cast(f"decimal({len(str(limit + 1))},0)")
    return (column >= beyond) | (column <= -beyond)


def lenient_cast(column: Column, source: T.DataType, target: T.DataType) -> Column:
    """``column`` as ``target``, NULL where that is impossible."""
    hopeless = _hopeless(column, source, target)
    converted = column.try_cast(target)
    return converted if hopeless is None else F.when(~hopeless, converted)


def unconvertible(column: Column, source: T.DataType, target: T.DataType) -> Column:
    """True for values that the cast would turn into NULL."""
    return column.isNotNull() & lenient_cast(column, source, target).isNull()
