"""Declared type names to Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Accepted type names and their Spark types.
NAMED_TYPES = {
    "string": T.StringType(),
    "varchar": T.StringType(),
    "char": T.StringType(),
    "text": T.StringType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "smallint": T.ShortType(),
    "tinyint": T.ByteType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "real": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "datetime": T.TimestampType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "binary": T.BinaryType(),
    "decimal": T.DecimalType(10, 0),
    "numeric": T.DecimalType(10, 0),
}

_SIZED = re.compile(r"^(decimal|numeric|varchar|char)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)$")


def spark_type(declared: str | T.DataType) -> T.DataType:
    """Spark type of a declared type; precision, scale and bigint range are kept, and an unknown
    name is an error."""
    if isinstance(declared, T.DataType):
        return declared
    text = declared.strip().lower()
    if text in NAMED_TYPES:
        return NAMED_TYPES[text]
    sized = _SIZED.match(text)
    if sized:
        if sized[1] in ("varchar", "char"):
            return T.StringType()
        return T.DecimalType(int(sized[2]), int(sized[3] or 0))
    if text.startswith(("struct<", "array<", "map<")):
        return T.DataType.fromDDL(declared)
    raise ValueError(f"unknown type: {declared!r}")
