"""Registering SQL, Python and pandas functions from specifications."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from terrace.types import spark_type


def parameters(spec: dict[str, Any]) -> list[tuple[str, str]]:
    """Normalise ``{name, type}``, ``"name: type"`` and ``"name"`` (a string) to pairs."""
    pairs = []
    for param in spec.get("params", []):
        if isinstance(param, dict):
            pairs.append((param["name"], param["type"]))
        else:
            name, _, declared = param.partition(":")
            pairs.append((name.strip(), declared.strip() or "string"))
    return pairs


def python_callable(spec: dict[str, Any]) -> Callable:
    """The function of a Python or pandas specification: ``fn``, or source text in ``body`` that
    defines ``handler``."""
    if "fn" in spec:
        return spec["fn"]
    namespace: dict[str, Any] = {"__name__": "__main__"}
    exec(spec["body"], namespace)
    return namespace[spec["handler"]]


def register_udf(spark: SparkSession, name: str, spec: dict[str, Any]) -> None:
    """Make ``name`` callable from expressions of this session.

    A SQL body is inlined by the optimiser; Python runs in Arrow batches, pandas vectorised. Both
    are called through a SQL function, so that arguments are cast to the declared types first.
    """
    language = spec.get("language", "sql").lower()
    returns = spark_type(spec.get("returns", "string"))
    params = parameters(spec)
    if language == "sql":
        body = spec["body"].strip()
    elif language in ("python", "pandas"):
        make = F.pandas_udf if language == "pandas" else partial(F.udf, useArrow=True)
        spark.udf.register(f"{name}_{language}", make(python_callable(spec), returns))
        body = f"{name}_{language}({', '.join(p for p, _ in params)})"
    else:
        raise ValueError(f"unknown UDF language: {language!r}")
    signature = ", ".join(f"{p} {spark_type(t).simpleString()}" for p, t in params)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) "
        f"RETURNS {returns.simpleString()} RETURN ({body})"
    )


def register_udfs(spark: SparkSession, specs: dict[str, dict[str, Any]]) -> dict[str, str]:
    """Register every function and return the language of each, as lineage needs it."""
    for name, spec in specs.items():
        register_udf(spark, name, spec)
    return {name: spec.get("language", "sql").lower() for name, spec in specs.items()}


# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def clean_text(column: Column | str) -> Column:
    """Strip and lower-case inside the JVM; the preferred form of the Python function."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.btrim(column, F.lit(WHITESPACE)))


def content_hash(*columns: Column | str) -> Column:
    """SHA-256, as hex, of the columns as a JSON object. A shortened one is a label, not a key."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


# Thresholds and names of the loyalty tiers.
STANDARD_UDFS: dict[str, dict[str, Any]] = {
    "loyalty_tier": {
        "language": "sql",
        "returns": "string",
        "params": [{"name": "revenue", "type": "decimal(18,2)"}],
        "body": "CASE WHEN revenue >= 1000 THEN 'GOLD' WHEN revenue >= 500 THEN 'SILVER' "
        "ELSE 'BRONZE' END",
    },
    "clean_email": {
        "language": "python",
        "returns": "string",
        "params": ["raw_email: string"],
        "fn": lambda value: None if value is None else value.strip().lower(),
    },
    "average_score": {
        "language": "pandas",
        "returns": "double",
        "params": ["score_a: double", "score_b: double"],
        "handler": "mean_of_two",
        "body": "import pandas as pd\n"
        "def mean_of_two(score_a: pd.Series, score_b: pd.Series) -> pd.Series:\n"
        "    return (score_a + score_b) / 2\n",
    },
}
