"""The ``_lineage`` struct every modelled row carries."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators.columns import ColumnSpec, is_computed, normalise, quoted, source_name

# The struct's version and its field names and types.
SCHEMA_VERSION = "4"
ORIGIN_DDL = "struct<type:string,path:string,endpoint:string,format:string,loaded_at:timestamp>"
COLUMNS_DDL = "array<struct<name:string,expression:string,op:string,inputs:map<string,string>>>"
LINEAGE_DDL = (
    "struct<schema_version:string,model:string,sources:string,git_commit:string,"
    "deployed_at:string,compute_type:string,contract_id:string,version:string,"
    f"lineage_mode:string,origin:{ORIGIN_DDL},columns:{COLUMNS_DDL}>"
)

# Where a source's data may come from.
ORIGIN_TYPES = ("seed", "volume_file", "api", "webscraper", "external_table", "python_process")

# The operation label of a function by its language.
UDF_OPS = {"sql": "SQL_UDF", "python": "PYTHON_UDF", "pandas": "PANDAS_UDF"}

MODES = ("full", "lightweight")


@dataclass(frozen=True)
class Run:
    """What is the same for all rows of one deployment. ``as_of`` replaces the clock, so that a
    rerun gives the same rows."""

    git_commit: str = "unknown"
    deployed_at: str = ""
    compute_type: str = "serverless"
    as_of: datetime | None = None

    def now(self) -> Column:
        """A naive ``as_of`` is read in the session's time zone."""
        return F.current_timestamp() if self.as_of is None else F.lit(str(self.as_of)).cast("timestamp")


@dataclass(frozen=True)
class Entry:
    """Lineage of one output column: ``inputs`` maps a label to the column holding its value."""

    name: str
    expression: str
    op: str
    inputs: Mapping[str, str]


_STRING = re.compile(r"'(?:[^'\\]|\\.|'')*'")
_NAME = re.compile(r"(?<![\w.`])(?:(?P<alias>[A-Za-z_]\w*)\.)?(?P<name>[A-Za-z_]\w*)\b(?!\s*\()(?!\.)")


def referenced_columns(expression: str, available: Iterable[str]) -> list[str]:
    """Names in ``expression`` that are available columns, in order of first use. Literals, function
    names and keywords drop out because they are not columns of the source."""
    known = {c.lower(): c for c in available}
    found: dict[str, None] = {}
    for match in _NAME.finditer(_STRING.sub("''", expression)):
        name = match["name"].lower()
        if name in known:
            found[f"{match['alias']}.{known[name]}" if match["alias"] else known[name]] = None
        elif match["alias"] and match["alias"].lower() in known:  # a field of a struct column
            found[known[match["alias"].lower()]] = None
    return list(found)


def operation(spec: ColumnSpec, udf_languages: Mapping[str, str] | None = None) -> str:
    """The operation label of an output column."""
    spec = normalise(spec)
    if "udf" in spec:
        language = (udf_languages or {}).get(spec["udf"].split("(")[0].strip())
        return UDF_OPS.get(language, "SQL_UDF") if language else "EXTERNAL_UDF"
    if "expr" in spec:
        text = spec["expr"].strip().lower()
        if re.match(r"(count|sum|avg|min|max)\(", text):
            return "AGGREGATION"
        return "CASE" if text.startswith("case ") else "EXPRESSION"
    return "CAST" if spec.get("cast") else "PASSTHROUGH"


def column_entries(
    columns: Mapping[str, ColumnSpec],
    available: Sequence[str],
    udf_languages: Mapping[str, str] | None = None,
    aggregated: bool = False,
    include_passthrough: bool = False,
) -> list[Entry]:
    """Entries of the derived columns, and of passed-through ones on request.

    Inputs are the source columns an expression names; ``inputs`` in the specification overrides
    them. In an aggregated model a group has no single input value, so the values recorded are those
    of the outputs: of the column itself, or of the outputs a later column is computed from.
    """
    entries = []
    seen: list[str] = []
    for name, raw in columns.items():
        spec = normalise(raw)
        op = operation(spec, udf_languages)
        if is_computed(spec):
            expression = spec["udf"] if "udf" in spec else spec["expr"]
            if aggregated:
                names = [] if op == "AGGREGATION" else referenced_columns(expression, seen)
                inputs = {n: n for n in names or [name]}
            else:
                inputs = {n: n for n in referenced_columns(expression, [*available, *seen])}
            if "inputs" in spec:
                inputs = {n: n for n in spec["inputs"]}
        else:
            expression = source_name(name, spec)
            if spec.get("from"):
                expression = f"{spec['from']}.{expression}"
            inputs = {expression: name if aggregated else expression}
            if op == "CAST":
                expression = f"cast({expression} as {spec.get('type', 'string')})"
        seen.append(name)
        if op != "PASSTHROUGH" or include_passthrough:
            entries.append(Entry(name, expression, op, inputs))
    return entries


def origin_struct(origin: Mapping[str, str] | None, run: Run) -> Column:
    """Where a source came from; a typed NULL when unknown."""
    if not origin:
        return F.lit(None).cast(T.DataType.fromDDL(ORIGIN_DDL))
    kind = origin.get("type", "unknown")
    if kind not in (*ORIGIN_TYPES, "unknown"):
        raise ValueError(f"unknown origin type: {kind!r}")
    return F.struct(
        F.lit(kind).alias("type"),
        *[F.lit(origin.get(key, "")).alias(key) for key in ("path", "endpoint", "format")],
        run.now().alias("loaded_at"),
    )


def _dotted(name: str) -> str:
    return ".".join(quoted(part) for part in name.split("."))


def entries_array(entries: Sequence[Entry], mode: str) -> Column:
    """``full`` records each input's value as text, ``lightweight`` only its name; without entries
    the array is NULL."""
    if not entries:
        return F.lit(None).cast(T.DataType.fromDDL(COLUMNS_DDL))
    structs = []
    for entry in entries:
        pairs: list[Column] = []
        for label, column in entry.inputs.items():
            value = F.col(_dotted(column)).cast("string") if mode == "full" else F.lit(label)
            pairs += [F.lit(label), value]
        inputs = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        structs.append(
            F.struct(
                F.lit(entry.name).alias("name"),
                F.lit(entry.expression).alias("expression"),
                F.lit(entry.op).alias("op"),
                inputs.alias("inputs"),
            )
        )
    return F.array(*structs)


def lineage_column(
    model: str | Column,
    sources: Sequence[str],
    run: Run = Run(),
    entries: Sequence[Entry] = (),
    origin: Mapping[str, str] | None = None,
    mode: str = "full",
    version: str | None = None,
    schema: str = "default",
) -> Column:
    """The ``_lineage`` struct as a column over a model's inputs and outputs."""
    if mode not in MODES:
        raise ValueError(f"unknown lineage mode: {mode!r}")
    model = F.lit(model) if isinstance(model, str) else model
    return F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        model.alias("model"),
        F.lit(", ".join(sources)).alias("sources"),
        F.lit(run.git_commit).alias("git_commit"),
        F.lit(run.deployed_at).alias("deployed_at"),
        F.lit(run.compute_type).alias("compute_type"),
        F.concat(F.lit(f"{schema}."), model).alias("contract_id"),
        F.lit(version or "v1").alias("version"),
        F.lit(mode).alias("lineage_mode"),
        origin_struct(origin, run).alias("origin"),
        entries_array(entries, mode).alias("columns"),
    ).alias("_lineage")


def with_lineage(df: DataFrame, model: str, sources: Sequence[str], **options: Any) -> DataFrame:
    """Append ``_lineage`` to a finished DataFrame; see ``lineage_column`` for the options."""
    return df.withColumn("_lineage", lineage_column(model, sources, **options))


def data_challenge(df: DataFrame, model: str, column: str, condition: str) -> DataFrame:
    """Which run, code version and sources produced the values of ``column`` in the rows asked for."""
    fields = ("model", "sources", "git_commit", "deployed_at", "compute_type", "contract_id",
              "version", "schema_version")
    return df.where(F.expr(condition)).select(
        F.lit(model).alias("challenged_model"),
        F.lit(column).alias("challenged_column"),
        *[F.col(f"_lineage.{f}").alias(f"_lineage_{f}") for f in fields],
        F.col(quoted(column)).alias("challenged_value"),
    )


def upgrade_lineage(df: DataFrame) -> DataFrame:
    """Bring ``_lineage`` of older shapes to the current one, row by row and without a shuffle.

    Rows already current keep their values; others get defaults for what they lack. Fields that the
    stored struct does not have at all become their defaults too.
    """
    stored = {f.name: f.dataType for f in df.schema["_lineage"].dataType.fields}

    def field(name: str, default: Any, ddl: str = "string") -> Column:
        target = T.DataType.fromDDL(ddl)
        missing = F.lit(default).cast(target)
        return F.coalesce(F.col(f"_lineage.{name}"), missing) if name in stored else missing

    if "columns" not in stored:
        columns = F.lit(None).cast(T.DataType.fromDDL(COLUMNS_DDL))
    else:
        known = stored["columns"].elementType.names
        columns = F.transform(
            F.col("_lineage.columns"),
            lambda c: F.struct(
                *[
                    (c[n] if n in known else F.lit(None).cast("string")).alias(n)
                    for n in ("name", "expression", "op")
                ],
                (c["inputs"] if "inputs" in known else F.lit(None).cast("map<string,string>")).alias(
                    "inputs"
                ),
            ),
        )
    upgraded = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        field("model", "").alias("model"),
        field("sources", "").alias("sources"),
        field("git_commit", "unknown").alias("git_commit"),
        field("deployed_at", "").alias("deployed_at"),
        field("compute_type", "serverless").alias("compute_type"),
        field("contract_id", "").alias("contract_id"),
        field("version", "v1").alias("version"),
        field("lineage_mode", "full").alias("lineage_mode"),
        field("origin", None, ORIGIN_DDL).alias("origin"),
        columns.alias("columns"),
    )
    return df.withColumn("_lineage", upgraded)
