"""A whole model: sources, join, filter, columns, grouping and lineage in one lazy plan."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.columns import (
    compile_column, compile_columns, is_computed, normalise, source_name,
)
from terrace.operators.contracts import managed_frame
from terrace.operators.joins import join_sources
from terrace.operators.lineage import Run, column_entries, lineage_column
from terrace.sizing import BROADCAST_LIMIT_BYTES


def model_sources(spec: Mapping[str, Any]) -> dict[str, str]:
    """Alias to source name; a single source is its own alias."""
    if "sources" in spec:
        return dict(spec["sources"])
    return {spec["source"]: spec["source"]}


def build_model(
    name: str,
    spec: Mapping[str, Any],
    tables: Mapping[str, DataFrame],
    run: Run = Run(),
    udf_languages: Mapping[str, str] | None = None,
    lineage_mode: str | None = "full",
    all_columns: bool = False,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
    domain: str | None = None,
    domain_totals: Column | None = None,
) -> DataFrame:
    """The DataFrame a model specification describes.

    Keys: ``source`` or ``sources`` + ``join`` (one condition or one per later source),
    ``join_type``, ``broadcast``, ``salt`` (hot alias: buckets), ``where``, ``columns``, ``group_by``, ``version``,
    ``schema``, ``origin``. Expressions see the source columns first, then the outputs before them.
    ``lineage_mode=None`` leaves the ``_lineage`` column out; ``all_columns`` also lists the columns
    that pass through unchanged. ``domain`` is the SQL expression that tells the instances of a model apart;
    ``domain_totals`` repeats the totals of a model without grouping keys for the domains it explodes.
    """
    sources = model_sources(spec)
    frames = {alias: tables[source] for alias, source in sources.items()}
    for alias in spec.get("salt", {}):
        frames[alias] = _used_columns(frames[alias], spec)
    if len(frames) > 1:
        inputs = join_sources(
            frames,
            spec["join"],
            spec.get("join_type", "inner"),
            spec.get("broadcast", ()),
            spec.get("salt"),
            broadcast_limit,
        )
    else:
        (alias, frame), = frames.items()
        inputs = frame.alias(alias)
    if spec.get("where"):
        inputs = inputs.where(F.expr(spec["where"]))

    columns = spec["columns"]
    selected = compile_columns(columns, inputs)
    grouped = "group_by" in spec
    lineage = []
    if lineage_mode is not None:
        available = [c for frame in frames.values() for c in frame.columns if c != "_lineage"]
        label = F.lit(name)
        if domain:
            label = F.concat(F.lit(f"{name}_"), F.col("domain") if grouped else F.expr(domain))
        lineage.append(
            lineage_column(
                label,
                list(sources.values()),
                run,
                column_entries(columns, available, udf_languages, grouped, all_columns),
                spec.get("origin"),
                lineage_mode,
                spec.get("version"),
                spec.get("schema", "default"),
            )
        )
    if not grouped:
        return inputs.select(*([F.expr(domain).alias("domain")] if domain else []), *selected, *lineage)

    keys = [_group_key(key, columns, inputs.columns) for key in spec["group_by"]]
    if domain_totals is not None:
        result = inputs.agg(*selected).withColumn("domain", domain_totals).select("domain", *columns)
        return result.select("*", *lineage)
    own = [F.expr(domain).alias("domain")] if domain else []
    hidden = [f"__key{i}" for i in range(len(keys))]
    result = inputs.groupBy(*own, *[k.alias(h) for k, h in zip(keys, hidden)]).agg(*selected).drop(*hidden)
    return result.select("*", *lineage)


def _used_columns(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """Only the columns the model names anywhere: a salt hashes whole rows and would keep the scan
    from leaving the others out."""
    texts = [spec.get("where", ""), *spec.get("group_by", [])]
    texts += [spec["join"]] if isinstance(spec["join"], str) else spec["join"]
    for name, raw in spec["columns"].items():
        column = normalise(raw)
        texts += [column.get("udf", ""), column.get("expr", ""), source_name(name, column)]
    words = set(re.findall(r"\w+", " ".join(texts).lower()))
    return df.select(*[c for c in df.columns if c.lower() in words or not re.fullmatch(r"\w+", c)])


def _group_key(key: str, columns: Mapping[str, Any], available: list[str]) -> Column:
    """A grouping key is a source expression, or the name of an output; a source column wins."""
    if key in columns:
        spec = normalise(columns[key])
        if key not in available or (spec.get("from") and not is_computed(spec)):
            return compile_column(key, spec)
    return F.expr(key)


def build_models(
    specs: Mapping[str, Mapping[str, Any]], tables: Mapping[str, DataFrame], **options: Any
) -> dict[str, DataFrame]:
    """Build models in the order given, each seeing the ones before it; nothing runs yet. A model
    that says ``managed_by`` is filled elsewhere: it is taken from ``tables``, or empty and typed."""
    built = dict(tables)
    for name, spec in specs.items():
        if not spec.get("managed_by"):
            built[name] = build_model(name, spec, built, **options)
        elif name not in built:
            session = next(iter(built.values())).sparkSession
            built[name] = managed_frame(session, spec["columns"])
    return {name: built[name] for name in specs}
