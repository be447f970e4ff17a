"""One model for many domains, as one plan with a ``domain`` column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.operators.columns import quoted
from terrace.operators.joins import join_type
from terrace.plans.model import build_model, model_sources

DOMAIN = "domain"


def union_domains(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Stack per-domain tables and say in ``domain`` where each row is from."""
    tagged = [df.withColumn(DOMAIN, F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, tagged)


def is_domain_table(df: DataFrame) -> bool:
    return DOMAIN in df.columns


def instance_name(model: str, domain: str) -> str:
    return f"{model}_{domain}"


def domain_instance(df: DataFrame, domain: str) -> DataFrame:
    """One domain's rows; on a table partitioned by ``domain`` only its files are read."""
    return df.where(F.col(DOMAIN) == domain).drop(DOMAIN)


def _input(
    alias: str,
    spec: Mapping[str, Any],
    tables: Mapping[str, DataFrame],
    domains: Sequence[str],
) -> DataFrame:
    """The rows an alias stands for over all domains. A domain may bring its own source; the others
    use the model's. A shared table stays without a ``domain`` column."""
    default = model_sources(spec)[alias]
    own = {}
    for domain in domains:
        override = spec.get("domain_sources", {}).get(domain)
        if isinstance(override, str) and "source" in spec:
            own[domain] = override
        elif isinstance(override, Mapping) and alias in override:
            own[domain] = override[alias]
    if not own:
        table = tables[default]
        return table.where(F.col(DOMAIN).isin(list(domains))) if is_domain_table(table) else table

    def rows(domain: str) -> DataFrame:
        table = tables[own.get(domain, default)]
        return domain_instance(table, domain) if is_domain_table(table) else table

    return union_domains({domain: rows(domain) for domain in domains})


def replicated(df: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Every row once for each domain."""
    return df.withColumn(DOMAIN, F.explode(F.array(*[F.lit(d) for d in domains])))


def build_domain_model(
    name: str,
    spec: Mapping[str, Any],
    tables: Mapping[str, DataFrame],
    domains: Sequence[str],
    **options: Any,
) -> DataFrame:
    """All instances of a model in one plan, with the rows that building each domain by itself would give.

    ``domain`` joins the join conditions of domain tables and the grouping keys; a shared table joins without
    it, and is only repeated for each domain where a join keeps its rows without a match. Totals without
    grouping keys have a row for every domain, also for one without rows. A model with ``domain: False`` is
    built once and has no such column. When no input knows domains, every domain gets all rows.
    """
    if spec.get("domain", True) is False:
        return build_model(name, spec, tables, **options)
    aliases = list(model_sources(spec))
    frames = {alias: _input(alias, spec, tables, domains) for alias in aliases}
    kinds = _per_join(spec.get("join_type", "inner"), aliases)
    conditions = _per_join(spec.get("join", ""), aliases)
    while True:
        tagged = {alias for alias in aliases if is_domain_table(frames[alias])}
        repeat, joins, domain = _domain_joins(aliases, kinds, conditions, tagged)
        if not repeat:
            break
        frames.update({alias: replicated(frames[alias], domains) for alias in repeat})

    combined = dict(spec)
    combined.pop("source", None)
    combined["sources"] = {alias: alias for alias in aliases}
    if len(aliases) > 1:
        combined["join"] = joins
    built = build_model(name, combined, frames, domain=domain, **options)
    if spec.get("group_by") != []:
        return built
    nothing = {alias: df.where(F.lit(False)) for alias, df in frames.items()}
    label = F.explode(F.array(*[F.lit(d) for d in domains]))
    empty = build_model(name, {**combined, "where": "false"}, nothing, domain=domain, domain_totals=label, **options)
    # a domain's own totals win over those of no rows
    both = built.withColumn("__own", F.lit(1)).unionByName(empty.withColumn("__own", F.lit(0)))
    columns = F.struct(*[F.col(quoted(c)) for c in built.columns if c != DOMAIN])
    return both.groupBy(DOMAIN).agg(F.max_by(columns, "__own").alias("__row")).select(DOMAIN, "__row.*")


def _per_join(value: str | Sequence[str], aliases: Sequence[str]) -> list[str]:
    return [value] * (len(aliases) - 1) if isinstance(value, str) else list(value)


def _domain_joins(
    aliases: Sequence[str], kinds: Sequence[str], conditions: Sequence[str], tagged: set[str]
) -> tuple[list[str], list[str], str]:
    """Shared sources to repeat for each domain first, or else the join conditions with domains and the SQL
    expression of a joined row's domain."""
    domain = f"{quoted(aliases[0])}.{DOMAIN}" if aliases[0] in tagged else None
    result = []
    for position, (alias, kind, condition) in enumerate(zip(aliases[1:], kinds, conditions), start=1):
        kind, own = join_type(kind), f"{quoted(alias)}.{DOMAIN}"
        if domain is None and alias in tagged:
            if kind not in ("inner", "right"):  # the join keeps shared rows, for each domain by itself
                return list(aliases[:position]), [], ""
            domain = own
        elif domain is not None and alias not in tagged:
            if kind in ("right", "full"):
                return [alias], [], ""
        elif domain is not None:
            condition = f"({condition}) AND {domain} = {own}"
            domain = own if kind == "right" else f"coalesce({domain}, {own})" if kind == "full" else domain
        result.append(condition)
    return ([], result, domain) if domain else ([aliases[0]], [], "")


def split_by_rule(df: DataFrame, rules: Mapping[str, str], default: str | None = None) -> DataFrame:
    """Assign each row of a shared table the first domain whose predicate holds, in one pass. Rows
    without one get ``default``, or NULL, so none is lost."""
    branches = F
    if not rules:
        return df.withColumn(DOMAIN, F.lit(default).cast("string"))
    for domain, predicate in rules.items():
        branches = branches.when(F.expr(predicate), F.lit(domain))
    return df.withColumn(DOMAIN, branches.otherwise(F.lit(default)))
