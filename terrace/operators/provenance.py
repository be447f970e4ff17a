"""Where columns come from: recorded when models are stored, or read back from ``_lineage`` structs in rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from terrace.operators.columns import normalise
from terrace.operators.lineage import Entry, Run, column_entries
from terrace.plans.model import build_model
from terrace.session import checkpoint
from terrace.sources.tables import overwrite_partitions, read_table
from terrace.sources.versions import publish, write_version

EDGE_COLUMNS = ("target_model", "target_column", "op", "expression", "source_model", "source_column")


def _recorded(df: DataFrame) -> DataFrame:
    """The distinct lineage descriptions in a table. Run-time values are dropped before the shuffle,
    so a table of any size shrinks to a few rows per task."""
    entries = F.transform(
        F.col("_lineage.columns"),
        lambda c: F.struct(
            c["name"].alias("name"),
            c["op"].alias("op"),
            c["expression"].alias("expression"),
            F.array_sort(F.map_keys(c["inputs"])).alias("inputs"),
        ),
    )
    return df.select(
        F.col("_lineage.model").alias("target_model"),
        F.col("_lineage.sources").alias("sources"),
        F.col("_lineage.git_commit").alias("git_commit"),
        F.col("_lineage.deployed_at").alias("deployed_at"),
        entries.alias("entries"),
    ).distinct()


def _recorded_once(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The descriptions of all tables, a few rows per model, checkpointed: tables are scanned once
    however often the descriptions are used."""
    return checkpoint(reduce(DataFrame.unionByName, [_recorded(df) for df in tables.values()]))


def _edges(recorded: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    spark = recorded.sparkSession
    words = F.regexp_extract_all(F.col("entry.expression"), F.lit(r"([A-Za-z_]\w*)"))
    names = F.transform("entry.inputs", lambda i: F.element_at(F.split(i, r"\."), -1))
    # as in _records_itself
    computed = ~F.col("entry.op").isin("PASSTHROUGH", "CAST") & (F.col("entry.inputs") == F.array("entry.name"))
    names = F.when((F.col("entry.op") == "AGGREGATION") | computed, words).otherwise(names)
    candidates = (
        recorded.select("*", F.explode("entries").alias("entry"))
        .withColumn("source_column", F.explode(F.array_distinct(names)))
        .withColumn("target_column", F.col("entry.name"))
        .withColumn("op", F.col("entry.op"))
        .withColumn("expression", F.col("entry.expression"))
    )
    known = [(model, c) for model, df in tables.items() for c in df.columns if c != "_lineage"]
    schemas = spark.createDataFrame(known, "source_model string, source_column string")
    upstream = candidates.withColumn("source_model", F.explode(F.split("sources", ", ")))
    unknown = ~F.col("source_model").isin(list(tables)) & (F.col("op") != "AGGREGATION")
    found = upstream.join(schemas, ["source_model", "source_column"], "left_semi").select(*EDGE_COLUMNS).distinct()
    # what no known source has may be an output of the same model, used as a lateral alias, unless that output is made
    # of a source column of its own name, which expressions see first
    key = ["target_model", "target_column", "source_column"]
    named = candidates.where("source_column = target_column").select("target_model", "source_column").distinct()
    own = (
        candidates.withColumn("source_model", F.col("target_model"))
        .where("source_column <> target_column")
        .join(named, ["target_model", "source_column"], "left_anti")
        .join(schemas, ["source_model", "source_column"], "left_semi")
        .join(found, key, "left_anti")
        .select(*EDGE_COLUMNS)
    )
    assumed = upstream.where(unknown).join(own, key, "left_anti").select(*EDGE_COLUMNS)
    return found.unionByName(own).unionByName(assumed).distinct()


def lineage_edges(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per (output column, input column) pair the tables' rows record.

    Build the models with ``all_columns=True``, or columns that pass through leave no edge. An input
    belongs to the sources that have a column of that name; sources whose tables are not given are
    assumed to have it.
    """
    return _edges(_recorded_once(tables), tables)


def provenance_registry(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The edges with the commit and time that recorded them, for an append-only audit table."""
    recorded = _recorded_once(tables)
    runs = recorded.select("target_model", "git_commit", "deployed_at").distinct()
    edges = _edges(recorded, tables).select(
        "target_model", "target_column", "source_model", "source_column"
    )
    return edges.distinct().join(runs, "target_model")


def trace_column(edges: DataFrame, model: str, column: str) -> DataFrame:
    """Everything ``model.column`` was computed from, with the number of steps back to it.

    Edges describe models, not rows, so this is small work: one join per step until a step finds no
    new column. Each step is checkpointed: it is used several times, and plans stay short.
    """
    edges = checkpoint(edges)
    start = edges.where((F.col("target_model") == model) & (F.col("target_column") == column))
    reached = checkpoint(start.withColumn("depth", F.lit(1)))
    frontier = reached
    depth = 1
    while not frontier.isEmpty():
        depth += 1
        heads = frontier.select(
            F.col("source_model").alias("target_model"), F.col("source_column").alias("target_column")
        ).distinct()
        step = edges.join(heads, ["target_model", "target_column"]).select(*EDGE_COLUMNS)
        frontier = checkpoint(
            step.join(reached, list(EDGE_COLUMNS), "left_anti").withColumn("depth", F.lit(depth))
        )
        reached = reached.unionByName(frontier)
    return reached


# What the registry holds of each input of each output column of a stored model.
REGISTRY_DDL = (
    "target_model string, target_column string, op string, expression string, source_model string, "
    "source_column string, model_rows bigint, git_commit string, deployed_at string, recorded_at timestamp"
)


def _records_itself(op: str, name: str, inputs: Sequence[str]) -> bool:
    """Values of groups have no single input, so aggregates and what is computed of them record their own output;
    what they are made of is looked up in their expressions."""
    return op == "AGGREGATION" or (op not in ("PASSTHROUGH", "CAST") and list(inputs) == [name])


def _inputs(entry: Entry, sources: Mapping[str, str], schemas: Mapping[str, Sequence[str]], own: Sequence[str]) -> list[tuple[str, str]]:
    """The (model, column) pairs an entry names. A name with an alias belongs to its source; others to every source
    that has such a column, or else to an earlier output of the model itself."""
    names = list(entry.inputs)
    if _records_itself(entry.op, entry.name, names):
        names = re.findall(r"(?:[A-Za-z_]\w*\.)?[A-Za-z_]\w*", entry.expression)
    found: dict[tuple[str, str], None] = {}
    for name in names:
        alias, _, column = name.rpartition(".")
        having = [m for a, m in sources.items() if column in schemas[m] and alias in ("", a)]
        if not having and column in own and column != entry.name:
            having = [""]
        found.update({(m, column): None for m in having})
    return list(found)


def model_edges(
    name: str, spec: Mapping[str, Any], tables: Mapping[str, DataFrame], udf_languages: Mapping[str, str] | None = None
) -> list[tuple[str, str, str, str, str, str]]:
    """The edges of a model from its specification and the schemas of its sources; no row is read."""
    sources = dict(spec["sources"]) if "sources" in spec else {spec["source"]: spec["source"]}
    schemas = {m: [c for c in tables[m].columns if c != "_lineage"] for m in sources.values()}
    available = list(dict.fromkeys(c for columns in schemas.values() for c in columns))
    entries = column_entries(spec["columns"], available, udf_languages, "group_by" in spec, True)
    edges, own = [], []
    for entry in entries:
        column = normalise(spec["columns"][entry.name])
        pairs = _inputs(entry, sources, schemas, own)
        if entry.op in ("PASSTHROUGH", "CAST") and column.get("from"):
            pairs = [(sources[column["from"]], c) for _, c in pairs[:1]]
        edges += [(name, entry.name, entry.op, entry.expression, m or name, c) for m, c in pairs]
        own.append(entry.name)
    return edges


def store_models(
    specs: Mapping[str, Mapping[str, Any]],
    tables: Mapping[str, DataFrame],
    registry: str,
    run_key: str,
    run: Run = Run(),
    database: str = "default",
    udf_languages: Mapping[str, str] | None = None,
    **options: Any,
) -> dict[str, int]:
    """Build and store models in the order given and enter where their columns come from in the registry; the rows of
    each.

    Each model reads the stored ones before it, so none is computed twice; ``tables`` are the other sources. Rows are
    counted while they are written. The registry is a parquet folder that only grows: a partition for each run, and a
    repeated run replaces its own. ``options`` go to ``build_model``.
    """
    spark = next(iter(tables.values())).sparkSession
    known, edges, counts = dict(tables), [], {}
    for name, spec in specs.items():
        counted = Observation()
        built = build_model(name, spec, known, run, udf_languages, **options)
        table = f"{database}.{name}"
        publish(spark, table, write_version(built.observe(counted, F.count(F.lit(1)).alias("rows")), table))
        counts[name] = counted.get["rows"]
        edges += [(*edge, counts[name]) for edge in model_edges(name, spec, known, udf_languages)]
        known[name] = spark.table(table)
    schema = ", ".join(REGISTRY_DDL.split(", ")[:7])
    entries = spark.createDataFrame(edges, schema).withColumns(
        {"git_commit": F.lit(run.git_commit), "deployed_at": F.lit(run.deployed_at), "recorded_at": run.now(), "_run": F.lit(run_key)}
    )
    overwrite_partitions(entries, registry, ("_run",))
    return counts


def read_registry(spark: SparkSession, registry: str, run_key: str | None = None) -> DataFrame:
    """All entries, or those of one run; runs are partitions."""
    entries = read_table(spark, registry)
    return entries if run_key is None else entries.where(F.col("_run") == run_key)


def trace_recorded(entries: DataFrame, model: str, column: str) -> DataFrame:
    """Everything ``model.column`` was computed from, with the number of steps back to it, by one recursive query over
    the registry's entries of a run."""
    view = f"terrace_entries_{uuid.uuid4().hex}"
    entries.select(*EDGE_COLUMNS, "model_rows").distinct().createOrReplaceTempView(view)
    return entries.sparkSession.sql(
        f"""
        WITH RECURSIVE reached AS (
            SELECT *, 1 AS depth FROM {view} WHERE target_model = :model AND target_column = :column
            UNION ALL
            SELECT e.*, r.depth + 1 FROM {view} e JOIN reached r
              ON e.target_model = r.source_model AND e.target_column = r.source_column)
        SELECT target_model, target_column, op, expression, source_model, source_column, model_rows, min(depth) AS depth
        FROM reached GROUP BY ALL
        """,
        args={"model": model, "column": column},
    )
