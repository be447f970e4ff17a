"""Scans and sinks: catalog tables by name, or parquet folders by path."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators.columns import ColumnSpec
from terrace.operators.contracts import contract_schema, managed_frame
from terrace.operators.lineage import LINEAGE_DDL, SCHEMA_VERSION, Run, upgrade_lineage
from terrace.operators.quarantine import quarantined
from terrace.sources.versions import current_version, previous_name, publish, write_version

FILE_FORMATS = ("csv", "json", "parquet")  # fixed values: landing formats without extra jars


def is_path(table: str) -> bool:
    return "/" in table


def read_table(spark: SparkSession, table: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Scan a catalog table, or a parquet folder when ``table`` is a path. A known schema saves
    looking into the folder's files for it."""
    if not is_path(table):
        return spark.table(table)
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(table)


def read_table_or_none(
    spark: SparkSession, table: str, schema: T.StructType | str | None = None
) -> DataFrame | None:
    """The table, or None while nothing was written to it."""
    try:
        return read_table(spark, table, schema)
    except AnalysisException as error:
        if error.getCondition() in (
            "PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA",
        ):
            return None
        raise


def read_seed(spark: SparkSession, path: str | list[str], columns: Mapping[str, ColumnSpec]) -> DataFrame:
    """Headered CSV with declared columns; a malformed value is an error when its row is read."""
    schema = contract_schema(columns)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_files(
    spark: SparkSession,
    paths: str | list[str],
    file_format: str = "csv",
    columns: Mapping[str, ColumnSpec] | None = None,
    **options: Any,
) -> DataFrame:
    """One scan over any number of landing files. Without declared columns Spark derives names
    (CSV columns are strings then)."""
    if file_format not in FILE_FORMATS:
        raise ValueError(f"unknown file format: {file_format!r}")
    reader = spark.read.format(file_format).options(**options)
    if columns is not None:
        reader = reader.schema(contract_schema(columns))
    return reader.load(paths)


def run_sql(spark: SparkSession, query: str, **arguments: Any) -> DataFrame:
    """SQL as a source. DataFrame arguments are named ``{like_this}`` in the text, other values too
    and are passed as literals, never spliced in."""
    return spark.sql(query, **arguments)


def write_table(
    df: DataFrame,
    table: str,
    mode: str = "overwrite",
    partition_by: Iterable[str] = (),
    rebalance: bool = False,
) -> None:
    """Write a table. Overwriting a catalog table goes through ``replace_table``, so that a plan may
    read the table it replaces.

    Partitioned writes are not shuffled by default: every task writes a file per partition value, and
    a value that holds most rows stays spread over all tasks. ``rebalance`` shuffles by the partition
    columns first, which makes fewer, larger files; AQE splits values that are too large for a task.
    """
    partition_by = list(partition_by)
    if rebalance:
        df = df.hint("rebalance", *partition_by)
    if mode == "overwrite" and not is_path(table):
        replace_table(df, table, keep_previous=False, partition_by=partition_by)
        return
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if is_path(table):
        writer.parquet(table)
    else:
        writer.format("parquet").saveAsTable(current_version(df.sparkSession, table) or table)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Iterable[str]) -> None:
    """Replace just the partitions present in ``df``; running it twice leaves the same rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partition_by
    ).parquet(path)


def create_managed_table(
    spark: SparkSession, table: str, columns: Mapping[str, ColumnSpec], lineage: bool = False
) -> None:
    """Create an empty, typed table when there is none; an existing one keeps its rows."""
    if read_table_or_none(spark, table) is None:
        write_table(managed_frame(spark, columns, lineage), table, mode="errorifexists")


def create_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def replace_table(
    df: DataFrame, table: str, keep_previous: bool = True, partition_by: Iterable[str] = ()
) -> None:
    """Write a new version and make it the table.

    The current version is readable until then, and afterwards stays available as ``previous_name(table)`` unless
    ``keep_previous`` is off. The plan may read the table that it replaces.
    """
    publish(df.sparkSession, table, write_version(df, table, partition_by), keep_previous)


def read_previous(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(previous_name(table))


def quarantine_name(table: str) -> str:
    return f"{table}_quarantine"


def materialise(
    df: DataFrame, name: str, spec: Mapping[str, Any], run: Run = Run()
) -> DataFrame:
    """Make a built model readable by name: a view by default, a table when the model says so, with
    the version before it kept. Rows breaking its quarantine rule are copied to a table beside it,
    read back from what was just written. A model of many domains is partitioned by domain."""
    if spec.get("materialized", "view") == "view":
        stored = create_view(df, name)
    else:
        replace_table(df, name, partition_by=["domain"] if "domain" in df.columns else [])
        stored = df.sparkSession.table(name)
    if spec.get("quarantine"):
        bad = quarantined(stored, spec["quarantine"], name, run)
        replace_table(bad, quarantine_name(name), keep_previous=False)
    return stored


def migrate_lineage(spark: SparkSession, table: str) -> bool:
    """Bring a stored table's ``_lineage`` to the current shape and say whether that was needed. The
    check reads one field; only a table with stale rows is rewritten, beside itself."""
    stored = spark.table(table)
    current = stored.schema["_lineage"].dataType.simpleString() == LINEAGE_DDL
    stale = F.coalesce(F.col("_lineage.schema_version") != SCHEMA_VERSION, F.lit(True))
    if current and stored.where(stale).isEmpty():
        return False
    replace_table(upgrade_lineage(stored), table)
    return True
