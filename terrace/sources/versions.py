"""Stored tables as immutable versions behind one pointer.

A version is a table of its own that nothing changes once it is complete. The name readers use is a view on one
version, and publishing replaces that view: one entry of the catalog changes, no data is moved, and whoever reads in
the meantime sees the old version or the new one. What was current before stays readable under ``previous_name``.
A version that was written but never published, because a run broke off, is removed by a later publication.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from terrace.operators.columns import quoted

#: Property of the view that names the version it shows.
PROPERTY = "terrace.version"


def full_name(table: str) -> str:
    return ".".join(quoted(part) for part in table.split("."))


def previous_name(table: str) -> str:
    """The view of the version before the current one."""
    return f"{table}_v_previous"


def current_version(spark: SparkSession, table: str) -> str | None:
    """The table behind the name, or None when the name is not a pointer."""
    if not spark.catalog.tableExists(table) or spark.catalog.getTable(table).tableType != "VIEW":
        return None
    rows = spark.sql(f"SHOW TBLPROPERTIES {full_name(table)}").where(f"key = '{PROPERTY}'").collect()
    return rows[0]["value"] if rows else None


def new_version(table: str) -> str:
    """A name that sorts behind those of all earlier versions."""
    return f"{table}__v{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}_{uuid.uuid4().hex[:8]}"


def write_version(df: DataFrame, table: str, partition_by: Iterable[str] = ()) -> str:
    """Write ``df`` as a version that nobody reads yet, and return its name."""
    version = new_version(table)
    df.write.mode("errorifexists").format("parquet").partitionBy(*partition_by).saveAsTable(version)
    return version


def drop_version(spark: SparkSession, version: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {full_name(version)}")


def _point(spark: SparkSession, name: str, version: str) -> None:
    spark.sql(
        f"CREATE OR REPLACE VIEW {full_name(name)} TBLPROPERTIES ('{PROPERTY}' = '{version}') "
        f"AS SELECT * FROM {full_name(version)}"
    )


def publish(spark: SparkSession, table: str, version: str, keep_previous: bool = True) -> None:
    """Make ``version`` the table. A plain table of that name becomes the version before it, once."""
    before = current_version(spark, table)
    if before is None and spark.catalog.tableExists(table):
        before = f"{table}__v0_{uuid.uuid4().hex[:8]}"
        spark.sql(f"ALTER TABLE {full_name(table)} RENAME TO {full_name(before)}")
    if before and keep_previous:
        _point(spark, previous_name(table), before)
    _point(spark, table, version)
    shown = current_version(spark, previous_name(table))
    _clean(spark, table, version, [before, shown])


def _clean(spark: SparkSession, table: str, version: str, kept: list[str | None]) -> None:
    """Remove older versions but those to keep: what a pointer shows, and what a reader may have begun with. Later
    ones may be about to be published."""
    for name in versions(spark, table):
        if name.lower() < version.lower() and name.lower() not in {(k or "").lower() for k in kept}:
            drop_version(spark, name)


def versions(spark: SparkSession, table: str) -> list[str]:
    """All versions of a table in the catalog, oldest first."""
    database, _, name = table.rpartition(".")
    where = f" IN {full_name(database)}" if database else ""
    found = spark.sql(f"SHOW TABLES{where} LIKE '{name}__v*'").where("NOT isTemporary").collect()
    names = sorted(r["tableName"] for r in found if r["tableName"].startswith(f"{name}__v".lower()))
    return [f"{database}.{n}" if database else n for n in names]
