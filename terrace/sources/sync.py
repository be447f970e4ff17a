"""Repeatable incremental copies by a high-water mark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.operators.columns import quoted
from terrace.operators.lineage import Run
from terrace.sources.tables import overwrite_partitions, read_table, read_table_or_none


def incremental_sync(
    source: DataFrame,
    target: str,
    log: str,
    column: str,
    partition_by: Sequence[str] = (),
    run: Run = Run(),
) -> int:
    """Copy rows of ``column`` beyond the last mark, and return how many there were.

    Rows with the mark's own value, and rows without a value (null or NaN), may come later than others of the
    same value: those are compared with what is copied already, as multisets, and what is new is copied too.
    The rows of a run form one batch, entered in ``log`` at the end. A run after an interrupted one removes all
    of its batch first; until then ``read_synced``, which shows entered batches only, leaves it out.
    """
    spark = source.sparkSession
    kind = source.schema[column].dataType
    log_schema = (
        T.StructType()
        .add("high_water", kind)
        .add("rows", "long")
        .add("synced_at", "timestamp")
        .add("_batch", "integer")
    )
    marks = read_table_or_none(spark, log, log_schema)
    rows, batch, name = source, 1, F.col(quoted(column))
    without = name.isNull() | F.isnan(name) if isinstance(kind, (T.FloatType, T.DoubleType)) else name.isNull()
    stored_schema = T.StructType([*source.schema.fields, T.StructField("_batch", T.IntegerType())])
    if marks is not None:
        last = marks.agg(F.max("_batch").alias("batch"), F.max("high_water").cast("string").alias("mark")).first()
        batch = last["batch"] + 1
        again, beyond = without, F.lit(False)
        if last["mark"] is not None:
            mark = F.lit(last["mark"]).cast(kind)
            again, beyond = without | (name == mark), ~without & (name > mark)
        copied = read_synced(spark, target, log, stored_schema).select(*[quoted(c) for c in source.columns])
        rows = source.where(beyond).unionAll(source.where(again).exceptAll(copied.where(again)))
    _remove(spark, f"{target}/_batch={batch}")
    overwrite_partitions(rows.withColumn("_batch", F.lit(batch)), target, ("_batch", *partition_by))
    written = read_table_or_none(spark, target, stored_schema)
    if written is None:
        return 0
    mark = written.where(F.col("_batch") == batch).agg(
        F.max(F.when(~without, name)).alias("high_water"), F.count(F.lit(1)).alias("rows")
    )
    count = mark.first()["rows"]
    if count:
        entry = mark.select(
            "high_water", "rows", run.now().alias("synced_at"), F.lit(batch).alias("_batch")
        )
        overwrite_partitions(entry, log, ("_batch",))
    return count


def _remove(spark: SparkSession, path: str) -> None:
    """Delete the folder of an unfinished batch, whatever partitions it has."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_synced(spark: SparkSession, target: str, log: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of the batches that the log has entered."""
    entered = read_table(spark, log).select("_batch").distinct()
    return read_table(spark, target, schema).join(entered, "_batch", "left_semi")
