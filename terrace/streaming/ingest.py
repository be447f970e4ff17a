"""The file feed as a stream: the same tables and manifest, files tracked by Spark's checkpoint."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrace.operators.columns import ColumnSpec
from terrace.operators.contracts import contract_schema
from terrace.operators.lineage import Run
from terrace.sources.ingest import (
    CORRUPT, FILES_PER_BATCH, INVALID, STORED_MANIFEST_DDL, Feed, checked_rows, few_tasks, ingest_lineage,
    list_files, manifest_entries, publish, refuse_invalid, source_path, text_schema, write_batch,
)
from terrace.sources.tables import read_table_or_none


def stream_name(checkpoint: str) -> str:
    """What names the batches of a checkpoint: a digest of its whole path, so no two share one."""
    return f"stream-{hashlib.sha256(checkpoint.rstrip('/').encode()).hexdigest()}"


def stream_feed(
    spark: SparkSession,
    feed: Feed,
    volumes: str,
    tables: str,
    columns: Mapping[str, ColumnSpec],
    checkpoint: str,
    domain: str | None = None,
    run: Run = Run(),
    files_per_batch: int = FILES_PER_BATCH,
    invalid: str = "reject",
) -> StreamingQuery:
    """Load all files that neither this checkpoint nor the manifest knows, then stop.

    Micro-batches are named by the checkpoint and their number, so they never replace a batch of a run or of another
    checkpoint; a repeated micro-batch replaces its own partition, and a restart adds no row twice. Rows that break
    the contract are kept aside as in ``ingest_feed``. Files without rows get no manifest entry here."""
    if invalid not in INVALID:
        raise ValueError(f"unknown way with invalid rows: {invalid!r}")
    target, manifest_path = f"{tables}/{feed.target_model}", f"{tables}/file_manifest"
    checks = invalid != "trust" and feed.file_format != "parquet"
    reader = spark.readStream.format(feed.file_format).options(**feed.read_options()).option("maxFilesPerTrigger", files_per_batch)
    if checks:
        reader = reader.schema(text_schema(feed, columns)).option("columnNameOfCorruptRecord", CORRUPT)
    else:
        reader = reader.schema(contract_schema(columns)).option("mode", "FAILFAST")
    volume = f"{volumes}/{feed.volume_name}"
    name = F.element_at(F.split(source_path(), "/"), -1)
    rows = reader.load(volume).where(name.rlike(feed.file_regex))
    rows = rows.select("*", ingest_lineage(feed.target_model, source_path(), "volume", run))
    own = stream_name(checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        session, key = batch.sparkSession, f"{own}-{number:010d}"
        manifest = read_table_or_none(session, manifest_path, STORED_MANIFEST_DDL)
        if manifest is not None:
            others = manifest.where((F.col("_feed") == feed.config_id) & (F.col("_batch") != key))
            known = others.select(F.col("file_path").alias("_known")).distinct()
            batch = batch.join(known, F.col("_lineage.source_path") == F.col("_known"), "left_anti")
        written = write_batch(checked_rows(batch, columns), target, feed, key)
        if invalid == "error":
            refuse_invalid(written, feed)
        # the files of a micro-batch, at most files_per_batch
        paths = [] if written is None else [r[0] for r in written.select("_lineage.source_path").distinct().collect()]
        if not paths:
            return
        files = list_files(session, paths).withColumn("checksum", F.md5("file_path"))
        with few_tasks(session):
            publish(manifest_entries(files, written, feed, domain, run), manifest_path, feed, key)

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
