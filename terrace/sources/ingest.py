"""Loading landing files once each, tracked in a manifest.

A batch is a partition of its own, named by the run or by the stream's checkpoint and number, and counts only
once the manifest, written last, names it. So a run that breaks off leaves nothing that is read, and runs or streams
of one feed cannot replace each other's rows. If two of them load the same file at once, the batch that entered it
first is the one whose rows are read.

Rows that break the contract are kept beside the good ones, with what is wrong and the values as they came: one scan
and one write for both.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.casts import lenient_cast
from terrace.operators.columns import ColumnSpec, quoted
from terrace.operators.contracts import SHOWN_ROWS, conform, contract_schema, require_valid, with_errors
from terrace.operators.lineage import Run
from terrace.session import checkpoint
from terrace.sources.checksums import RANGE_BYTES, content_checksums
from terrace.sources.tables import overwrite_partitions, read_table, read_table_or_none, write_table

# Manifest columns and types, the batch keys, and the shape of the ingest lineage.
MANIFEST_DDL = (
    "file_path string, file_name string, model_name string, domain string, file_format string, "
    "row_count bigint, file_size_bytes bigint, checksum string, ingested_at timestamp, status string"
)
BATCH_KEYS = ("_feed", "_batch")
PARTITIONS = (*BATCH_KEYS, "_bad")
STORED_MANIFEST_DDL = f"{MANIFEST_DDL}, rejected_count bigint, _feed int, _batch string"
CORRUPT = "_corrupt"
INGEST_SCHEMA_VERSION = "3"

# Files of one batch, hence paths the driver holds at a time. More files make more batches.
FILES_PER_BATCH = 10_000


@dataclass(frozen=True)
class Feed:
    """One row of the ingestion configuration."""

    config_id: int
    target_model: str
    volume_name: str
    file_regex: str = ".*"
    file_format: str = "csv"
    has_header: bool | None = True
    delimiter: str | None = ","
    source_name: str = ""

    def read_options(self) -> dict[str, Any]:
        options: dict[str, Any] = {}
        if self.file_format == "csv":
            if self.has_header is not None:
                options["header"] = self.has_header
            if self.delimiter:
                options["sep"] = self.delimiter
            options["enforceSchema"] = not self.has_header  # a header that differs is an error
        return options


def active_feeds(config: DataFrame) -> list[Feed]:
    """Feeds to run. The configuration is small by nature: it drives one read per row."""
    rows = config.where("active AND ingest_type = 'volume'").orderBy("config_id").collect()
    return [
        Feed(
            r["config_id"], r["target_model"], r["volume_name"], r["file_regex"],
            r["file_format"] or "csv", r["has_header"], r["delimiter"], r["source_name"],
        )
        for r in rows
    ]


def source_path() -> Column:
    """The path of the file a row was read from. Spark encodes it like a URL, unlike listings."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


@contextmanager
def few_tasks(spark: SparkSession) -> Iterator[None]:
    """While listing files, keep Spark from cutting the scan by file sizes: contents are not read, so
    a task per 128 MB of them would be wasted."""
    key = "spark.sql.files.maxPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, 2 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def list_files(spark: SparkSession, volume: str | list[str]) -> DataFrame:
    """Files directly in a folder, or those given: file_path, file_name, file_size_bytes. Contents are not read."""
    listing = spark.read.format("binaryFile").load(volume)
    return listing.select(
        F.col("path").alias("file_path"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("file_size_bytes"),
    )


def new_files(files: DataFrame, feed: Feed, manifest: DataFrame | None) -> DataFrame:
    """Files whose name matches the feed's pattern somewhere and that it has not loaded yet."""
    matching = files.where(F.col("file_name").rlike(feed.file_regex))
    if manifest is None:
        return matching
    loaded = manifest.where(F.col("_feed") == feed.config_id).select("file_path")
    return matching.join(loaded, "file_path", "left_anti")


def ingest_lineage(model: str, path: Column | str, source_type: str, run: Run) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.struct(
        F.lit(INGEST_SCHEMA_VERSION).alias("schema_version"),
        F.lit(model).alias("model"),
        path.alias("source_path"),
        F.lit(source_type).alias("source_type"),
        F.date_format(run.now(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ingested_at"),
    ).alias("_lineage")


def append_with_lineage(
    df: DataFrame,
    table: str,
    model: str,
    path: Column | str = "",
    source_type: str = "volume",
    mode: str = "append",
    columns: Mapping[str, ColumnSpec] | None = None,
    run: Run = Run(),
) -> None:
    """Write rows with the ingest lineage; with ``columns`` every row is validated before."""
    if columns is not None:
        df = conform(require_valid(df, columns, model), columns)
    write_table(df.withColumn("_lineage", ingest_lineage(model, path, source_type, run)), table, mode)


def checked_rows(raw: DataFrame, columns: Mapping[str, ColumnSpec]) -> DataFrame:
    """Rows in the contract's types, values that cannot be converted as NULL, with ``_errors`` (what a row breaks),
    ``_raw`` (a broken row as it came, as JSON) and ``_bad`` (1 for a broken row). No shuffle."""
    names = [c for c in raw.columns if c not in ("_lineage", CORRUPT)]
    errors = F.col("_errors")
    if CORRUPT in raw.columns:
        errors = F.when(F.col(CORRUPT).isNotNull(), F.array_append(errors, "malformed row")).otherwise(errors)
    marked = with_errors(raw, columns).withColumn("_errors", errors)
    bad = F.size("_errors") > 0
    typed = [
        (lenient_cast(F.col(quoted(f.name)), raw.schema[f.name].dataType, f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in contract_schema(columns).fields
    ]
    return marked.select(
        *typed,
        "_lineage",
        F.when(bad, F.col("_errors")).alias("_errors"),
        F.when(bad, F.to_json(F.struct(*[quoted(n) for n in names]))).alias("_raw"),
        bad.cast("int").alias("_bad"),
    )


def text_schema(feed: Feed, columns: Mapping[str, ColumnSpec]) -> str | None:
    """The schema that reads every value as text and marks lines of another shape; None where files bring types."""
    if feed.file_format == "parquet":
        return None
    return ", ".join(f"{quoted(c)} string" for c in [*columns, CORRUPT])


def load_files(
    spark: SparkSession,
    paths: list[str],
    feed: Feed,
    columns: Mapping[str, ColumnSpec] | None,
    run: Run,
    invalid: str,
) -> DataFrame:
    """Rows of all given files in one scan, each naming the file it came from, good and broken ones. With
    ``invalid="trust"`` nothing is looked at and the first malformed value is an error."""
    options, schema = feed.read_options(), None
    if columns is not None and feed.file_format != "parquet":
        if invalid == "trust":
            schema = contract_schema(columns)
            options["mode"] = "FAILFAST"
        else:
            schema = text_schema(feed, columns)
            options["columnNameOfCorruptRecord"] = CORRUPT
    reader = spark.read.format(feed.file_format).options(**options)
    rows = (reader if schema is None else reader.schema(schema)).load(paths)
    rows = rows.select("*", ingest_lineage(feed.target_model, source_path(), "volume", run))
    if columns is not None and invalid != "trust":
        return checked_rows(rows, columns)
    if columns is not None:
        rows = conform(rows, columns, keep=("_lineage",))
    none = {"_errors": F.lit(None).cast("array<string>"), "_raw": F.lit(None).cast("string"), "_bad": F.lit(0)}
    return rows.withColumns(none)


def write_batch(rows: DataFrame, target: str, feed: Feed, batch: str) -> DataFrame | None:
    """Write a batch in place of what an earlier attempt at it has left, and read it back; None without rows."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_feed={feed.config_id}/_batch={batch}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    keyed = rows.withColumns({"_feed": F.lit(feed.config_id), "_batch": F.lit(batch)})
    overwrite_partitions(keyed, target, PARTITIONS)
    written = read_table_or_none(spark, target, keyed.schema)
    return None if written is None else written.where((F.col("_feed") == feed.config_id) & (F.col("_batch") == batch))


def refuse_invalid(written: DataFrame | None, feed: Feed) -> None:
    """Raise when a written batch has broken rows, quoting the first few."""
    if written is None:
        return
    bad = written.where("_bad = 1")
    total = bad.count()
    if total:
        shown = [f"  {', '.join(r['_errors'])}" for r in bad.select("_errors").limit(SHOWN_ROWS).collect()]
        raise ValueError("\n".join([f"{total} invalid rows in '{feed.target_model}':", *shown]))


INVALID = ("reject", "error", "trust")  # fixed values: what happens to rows that break the contract


def ingest_feed(
    spark: SparkSession,
    feed: Feed,
    volumes: str,
    tables: str,
    columns: Mapping[str, ColumnSpec] | None = None,
    domain: str | None = None,
    run: Run = Run(),
    invalid: str = "reject",
    files_per_batch: int = FILES_PER_BATCH,
    checksum: str = "path",
    range_bytes: int = RANGE_BYTES,
) -> int:
    """Load a feed's new files and return how many there were.

    ``volumes`` holds the landing folders, ``tables`` the target tables and ``file_manifest``. The folder is listed
    once; jobs per batch do not depend on the number of files. Rows that break the contract are kept aside
    (``read_rejected``); with ``invalid="error"`` a batch that has any is not loaded, with ``"trust"`` values are
    not checked before they are read. ``checksum="content"`` digests file contents of any length, in ranges of
    ``range_bytes``, instead of paths.
    """
    if invalid not in INVALID:
        raise ValueError(f"unknown way with invalid rows: {invalid!r}")
    target, manifest_path = f"{tables}/{feed.target_model}", f"{tables}/file_manifest"
    manifest = read_table_or_none(spark, manifest_path, STORED_MANIFEST_DDL)
    try:
        files = list_files(spark, f"{volumes}/{feed.volume_name}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return 0
        raise
    with few_tasks(spark):
        waiting = checkpoint(new_files(files, feed, manifest))
    total = waiting.count()
    slices = math.ceil(total / files_per_batch)
    for k in range(slices):
        chosen = waiting.where(F.pmod(F.xxhash64("file_path"), F.lit(slices)) == k)
        listed = chosen.collect()  # about files_per_batch rows
        if not listed:
            continue
        batch, paths = f"run-{uuid.uuid4().hex}", [f["file_path"] for f in listed]
        written = write_batch(load_files(spark, paths, feed, columns, run, invalid), target, feed, batch)
        if invalid == "error":
            refuse_invalid(written, feed)
        batch_files = spark.createDataFrame(listed, files.schema)
        if checksum == "content":
            batch_files = batch_files.join(content_checksums(batch_files, range_bytes), "file_path")
        else:
            batch_files = batch_files.withColumn("checksum", F.md5("file_path"))
        publish(manifest_entries(batch_files, written, feed, domain, run), manifest_path, feed, batch)
    return total


def publish(entries: DataFrame, manifest: str, feed: Feed, batch: str) -> None:
    """Enter a batch in the manifest, from when on its rows are read."""
    keys = {"_feed": F.lit(feed.config_id), "_batch": F.lit(batch)}
    overwrite_partitions(entries.withColumns(keys), manifest, BATCH_KEYS)


def manifest_entries(
    files: DataFrame, written: DataFrame | None, feed: Feed, domain: str | None, run: Run
) -> DataFrame:
    """One manifest row per file, counted from the written batch; an empty file counts zero rows."""
    none = F.lit(0).cast("long")
    if written is None:
        counted = files.withColumns({"rows": none, "bad": none})
    else:
        counts = written.groupBy(F.col("_lineage.source_path").alias("file_path")).agg(
            F.count_if(F.col("_bad") == 0).alias("rows"), F.count_if(F.col("_bad") == 1).alias("bad")
        )
        counted = files.join(counts, "file_path", "left")
    return counted.select(
        "file_path",
        "file_name",
        F.lit(feed.target_model).alias("model_name"),
        F.lit(domain).cast("string").alias("domain"),
        F.lit(feed.file_format).alias("file_format"),
        F.coalesce("rows", none).alias("row_count"),
        "file_size_bytes",
        "checksum",
        run.now().alias("ingested_at"),
        F.when(F.coalesce("bad", none) > 0, "PARTIAL").otherwise("SUCCESS").alias("status"),
        F.coalesce("bad", none).alias("rejected_count"),
    )


def _published(spark: SparkSession, tables: str, model: str, bad: int) -> DataFrame:
    manifest = read_table(spark, f"{tables}/file_manifest", STORED_MANIFEST_DDL).where(F.col("model_name") == model)
    finished = manifest.select(*BATCH_KEYS).distinct()
    rows = read_table(spark, f"{tables}/{model}").where(F.col("_bad") == bad).join(finished, list(BATCH_KEYS), "left_semi")
    first = F.min(F.struct("ingested_at", "_batch"))["_batch"].alias("winner")
    winners = manifest.groupBy("_feed", "file_path").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    late = manifest.join(winners, ["_feed", "file_path"]).where("_batch <> winner").select(*BATCH_KEYS, "file_path")
    if late.isEmpty():
        return rows
    same = [rows["_feed"] == late["_feed"], rows["_batch"] == late["_batch"], F.col("_lineage.source_path") == late["file_path"]]
    return rows.join(late, same, "left_anti")


def read_ingested(spark: SparkSession, tables: str, model: str) -> DataFrame:
    """Good rows of finished batches: those the manifest knows. Batches are partitions, so others are not read."""
    return _published(spark, tables, model, 0).drop("_errors", "_raw", "_bad")


def read_rejected(spark: SparkSession, tables: str, model: str) -> DataFrame:
    """Rows of finished batches that break the contract: ``_errors``, ``_raw``, lineage and batch."""
    return _published(spark, tables, model, 1).select("_errors", "_raw", "_lineage", *BATCH_KEYS)


def ingest_all(
    spark: SparkSession,
    config: DataFrame,
    volumes: str,
    tables: str,
    contracts: Mapping[str, Mapping[str, ColumnSpec]] | None = None,
    **options: Any,
) -> dict[int, int]:
    """Run every active feed; the result maps config ids to files loaded."""
    return {
        feed.config_id: ingest_feed(
            spark, feed, volumes, tables, (contracts or {}).get(feed.target_model), **options
        )
        for feed in active_feeds(config)
    }
