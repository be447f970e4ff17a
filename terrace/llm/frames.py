"""Shared small helpers: Arrow passes over text columns that keep the other columns, bounded slices of a batch."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrace.session import checkpoint, scratch_path

#: Bytes of text that a Python worker unpacks at a time. A longer text makes a slice of its own and is never cut.
SLICE_BYTES = 4 << 20
#: The same where whole texts get new columns: what is made of a slice can take fifty times its bytes.
COLUMN_BYTES = 1 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, unless their PYTHONPATH has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    context = spark.sparkContext
    if context.applicationId in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    # staged beside the driver, whose file server hands it to all executors
    path = os.path.join(tempfile.mkdtemp(prefix="terrace-"), "terrace.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "terrace")):
            for name in names:
                if name.endswith(".py"):
                    archive.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Lets an execution remove its shuffle files at its end, instead of when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in the shared folder; the shuffle files that led to it go at once.

    A join with a settled side deals both sides plainly, so that AQE can split a hot key of the other one.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        return checkpoint(df)
    finally:
        conf.set(_CLEANUP, before)


#: Rows of a file of a table whose rows are known to be few.
FILE_ROWS = 250_000


class Scratch:
    """Intermediate tables in the shared folder, compressed, each of which goes when nothing reads it any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, scratch_path(spark, "scratch")

    def keep(self, name: str, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``df`` written and read again; the shuffle files that led to it go at once.

        Where ``rows`` bounds its rows, few rows are written in few files, not in one for each partition. The plan, the
        broadcasts and the task binaries of the job are garbage on the driver then, much of it in blocks of megabytes;
        they are collected at once, or its heap grows by those of many small jobs.
        """
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        conf = self.spark.conf
        before = conf.get(_CLEANUP)
        conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(f"{self.folder}/{name}")
        finally:
            conf.set(_CLEANUP, before)
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables, or all of them; what was made of them must have been kept by then."""
        for name in names or ("",):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def without(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` without the columns an operator is about to add, in any spelling Spark takes for the same."""
    taken = {n.lower() for n in names}
    return docs.drop(*[c for c in docs.columns if c.lower() in taken])


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``docs`` has a column that Spark takes for the same."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``most`` bytes of ``column``."""
    values = batch.column(column)
    values = values.field(0) if pa.types.is_struct(values.type) else values  # a text with what belongs to it
    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for row, length in enumerate(lengths):
        if size and size + length > most:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += int(length) + 16
    if start < batch.num_rows:
        yield batch.slice(start)


def add_columns(docs: DataFrame, column: str, added: str, make: Callable[[list], list[list]]) -> DataFrame:
    """``docs`` with the columns of the DDL ``added``; columns of the same names are replaced.

    ``make`` gets the values of ``column`` of some rows and returns one list for each new column.
    """
    ship(docs.sparkSession)
    fields = StructType.fromDDL(added)
    source = without(docs, [n for n in fields.names if n.lower() != column.lower()])
    schema = StructType(source.schema.fields + fields.fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            for rows in slices(batch, column, COLUMN_BYTES):
                made = make(rows.column(column).to_pylist())
                arrays = [*rows.columns, *(pa.array(v, kinds.field(f.name).type) for v, f in zip(made, fields.fields))]
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return source.mapInArrow(run, schema)


def texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with null texts as empty ones."""
    return docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
