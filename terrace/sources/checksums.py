"""Checksums of file contents, large files in ranges that are digested side by side."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a range, and bytes read at a time.
RANGE_BYTES, READ_BYTES = 64 << 20, 4 << 20


def content_checksums(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file_path`` and ``checksum`` for ``files`` (``file_path``, ``file_size_bytes``).

    The checksum is the SHA-256 of the SHA-256 digests (lowercase hex, one behind the other) of all ranges of
    ``range_bytes``. Ranges of one file are read by different tasks; a file of any length is possible. The folder must be
    reachable under the same name for Spark and for pyarrow.
    """

    def run(batches):
        for batch in batches:
            digests = []
            for path, offset in zip(batch.column("file_path").to_pylist(), batch.column("offset").to_pylist()):
                store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
                digest, left = hashlib.sha256(), range_bytes
                with store.open_input_file(name) as source:
                    source.seek(offset)
                    while left and (data := source.read(min(left, READ_BYTES))):
                        digest.update(data)
                        left -= len(data)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("file_path"), batch.column("offset"), pa.array(digests, pa.string())], names=["file_path", "offset", "digest"])

    last = F.greatest(F.col("file_size_bytes") - 1, F.lit(0))
    ranges = files.select("file_path", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(range_bytes).cast("long"))).alias("offset"))
    digests = ranges.repartition("file_path", "offset").mapInArrow(run, "file_path string, offset long, digest string")
    in_order = F.array_sort(F.collect_list(F.struct("offset", "digest")))["digest"]
    return digests.groupBy("file_path").agg(F.sha2(F.concat_ws("", in_order), 256).alias("checksum"))
