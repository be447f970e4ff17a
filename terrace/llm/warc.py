"""WARC archives: a deterministic sharded writer and a reader that checks what it reads.

Writing, from a table of records (id, url, payload):

1. Equal rows are counted by id, url and digest of the payload, combined before the shuffle. Of equal payloads the
   record with the smallest id (then url, null last) is the response, all others revisit it.
2. These counts, without payloads, are range-sorted by (id, url, digest). A running sum of the bytes they will take
   cuts the order into shards. The sums of the partitions make it independent of how Spark has cut the ranges, so
   shards depend on the records alone. Copies of one row are dealt out in chunks, so no row is hot.
3. Payloads meet their counts in the shard: one shuffle. Before it a task drops the payloads that repeat a smaller
   key of its own, so copies travel once for each task at most, and revisits hold no payload.
4. A task writes a shard in order and rolls to the next file when the compressed bytes reach ``roll_bytes``. Every
   record is a gzip member of its own; headers, ids and digests are made anew from the payload, and a payload whose
   digest isn't the one that was counted is an error.
5. Files are written under temporary names that hold the attempt. Their manifest is a table that Spark commits, so
   lost or repeated attempts leave no rows in it. Then the files get their names, and a small file naming the
   manifest is put in place last: without it there is no archive, and readers only open what the manifest lists.

The same records give the same files, byte for byte, however often the job or parts of it ran. A path that holds an
archive is refused; what a broken run has left there is replaced or ignored.

Null payloads are empty ones. A null url has no target address; blanks and control characters in a url are written
in percent form and stay so when read. Null ids come last. Rows equal in id, url and payload are each a record; one
of them at most is the response. A payload of any length is one record in memory; an empty table makes an archive
without files. Other columns are not looked at, so their names may clash with any here.

Folders must be reachable under one name for Spark and for pyarrow (a mounted folder, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .frames import settled, ship, slices

#: Copies of one row that are written in a row; bytes of a shard at least and number of shards at most, which also
#: bounds the list of their first keys; compressed bytes of a file; payload bytes a reader passes on at a time.
COPIES, SHARD_BYTES, SHARDS, ROLL_BYTES, READ_BYTES = 1 << 16, 4 << 20, 10_000, 1 << 30, 4 << 20
#: Tasks that read an archive at most; each takes its files in turn.
READERS = 50_000
#: Bytes that a record's headers take at about, and payloads that a task remembers to drop their copies.
HEAD, SEEN = 700, 100_000
LEVEL = 6

# Fixed values of the format.
VERSION, BREAK = b"WARC/1.1", b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"

KEY = ["id", "url", "digest", "mark"]
PLANNED = "shard int, id long, url string, digest string, mark long, chunk long, copies long, size long, revisits boolean, first_id long, first_url string, payload string"
WRITTEN = "shard int, part int, name string, made string, records long, bytes long, digest string"
READ = (
    "record_id string, record_type string, id long, url string, date string, refers_to string, refers_to_id long, "
    "payload_bytes long, payload_digest string, payload binary"
)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def _sorted_key(row: tuple) -> tuple:
    """Python's order of (id, url, digest, mark, chunk) as Spark sorts it with nulls last."""
    number, url, *rest = row
    return number is None, number or 0, url is None, (url or "").encode(), *rest


def _order() -> list[Column]:
    return [F.col("id").asc_nulls_last(), F.col("url").asc_nulls_last(), F.col("digest"), F.col("mark"), F.col("chunk")]


def _planned(own: DataFrame, least: int) -> DataFrame:
    """Chunks of equal rows with what they revisit, and the bytes that they will take (``weight``)."""
    groups = settled(own.groupBy(*KEY, "size").agg(F.count("*").alias("n")))
    key = F.struct(F.col("id").isNull().alias("a"), "id", F.col("url").isNull().alias("b"), "url")
    many = groups.where(F.col("size") >= least).groupBy("digest", "mark").agg(F.sum("n").alias("all"), F.min(key).alias("first"))
    # settled, so that both sides of the join are dealt plainly and a hot payload can be split
    many = settled(many.where("all > 1").select("digest", "mark", F.lit(True).alias("known"), F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url")))
    joined = groups.join(many, ["digest", "mark"], "left")
    joined = joined.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    own_first = F.col("id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    copies = F.least(F.lit(COPIES), F.col("n") - F.col("chunk") * COPIES)
    responses = F.when(F.col("size") < least, copies).when(F.col("known").isNull() | (own_first & (F.col("chunk") == 0)), 1).otherwise(0)
    return joined.select(
        *KEY,
        "chunk",
        copies.alias("copies"),
        "size",
        F.col("known").isNotNull().alias("revisits"),
        "first_id",
        "first_url",
        (copies * HEAD + responses * F.col("size")).alias("weight"),
    )


def _sharded(planned: DataFrame, shard_bytes: int, shards: int) -> tuple[DataFrame, list[tuple], list[int]]:
    """The chunks in order with their shards, and the first key of each shard with its number."""
    ordered = planned.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    ordered = settled(ordered.withColumn("range", F.spark_partition_id()))
    sums = {r["range"]: r["bytes"] for r in ordered.groupBy("range").agg(F.sum("weight").alias("bytes")).collect()}
    size, offsets, total = max(shard_bytes, -(-sum(sums.values()) // shards)), {}, 0
    for number in sorted(sums):  # one for each partition
        offsets[number], total = total, total + sums[number]
    columns = PLANNED.removesuffix(", payload string")
    names = StructType.fromDDL(columns).names

    def run(batches):
        passed = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if passed is None:
                passed = offsets[batch.column("range")[0].as_py()]
            numbers, heads = [], []
            for weight in batch.column("weight").to_pylist():
                numbers.append(passed // size)
                heads.append(numbers[-1] != last)
                last, passed = numbers[-1], passed + weight
            arrays = [pa.array(numbers, pa.int32()), *(batch.column(c) for c in names[1:]), pa.array(heads, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "head"])

    numbered = settled(ordered.mapInArrow(run, StructType.fromDDL(f"{columns}, head boolean")))
    # a shard that goes on in the next range has another head there; the first one counts
    heads = {}
    for row in numbered.where("head").select("shard", *KEY, "chunk").collect():
        key = _sorted_key(tuple(row)[1:])
        heads[row["shard"]] = min(heads.get(row["shard"], key), key)
    begun = sorted((key, shard) for shard, key in heads.items())
    return numbered.drop("head"), [key for key, _ in begun], [shard for _, shard in begun]


def _dealt(own: DataFrame, first_keys: list[tuple], numbers: list[int], least: int) -> DataFrame:
    """Payloads with the shards that need them; of copies in a task the smallest key and what came before it."""
    kinds = to_arrow_schema(StructType.fromDDL(PLANNED))
    none = {c: None for c in kinds.names}

    def run(batches):
        seen: dict = {}
        for part in (rows for batch in batches for rows in slices(batch, "payload")):
            out = []
            for row in part.to_pylist():
                key = _sorted_key(tuple(row[c] for c in KEY))
                what = (row["digest"], row["mark"]) if row["size"] >= least else key
                if what in seen and seen[what] <= key:
                    continue
                if len(seen) >= SEEN:  # forgetting only sends some copies more
                    seen.clear()
                seen[what] = key
                begin = bisect_right(first_keys, (*key, 0)) - 1
                end = begin if row["size"] >= least else bisect_right(first_keys, (*key, 1 << 62)) - 1
                out.extend(none | row | {"shard": numbers[k], "chunk": -1} for k in range(begin, end + 1))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return own.select(*KEY, "size", "payload").mapInArrow(run, StructType.fromDDL(PLANNED))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(number: int | None, url: str | None, digest: str, mark: int, copy: int) -> str:
    """A name for a record that the record alone decides."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{number} {digest} {mark} {copy} {url}')}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record with its digest and length, compressed by itself; fields without a value are left out."""
    headers = [*headers, ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("Content-Length", len(block))]
    head = b"".join(f"{k}: {v}".encode() + BREAK for k, v in headers if v is not None)
    return gzip.compress(VERSION + BREAK + head + BREAK + block + 2 * BREAK, LEVEL, mtime=0)


class _Shard:
    """Files of one shard, written under temporary names."""

    def __init__(self, number: int, folder: str, attempt: int, roll_bytes: int, date: str):
        self.number, self.attempt, self.roll_bytes, self.date = number, attempt, roll_bytes, date
        self.store, self.folder = _place(folder)
        self.part, self.stream = 0, None

    def add(self, data: bytes) -> dict | None:
        """Write a record; the manifest's row of the file that it has filled, if it has."""
        if self.stream is None:
            self.name = f"{self.number:05d}-{self.part:05d}.warc.gz"
            self.made = f"{self.attempt}-{self.name}"
            self.stream = self.store.open_output_stream(f"{self.folder}/{self.made}", compression=None)
            self.records, self.bytes, self.digest = 0, 0, hashlib.sha256()
            info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, "", 0, 0)), ("WARC-Date", self.date)]
            self._write(member([*info, ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._write(data)
        self.records += 1
        return self.close() if self.bytes >= self.roll_bytes else None

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def close(self) -> dict | None:
        if self.stream is None:
            return None
        self.stream.close()
        self.stream, self.part = None, self.part + 1
        return {"shard": self.number, "part": self.part - 1, "name": self.name, "made": self.made, "records": self.records, "bytes": self.bytes, "digest": self.digest.hexdigest()}


def _members(chunk: dict, held: tuple | None, least: int, date: str, content_type: str) -> Iterator[bytes]:
    """The records of a chunk of equal rows; ``held`` is the last payload with its key."""
    number, url, digest, mark = (chunk[c] for c in KEY)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {chunk['size']}\r\n\r\n".encode()
    payload_digest = base32(bytes.fromhex(digest))
    own_first = (number, url) == (chunk["first_id"], chunk["first_url"])
    for copy in range(chunk["chunk"] * COPIES, chunk["chunk"] * COPIES + chunk["copies"]):
        revisit = chunk["size"] >= least and chunk["revisits"] and not (own_first and not copy)
        target = None if url is None else _clean(url)
        common = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(number, url, digest, mark, copy)), ("WARC-Date", date)]
        common += [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", HTTP_TYPE), ("Terrace-Key", number)]
        if revisit:
            first = chunk["first_url"]
            common += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(chunk["first_id"], first, digest, mark, 0))]
            common += [("WARC-Refers-To-Target-URI", None if first is None else _clean(first)), ("WARC-Refers-To-Date", date), ("Terrace-Refers-To-Key", chunk["first_id"])]
            yield member(common, http)
            continue
        if held is None or held[0] != (number, url, digest, mark):
            raise ValueError(f"the payload of record {number} did not reach its shard")
        payload = held[1].encode()
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of record {number} has changed while it was written")
        yield member(common, http + payload)


def write_archive(
    records: DataFrame,
    path: str,
    record_id: str = "id",
    url: str = "url",
    payload: str = "payload",
    least: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    content_type: str = "text/html; charset=utf-8",
    roll_bytes: int = ROLL_BYTES,
    shard_bytes: int = SHARD_BYTES,
    shards: int = SHARDS,
) -> DataFrame:
    """Write a record for each row below ``path`` and return the manifest: one row for each file.

    Equal payloads of at least ``least`` bytes are one response and its revisits.
    """
    spark = records.sparkSession
    store, folder = _place(path)
    if store.get_file_info(f"{folder}/current.txt").type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} holds an archive")
    ship(spark)
    body = F.coalesce(F.col(payload), F.lit(""))
    own = records.select(F.col(record_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    own = own.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "mark": F.xxhash64("payload"), "size": F.octet_length("payload").cast("long")})
    planned, first_keys, numbers = _sharded(_planned(own.drop("payload"), least), shard_bytes, shards)
    run_id = uuid.uuid4().hex
    working = f"{path}/_temporary/{run_id}"
    store.create_dir(f"{folder}/_temporary/{run_id}", recursive=True)

    def write(batches):
        shard, held, attempt = None, None, TaskContext.get().taskAttemptId()
        for batch in batches:
            done = []
            for row in range(batch.num_rows):
                chunk = {c: batch.column(c)[row].as_py() for c in names}
                if shard is None or shard.number != chunk["shard"]:
                    done += [] if shard is None else [shard.close()]
                    shard, held = _Shard(chunk["shard"], working, attempt, roll_bytes, date), None
                if chunk["chunk"] < 0:
                    held = (tuple(chunk[c] for c in KEY), batch.column("payload")[row].as_py())
                    continue
                done += [shard.add(data) for data in _members(chunk, held, least, date, content_type)]
            yield _rows(done)
        yield _rows([] if shard is None else [shard.close()])

    def _rows(done):
        return pa.RecordBatch.from_pylist([d for d in done if d], schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(WRITTEN))
    names = [c for c in StructType.fromDDL(PLANNED).names if c != "payload"]
    rows = planned.withColumn("payload", F.lit(None).cast("string"))
    if numbers:
        rows = rows.unionByName(_dealt(own, first_keys, numbers, least))
    dealt = rows.repartitionById(numbers[-1] + 1 if numbers else 1, F.col("shard")).sortWithinPartitions("shard", *_order())
    manifest = f"{path}/manifests/{run_id}"
    dealt.mapInArrow(write, StructType.fromDDL(WRITTEN)).write.parquet(manifest)
    found = spark.read.parquet(manifest)

    def publish(batches):
        for batch in batches:
            store, folder = _place(path)
            for name, made, size in zip(*(batch.column(c).to_pylist() for c in ("name", "made", "bytes"))):
                source = f"{folder}/_temporary/{run_id}/{made}"
                if store.get_file_info(source).type != fs.FileType.NotFound:
                    store.move(source, f"{folder}/{name}")
                elif store.get_file_info(f"{folder}/{name}").size != size:  # else an earlier attempt has moved it
                    raise FileNotFoundError(source)
            yield batch

    found.mapInArrow(publish, found.schema).write.format("noop").mode("overwrite").save()
    with store.open_output_stream(f"{folder}/_temporary/{run_id}/current.txt") as out:
        out.write(f"{run_id}\n".encode())
    store.move(f"{folder}/_temporary/{run_id}/current.txt", f"{folder}/current.txt")
    store.delete_dir(f"{folder}/_temporary")
    return found.drop("made")


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    run_id = spark.read.text(f"{path}/current.txt").first()[0]
    return spark.read.parquet(f"{path}/manifests/{run_id}").drop("made")


def records_in(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers (lower-case names) and block of each record; a digest or length that doesn't fit is an error."""
    while line := stream.readline():
        if line.rstrip() != VERSION:
            raise ValueError(f"not the beginning of a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (BREAK, b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip(" \t\r\n")
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or stream.read(4) != 2 * BREAK:
            raise ValueError(f"record {headers.get('warc-record-id')} ends too early")
        if headers.get("warc-block-digest", "").removeprefix("sha1:") != base32(hashlib.sha1(block).digest()):
            raise ValueError(f"record {headers.get('warc-record-id')} does not have the digest it names")
        yield headers, block


def _described(headers: dict, block: bytes, with_payload: bool) -> dict:
    head, _, payload = block.partition(2 * BREAK)
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?im)^content-length: *(\d+)", head)[1])
    full = headers["warc-type"] == "response"
    if full and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"record {headers['warc-record-id']} does not have the payload it names")
    number = lambda name: int(headers[name]) if name in headers else None
    return {
        "record_id": headers["warc-record-id"],
        "record_type": headers["warc-type"],
        "id": number("terrace-key"),
        "url": headers.get("warc-target-uri"),
        "date": headers["warc-date"],
        "refers_to": headers.get("warc-refers-to"),
        "refers_to_id": number("terrace-refers-to-key"),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if full and with_payload else None,
    }


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The responses and revisits of an archive, one row for each; a revisit's size and digest are its response's.

    Every length and digest is checked. ``with_payload=False`` checks payloads too, but passes none on.
    """
    ship(spark)
    kinds = to_arrow_schema(StructType.fromDDL(READ))

    def run(batches):
        store, folder = _place(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out, size = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in records_in(stream):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        out.append(_described(headers, block, with_payload))
                        size += 200 + len(out[-1]["payload"] or b"")
                        if size >= READ_BYTES:
                            yield pa.RecordBatch.from_pylist(out, schema=kinds)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    files = manifest_of(spark, path).select("name", "shard", "part")
    # a task for each file: by their names alone Spark would take a few rows for little work and put them together
    tasks = max(1, min(files.count(), READERS))
    dealt = files.withColumn("task", F.pmod(F.col("shard") * 31 + F.col("part"), F.lit(tasks)))
    return dealt.repartitionById(tasks, F.col("task")).select("name").mapInArrow(run, StructType.fromDDL(READ))
