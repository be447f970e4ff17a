import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from terrace.operators.lineage import Run
from terrace.sources import ingest as ing
from terrace.sources.ingest import (
    Feed, active_feeds, append_with_lineage, ingest_all, ingest_feed, read_ingested, read_rejected,
)
from terrace.sources.checksums import content_checksums
from terrace.sources.sync import incremental_sync, read_synced
from terrace.sources.tables import read_table
from terrace.streaming.ingest import stream_feed

COLUMNS = {"id": {"type": "int", "required": True}, "price": "decimal(10,2)"}
RUN = Run(as_of=datetime(2024, 1, 1))
FEED = Feed(1, "raw_orders", "landing", r"^orders_.*\.csv$")


def land(root, name, *rows, volume="landing", header="id,price"):
    folder = root / "volumes" / volume
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([header, *rows]) + "\n")


def paths(root):
    return f"{root}/volumes", f"{root}/tables"


def loaded(spark, root, table="raw_orders"):
    return sorted(r["id"] for r in read_ingested(spark, f"{root}/tables", table).select("id").collect())


def rejected(spark, root, table="raw_orders"):
    return sorted((r["_raw"], *r["_errors"]) for r in read_rejected(spark, f"{root}/tables", table).collect())


def manifest(spark, root):
    return read_table(spark, f"{root}/tables/file_manifest")


def test_each_file_is_loaded_once(spark, tmp_path):
    land(tmp_path, "orders_1.csv", "1,2.50", "2,3.50")
    land(tmp_path, "orders_2 ü+%.csv", "3,1.00")
    land(tmp_path, "orders_3.csv")
    land(tmp_path, "raw_orders_4.csv", "9,9.00")  # the pattern is anchored: not this one
    assert ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS, domain="eu", run=RUN) == 3
    assert ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS, domain="eu", run=RUN) == 0
    assert loaded(spark, tmp_path) == [1, 2, 3]
    land(tmp_path, "orders_5.csv", "5,5.00")
    assert ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS, domain="eu", run=RUN) == 1
    assert loaded(spark, tmp_path) == [1, 2, 3, 5]

    rows = {r["file_name"]: r for r in manifest(spark, tmp_path).collect()}
    assert {n: r["row_count"] for n, r in rows.items()} == {
        "orders_1.csv": 2, "orders_2 ü+%.csv": 1, "orders_3.csv": 0, "orders_5.csv": 1,
    }
    one = rows["orders_1.csv"]
    assert (one["model_name"], one["domain"], one["file_format"], one["status"]) == ("raw_orders", "eu", "csv", "SUCCESS")
    assert one["file_size_bytes"] == os.path.getsize(tmp_path / "volumes/landing/orders_1.csv")
    assert one["ingested_at"] == datetime(2024, 1, 1) and one["checksum"] != rows["orders_5.csv"]["checksum"]
    assert manifest(spark, tmp_path).where("checksum <> md5(file_path)").count() == 0


def test_rows_name_their_own_file(spark, tmp_path):
    land(tmp_path, "orders_1.csv", "1,1.00")
    land(tmp_path, "orders_2 b.csv", "2,1.00")
    ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS, run=RUN)
    rows = {r["id"]: r["_lineage"] for r in read_table(spark, f"{tmp_path}/tables/raw_orders").collect()}
    assert rows[2]["source_path"].endswith("/orders_2 b.csv")
    assert (rows[1]["schema_version"], rows[1]["model"], rows[1]["source_type"]) == ("3", "raw_orders", "volume")


def test_a_break_between_the_two_writes_loads_nothing_twice(spark, tmp_path, monkeypatch):
    land(tmp_path, "orders_1.csv", "1,1.00")

    def broken(*_):
        raise RuntimeError("lost the driver")

    with monkeypatch.context() as patch:
        patch.setattr(ing, "manifest_entries", broken)
        with pytest.raises(RuntimeError):
            ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS)
    left = read_table(spark, f"{tmp_path}/tables/raw_orders")
    assert [r["id"] for r in left.collect()] == [1]  # written, but in no manifest
    land(tmp_path, "orders_1.csv", "7,1.00", volume="other")
    ingest_feed(spark, Feed(2, "raw_orders", "other"), *paths(tmp_path), COLUMNS)
    finished = read_ingested(spark, f"{tmp_path}/tables", "raw_orders")
    assert [r["id"] for r in finished.collect()] == [7]
    land(tmp_path, "orders_2.csv", "2,1.00")
    assert ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS) == 2
    assert loaded(spark, tmp_path) == [1, 2, 7]
    assert read_ingested(spark, f"{tmp_path}/tables", "raw_orders").count() == 3
    assert manifest(spark, tmp_path).count() == 3


def test_small_batches_load_everything(spark, tmp_path):
    for i in range(5):
        land(tmp_path, f"orders_{i}.csv", f"{i},1.00")
    assert ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS, files_per_batch=2) == 5
    assert loaded(spark, tmp_path) == [0, 1, 2, 3, 4]
    assert manifest(spark, tmp_path).select("_batch").distinct().count() in (2, 3)


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    def jobs(root, files):
        for i in range(files):
            land(root, f"orders_{i}.csv", f"{i},1.00")
        group = f"ingest-{files}"
        spark.sparkContext.setJobGroup(group, group)
        ingest_feed(spark, FEED, *paths(root), COLUMNS)
        spark.sparkContext.setJobGroup("rest", "rest")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(tmp_path / "a", 2) == jobs(tmp_path / "b", 20)


def test_two_feeds_may_share_file_names_and_targets(spark, tmp_path):
    land(tmp_path, "orders_1.csv", "1,1.00")
    land(tmp_path, "orders_1.csv", "2,1.00", volume="other")
    config = spark.createDataFrame(
        [
            (1, "volume", "a", "raw_orders", "landing", "^orders", "csv", True, ",", True),
            (2, "volume", "b", "raw_orders", "other", "^orders", "csv", True, ",", True),
            (3, "volume", "c", "raw_orders", "nowhere", "^orders", None, None, None, True),
            (4, "volume", "d", "raw_orders", "landing", "^orders", "csv", True, ",", False),
            (5, "api", "e", "raw_orders", "landing", "^orders", "csv", True, ",", True),
        ],
        "config_id int, ingest_type string, source_name string, target_model string, volume_name string, "
        "file_regex string, file_format string, has_header boolean, delimiter string, active boolean",
    )
    assert [f.config_id for f in active_feeds(config)] == [1, 2, 3]
    assert ingest_all(spark, config, *paths(tmp_path), {"raw_orders": COLUMNS}) == {1: 1, 2: 1, 3: 0}
    assert loaded(spark, tmp_path) == [1, 2]
    assert manifest(spark, tmp_path).count() == 2


def test_broken_rows_are_kept_beside_the_good_ones(spark, tmp_path):
    land(tmp_path, "orders_1.csv", "1,1.00", ",2.00", "x,1.00", "2,abc", "3,1.00,more", "4")
    land(tmp_path, "orders_2.csv", "5,5.00")
    assert ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS) == 2
    assert loaded(spark, tmp_path) == [1, 5]
    assert rejected(spark, tmp_path) == [
        ('{"id":"2","price":"abc"}', "price: not a decimal(10,2)"),
        ('{"id":"3","price":"1.00"}', "malformed row"),
        ('{"id":"4"}', "malformed row"),
        ('{"id":"x","price":"1.00"}', "id: not a int"),
        ('{"price":"2.00"}', "id: required value is missing"),
    ]
    assert sorted((r["file_name"], r["row_count"], r["rejected_count"], r["status"]) for r in manifest(spark, tmp_path).collect()) == [
        ("orders_1.csv", 1, 5, "PARTIAL"), ("orders_2.csv", 1, 0, "SUCCESS"),
    ]
    assert dict(read_ingested(spark, f"{tmp_path}/tables", "raw_orders").dtypes)["price"] == "decimal(10,2)"
    land(tmp_path, "orders_3.csv", "y,5.00")
    for _ in range(2):
        stream_feed(spark, FEED, *paths(tmp_path), COLUMNS, f"{tmp_path}/progress").awaitTermination()
    assert loaded(spark, tmp_path) == [1, 5] and len(rejected(spark, tmp_path)) == 6


def test_errors_stop_a_batch_on_request_and_name_the_rows(spark, tmp_path):
    land(tmp_path, "orders_1.csv", "1,1.00", ",2.00", "x,1.00")
    with pytest.raises(ValueError, match="2 invalid rows in 'raw_orders'"):
        ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS, invalid="error")
    with pytest.raises(ValueError, match="unknown way"):
        ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS, invalid="drop")
    land(tmp_path, "orders_1.csv", "1,1.00", "4,2.00")
    assert ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS, invalid="error") == 1
    assert loaded(spark, tmp_path) == [1, 4]


def test_malformed_values_and_headers_are_errors(spark, tmp_path):
    land(tmp_path, "orders_1.csv", "x,1.00")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS, invalid="trust")
    land(tmp_path, "orders_1.csv", "1.00,1", header="price,id")
    for invalid in ing.INVALID:
        with pytest.raises(Exception, match="header|FAILED_READ_FILE"):
            ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS, invalid=invalid)


def test_other_formats_and_content_checksums(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "id int, price double").coalesce(1).write.json(f"{tmp_path}/volumes/landing")
    feed = Feed(7, "raw_json", "landing", r"^part-.*\.json$", "json", None, None)
    assert ingest_feed(spark, feed, *paths(tmp_path), COLUMNS, checksum="content") == 1
    assert loaded(spark, tmp_path, "raw_json") == [1]
    row = manifest(spark, tmp_path).first()
    import hashlib

    name = next((tmp_path / "volumes/landing").glob("part-*.json"))
    one = hashlib.sha256(name.read_bytes()).hexdigest()
    assert row["checksum"] == hashlib.sha256(one.encode()).hexdigest()


def test_content_checksums_of_ranges(spark, tmp_path):
    """Files below, at and above the length of a range, and an empty one."""
    import hashlib

    data = {f"f{n}": bytes(k % 251 for k in range(n)) for n in (0, 1, 99, 100, 101, 250, 300)}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    files = spark.createDataFrame([(f"file:{tmp_path}/{n}", len(c)) for n, c in data.items()], "file_path string, file_size_bytes long")
    found = {r["file_path"].rsplit("/")[-1]: r["checksum"] for r in content_checksums(files, 100).collect()}
    for name, content in data.items():
        parts = [hashlib.sha256(content[k : k + 100]).hexdigest() for k in range(0, max(1, len(content)), 100)]
        assert found[name] == hashlib.sha256("".join(parts).encode()).hexdigest()


def test_stream_form(spark, tmp_path):
    land(tmp_path, "orders_1.csv", "1,2.50", "2,3.50")
    land(tmp_path, "skipped.csv", "8,1.00")

    def run():
        stream_feed(spark, FEED, *paths(tmp_path), COLUMNS, f"{tmp_path}/progress", run=RUN).awaitTermination()

    run()
    run()
    assert loaded(spark, tmp_path) == [1, 2]
    land(tmp_path, "orders_2.csv", "3,1.00")
    run()
    assert loaded(spark, tmp_path) == [1, 2, 3]
    assert sorted((r["file_name"], r["row_count"]) for r in manifest(spark, tmp_path).collect()) == [
        ("orders_1.csv", 2), ("orders_2.csv", 1),
    ]


def test_append_with_lineage(spark, tmp_path):
    table = f"{tmp_path}/raw"
    rows = spark.createDataFrame([(1, "2.5")], "id int, price string")
    append_with_lineage(rows, table, "raw", "/x/y.csv", columns=COLUMNS)
    append_with_lineage(rows, table, "raw", "/x/z.csv", "api", columns=COLUMNS)
    assert sorted(r["_lineage"]["source_path"] for r in read_table(spark, table).collect()) == ["/x/y.csv", "/x/z.csv"]
    with pytest.raises(ValueError):
        append_with_lineage(rows.withColumn("id", F.lit(None).cast("int")), table, "raw", columns=COLUMNS)


def test_incremental_sync(spark, tmp_path):
    def source(*ids):
        return spark.createDataFrame([(i, f"2024-01-{i:02d}") for i in ids], "id int, day string").withColumn(
            "day", F.to_timestamp("day")
        )

    target, log = f"{tmp_path}/t", f"{tmp_path}/log"
    assert incremental_sync(source(1, 2), target, log, "day", run=RUN) == 2
    assert incremental_sync(source(1, 2), target, log, "day", run=RUN) == 0
    assert incremental_sync(source(1, 2, 3), target, log, "day", run=RUN) == 1
    assert sorted(r["id"] for r in read_table(spark, target).collect()) == [1, 2, 3]
    assert sorted((r["_batch"], r["rows"]) for r in read_table(spark, log).collect()) == [(1, 2), (2, 1)]


def test_interrupted_sync_repeats_nothing(spark, tmp_path, monkeypatch):
    from terrace.sources import sync

    source = spark.range(5).withColumnRenamed("id", "n")
    target, log = f"{tmp_path}/t", f"{tmp_path}/log"
    original = sync.overwrite_partitions

    def fail_on_log(df, path, keys):
        if path == log:
            raise RuntimeError("stopped")
        original(df, path, keys)

    with monkeypatch.context() as patch:
        patch.setattr(sync, "overwrite_partitions", fail_on_log)
        with pytest.raises(RuntimeError):
            incremental_sync(source, target, log, "n")
    assert incremental_sync(source, target, log, "n") == 5
    assert read_table(spark, target).count() == 5


def test_stream_and_batch_share_tables(spark, tmp_path):
    """Neither form replaces or repeats what the other, or another checkpoint, has loaded."""
    land(tmp_path, "orders_1.csv", "1,1.00")
    assert ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS, run=RUN) == 1
    land(tmp_path, "orders_2.csv", "2,1.00")
    for progress in ("one", "two", "one"):
        stream_feed(spark, FEED, *paths(tmp_path), COLUMNS, f"{tmp_path}/{progress}", run=RUN).awaitTermination()
        assert loaded(spark, tmp_path) == [1, 2]
    land(tmp_path, "orders_3.csv", "3,1.00")
    assert ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS, run=RUN) == 1
    assert loaded(spark, tmp_path) == [1, 2, 3]
    names = sorted(r["file_name"] for r in manifest(spark, tmp_path).collect())
    assert names == ["orders_1.csv", "orders_2.csv", "orders_3.csv"]


def test_streams_may_refuse_unreadable_values(spark, tmp_path):
    land(tmp_path, "orders_1.csv", "notint,1.00")
    for invalid, message in (("trust", "MALFORMED|notint|FAILFAST"), ("error", "1 invalid rows")):
        with pytest.raises(Exception, match=message):
            stream_feed(spark, FEED, *paths(tmp_path), COLUMNS, f"{tmp_path}/{invalid}", invalid=invalid).awaitTermination()


def test_checkpoints_never_share_batches(spark, tmp_path):
    """Two checkpoints whose CRC-32 agrees modulo 20,000 take turns on one feed."""
    import zlib

    one, other = f"{tmp_path}/feed_a", next(f"{tmp_path}/feed_{k}" for k in range(10**6) if zlib.crc32(f"{tmp_path}/feed_{k}".encode()) % 20_000 == zlib.crc32(f"{tmp_path}/feed_a".encode()) % 20_000)
    for k in range(4):
        land(tmp_path, f"orders_{k}.csv", f"{k},1.00")
        stream_feed(spark, FEED, *paths(tmp_path), COLUMNS, (one, other)[k % 2], run=RUN).awaitTermination()
    assert loaded(spark, tmp_path) == [0, 1, 2, 3]


def test_a_file_loaded_by_two_runs_at_once_counts_once(spark, tmp_path, monkeypatch):
    land(tmp_path, "orders_1.csv", "1,1.00", "x,1.00")
    land(tmp_path, "orders_2.csv", "2,1.00")
    with monkeypatch.context() as patch:  # the second run does not see what the first has entered
        patch.setattr(ing, "new_files", lambda files, feed, manifest: files)
        for _ in range(2):
            assert ingest_feed(spark, FEED, *paths(tmp_path), COLUMNS) == 2
    assert manifest(spark, tmp_path).count() == 4
    assert loaded(spark, tmp_path) == [1, 2] and len(rejected(spark, tmp_path)) == 1


def test_sync_of_ties_and_missing_values(spark, tmp_path):
    target, log = f"{tmp_path}/t", f"{tmp_path}/log"
    rows = [(1, 1.0, "x"), (2, 2.0, "x"), (3, None, "x"), (4, float("nan"), "x")]

    def sync():
        return incremental_sync(spark.createDataFrame(rows, "id int, v double, p string"), target, log, "v", ["p"], RUN)

    assert sync() == 4 and sync() == 0
    rows += [(5, 2.0, "y"), (6, None, "y"), (7, float("nan"), "y"), (2, 2.0, "x"), (8, 3.0, "x")]
    assert sync() == 5 and sync() == 0
    assert sorted(r["id"] for r in read_synced(spark, target, log).collect()) == [1, 2, 2, 3, 4, 5, 6, 7, 8]


def test_interrupted_sync_forgets_changed_partitions(spark, tmp_path, monkeypatch):
    from terrace.sources import sync

    target, log = f"{tmp_path}/t", f"{tmp_path}/log"
    original = sync.overwrite_partitions

    def fail_on_log(df, path, keys):
        if path == log:
            raise RuntimeError("stopped")
        original(df, path, keys)

    with monkeypatch.context() as patch:
        patch.setattr(sync, "overwrite_partitions", fail_on_log)
        with pytest.raises(RuntimeError):
            incremental_sync(spark.createDataFrame([(1, "y")], "n int, p string"), target, log, "n", ["p"])
    assert incremental_sync(spark.createDataFrame([(1, "z")], "n int, p string"), target, log, "n", ["p"]) == 1
    assert [(r["n"], r["p"]) for r in read_table(spark, target).collect()] == [(1, "z")]
