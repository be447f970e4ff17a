"""Archives: round trips, equal bytes on every run, what broken runs leave, and the query against brute force."""

import base64
import gzip
import hashlib
import os
import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from terrace.llm import queries, warc

SCHEMA = "page_id long, url string, html string, size long, digest string, shard int, chunk string"


def pages(seed=4, count=120):
    rng = random.Random(seed)
    body = lambda: "<p>" + " ".join(rng.choice(["eins", "zwei", "é", "漢", "\r\n\r\n", "WARC/1.1"]) for _ in range(rng.randint(0, 80)))
    rows = [(k, f"http://h{k % 7}.example/{k}?a=%20b", body()) for k in range(count)]
    copied = body()
    rows += [(count + k, rng.choice([f"http://x/{k}", "http://same/", None]), copied) for k in range(40)]
    rows += [rows[2]] * 5 + [(200, "http://a/b c\r\nX: y ü", None), (201, None, ""), (202, "", ""), (None, "http://n/", body()), (None, None, copied), (3, "http://other/", rows[3][2])]
    rows += [(300, "http://long/", "long é " * 60_000)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2, "c") for r in rows], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, (r[1] or "").encode())
    first = {}
    for r in sorted(rows, key=order):
        first.setdefault(r[2] or "", r)
    result, taken = Counter(), set()
    for r in rows:
        text = r[2] or ""
        size, f = len(text.encode()), first[text]
        response = size < least or (order(r) == order(f) and text not in taken)
        if response and size >= least:
            taken.add(text)
        result[(r[0], size, digest(text), "response" if response else "revisit", None if response else f[0])] += 1
    return result


def written(spark, rows, path, **options):
    return warc.write_archive(frame(spark, rows).repartition(7), str(path), record_id="page_id", url="url", payload="html", **options)


def files(path):
    return {n: open(f"{path}/{n}", "rb").read() for n in sorted(os.listdir(path)) if n.endswith(".warc.gz")}


COLUMNS = ("id", "payload_bytes", "payload_digest", "record_type", "refers_to_id")


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, tmp_path, monkeypatch, least):
    """Small shards, files and chunks, so that each of them is cut."""
    monkeypatch.setattr(warc, "COPIES", 2)
    monkeypatch.setattr(warc, "SEEN", 3)
    rows = pages()
    manifest = written(spark, rows, tmp_path / "a", least=least, roll_bytes=2000, shard_bytes=12_000).collect()
    found = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in found) == expected(rows, least)
    assert len({r["shard"] for r in manifest}) > 5 and max(r["part"] for r in manifest) > 2
    assert sum(r["records"] for r in manifest) == len(rows)
    bodies = {(r["id"], r["payload_digest"]): bytes(r["payload"]) for r in found if r["record_type"] == "response"}
    for i, _, text in rows:
        if (i, digest(text)) in bodies:
            assert bodies[i, digest(text)] == (text or "").encode()
    names = {r["record_id"]: r for r in found}
    assert len(names) == len(rows)
    for r in found:
        if r["refers_to"]:
            target = names[r["refers_to"]]
            assert (target["record_type"], target["id"], target["payload_digest"]) == ("response", r["refers_to_id"], r["payload_digest"])
    assert {r["url"] for r in found if r["id"] == 200} == {"http://a/b%20c%0D%0AX:%20y ü"}


def test_records_are_ordered_members_and_files_repeat(spark, tmp_path):
    rows = pages(5)
    manifest = written(spark, rows, tmp_path / "a", roll_bytes=3000, shard_bytes=9000).collect()
    random.Random(1).shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        written(spark, rows, tmp_path / "b", roll_bytes=3000, shard_bytes=9000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    one, other = files(tmp_path / "a"), files(tmp_path / "b")
    assert one == other and one
    listed = {r["name"]: r for r in manifest}
    assert listed.keys() == one.keys()
    keys = []
    for name, data in one.items():
        assert listed[name]["bytes"] == len(data) and listed[name]["digest"] == hashlib.sha256(data).hexdigest()
        with gzip.open(f"{tmp_path}/a/{name}") as stream:
            kept = list(warc.records_in(stream))
        assert kept[0][0]["warc-type"] == "warcinfo" and kept[0][0]["warc-filename"] == name
        keys += [int(h["terrace-key"]) if "terrace-key" in h else 1 << 40 for h, _ in kept[1:]]
        assert len(kept) - 1 == listed[name]["records"]
        assert data.startswith(b"\x1f\x8b") and gzip.decompress(data).count(b"WARC-Record-ID: ") >= len(kept)
    assert keys == sorted(keys)
    assert sorted(os.listdir(tmp_path / "a")) == sorted([*one, "current.txt", "manifests"])


def test_an_archive_is_not_replaced_and_broken_runs_are(spark, tmp_path):
    rows = pages(6, 20)
    left = tmp_path / "a" / "_temporary" / "old"
    left.mkdir(parents=True)
    (left / "0-00000-00000.warc.gz").write_bytes(b"half a fi")
    (tmp_path / "a" / "00000-00000.warc.gz").write_bytes(b"old")
    (tmp_path / "a" / "00077-00000.warc.gz").write_bytes(b"not listed")
    written(spark, rows, tmp_path / "a")
    assert Counter(tuple(r[c] for c in COLUMNS) for r in warc.read_archive(spark, str(tmp_path / "a")).collect()) == expected(rows)
    with pytest.raises(FileExistsError):
        written(spark, rows, tmp_path / "a")


def test_a_changed_byte_is_an_error(spark, tmp_path):
    written(spark, [(1, "http://a/", "text " * 50)], tmp_path / "a")
    name, data = next(iter(files(tmp_path / "a").items()))
    changed = gzip.decompress(data).replace(b"text text", b"text test", 1)
    (tmp_path / "a" / name).write_bytes(gzip.compress(changed))
    with pytest.raises(Exception, match="does not have the digest"):
        warc.read_archive(spark, str(tmp_path / "a")).collect()


def test_query(spark, tmp_path):
    rows = [r for r in pages(7) if r[0] is not None]
    columns = {"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()), "html": pa.array([r[2] for r in rows], pa.string())}
    pq.write_table(pa.table(columns), tmp_path / "pages.parquet")
    found = queries.op11_warc(spark, str(tmp_path))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, found.collect())) == expected(rows)
    (tmp_path / "none").mkdir()
    pq.write_table(pa.table(columns).slice(0, 0), tmp_path / "none" / "pages.parquet")
    assert queries.op11_warc(spark, str(tmp_path / "none")).count() == 0
