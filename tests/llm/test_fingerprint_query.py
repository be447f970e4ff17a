"""The fingerprint query beside plain Python, with hot and null ids."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from terrace.llm import fingerprints, queries


def documents(seed=3):
    """Texts of shared words; a third of the rows have one id, many of them the same text, some have none."""
    rng = random.Random(seed)
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(50)}" for _ in range(300)]
    text = lambda: " ".join(rng.choice([w, w, w, f"own{rng.randrange(99)}"]) for w in base[: rng.randrange(40, 300)])
    rows = [(3 * k, text()) for k in range(120)]
    rows += [(77, rng.choice([rows[0][1], rows[1][1], text(), "é漢🙂 x"])) for _ in range(110)]
    rows += [(None, rng.choice(["", None, rows[2][1], text()])) for _ in range(60)]
    rows += [(1000, ""), (1001, None), (1002, " \n\t "), (1003, "word"), (1004, "word"), (1005, "x" * 50_000), (1006, "a\u00a0b c\u2003d")]
    rng.shuffle(rows)
    return rows


def ordered(spark, path, rows):
    """The rows in the order the operator gives them: all of them, by descending id, null ids last."""
    docs = spark.read.parquet(f"{path}/documents.parquet")
    found = fingerprints.with_next(docs).where("not _guest").orderBy("_range", "_pos").collect()
    order = [(r["_id"], r["_text"]) for r in found]
    assert Counter(order) == Counter((i, t or "") for i, t in rows)
    ids = [(i is None, -(i or 0)) for i, _ in order]
    assert ids == sorted(ids)
    assert [r["_next"] for r in found] == [order[(k + 1) % len(order)][1] for k in range(len(order))]
    return order


def expected(order):
    result = []
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        result.append((i, len(text), text, following, edited, hashlib.sha256(edited.encode()).hexdigest()))
    return result


def jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def test_query(spark, tmp_path):
    rows = documents()
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "_row": ["x"] * len(rows)}), f"{tmp_path}/documents.parquet")
    found = queries.op1_fingerprints(spark, str(tmp_path)).collect()
    want = expected(ordered(spark, tmp_path, rows))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == Counter((w[0], w[1], w[5]) for w in want)
    # rows of equal text and edited text have equal fingerprints, and likenesses estimate the similarity
    by = {}
    for r in found:
        by.setdefault((r["doc_id"], r["n_chars"], r["edited_sha256"]), set()).add((r["fingerprint"], r["edited_fingerprint"], r["near_edited"]))
    assert all(len(v) == 1 for v in by.values())
    prints, error = {}, []
    for i, n, text, following, edited, digest in want:
        own, other, near = next(iter(by[i, n, digest]))
        assert prints.setdefault(tuple(text.split()), own) == own and prints.setdefault(tuple(edited.split()), other) == other
        assert len(own) == len(other) == 8 * fingerprints.SAMPLES
        if "\u00a0" not in text and "\u2003" not in text:
            error.append(near - jaccard(text, edited))
    assert abs(np.mean(error)) < 0.03 and np.sqrt(np.mean(np.square(error))) < 0.09
    nexts = Counter((r["doc_id"], round(r["near_next"], 6)) for r in found)
    share = lambda a, b: np.mean([a[8 * k : 8 * k + 8] == b[8 * k : 8 * k + 8] for k in range(fingerprints.SAMPLES)])
    assert nexts == Counter((w[0], round(share(prints[tuple(w[2].split())], prints[tuple(w[3].split())]), 6)) for w in want)


def test_hot_and_null_ids_are_split(spark, tmp_path):
    rows = [(k, f"text {k}") for k in range(1000)] + [(500, "copy")] * 1000 + [(None, "copy")] * 1000
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    sizes = [r["count"] for r in fingerprints.with_next(docs).where("not _guest").groupBy("_range").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 300 and len(sizes) > 20


@pytest.mark.parametrize("ids", ["doc_id string", "doc_id long"])
def test_ids_of_any_kind_and_no_rows(spark, ids):
    value = (lambda k: f"id{k}") if "string" in ids else (lambda k: k)
    docs = spark.createDataFrame([(value(k), f"text {k}") for k in range(5)] + [(None, "none")], f"{ids}, text string")
    found = fingerprints.with_next(docs).where("not _guest").collect()
    assert sorted(r["_text"] for r in found) == sorted(r["_next"] for r in found)
    assert fingerprints.with_next(docs.limit(0)).count() == 0
