"""Spelling variants and hard negatives beside brute force, odd rows and clashing names included."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from terrace.llm import hard_negatives, queries, spelling


def written(folder, **tables):
    for name, table in tables.items():
        pq.write_table(table, f"{folder}/{name}.parquet")
    return str(folder)


def documents(rows, **more):
    columns = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}
    return pa.table(columns | more)


def near(a, b):
    """Whether one inserted, deleted or replaced letter turns a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) - len(short) == 1 and any(long_[:k] + long_[k + 1 :] == short for k in range(len(long_)))


def expected_variants(rows):
    count = Counter()
    for i, text in rows:
        for found in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    beside = {w: [u for u in n if u != w and near(w, u)] for w in n}
    form = {}
    for w in n:
        best = min(beside[w], key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    result = Counter()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        result[(w, form[w], root, n[w], len(beside[w]), n.get(form[w]))] += 1
    return result


def spelled(seed, count=400):
    """Texts of words with slips, runs of equal letters, ties, accents and words that hold no letter twice."""
    rng = random.Random(seed)
    letters = "abcéÿß"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(25)]
    stems += ["aaaaaa", "aaaaaaa", "aabaaa", "abaaaa", "Ärmelchen", "ÀÀÀÀÀÀ", "z" * 63, "z" * 64, "z" * 65, "zy" * 40, "zy" * 39 + "zx", "z" + "zy" * 40]

    def word():
        w = stems[min(int(rng.expovariate(0.12)), len(stems) - 1)]
        p = rng.randrange(len(w))
        return rng.choice([w] * 12 + [w[:p] + w[p + 1 :], w[:p] + rng.choice(letters) + w[p:], w[:p] + rng.choice(letters) + w[p + 1 :], w.upper()])

    rows = [(i, " ".join(word() + rng.choice(["", ",", "9", "\n", "漢"]) for _ in range(rng.randint(0, 60)))) for i in range(count)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1]), (count, None), (count + 1, ""), (count + 2, "  \n"), (count + 3, "Q" * 3000 + " ")]
    # a chain of forms, and a word with many neighbours
    chain = " ".join(["kettles"] * 150 + ["kettless"] * 25 + ["kettlless"] * 5 + ["lantern", "lanterm", "lanter", "lanterns", "llantern"] * 6)
    rows.append((count + 50, chain))
    return rows + [(count + 4 + k, "Q" * 3000 + " x " + "q" * (2999 + k % 2)) for k in range(9)]


def test_spelling_variants(spark, tmp_path):
    rows = spelled(1)
    table = documents(rows, n=pa.array(["x"] * len(rows)), word=pa.array(["x"] * len(rows)), id=pa.array([1] * len(rows)))
    found = queries.op12_spelling_variants(spark, written(tmp_path, documents=table))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = expected_variants(rows)
    assert Counter(map(tuple, found.collect())) == want
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 3 for w in want)  # a chain, many neighbours


def test_spelling_variants_of_nothing(spark, tmp_path):
    assert queries.op12_spelling_variants(spark, written(tmp_path, documents=documents([]))).count() == 0
    rows = [(1, None), (2, ""), (3, "short words of few let")]
    assert queries.op12_spelling_variants(spark, written(tmp_path, documents=documents(rows))).count() == 0
    with pytest.raises(ValueError, match="more often"):
        spelling.group_variants(spark.createDataFrame([("abc", 1)], "word string, n long"), ratio=1)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    data = "Ab éÉ aB, a1b ".encode() * 50
    whole = spelling.run_counts(data)
    monkeypatch.setattr(spelling, "LISTED", 10)
    assert spelling.run_counts(data) == whole == Counter({b"ab": 100, "éÉ".encode(): 50, b"a": 50, b"b": 50})


VECTORS = pa.list_(pa.float32())


def embeddings(rows, **more):
    columns = {"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], VECTORS)}
    return pa.table(columns | {"label": pa.array([r[2] for r in rows], pa.int32())} | more)


def expected_negatives(rows):
    import math
    import struct

    kept = []
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        vector = [struct.unpack("f", struct.pack("f", x))[0] for x in vector]
        kept.append((i, [math.floor(256 * x) for x in vector], label))
    result = Counter()
    last = lambda i: (i is None, i or 0)
    for a, (i, vector, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(vector, v)), last(j), j, own) for b, (j, v, own) in enumerate(kept) if a != b), key=lambda s: s[:2])
        for minus, _, j, _ in [s for s in scored if s[3] == label][:5]:
            inside = [s for s in scored if s[3] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus][:10]
            for rank, s in enumerate(inside, 1):
                result[(i, j, rank, s[2], -minus, -s[0])] += 1
    return result


def points(seed, count, width=6, scale=1.0):
    rng = random.Random(seed)
    vector = lambda: [rng.choice([rng.gauss(0, 1), rng.randint(-2, 2) / 2, 0.0]) * scale for _ in range(width)]
    ids = [rng.choice([k, k * 10, k * 100]) for k in range(count)]
    rows = [(i, vector(), rng.randint(0, 3)) for i in ids]
    rows += rows[:3] + [(100, rows[0][1], 1), (100, rows[0][1], 1), (100, rows[0][1], 2)]
    odd = [(200, None, 1), (300, [1.0] * width, None), (400, [None] + [1.0] * (width - 1), 1), (500, [float("nan")] * width, 1)]
    odd += [(600, [float("-inf")] * width, 1), (None, vector(), 1), (None, vector(), 2), (700, [], 1), (800, [1.0], 2), (900, vector() + [3.0], 1)]
    return rows + odd


@pytest.mark.parametrize("scale", [1.0, 3e5])
def test_hard_negatives(spark, tmp_path, monkeypatch, scale):
    """Small blocks, so that an anchor meets its rows in many; large components take exact whole numbers."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rows = points(2, 300, scale=scale)
    n = len(rows)
    table = embeddings(rows, row=pa.array(["x"] * n), id=pa.array(["x"] * n), block=pa.array([0] * n), vector=pa.array(["x"] * n), asked=pa.array([0] * n))
    found = queries.op13_hard_negatives(spark, written(tmp_path, embeddings=table))
    want = expected_negatives(rows)
    assert want and Counter(map(tuple, found.collect())) == want


def test_hard_negatives_of_equal_rows_and_of_none(spark, tmp_path):
    rows = [(100 * (k % 3), [0.5, 0.25], k % 2) for k in range(30)] + [(k, [0.375, 0.25], 2) for k in range(1, 30)]
    found = queries.op13_hard_negatives(spark, written(tmp_path, embeddings=embeddings(rows)))
    assert Counter(map(tuple, found.collect())) == expected_negatives(rows)
    (tmp_path / "none").mkdir()
    assert queries.op13_hard_negatives(spark, written(tmp_path / "none", embeddings=embeddings([]))).count() == 0


def test_hard_negatives_by_text_labels(spark):
    rows = spark.createDataFrame([(0, [4, 0], "a"), (1, [4, 0], "a"), (2, [3, 1], "b"), (3, [3, 0], "b"), (4, [1, 0], "c")], "vec_id long, vector array<long>, label string")
    found = hard_negatives.mine(rows, rows["vec_id"] == 0, negatives=2)
    assert sorted(map(tuple, found.collect())) == [(0, 1, 1, 2, 16, 12), (0, 1, 2, 3, 16, 12)]
