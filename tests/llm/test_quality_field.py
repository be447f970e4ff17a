"""The chain over lines beside enumeration of all labellings, and the query on odd rows."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from terrace.llm import quality, queries


def enumerated(scores, moves):
    """Log partition sum, probability of good of each line and of each pair of neighbours, over all labellings."""
    n = len(scores)
    total, good, pairs = 0.0, np.zeros(n), np.zeros((n - 1, 2, 2))
    for labels in itertools.product((0, 1), repeat=n):
        weight = np.exp(sum(s for s, y in zip(scores, labels) if y) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
        total += weight
        good += weight * np.array(labels)
        for k, (a, b) in enumerate(zip(labels, labels[1:])):
            pairs[k, a, b] += weight
    return np.log(total), good / total, pairs / total


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(3)
    for trial in range(20):
        lines = rng.integers(1, 9, 5)
        features = rng.normal(size=(lines.sum(), 4)).astype(np.float32)
        field = quality.Field(rng.normal(size=4).astype(np.float32), rng.normal(size=(2, 2)) * (trial % 3), 1.0, 0.0)
        found = quality.marginals(features, lines, field)
        scores, at = features @ field.weights, 0
        for n in lines:
            assert np.allclose(found[at : at + n], enumerated(scores[at : at + n], field.moves)[1], atol=1e-5)
            at += n


def test_fit_stops_where_the_likelihood_is_flat():
    """The gradient of the decayed likelihood, from enumeration, is small at what was fitted."""
    rng = np.random.default_rng(4)
    lines = rng.integers(1, 7, 60)
    labels = rng.random(60) < 0.5
    owner = np.repeat(np.arange(60), lines)
    features = (rng.normal(size=(len(owner), 3)) + labels[owner, None] * [0.4, -0.3, 0.0]).astype(np.float32)
    size = rng.integers(1, 50, len(owner))
    field = quality.fit(features, size, lines, labels)

    def loss(x):
        scores, moves, at, value = features @ x[:3], x[3:].reshape(2, 2), 0, 0.0
        for n, y in zip(lines, labels):
            part = scores[at : at + n]
            value += n**-0.5 * ((part.sum() if y else 0) + (n - 1) * moves[int(y), int(y)] - enumerated(part, moves)[0])
            at += n
        return value / (lines**0.5).sum() - quality.DECAY / 2 * (x**2).sum()

    x = np.r_[field.weights, field.moves.ravel()].astype(float)
    slope = [(loss(x + h) - loss(x - h)) / 2e-4 for h in np.eye(7) * 1e-4]
    assert np.abs(slope).max() < 2e-3 and np.abs(x).max() > 0.1


def test_document_quality_is_the_length_weighted_mean():
    good, size, lines = np.array([0.2, 0.9, 0.5]), np.array([9, 29, 3]), np.array([2, 1])
    assert np.allclose(quality.weighted(good, size, lines), [(0.2 * 10 + 0.9 * 30) / 40, 0.5])


def test_neighbours_are_those_of_the_same_text():
    texts = ["a b\nC 1!!\n\nend.", "one line", "", "x\ny"]
    features, size, lines = quality.line_features(texts)
    assert lines.tolist() == [4, 1, 1, 2] and size.tolist() == [3, 5, 0, 4, 8, 0, 1, 1]
    width = (features.shape[1] - 3) // 3
    own, before, after = (features[:, k * width : (k + 1) * width] for k in range(3))
    assert (before[[0, 4, 5, 6]] == 0).all() and (after[[3, 4, 5, 7]] == 0).all()
    assert (before[1:4] == own[0:3]).all() and (after[0:3] == own[1:4]).all()
    assert features[:, -2].tolist() == [1, 0, 0, 0, 1, 1, 1, 0] and features[:, -1].tolist() == [0, 0, 0, 1, 1, 1, 0, 1]


def tables(folder, count=400):
    clean = "The garden lies behind the house, and every morning somebody walks there.\nIt was quiet; nobody spoke.\n"
    junk = "BUY NOW!!! $$$ | click | click\n>>> 4837 9999 ###\n"
    rows = [(k, (clean if k % 2 else junk) * (1 + k % 5 * (40 if k % 50 == 0 else 1)), k % 2) for k in range(count)]
    docs = [(k, t) for k, t, _ in rows] + [(count, None), (count + 1, ""), (None, "no id"), (3, rows[3][1]), (3, "other text")]
    labels = [(k, y) for k, _, y in rows[: count // 2]] + [(None, 1), (5, None), (7, 0)]
    columns = lambda names, data, kinds: pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*data), kinds)})
    long = pa.int64()
    pq.write_table(columns(["doc_id", "text"], docs, [long, pa.string()]).append_column("score", pa.array(["x"] * len(docs))), f"{folder}/documents.parquet")
    pq.write_table(columns(["doc_id", "quality"], labels, [long, pa.int32()]), f"{folder}/labels.parquet")
    return docs


def test_query(spark, tmp_path):
    docs = tables(tmp_path)
    rows = queries.op6_quality(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["held_out"]) for r in rows) == sorted(
        (str(i), zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0) for i, _ in docs
    )
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    unseen = [r for r in rows if r["doc_id"] is not None and 200 <= r["doc_id"] < 400]
    assert all(r["predicted"] == r["doc_id"] % 2 for r in unseen)
    again = queries.op6_quality(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("a", "Good words here."), ("b", "!!! 99 ##"), ("c", None)], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, quality int")
    assert quality.score_quality(docs, quality.learn(docs, labels)).count() == 3
    field = quality.learn(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, field).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), quality.learn(docs.limit(0), labels)).count() == 0


@pytest.mark.parametrize("text", ["", "\n\n\n", "é" * 5, "a" * 300_000, "\n" * 3000 + "end"])
def test_odd_texts_have_finite_features(text):
    features, size, lines = quality.line_features([text, "other"])
    assert np.isfinite(features).all() and lines[0] == text.count("\n") + 1 and size.sum() == len(text.encode()) - text.count("\n") + 5
