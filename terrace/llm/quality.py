"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of kinds of characters, lengths and repetition, of the line
itself and of the lines before and after it; the chain adds how likely good and bad follow each other. Forward
and backward passes give each line's probability of being good, the mean of these weighted by the length of the
lines is the document's, and a logistic curve fitted on the same sample turns it into the score.

The field is fitted on a bounded sample: the whole texts of ``SAMPLE_DOCS`` labelled documents, those whose doc_id
hashes lowest, where every line carries the label of its document. Only the lines' own features come to the driver.
Rows held out (crc32 of doc_id as text is divisible by 5; a null doc_id counts as the empty text) are never in
it. Scoring covers all documents and whole texts, line by line; doc_id, lang, source and labels are no input.

Null and empty texts are one empty line and get the score that the field gives that. Without labels of both
kinds the score of every document is the share of good labels, or 0.5 without any. Labels that are null are left
out; a doc_id with several labels counts as good if any of them is. Repeated rows are scored each for itself. Texts
of any length are scored whole. Empty tables give empty results; a column named ``score`` is replaced, all others pass
through; ids may be of any kind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .frames import COLUMN_BYTES, add_columns, ship, slices, texts

SAMPLE_DOCS = 4000
THRESHOLD = 0.3
STEPS, RATE, DECAY = 250, 0.08, 1e-3

#: Kinds of bytes that are counted for each line.
KINDS = ("upper", "lower", "digit", "blank", "stop", "comma", "bang", "bar", "symbol", "high")


def _kinds() -> np.ndarray:
    table = np.full(256, KINDS.index("symbol"), np.uint8)
    for name, members in (
        ("upper", range(65, 91)),
        ("lower", range(97, 123)),
        ("digit", range(48, 58)),
        ("blank", [9, 10, 11, 12, 13, 32]),
        ("stop", b".?:"),
        ("comma", b",;'\"()-"),
        ("bang", b"!"),
        ("bar", b"|"),
        ("high", range(128, 256)),
    ):
        table[list(members)] = KINDS.index(name)
    return table


_TABLE = _kinds()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def line_features(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts (rows by lines), their lengths in bytes, and the lines of each text."""
    own, size, lines = own_features(values)
    return surrounded(own, lines), size, lines


def own_features(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same without those of the lines around."""
    raw = [v.encode() for v in values]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    lines = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    size = ends - starts
    kind = _TABLE[data]
    # the line ends count as blanks of their lines
    line = np.repeat(np.arange(len(size), dtype=np.int32) * len(KINDS), size + 1)
    table = np.bincount(line + kind, minlength=len(size) * len(KINDS)).reshape(-1, len(KINDS)).astype(float)
    count = dict(zip(KINDS, table.T))
    count["blank"] = count["blank"] - 1
    blank = kind == KINDS.index("blank")
    begin = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    of = np.searchsorted(ends, begin, "right")
    words = np.bincount(of, minlength=len(size)).astype(float)
    again_word = np.zeros(len(size))
    if len(begin) > 1:
        stop = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])  # every word ends before a blank
        total = np.add.reduceat(np.where(blank, 0, data).astype(np.int64), begin)
        twin = (of[1:] == of[:-1]) & (np.diff(stop - begin) == 0) & (np.diff(total) == 0) & (data[begin[1:]] == data[begin[:-1]])
        again_word = np.bincount(of[1:][twin], minlength=len(size)).astype(float)
    doubled = np.flatnonzero((data[1:] == data[:-1]) & (kind[1:] >= KINDS.index("bang")) & (kind[1:] != KINDS.index("high"))) + 1
    runs = np.bincount(np.searchsorted(ends, doubled, "right"), minlength=len(size)).astype(float)
    last = kind[np.maximum(ends - 1, 0)]
    again = np.zeros(len(size))
    at = 0
    for r, n in zip(raw, lines):
        if n > 1:
            seen: set[bytes] = set()
            for k, line in enumerate(r.split(b"\n")):
                again[at + k] = bool(line) and line in seen
                seen.add(line)
        at += n
    letters = np.maximum(1, count["upper"] + count["lower"] + count["high"])
    length, word = np.maximum(1, size), np.maximum(1, words)
    shares = [
        count["upper"] / letters,
        count["digit"] / length,
        count["symbol"] / length,
        count["bang"] / word,
        count["bar"] / word,
        runs / word,
        again_word / word,
        count["stop"] / word,
        count["comma"] / word,
        count["blank"] / length,
    ]
    parts = [np.minimum(x, 3.0) for x in shares] + [np.minimum(1.0, 8 * x) for x in shares[:7]] + [x > 0 for x in shares[:7]]
    parts += [
        np.minimum(size / word, 30) / 10,
        np.log1p(words) / 4,
        size == 0,
        words == 1,
        (size > 0) & (last == KINDS.index("stop")),
        again,
    ]
    return np.stack([p.astype(np.float32) for p in parts], 1), size, lines


def surrounded(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features with those of the lines before and after it, and where a text begins and ends."""
    first, final = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[np.cumsum(lines) - lines] = True
    final[np.cumsum(lines) - 1] = True
    before = np.where(first[:, None], 0, np.roll(own, 1, 0))
    after = np.where(final[:, None], 0, np.roll(own, -1, 0))
    edge = np.stack([np.ones(len(own)), first, final], 1)
    return np.concatenate([own, before, after, edge], 1).astype(np.float32)


@dataclass
class Field:
    weights: np.ndarray  # of a line's features, for good against bad
    moves: np.ndarray  # log potentials [from, to] of bad (0) and good (1)
    slope: float
    shift: float
    prior: float | None = None  # the score of everything, where there was nothing to learn


def passes(odds: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds of good (with a line's own) and backward odds (without), for all chains side by side."""
    t = np.exp(moves)
    order = np.argsort(-lines, kind="stable")
    begin = (np.cumsum(lines) - lines)[order]
    alive = np.searchsorted(-lines[order], -np.arange(lines.max(initial=0)), "left")  # chains longer than k
    forth, back = odds.copy(), np.ones(len(odds))
    for k in range(1, len(alive)):
        at = begin[: alive[k]] + k
        a = forth[at - 1]
        forth[at] = np.clip(odds[at] * (a * t[1, 1] + t[0, 1]) / (a * t[1, 0] + t[0, 0]), 1e-30, 1e30)
    final = begin + lines[order] - 1
    for k in range(1, len(alive)):
        at = final[: alive[k]] - k
        b = odds[at + 1] * back[at + 1]
        back[at] = np.clip((t[1, 1] * b + t[1, 0]) / (t[0, 1] * b + t[0, 0]), 1e-30, 1e30)
    return forth, back


def marginals(features: np.ndarray, lines: np.ndarray, field: Field) -> np.ndarray:
    """Each line's probability of being good."""
    odds = np.exp(np.clip(features @ field.weights, -30, 30).astype(float))
    forth, back = passes(odds, lines, field.moves)
    both = np.clip(forth * back, 1e-30, 1e30)
    return both / (1 + both)


def weighted(good: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Length-weighted mean over the lines of each text."""
    begin = np.cumsum(lines) - lines
    weight = size + 1.0
    return np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(features: np.ndarray, size: np.ndarray, lines: np.ndarray, labels: np.ndarray) -> Field:
    """Maximum likelihood with a small decay, by Adam over the whole sample; a chain counts by the root of its length."""
    owner = np.repeat(np.arange(len(lines)), lines)
    y = labels[owner].astype(float)
    weight = (lines**-0.5)[owner]
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    total = weight.sum()
    width = features.shape[1]
    x = np.zeros(width + 4)
    mean, spread = np.zeros_like(x), np.zeros_like(x)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), weight[inner])
    for step in range(1, STEPS + 1):
        moves = x[width:].reshape(2, 2)
        odds = np.exp(np.clip(features @ x[:width], -30, 30))
        forth, back = passes(odds, lines, moves)
        both = np.clip(forth * back, 1e-30, 1e30)
        gradient = features.T @ (weight * (y - both / (1 + both)))
        expected = np.zeros((2, 2))
        if len(inner):
            a, b = forth[inner], odds[inner + 1] * back[inner + 1]
            t = np.exp(moves)
            joint = np.stack([np.full(len(a), t[0, 0]), t[0, 1] * b, a * t[1, 0], a * b * t[1, 1]], 1)
            joint /= joint.sum(1, keepdims=True)
            expected = (joint * weight[inner, None]).sum(0).reshape(2, 2)
        slope = np.r_[gradient, (seen - expected).ravel()] / total - DECAY * x
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.999 * spread + 0.001 * slope**2
        x = x + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    field = Field(x[:width].astype(np.float32), x[width:].reshape(2, 2), 1.0, 0.0)
    z = logit(weighted(marginals(features, lines, field), size, lines))
    a, b, y = 1.0, 0.0, labels.astype(float)
    for _ in range(50):  # Newton steps of a logistic curve, held near the identity
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([(z * (y - p)).sum() - (a - 1), (y - p).sum() - b])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
        move = np.linalg.solve(h, g)
        a, b = a + np.clip(move[0], -1, 1), b + np.clip(move[1], -1, 1)
    field.slope, field.shift = float(max(a, 0.05)), float(b)
    return field


def scores(values: list[str], field: Field) -> list[float]:
    if field.prior is not None:
        return [field.prior] * len(values)
    features, size, lines = line_features(values)
    z = logit(weighted(marginals(features, lines, field), size, lines))
    return (1 / (1 + np.exp(-np.clip(field.slope * z + field.shift, -30, 30)))).tolist()


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str) -> DataFrame:
    """The sampled documents, one row for each id: ``_id``, ``label`` and ``text``."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("label"))
    # at most SAMPLE_DOCS rows of two numbers: small enough to broadcast at any size of the tables
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
    own = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # of a repeated id one row, so that no more than SAMPLE_DOCS are collected; which one doesn't depend on their order
    chosen = F.min_by("text", F.xxhash64("text")).alias("text")
    return own.join(F.broadcast(known), "_id").groupBy("_id", "label").agg(chosen)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Field:
    schema = StructType.fromDDL("id long, good boolean, size binary, features binary")

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "text", COLUMN_BYTES):
                values = rows.column("text").to_pylist()
                if not values:
                    continue
                own, size, lines = own_features(values)
                ends = np.cumsum(lines)
                parts = [slice(end - n, end) for end, n in zip(ends.tolist(), lines.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("_order"),
                        rows.column("good"),
                        pa.array([size[p].astype("<i4").tobytes() for p in parts], pa.binary()),
                        pa.array([own[p].astype("<f4").tobytes() for p in parts], pa.binary()),
                    ],
                    names=["id", "good", "size", "features"],
                )

    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, text, doc_id, label)
    sample = sample.select(F.xxhash64("_id").alias("_order"), (F.col("label") > 0).alias("good"), "text").mapInArrow(run, schema)
    rows = sorted(sample.collect(), key=lambda r: (r["id"], r["size"], r["features"]))
    y = np.array([r["good"] for r in rows])
    if len(set(y.tolist())) < 2:
        return Field(np.zeros(0), np.zeros((2, 2)), 1.0, 0.0, float(y.mean()) if len(y) else 0.5)
    size = [np.frombuffer(r["size"], "<i4") for r in rows]
    lines = np.array([len(s) for s in size], np.int64)
    own = np.concatenate([np.frombuffer(r["features"], "<f4") for r in rows]).reshape(int(lines.sum()), -1)
    return fit(surrounded(own, lines), np.concatenate(size).astype(np.int64), lines, y)


def score_quality(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` between 0 and 1, higher for better texts."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return add_columns(texts(docs, text), text, "score double", lambda values: [scores(values, shared.value)])
