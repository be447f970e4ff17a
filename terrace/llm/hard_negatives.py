"""Hard negatives: for each anchor and each of its nearest rows of the same label, the best rows of other labels whose
score lies in a band below the positive's.

Scores of a block of rows against a batch of anchors are one matrix product. What leaves a block are packed pair
scores, (anchor, descending score, id), and of them only those that can still count:

1. the block's first rows of the anchor's own label. The shuffle by anchor leaves its first positives of all blocks;
2. with these known, for each of them the block's first rows of other labels within its band.

The second shuffle is a secondary sort: pairs are dealt by anchor and sorted by (anchor, descending score, id), the
positives in front of equal scores. One iterator goes through them: a positive opens a window, every following
negative goes to the open windows whose band it meets, and a window closes when it is full or the scores have fallen
below its band. It holds the windows of one anchor, never its pairs. An anchor sends at most ``positives * (1 +
negatives)`` pairs from each block, so hot labels and repeated rows don't gather anywhere.

Components are whole numbers. Scores are exact: a float64 product where no sum can pass 2**53, whole numbers of any
size elsewhere; a score that no long can hold is an error. A shorter vector counts as if filled up with zeros.
Rows with a null label or a null vector or any null component take no part. A null id is no anchor and comes after
all others in ties. Rows are told apart by where they lie, not by id: of rows with the same id each is a row, and
repeated anchors each give their own result. Empty tables give empty results. Other columns are not looked at, so
their names may clash with any here. Texts play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType
from pyspark.sql.window import Window

from .frames import settled, ship

#: Rows of a block, anchors scored at a time, and partitions that blocks are dealt to at most (a partition takes
#: several blocks in turn).
BLOCK_ROWS, ANCHORS, PARTITIONS = 8192, 64, 50_000
PAIR = "anchor long, anchor_id long, score_order long, kind int, id long"


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows of whole numbers, filled up with zeros; Python's own where 64 bits might not do."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place < width
    out[row[inside], place[inside]] = values[inside]
    return out


def _products(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``one`` with all of ``other``, exact."""
    bound = _size(one) * _size(other) * one.shape[1] * 100  # bands compare hundredfold scores
    if bound < 1 << 53:
        return (one.astype(np.float64) @ other.T.astype(np.float64)).astype(np.int64)
    if not one.shape[1]:
        return np.zeros((len(one), len(other)), np.int64)
    return one.astype(object) @ other.T.astype(object)


def _size(values: np.ndarray) -> int:
    return max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))


def _first(scores: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` largest scores among some ascending places; of equal ones the first."""
    if len(among) > most:
        own = scores[among]
        among = among[own >= np.partition(own, len(own) - most)[len(own) - most]]
    return among[np.argsort(-scores[among], kind="stable")[:most]]


def _compared(rows: DataFrame, anchors: DataFrame, blocks: int, pick) -> DataFrame:
    """Pairs that ``pick(scores, same, anchor)`` chooses for each anchor in each block of rows.

    ``pick`` gets the scores of the block's rows in the order of their ids, which of them have the anchor's label
    (without the anchor itself: 1, other labels: 0, the anchor: 2) and the anchor's ``bands``.
    """

    def run(batches):
        gathered, block, held = [], None, None
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            kinds = batch.column("kind").to_numpy()
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if begin == end:
                    continue
                if numbers[begin] != block:
                    gathered, block, held = [], numbers[begin], None
                part = batch.slice(begin, end - begin)
                if not kinds[begin]:
                    gathered.append(part)
                    continue
                if held is None:
                    held, gathered = _held(gathered), []
                for start in range(0, part.num_rows, ANCHORS):
                    yield _picked(held, part.slice(start, ANCHORS), pick)

    ship(rows.sparkSession)
    columns = ["row", "id", "label", "vector"]
    own = rows.select("block", F.lit(0).alias("kind"), *columns, F.lit(None).cast("array<long>").alias("bands"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = anchors.select(everywhere.alias("block"), F.lit(1).alias("kind"), *columns, "bands")
    dealt = own.unionAll(asked).repartitionById(min(blocks, PARTITIONS), F.col("block"))
    return dealt.sortWithinPartitions("block", "kind").mapInArrow(run, StructType.fromDDL(PAIR))


def _held(parts: list[pa.RecordBatch]) -> tuple:
    """Row numbers, ids, labels and vectors of a block in the order of ids, null ids last."""
    table = pa.Table.from_batches(parts).combine_chunks()
    ids = table.column("id")
    order = pa.compute.sort_indices(table.select(["id", "row"]), [("id", "ascending"), ("row", "ascending")])
    table, ids = table.take(order), ids.take(order)
    vectors = table.column("vector").combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    return table.column("row").to_numpy(), ids.combine_chunks(), table.column("label").to_numpy(), _matrix(vectors)


def _picked(held: tuple, anchors: pa.RecordBatch, pick) -> pa.RecordBatch:
    rows, ids, labels, vectors = held
    scores = _products(_matrix(anchors.column("vector"), vectors.shape[1]), vectors)
    own, label, number = (anchors.column(c).to_numpy() for c in ("row", "label", "id"))
    bands = anchors.column("bands").to_pylist()
    anchor, anchor_id, order, kind, other = [], [], [], [], []
    for k in range(anchors.num_rows):
        same = (labels == label[k]).astype(np.int8)
        same[rows == own[k]] = 2
        chosen = pick(scores[k], same, bands[k])
        anchor.append(np.full(len(chosen), own[k]))
        anchor_id.append(np.full(len(chosen), number[k]))
        order.extend((-scores[k][chosen]).tolist())
        kind.append((same[chosen] != 1).astype(np.int32))
        other.append(chosen)
    arrays = [
        pa.array(np.concatenate(anchor).astype(np.int64)),
        pa.array(np.concatenate(anchor_id).astype(np.int64)),
        pa.array(order, pa.int64()),
        pa.array(np.concatenate(kind).astype(np.int32)),
        ids.take(pa.array(np.concatenate(other).astype(np.int64))),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["anchor", "anchor_id", "score_order", "kind", "id"])


def _windows(pairs: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """Negatives of each positive, from pairs in the order of (anchor, descending score, id)."""

    def run(batches):
        anchor, open_ = None, []
        for batch in batches:
            out = []
            for own, own_id, order, kind, other in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if own != anchor:
                    anchor, open_ = own, []
                score = -order
                if not kind:
                    open_.append([other, score, 0])
                    continue
                full = False
                for window in open_:
                    if low * window[1] <= 100 * score <= high * window[1]:
                        window[2] += 1
                        out.append((own_id, window[0], window[2], other, window[1], score))
                        full |= window[2] == negatives
                    full |= 100 * score < low * window[1]
                if full:
                    open_ = [w for w in open_ if w[2] < negatives and 100 * score >= low * w[1]]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    names = StructType.fromDDL(result).names
    ordered = pairs.repartition("anchor").sortWithinPartitions("anchor", "score_order", "kind", F.col("id").asc_nulls_last())
    return ordered.select("anchor", "anchor_id", "score_order", "kind", "id").mapInArrow(run, StructType.fromDDL(result))


def mine(
    rows: DataFrame,
    anchor: Column,
    vector: str = "vector",
    label: str = "label",
    row_id: str = "vec_id",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    ``vector`` is an array of longs, ``anchor`` tells which rows are asked for. The positives of an anchor are its
    first other rows of the same label by score, then id. The negatives of each are the first rows of other labels
    whose score is between ``low`` and ``high`` per cent of the positive's.
    """
    whole = isinstance(rows.schema[label].dataType, IntegralType)
    own = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    own = own.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(row_id).cast("long").alias("id"),
        (F.col(label).cast("long") if whole else F.xxhash64(label)).alias("label"),
        F.col(vector).cast("array<long>").alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("asked"),
    )
    own = settled(own)
    blocks = max(1, math.ceil(own.count() / BLOCK_ROWS))
    own = own.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    anchors = own.where(F.col("asked") & F.col("id").isNotNull())

    def nearest(scores, same, _):
        return _first(scores, np.flatnonzero(same == 1), positives)

    found = _compared(own, anchors.withColumn("bands", F.lit(None).cast("array<long>")), blocks, nearest)
    order = Window.partitionBy("anchor").orderBy("score_order", F.col("id").asc_nulls_last())
    best = settled(found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives).drop("k"))

    def within(scores, same, bands):
        other = np.flatnonzero(same == 0)
        hundred = 100 * scores[other]
        chosen = [other[:0]]
        for band in set(bands):
            inside = other[((hundred >= low * band) & (hundred <= high * band)).astype(bool)]
            chosen.append(_first(scores, inside, negatives))
        return np.unique(np.concatenate(chosen))

    bands = best.groupBy("anchor").agg(F.collect_list(-F.col("score_order")).alias("bands"))
    asked = anchors.join(bands, anchors["row"] == bands["anchor"]).select(anchors["*"], "bands")
    return _windows(best.unionAll(_compared(own, asked, blocks, within)), negatives, low, high)
