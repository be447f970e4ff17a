"""Windows of L symbols that occur more than once, in any document, without shuffling a row for each position.

Every window is represented by its anchor, the k-gram in it whose hash is least (the leftmost of equals), so equal
windows have equal anchors at equal places. Consecutive windows of a document with the same anchor occurrence
form a segment: about 2 / (L - k + 2) segments for each symbol, each written as four numbers.

1. Segments are counted by anchor and content, combined before the shuffle. Anchors that occur once, most of
   them, are done: their windows occur once.
2. A segment whose content occurs again is repeated in all its windows.
3. Anchors with several contents are contested: windows of one may occur in another. One occurrence of each
   content is fetched from its text, and the contents of an anchor are compared in one place by the caller's
   ``resolve`` (a suffix array, an FM-index).
4. An anchor with more than ``HOT`` contents is split before that: a window reaches at least half of what the
   anchor leaves to the left of it or to the right, so its windows go on under one of two longer keys, which equal
   windows share. This repeats until groups are small, or the key is the window itself and nothing is to compare.
5. Results go back to all occurrences by their content and become spans of each distinct text.

Joins back are on unique keys on the other side, so hot passages and copies are split by the skew join of AQE.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from .frames import Scratch, settled, ship, slices, unused

#: Contents of one key that are compared in one place, and symbols that a task compares at a time.
HOT, BATCH = 4096, 1 << 19
#: Windows of a text whose anchors are found at a time; longer texts go on with the next ones.
PIECE = 1 << 19
#: A place is 23 bits of a second hash of the text, 31 of the first window and 9 of the number of windows.
COUNT_BITS, START_BITS, EXTRA_BITS = 9, 31, 23
OCCURRENCE = "anchor long, content long, text_hash long, place long, doc_order long"
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Kind:
    """What symbols are: ``symbols`` gives an array for a text, ``length`` symbols are a window, ``gram`` an anchor.

    ``gram`` is a power of two. ``resolve(symbols, starts, counts, order)`` gets contents one behind the other,
    where each starts, its number of windows and its rank, and tells for every window if it occurs in another
    content (with ``first`` kept: in one of lower rank).
    """

    symbols: Callable[[str], np.ndarray]
    length: int
    gram: int
    resolve: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None], np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD
    return x ^ (x >> np.uint64(29))


def grams(symbols: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` symbols, from those of half the size."""
    h = _mixed(symbols.astype(np.uint64) + np.uint64(1))
    width = 1
    while width < size:
        h = _mixed(h[:-width] * ODD + h[width:]) if width * 2 == size else h[:-width] * ODD + h[width:]
        width *= 2
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(symbols: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, content hash, first window and number of windows of each segment."""
    total = len(symbols) - kind.length + 1
    width = kind.length - kind.gram + 1
    found = []
    for begin in range(0, max(0, total), PIECE):
        piece = symbols[begin : min(begin + PIECE, total) + kind.length - 1]
        h = grams(piece, kind.gram)
        low = np.uint64((1 << 20) - 1)
        place = _least((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[first, len(place)])
        found.append((h[place[first].astype(np.int64)], first + begin, count))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    anchor, first, count = (np.concatenate(x) for x in zip(*found))
    raw, item = memoryview(np.ascontiguousarray(symbols)).cast("B"), symbols.itemsize
    digest = xxhash.xxh3_64_intdigest
    ends = (first + count - 1 + kind.length) * item
    content = np.fromiter((digest(raw[a:b]) for a, b in zip((first * item).tolist(), ends.tolist())), np.uint64, len(first))
    return anchor.view(np.int64), content.view(np.int64), first, count


def keyed(docs: DataFrame, text: str, doc_id: str, names: list[str]) -> DataFrame:
    """``docs`` with three columns: two that tell texts apart and the order of documents; nulls come last.

    The order is that of whole numbers, and of the hashes of other ids.
    """
    own = F.col(doc_id) if isinstance(docs.schema[doc_id].dataType, IntegralType) else F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id))
    extra = F.xxhash64(F.lit("second"), text).bitwiseAND(F.lit((1 << EXTRA_BITS) - 1))
    values = F.xxhash64(text), extra, F.coalesce(own.cast("long"), F.lit((1 << 63) - 1))
    return docs.withColumns(dict(zip(names, values)))


def _occurrences(docs: DataFrame, text: str, kind: Kind) -> DataFrame:
    def run(batches):
        for batch in batches:
            for rows in slices(batch, text):
                out = []
                columns = (rows.column(c).to_pylist() for c in (text, "_h", "_x", "_o"))
                for value, h, x, o in zip(*columns):
                    anchor, content, first, count = segments(kind.symbols(value), kind)
                    if len(first):
                        place = (x << (COUNT_BITS + START_BITS)) | (first << COUNT_BITS) | count
                        out.append((anchor, content, np.full(len(first), h), place, np.full(len(first), o)))
                if out:
                    arrays = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "content", "text_hash", "place", "doc_order"])

    return docs.select(text, "_h", "_x", "_o").mapInArrow(run, StructType.fromDDL(OCCURRENCE))


CONTENT = "key long, anchor long, content long, doc_order long, place long, core long, core_size int, from int, to int, symbols binary"


def _fetch(docs: DataFrame, contents: DataFrame, text: str, kind: Kind) -> DataFrame:
    """The symbols of one occurrence of each content, from the texts that have them."""
    wanted = contents.select(
        F.col("first.text_hash").alias("_h"),
        F.shiftrightunsigned("first.place", COUNT_BITS + START_BITS).alias("_x"),
        F.col("first.doc_order").alias("_o"),
        F.struct("anchor", "content", "first.place").alias("want"),
    )
    wanted = wanted.groupBy("_h", "_x", "_o").agg(F.collect_list("want").alias("_want"))
    own = docs.select(text, "_h", "_x", "_o").join(wanted, ["_h", "_x", "_o"]).select(text, "_o", "_want")

    def run(batches):
        low, high = (1 << COUNT_BITS) - 1, (1 << START_BITS) - 1
        for batch in batches:
            for rows in slices(batch, text):
                out = [[] for _ in range(10)]
                for value, order, wants in zip(*(rows.column(c).to_pylist() for c in (text, "_o", "_want"))):
                    symbols = np.ascontiguousarray(kind.symbols(value))
                    for want in wants:
                        start, count = want["place"] >> COUNT_BITS & high, want["place"] & low
                        part = symbols[start : start + count - 1 + kind.length]
                        # where the anchor is: the grams of the last window have it at their head or later
                        h = grams(part, kind.gram) & ~np.uint64((1 << 20) - 1)
                        core = int(np.argmin(h[count - 1 : kind.length - kind.gram + 1])) + count - 1
                        row = (want["anchor"], want["anchor"], want["content"], order, want["place"], core, kind.gram, 0, count, part.tobytes())
                        for column, x in zip(out, row):
                            column.append(x)
                if out[0]:
                    schema = pa.schema(
                        [(n, pa.int64()) for n in ("key", "anchor", "content", "doc_order", "place", "core")]
                        + [(n, pa.int32()) for n in ("core_size", "from", "to")]
                        + [("symbols", pa.binary())]
                    )
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    # repeated rows of one document give the same content twice
    return own.mapInArrow(run, StructType.fromDDL(CONTENT)).dropDuplicates(["anchor", "content"])


def _split(rows: DataFrame, kind: Kind, dtype: np.dtype) -> DataFrame:
    """Each content under two longer keys: its windows that reach far to the left, and those that reach far to the right."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(10)]
            for row in batch.to_pylist():
                symbols = np.frombuffer(row["symbols"], dtype)
                core, size, first, last = row["core"], row["core_size"], row["from"], row["to"]
                half = (kind.length - size + 1) // 2
                # a window p has core - p symbols on the left of the core
                turn = min(max(core - half + 1, first), last)
                for a, b, start in ((first, turn, core - half), (turn, last, core)):
                    if a >= b:
                        continue
                    other = half if start < core else kind.length - size - half + 1
                    new = min(size + other, kind.length)
                    start = core - (new - size) if start < core else core
                    key = xxhash.xxh3_64_intdigest(symbols[start : start + new].tobytes(), row["key"] & 0xFFFFFFFF)
                    key = key - (1 << 64) if key >> 63 else key
                    made = (key, row["anchor"], row["content"], row["doc_order"], row["place"], start, new, a, b, row["symbols"])
                    for column, x in zip(out, made):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, batch.schema)], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


def _compare(rows: DataFrame, kind: Kind, dtype: np.dtype, keep_first: bool) -> DataFrame:
    """Runs of windows of each content that occur in others of its key: ``anchor``, ``content``, ``cut`` (start << 9 | count)."""

    def flush(group):
        table = pa.Table.from_batches(group)
        parts = [np.frombuffer(s, dtype) for s in table.column("symbols").to_pylist()]
        first = table.column("from").to_numpy().astype(np.int64)
        last = table.column("to").to_numpy().astype(np.int64)
        parts = [p[a : b - 1 + kind.length] for p, a, b in zip(parts, first, last)]
        sizes = np.array([len(p) for p in parts], np.int64)
        starts, counts = np.cumsum(sizes) - sizes, last - first
        rank = None
        if keep_first:
            place = table.column("place").to_numpy()
            rank = np.empty(len(parts), np.int64)
            rank[np.lexsort((place, table.column("doc_order").to_numpy()))] = np.arange(len(parts))
        marked = kind.resolve(np.concatenate(parts), starts, counts, rank)
        owner = np.repeat(np.arange(len(parts)), counts)
        within = np.arange(len(marked)) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]
        before = np.r_[False, marked[:-1] & (owner[1:] == owner[:-1])]
        begins = np.flatnonzero(marked & ~before)
        after = np.r_[marked[1:] & (owner[1:] == owner[:-1]), False]
        ends = np.flatnonzero(marked & ~after)
        cut = (within[begins] << COUNT_BITS) | (ends - begins + 1)
        own = owner[begins]
        return pa.RecordBatch.from_arrays(
            [pa.array(table.column("anchor").to_numpy()[own]), pa.array(table.column("content").to_numpy()[own]), pa.array(cut)],
            names=["anchor", "content", "cut"],
        )

    def run(batches):
        group, size = [], 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            edges = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
            lengths = np.diff(np.r_[0, np.cumsum([len(s) for s in batch.column("symbols").to_pylist()])[edges[1:] - 1]]) if len(keys) else []
            start = 0
            for a, length in zip(edges[:-1].tolist(), lengths):
                # between keys, so that no group is divided; the first key of a batch may go on from the last batch
                new = a > 0 or not group or group[-1].column("key")[-1].as_py() != keys[0]
                if new and size > BATCH * dtype.itemsize:
                    if a > start:
                        group.append(batch.slice(start, a - start))
                    yield flush(group)
                    group, size, start = [], 0, a
                size += int(length)
            if len(keys) > start:
                group.append(batch.slice(start))
        if group:
            yield flush(group)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, StructType.fromDDL("anchor long, content long, cut long"))


def _contested(rows: DataFrame, kind: Kind, dtype: np.dtype, keep_first: bool) -> DataFrame:
    """Cuts of all contents, with hot keys split until each can be compared in one place."""
    found = []
    size = kind.gram
    while True:
        hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key")
        hot = settled(hot)
        if hot.isEmpty():
            found.append(_compare(rows, kind, dtype, keep_first))
            break
        found.append(_compare(rows.join(hot, "key", "leftanti"), kind, dtype, keep_first))
        rows = rows.join(hot, "key", "leftsemi").select(*rows.columns)
        if size >= kind.length:
            # the key is the window itself: all of a key are equal
            cut = F.shiftleft(F.col("from").cast("long"), COUNT_BITS).bitwiseOR(F.lit(1))
            if keep_first:
                least = rows.groupBy("key").agg(F.min(F.struct("doc_order", "place")).alias("least"))
                rows = rows.join(least, "key").where(F.struct("doc_order", "place") != F.col("least"))
            found.append(rows.select("anchor", "content", cut.alias("cut")))
            break
        rows = settled(_split(rows, kind, dtype))
        size += (kind.length - size + 1) // 2
    cuts = found[0]
    for more in found[1:]:
        cuts = cuts.unionAll(more)
    return cuts


def repeated_spans(docs: DataFrame, kind: Kind, text: str, keep_first: bool = False) -> DataFrame:
    """For each text with repeated windows, ``_h``, ``_x``, ``_o`` and ``_spans``: first window << 9 | number of windows.

    ``docs`` has ``_h``, ``_x`` and ``_o`` from ``keyed``. Without ``keep_first`` every window that occurs elsewhere counts, and equal
    texts have equal spans; with it, those that occur earlier, in a document of lower ``_o`` or further ahead in
    the same one.
    """
    ship(docs.sparkSession)
    dtype = np.dtype(kind.symbols("").dtype)
    # each table is dropped when the next ones are kept, so that they don't lie side by side
    scratch = Scratch(docs.sparkSession)
    occurrences = scratch.keep("occurrences", _occurrences(docs, text, kind))
    counted = occurrences.groupBy("anchor", "content").agg(F.count("*").alias("n"))
    anchors = counted.groupBy("anchor").agg(F.count("*").alias("contents"), F.sum("n").alias("n")).where("n > 1")
    anchors = scratch.keep("anchors", anchors.select("anchor", "contents"))
    repeated = scratch.keep("repeated", occurrences.join(anchors, "anchor"))
    scratch.drop("occurrences", "anchors")
    least = F.min(F.struct("doc_order", "place", "text_hash")).alias("first")
    contents = repeated.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.max("contents").alias("contents"), least)
    contents = scratch.keep("contents", contents)
    fetched = scratch.keep("fetched", _fetch(docs, contents.where("contents > 1"), text, kind))
    cuts = _contested(fetched, kind, dtype, keep_first).groupBy("anchor", "content").agg(F.collect_set("cut").alias("cuts"))
    info = scratch.keep("info", contents.select("anchor", "content", "n", "first").join(cuts, ["anchor", "content"], "left"))
    scratch.drop("contents", "fetched")
    found = repeated.join(info, ["anchor", "content"])
    low, high = F.lit((1 << COUNT_BITS) - 1), F.lit((1 << START_BITS) - 1)
    start = F.shiftrightunsigned("place", COUNT_BITS).bitwiseAND(high)
    whole = F.array(F.shiftleft(start, COUNT_BITS).bitwiseOR(F.col("place").bitwiseAND(low)))
    parts = F.transform(F.coalesce("cuts", F.array().cast("array<long>")), lambda c: F.shiftleft(start, COUNT_BITS) + c)
    if keep_first:
        is_first = F.struct("doc_order", "place", "text_hash") == F.col("first")
        spans = F.when(is_first, parts).otherwise(whole)
    else:
        spans = F.when(F.col("n") > 1, whole).otherwise(parts)
    extra = F.shiftrightunsigned("place", COUNT_BITS + START_BITS)
    order = F.col("doc_order") if keep_first else F.lit(0).cast("long")
    each = found.select(F.col("text_hash").alias("_h"), extra.alias("_x"), order.alias("_o"), F.explode(spans).alias("span"))
    spans = scratch.keep("spans", each.groupBy("_h", "_x", "_o").agg(F.collect_set("span").alias("_spans")))
    scratch.drop("repeated", "info")
    return spans


def runs(spans: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of symbols that the windows of the spans cover, as begin and end."""
    if not spans:
        return []
    packed = np.sort(np.array(spans, np.int64))
    begin = packed >> COUNT_BITS
    end = np.maximum.accumulate(begin + (packed & ((1 << COUNT_BITS) - 1)) - 1 + length)
    new = np.r_[True, begin[1:] > end[:-1]]
    first = np.flatnonzero(new)
    return list(zip(begin[first].tolist(), end[np.r_[first[1:], len(end)] - 1].tolist()))


def with_spans(docs: DataFrame, kind: Kind, text: str, doc_id: str, added: str, keep_first: bool = False) -> DataFrame:
    """``docs`` (texts not null) with the spans of each text in the column ``added``, null where nothing is repeated."""
    own = keyed(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "text", "id", ["_h", "_x", "_o"])
    spans = repeated_spans(own, kind, "text", keep_first)
    keys = unused(docs, "_h", "_x", "_o")
    marked = keyed(docs, text, doc_id, keys)
    spans = spans.toDF(*keys, added)
    if not keep_first:
        return marked.join(spans.drop(keys[2]), keys[:2], "left").drop(*keys)
    return marked.join(spans, keys, "left").drop(*keys)
