"""Benchmark decontamination: a prefix-filtered set join of item windows with all documents, verified exactly.

Every item gives windows of ``window`` consecutive words (an item of fewer words is one window). A document
contains a window only if it contains all of the window's shingles, so one of them is a sufficient prefix for
the join. All steps are joins and aggregates of tables:

1. Items give distinct windows, their shingles, and which items have which window.
2. The items' shingles are counted over all documents, and each window takes the one that is rarest there.
3. Documents send the places of these shingles with the words around them. A place fixes where the window would have
   to begin; length and position bounds drop beginnings outside the document, and the rest is compared word by word.
4. Hits become spans and items of each distinct text and go back to its documents.

Documents pass through Python three times (counts, places, numbers of words) and are not shuffled, unless their hits are more than ``FOUND_BYTES``. Up to
``LOOKUP`` shingles are handed to all tasks, which is checked by counting them; beyond that, documents send all their
shingles and the shuffle join alone sorts them out: the same results in one pass, whatever the size of the benchmark.

Words are ASCII letters and digits and all other characters that are not ASCII, with A-Z lower-cased. Null and empty
texts have no words and no hits. A repeated item_id occurs if any of its rows does; an item without words never does.
Documents are answered by their text, so repeated rows get the same answer. Words never match across documents. Very
long documents are processed whole. Empty tables give empty results or no hits; columns named like new ones are
replaced, all others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .frames import Scratch, add_columns, ship, slices, texts, unused, without

SHINGLE = 3
#: Shingles, and words of them, that tasks look up themselves; bytes of hits that are broadcast.
LOOKUP, FOUND_BYTES = 2_000_000, 32 << 20
#: ASCII letters in lower case and digits stay, other ASCII becomes space, bytes of other characters stay.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) | np.uint64(1)


def codes(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the runs of ``size`` words that begin at some places; equal runs have equal numbers, and matches are
    verified."""
    found = np.full(len(starts), size, np.uint64)
    for k in range(size):
        found = (found ^ (found >> np.uint64(29))) * ODD + hashes[starts + k]
    return (found ^ (found >> np.uint64(32))).view(np.int64)


class Lookup:
    """A bounded set of shingles: their numbers, and the hashes of the words they are made of."""

    def __init__(self, numbers: np.ndarray, words: list[str]) -> None:
        self.numbers = np.sort(numbers)
        self.words = dict(zip((w.encode() for w in words), hashes_of([w.encode() for w in words]).tolist()))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Hashes of words, 0 for those in no shingle."""
        get = self.words.get
        return np.array([get(w, 0) for w in words], np.uint64)

    def places(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where shingles of the set begin in a run of words, and which they are."""
        if len(hashes) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = hashes != 0
        every = known[: len(known) - size + 1].copy()
        for k in range(1, size):
            every &= known[k : len(every) + k]
        starts = np.flatnonzero(every)
        found = codes(hashes, starts, size)
        place = np.minimum(np.searchsorted(self.numbers, found), len(self.numbers) - 1)
        good = self.numbers[place] == found
        return starts[good], place[good]


def _runs(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All places of a text and the numbers of the shingles there."""
    starts = np.arange(max(0, len(hashes) - size + 1))
    return starts, codes(hashes, starts, size)


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``item``, ``words`` (joined by blanks), their number ``n`` and the ``codes`` of their shingles, for each window."""

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "text"):
                out = [[], [], [], []]
                for item, text in zip(rows.column("item").to_pylist(), rows.column("text").to_pylist()):
                    words = words_of(text)
                    for k in range(max(1, len(words) - window + 1) if words else 0):
                        part = words[k : k + window]
                        for column, x in zip(out, (item, b" ".join(part).decode(), len(part), _runs(hashes_of(part), min(SHINGLE, len(part)))[1].tolist())):
                            column.append(x)
                kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["item", "words", "n", "codes"])

    ship(items.sparkSession)
    return items.mapInArrow(run, StructType.fromDDL("item string, words string, n int, codes array<long>"))


def _lookup(shingles: DataFrame):
    """The shingles of windows (``code`` and ``words``) as a broadcast set, or None if they are too many for that."""
    numbers = shingles.select("code").distinct()
    words = shingles.select(F.explode(F.split("words", " ")).alias("word")).distinct()
    if max(numbers.count(), words.count()) > LOOKUP:
        return None
    found = numbers.toArrow().column(0).to_numpy().astype(np.int64)
    return numbers.sparkSession.sparkContext.broadcast(Lookup(found, words.toArrow().column(0).to_pylist()))


def shingle_counts(own: DataFrame, sizes: list[int], lookup) -> DataFrame:
    """``code`` and ``n``: occurrences of shingles in all documents, counted per task before the shuffle."""

    def run(batches):
        known = None if lookup is None else lookup.value
        total, gap = None if known is None else np.zeros(len(known.numbers), np.int64), [b" "]
        for batch in batches:
            for rows in slices(batch, "text"):
                lists = (words_of(v) for v in rows.column("text").to_pylist())
                if known is None:
                    parts = [_runs(hashes, size)[1] for hashes in map(hashes_of, lists) for size in sizes]
                    yield counted(*np.unique(np.concatenate(parts or [np.zeros(0, np.int64)]), return_counts=True))
                    continue
                # a word that is in no item parts the texts, so that they are looked at together
                hashes = known.hashes([w for words in lists for part in (words, gap) for w in part])
                for size in sizes:
                    total += np.bincount(known.places(hashes, size)[1], minlength=len(total))
        if known is not None:
            seen = np.flatnonzero(total)
            yield counted(known.numbers[seen], total[seen])

    def counted(numbers, n):
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    parts = own.select("text").mapInArrow(run, StructType.fromDDL("code long, n long"))
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def shingle_places(own: DataFrame, sizes: list[int], window: int, lookup) -> DataFrame:
    """Where shingles begin in each text, its number of words, and the words around with the place of the first."""
    schema = "code long, one long, other long, place int, total int, around string, first int"

    def run(batches):
        known = None if lookup is None else lookup.value
        for batch in batches:
            for rows in slices(batch, "text"):
                out = [[] for _ in range(7)]
                for one, other, text in zip(*(rows.column(c).to_pylist() for c in ("one", "other", "text"))):
                    words = words_of(text)
                    hashes = hashes_of(words) if known is None else known.hashes(words)
                    for size in sizes:
                        if known is None:
                            at, numbers = _runs(hashes, size)
                        else:
                            at, numbers = known.places(hashes, size)
                            numbers = known.numbers[numbers]
                        for k, number in zip(at.tolist(), numbers.tolist()):
                            first = max(0, k - window + size)
                            around = b" ".join(words[first : k + window]).decode()
                            for column, x in zip(out, (number, one, other, k, len(words), around, first)):
                                column.append(x)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
                names = ["code", "one", "other", "place", "total", "around", "first"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return own.mapInArrow(run, StructType.fromDDL(schema))


def found_in_texts(own: DataFrame, items: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Spans and items of each text that has any (``one`` and ``other`` tell texts apart), and about how many bytes."""
    rows = scratch.keep("windows", item_windows(items, window))
    windows = scratch.keep("distinct", rows.groupBy("words").agg(F.first("n").alias("n"), F.first("codes").alias("codes")))
    shingles = windows.select("words", "n", F.posexplode("codes").alias("offset", "code"))
    sizes = [r[0] for r in windows.select(F.least("n", F.lit(SHINGLE)).alias("size")).distinct().collect()]  # three at most
    lookup = _lookup(shingles)
    counts = scratch.keep("counts", shingle_counts(own, sizes, lookup))
    rarest = F.min_by(F.struct("code", "offset", "n"), F.struct("times", "code", "offset")).alias("best")
    chosen = shingles.join(counts.withColumnRenamed("n", "times"), "code").groupBy("words").agg(rarest, F.count("*").alias("seen"))
    # a window with a shingle that no document has occurs in none
    chosen = chosen.where(F.col("seen") == F.greatest(F.col("best.n") - SHINGLE + 1, F.lit(1))).select("words", "best.*")
    chosen = scratch.keep("chosen", chosen)
    places = shingle_places(own, sizes, window, _lookup(chosen))
    start = F.col("place") - F.col("offset")
    inside = (start >= 0) & (start + F.col("n") <= F.col("total"))
    same = F.concat_ws(" ", F.slice(F.split("around", " "), start - F.col("first") + 1, F.col("n"))) == F.col("words")
    hits = places.join(chosen, "code").where(inside).where(same)
    span = F.array(start.cast("long"), (start + F.col("n")).cast("long"))
    texts_ = hits.groupBy("one", "other").agg(F.collect_set(span).alias("spans"), F.collect_set("words").alias("windows"))
    texts_ = scratch.keep("texts", texts_)
    having = rows.select("words", "item").distinct()
    each = texts_.select("one", "other", F.explode("windows").alias("words")).join(having, "words")
    named = each.groupBy("one", "other").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = texts_.join(named, ["one", "other"]).select("one", "other", merged_spans("spans").alias("spans"), "items")
    counted = Observation()
    size = F.sum(F.size("spans") * 40 + F.octet_length(F.array_join("items", "|")) + F.size("items") * 16 + 64)
    found = scratch.keep("found", found.observe(counted, size.alias("bytes")))
    scratch.drop("windows", "distinct", "counts", "chosen", "texts")
    return found, counted.get["bytes"] or 0


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (begin and end of runs of hit words) and ``hit_items`` (sorted as text)."""
    ship(docs.sparkSession)
    asked = items.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    docs = texts(without(docs, [n for n in ("n_words", "hit_spans", "hit_items") if n.lower() != text.lower()]), text)
    hashes = F.xxhash64(text), F.xxhash64(F.lit("second"), text)
    own = docs.select(F.col(text).alias("text"), hashes[0].alias("one"), hashes[1].alias("other"))
    found, size = found_in_texts(own, asked, window, Scratch(docs.sparkSession))
    one, other, spans, hit = unused(docs, "one", "other", "spans", "hit")
    found = found.toDF(one, other, spans, hit)
    marked = docs.withColumns({one: hashes[0], other: hashes[1]})
    joined = marked.join(F.broadcast(found) if size <= FOUND_BYTES else found, [one, other], "left")
    joined = joined.select(
        *[joined[c] for c in docs.columns],
        F.coalesce(spans, F.array().cast("array<array<long>>")).alias("hit_spans"),
        F.coalesce(hit, F.array().cast("array<string>")).alias("hit_items"),
    )
    return add_columns(joined, text, "n_words long", lambda values: [[len(words_of(v)) for v in values]])


def merged_spans(spans: str):
    """The union of overlapping or touching runs of one document."""
    return F.expr(
        f"""aggregate(array_sort({spans}), cast(array() as array<array<bigint>>), (a, s) ->
            case when size(a) > 0 and element_at(a, -1)[1] >= s[0]
                 then concat(slice(a, 1, size(a) - 1), array(array(element_at(a, -1)[0], greatest(element_at(a, -1)[1], s[1]))))
                 else concat(a, array(s)) end)"""
    )
