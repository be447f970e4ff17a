"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found by permuterm rotations.

A word gets a terminator and is written in all its rotations. Of each, the letter that would be edited comes last, so
what it leaves, the rotation without its last letter, is a prefix range of all sorted rotations: the words in it
differ by a replacement at that place, and if the range begins with a whole rotation, that word is what deleting
the letter leaves. Each rotation is written under both names it can be met by, its whole and its prefix, dealt by
name and sorted; a scan then sees one range at a time. A range has one word for each letter of the alphabet at most
and one that is whole.

The scan emits no pairs. Every word of a range gets one row: how many neighbours it has there, and the one that
occurs most (of equal ones the first in code-point order). A pair meets in one range only: words of the same length
at the place where they differ, others where the letter that goes is the first of a run of equal ones. So the
numbers add up, and the best of a word is the best of its ranges.

Words have numbers in code-point order, so ties are settled without their texts. A word's form is its best neighbour
if that occurs at least ``ratio`` times as often. Forms occur more and more often, so chains are short (a logarithm
of the largest count) and roots are found by following two steps at once, each round cut by a checkpoint.

Ranges are named by the letters themselves up to ``PLAIN`` of them, so longer words don't take the square of their
length: there the parts before and behind the place are named by 128-bit digests that run along the word.

Runs are ``[A-Za-z\\u00C0-\\u00FF]+`` of the whole text with A-Z lower-cased. Null and empty texts have none; a null
doc_id counts as an empty one in the check sum; repeated rows count each time; very long texts are counted in
pieces; empty tables give empty results. Other columns are not looked at, so their names may clash with any here.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .frames import settled, ship, slices, texts

#: À to ÿ are C3 80 to C3 BF in UTF-8.
RUN = re.compile(rb"(?:[a-z]++|(?:\xc3[\x80-\xbf])++)++")
MARK = "$"
#: Longest name of a range that is spelt out; distinct words that a task counts before it passes them on; rows and
#: letters that it writes at a time.
PLAIN, COUNTED, ROWS = 64, 1 << 17, 1 << 16
#: Bytes of a text up to which all its runs are listed at once.
LISTED = 4 << 20


def run_counts(data: bytes) -> Counter:
    """Occurrences of each run of a text given as UTF-8."""
    data = data.lower()  # of bytes: A to Z only
    return Counter(RUN.findall(data) if len(data) <= LISTED else (m[0] for m in RUN.finditer(data)))


def slipped(run: bytes, digest: int) -> bytes:
    """The run without one letter."""
    letters = run.decode()
    place = digest % len(letters)
    return (letters[:place] + letters[place + 1 :]).encode()


def count_words(docs: DataFrame, slips: int = 0, shortest: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word`` and ``n``, its occurrences in all documents, for words of at least ``shortest`` letters.

    With ``slips`` a run loses a letter before it is counted if ``slips`` divides the CRC-32 of
    ``<doc_id>:<run>``: letter number CRC-32 modulo its length.
    """

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for rows in slices(batch, "text"):
                for own, value in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist()):
                    begun = zlib.crc32(f"{own}:".encode())
                    for found, times in run_counts(value.encode()).items():
                        if len(found) < shortest:  # bytes are no fewer than letters
                            continue
                        if slips and (digest := zlib.crc32(found, begun)) % slips == 0:
                            found = slipped(found, digest)
                        total[found] += times
                    if len(total) > COUNTED:
                        yield _counts(total)
                        total = Counter()
        yield _counts(total)

    ship(docs.sparkSession)
    own = texts(docs, text).select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    parts = own.mapInArrow(run, StructType.fromDDL("word string, n long"))
    return parts.where(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n"))


def _counts(total: Counter) -> pa.RecordBatch:
    words = pa.array(list(total), pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def names(word: str):
    """The ranges a word lies in: name, and 0 for its own whole rotation, else 1 or 2 for one without a letter.

    1 is the first of a run of equal letters, 2 any other.
    """
    size = len(word)
    first = [1 if not k or word[k] != word[k - 1] else 2 for k in range(size)]
    if size <= PLAIN:
        for k in range(size):
            yield word[k + 1 :] + MARK + word[:k], first[k]
    if size < PLAIN:
        for k in range(size + 1):
            yield word[k:] + MARK + word[:k], 0
        return
    before, behind = _running(word), _running(word[::-1])[::-1]
    if size > PLAIN:
        for k in range(size):
            yield before[k] + behind[k + 1], first[k]
    for k in range(size + 1):
        yield before[k] + behind[k], 0


def _running(word: str) -> list[str]:
    """Digests of all beginnings of a word."""
    digest, found = blake2b(digest_size=16), []
    for letter in word:
        found.append(digest.copy().hexdigest())
        digest.update(letter.encode())
    return [*found, digest.hexdigest()]


def _rotations(words: DataFrame) -> DataFrame:
    def run(batches):
        keys, owners, counts, kinds = [], [], [], []

        def full():
            arrays = [pa.array(keys, pa.string()), pa.array(owners, pa.int64()), pa.array(counts, pa.int64()), pa.array(kinds, pa.int32())]
            for c in (keys, owners, counts, kinds):
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["name", "id", "n", "kind"])

        for batch in batches:
            for own, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for name, kind in names(word):
                    keys.append(name)
                    owners.append(own)
                    counts.append(n)
                    kinds.append(kind)
                    if len(keys) >= ROWS:
                        yield full()
        yield full()

    return words.select("id", "word", "n").mapInArrow(run, StructType.fromDDL("name string, id long, n long, kind int"))


def neighbours(group: np.ndarray, ids: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each row of whole ranges: its neighbours there, and count and number of the best one (-1: none)."""
    groups = int(group[-1]) + 1
    edited, first = kind > 0, kind == 1
    whole = np.full(groups, -1)
    whole[group[kind == 0]] = np.flatnonzero(kind == 0)

    def ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the best and the second best of each range."""
        order = rows[np.lexsort((ids[rows], -n[rows], group[rows]))]
        begin = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else order
        best, second = np.full(groups, -1), np.full(groups, -1)
        best[group[order[begin]]] = order[begin]
        follows = begin + 1
        follows = follows[follows < len(order)]
        follows = follows[group[order[follows]] == group[order[follows - 1]]]
        second[group[order[follows]]] = order[follows]
        return best, second

    def better(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        wins = (n[other] > n[one]) | ((n[other] == n[one]) & (ids[other] < ids[one]))
        return np.where((one < 0) | ((other >= 0) & wins), other, one)

    all_edited, of_first = ranked(np.flatnonzero(edited)), ranked(np.flatnonzero(first))
    places = np.arange(len(group))
    beside = np.where(all_edited[0][group] == places, all_edited[1][group], all_edited[0][group])
    shorter = np.where(first, whole[group], -1)
    choice = np.where(edited, better(beside, shorter), of_first[0][group])
    count = np.where(edited, np.bincount(group[edited], minlength=groups)[group] - 1 + (shorter >= 0), np.bincount(group[first], minlength=groups)[group])
    return count, np.where(choice >= 0, n[choice], -1), np.where(choice >= 0, ids[choice], -1)


def _scanned(rotations: DataFrame) -> DataFrame:
    """A row for each word of a range in which it has neighbours."""

    def ranges(rows: pa.Table):
        name = rows.column("name").combine_chunks()
        change = pc.not_equal(name.slice(1), name.slice(0, len(name) - 1)).to_numpy(zero_copy_only=False)
        group = np.cumsum(np.r_[0, change.astype(np.int64)])
        ids, n, kind = (rows.column(c).to_numpy() for c in ("id", "n", "kind"))
        count, best_n, best = neighbours(group, ids, n, kind)
        some = count > 0
        arrays = [pa.array(c[some]) for c in (ids, count, best_n, best)]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "near", "best_n", "best"])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            # the last range may go on in the next batch; it has no more rows than letters
            last = rows.column("name")[rows.num_rows - 1]
            whole = pc.index(rows.column("name"), last).as_py()
            if whole:
                yield ranges(rows.slice(0, whole).combine_chunks())
            rest = rows.slice(whole).combine_chunks()
        if rest is not None:
            yield ranges(rest)

    dealt = rotations.repartition("name").sortWithinPartitions("name")
    return dealt.mapInArrow(run, StructType.fromDDL("id long, near long, best_n long, best long"))


def _roots(links: DataFrame) -> DataFrame:
    """``id`` and ``top``, the end of the chain that ``links`` (``id``, ``top``) begin."""
    now = settled(links)
    while not now.join(now.select(F.col("id").alias("top")), "top", "leftsemi").isEmpty():
        further = now.select(F.col("id").alias("top"), F.col("top").alias("further"))
        now = settled(now.join(further, "top", "left").select("id", F.coalesce("further", "top").alias("top")))
    return now


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of distinct ``word``s with their counts ``n``.

    ``n_near`` counts the words at one edit. ``form`` is the one of them that occurs most, if that is at least
    ``ratio`` times as often, ``root`` the end of the chain of forms. A null word is left out.
    """
    if ratio <= 1:
        raise ValueError("forms must occur more often than what they stand for")
    ship(words.sparkSession)
    own = settled(words.where(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")))
    # partitions follow each other in the order of words, and so do the numbers given in them
    own = own.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id())
    own = settled(own)
    rows = _scanned(_rotations(own))
    best = F.max(F.struct(F.col("best_n"), (-F.col("best")).alias("minus"))).alias("best")
    near = rows.groupBy("id").agg(F.sum("near").alias("n_near"), best)
    form = F.when(F.col("best.best_n") >= ratio * F.col("n"), -F.col("best.minus"))
    found = settled(own.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form_id")))
    tops = _roots(found.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("top")))
    forms = own.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    roots = own.select(F.col("id").alias("top"), F.col("word").alias("root"))
    ended = found.join(tops, "id", "left").join(forms, "form_id", "left").join(roots, "top", "left")
    return ended.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
