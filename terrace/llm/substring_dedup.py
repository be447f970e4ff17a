"""Substring dedup by compressed FM-indexes: words inside a window of words that also starts elsewhere.

``windows`` deals the windows to shards by content, so that a window meets every other place where it can occur
in one shard and documents need not be streamed past all shards. A shard's texts are indexed once: suffix array,
Burrows-Wheeler transform and a wavelet tree of packed bit vectors with sampled counts. All windows of a shard
then search backwards side by side, one symbol a step; the steps that an end position survives with at least two
occurrences are its matching statistics, and those that reach the window's length report an interval.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged, and are compared by 64-bit XXH64. Windows lie within one document and
are judged on the input. Null, empty and blank texts have no words; documents of fewer words than a window lose
nothing. Repeated rows are copies of each other. Texts of any length are looked at whole, in pieces of bounded size.
Empty tables give empty results. Columns that are named like new ones are replaced, all others pass through.

The index holds the tree alone, about 1.5 bits for each bit of a symbol's number among those of its shard; windows are
asked by these numbers.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .frames import add_columns, texts, unused, without

GRAM = 8


def symbols(text: str) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.encode().split()], np.uint64)


class WaveletTree:
    """Ranks of symbols in a sequence: one packed bit vector for each bit of a symbol, with a 32-bit count at every word."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.bits, self.size = bits, len(sequence)
        self.words, self.before, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.uint32)].astype(np.uint32))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place, up to a constant of the symbol that differences drop."""
        for level, (words, before, zeros) in enumerate(zip(self.words, self.before, self.zeros)):
            word = place >> 6
            rest = words[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
            ones = before[word].astype(np.int64) + np.bitwise_count(rest)
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            place = np.where(one, zeros + ones, place - ones)
        return place


class FMIndex:
    """Backward search over contents that are separated by symbols of their own."""

    def __init__(self, data: np.ndarray, starts: np.ndarray) -> None:
        ends = np.r_[starts[1:], len(data)]
        values, code = np.unique(data, return_inverse=True)
        n, pieces = len(data), len(starts)
        # a separator, 0 in the alphabet, ends each content; suffixes are told apart by the order of contents
        self.at = np.arange(n) + np.repeat(np.arange(pieces), ends - starts)
        text = np.zeros(n + pieces, np.int64)
        text[self.at] = code + 1
        rank = text + pieces
        separators = np.flatnonzero(text == 0)
        rank[separators] = np.arange(pieces)
        width, longest = 1, int((ends - starts).max()) + 1
        while True:
            follow = np.r_[rank[width:], np.full(min(width, len(rank)), -1)] + 1
            new = np.unique(rank * (int(rank.max()) + 2) + follow, return_inverse=True)[1]
            rank, width = new, width * 2
            if width > longest or int(rank.max()) == len(rank) - 1:
                break
        suffixes = np.argsort(rank, kind="stable")
        last = text[suffixes - 1]
        self.size, self.asked = len(text), text.astype(np.int32)
        self.tree = WaveletTree(last, max(1, int(len(values)).bit_length()))
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=len(values) + 1))]
        self.base = self.tree.rank(np.arange(len(values) + 1), np.zeros(len(values) + 1, np.int64))

    def matching(self, ends: np.ndarray, most: int) -> np.ndarray:
        """Length, up to ``most``, of the longest string that ends before each place and occurs twice or more."""
        found = np.zeros(len(ends), np.int64)
        alive = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for step in range(most):
            symbol = self.asked[ends[alive] - 1 - step].astype(np.int64)
            start = self.first[symbol] - self.base[symbol]
            low, high = start + self.tree.rank(symbol, low), start + self.tree.rank(symbol, high)
            still = (high - low > 1) & (symbol > 0)
            alive, low, high = alive[still], low[still], high[still]
            found[alive] += 1
            if not len(alive):
                break
        return found


def resolver(length: int):
    def resolve(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, order: np.ndarray | None) -> np.ndarray:
        index = FMIndex(data, starts)
        owner = np.repeat(np.arange(len(starts)), counts)
        place = np.repeat(starts, counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        return index.matching(index.at[place + length - 1] + 1, length) >= length

    return resolve


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_words``, ``removed_spans`` (begin and end of runs of removed words) and ``kept`` (the others, spaced)."""
    kind = windows.Kind(symbols, window, min(GRAM, 1 << ((window // 2).bit_length() - 1)), resolver(window))
    own = texts(without(docs, ["n_words", "removed_spans", "kept"]), text)
    found_in, both_in = unused(own, "_spans", "_both")
    marked = windows.with_spans(own, kind, text, doc_id, found_in)
    both = marked.withColumn(both_in, F.struct(F.col(text).alias("t"), F.col(found_in).alias("s"))).drop(found_in)

    def make(rows):
        sizes, spans, kept = [], [], []
        for row in rows:
            words, found = row["t"].encode().split(), windows.runs(row["s"], window)
            ends = [0, *(x for run in found for x in run), len(words)]
            sizes.append(len(words))
            spans.append(found)
            kept.append(b" ".join(w for a, b in zip(ends[::2], ends[1::2]) for w in words[a:b]).decode())
        return [sizes, spans, kept]

    return add_columns(both, both_in, "n_words long, removed_spans array<array<long>>, kept string", make).drop(both_in)
