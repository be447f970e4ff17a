"""Byte-level BPE: speculate with greedy longest matches, verify every adjacent pair, merge only where that fails.

A sequence of tokens is what BPE makes of a word exactly when BPE leaves each adjacent pair of them alone. So a
word's greedy longest-match tokens are a proposal; one vectorised check over all pairs of all new words of a
slice tells which words they are right for, and only the others are merged step by step. Words (pre-tokens of
the pattern) and their ids are kept in a cache of bounded size in each worker.

Null and empty texts have no tokens and decode to the empty text. Special strings inside texts are their own
tokens, as the library has it by default. Repeated rows are encoded each for itself; texts are never cut, a long
one only makes a slice of its own. Empty tables give empty results. Columns that are named like new ones are replaced,
all others pass through.
"""

from __future__ import annotations

import heapq
import json
import re
from dataclasses import dataclass

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .frames import add_columns, texts

#: The fixed split of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts of Latin letters only, whose classes the standard module can spell out and match faster.
#: Texts with other characters, or with ones on which the classes of the two modules differ, take ``PATTERN``.
LATIN, BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", r" \t-\r\x85\xa0"
LATIN_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^{BLANK}{LATIN}0-9]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
NOT_LATIN = re.compile(r"[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
#: Words in a worker's cache, and the longest it keeps.
CACHE_ENTRIES, CACHE_CHARS = 1 << 18, 64
NEVER = np.iinfo(np.int32).max
NONE = (NEVER, -1)
#: Bytes up to which a word is merged by looking over all its pairs, without a heap.
SHORT = 40

_state: dict = {}


def byte_letters() -> dict[str, int]:
    """The letters by which the vocabulary file writes bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """What a worker needs, all of it bound by the size of the vocabulary."""

    pieces: list[bytes]  # bytes of each id
    ids: dict[bytes, int]  # ids that a greedy match may take
    longest: int
    born: np.ndarray  # rank of the merge that makes an id, -1 for single bytes
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray  # left id << 32 | right id of every merge, sorted
    ranks: np.ndarray  # rank of each of them
    made: dict[int, tuple[int, int]]  # pair -> rank, merged id
    special: dict[str, int]


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"]
    plain = split["type"] == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"] and not spec["normalizer"]
    if model["type"] != "BPE" or not plain or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens with conditions")
    size = max([*model["vocab"].values(), *special.values()]) + 1
    pieces = [b""] * size
    for letter_text, i in model["vocab"].items():
        pieces[i] = bytes(letters[c] for c in letter_text)
    number = {p: i for i, p in enumerate(pieces) if p}
    for content, i in special.items():
        pieces[i] = content.encode()
    born, left, right = (np.full(size, -1, np.int64) for _ in range(3))
    made = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = (bytes(letters[c] for c in part) for part in (pair if isinstance(pair, list) else pair.split(" ")))
        i, j, k = number[a], number[b], number[a + b]
        if born[k] >= 0 or max(born[i], born[j]) >= rank:
            raise ValueError(f"{path}: merges out of order")
        born[k], left[k], right[k] = rank, i, j
        made[i << 32 | j] = (rank, k)
    pairs = np.array(sorted(made), np.int64)
    ranks = np.array([made[int(p)][0] for p in pairs], np.int64)
    found = Vocabulary(pieces, {}, 0, born, left, right, pairs, ranks, made, special)
    found.ids = {p: i for p, i in number.items() if merge(p, found, number) == [i]}
    found.longest = max(map(len, found.ids))
    return found


def _merge_short(ids: list[int], made: dict[int, tuple[int, int]]) -> list[int]:
    """The same by looking over all pairs of a few ids for each merge."""
    offers = [made.get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
    while offers and (best := min(offers)) is not NONE:
        i = offers.index(best)
        ids[i : i + 2] = [best[1]]
        del offers[i]
        if i:
            offers[i - 1] = made.get(ids[i - 1] << 32 | ids[i], NONE)
        if i < len(offers):
            offers[i] = made.get(ids[i] << 32 | ids[i + 1], NONE)
    return ids


def merge(word: bytes, v: Vocabulary, number: dict[bytes, int] | None = None) -> list[int]:
    """BPE step by step: the merge of lowest rank first, the leftmost of equals."""
    number = v.ids if number is None else number
    if len(word) <= SHORT:
        return _merge_short([number[word[i : i + 1]] for i in range(len(word))], v.made)
    ids: list[int | None] = [number[word[i : i + 1]] for i in range(len(word))]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(ids) and (found := v.made.get(ids[i] << 32 | ids[j])):
            heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

    for i in range(len(ids) - 1):
        offer(i)
    while heap:
        _, i, a, b, whole = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = whole, None, after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [i for i in ids if i is not None]


def propose(word: bytes, v: Vocabulary) -> list[int]:
    """Greedy longest matches."""
    found, at, ids = [], 0, v.ids
    while at < len(word):
        end = min(len(word), at + v.longest)
        while (i := ids.get(word[at:end])) is None:
            end -= 1
        found.append(i)
        at = end
    return found


def compatible(a: np.ndarray, b: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Whether BPE keeps the tokens ``a[i]`` and ``b[i]`` apart, side by side.

    Merges happen in the order of their ranks. Going back in that order, the boundary is touched by the token on
    its left (x) and the one on its right (y) of that time; x came into being at its own rank and went when the
    token that holds it was made. The pair is lost if x and y have a merge of lower rank than both those ends. Of
    equal ranks the leftmost merge goes first, which saves the pair on the left side and loses it on the right.
    """
    x, y = a.copy(), b.copy()
    x_end, y_end = np.full(len(x), NEVER, np.int64), np.full(len(x), NEVER, np.int64)
    good, at = np.ones(len(x), bool), np.arange(len(x))
    while len(at):
        code = x[at] << 32 | y[at]
        place = np.minimum(np.searchsorted(v.pairs, code), len(v.pairs) - 1)
        rank = np.where(v.pairs[place] == code, v.ranks[place], NEVER)
        lost = (rank < x_end[at]) & (rank <= y_end[at]) & (rank < NEVER)
        good[at[lost]] = False
        at = at[~lost]
        from_x, from_y = v.born[x[at]], v.born[y[at]]
        open_ = (from_x >= 0) | (from_y >= 0)
        at, from_x, from_y = at[open_], from_x[open_], from_y[open_]
        on_x = from_x > from_y
        i, j = at[on_x], at[~on_x]
        x_end[i], y_end[j] = from_x[on_x], from_y[~on_x]
        x[i], y[j] = v.right[x[i]], v.left[y[j]]
    return good


def encode_words(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """Ids of each word: proposals, one check of all their pairs, merging where it fails."""
    proposals = [propose(w, v) for w in words]
    sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
    flat = np.fromiter((i for p in proposals for i in p), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(words)), sizes)
    inner = np.flatnonzero(owner[:-1] == owner[1:]) if len(flat) else np.zeros(0, np.int64)
    codes, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
    good = compatible(codes >> 32, codes & 0xFFFFFFFF, v)[back] if len(codes) else np.zeros(0, bool)
    failed = np.unique(owner[inner[~good]])
    for w in failed.tolist():
        proposals[w] = merge(words[w], v)
    return proposals


class Encoder:
    """Encodes texts with a cache of the packed ids of words, and decodes the ids of whole texts."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.any, self.latin = v, regex.compile(PATTERN), re.compile(LATIN_PATTERN)
        self.packed: dict[str, bytes] = {}
        self.pieces = np.array(v.pieces, object)
        names = sorted(v.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def split(self, text: str) -> list[str]:
        return (self.any if NOT_LATIN.search(text) else self.latin).findall(text)

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text; special strings are words of their own."""
        if self.special is None or not any(s in text for s in self.v.special):
            return self.split(text)
        pieces = self.special.split(text)
        return [w for k, p in enumerate(pieces) for w in ([p] if k % 2 else self.split(p))]

    def _keep(self, words: dict[str, list[int]]) -> None:
        for w, ids in words.items():
            self.packed[w] = np.array(ids, "<u4").tobytes()

    def decode(self, token_ids: bytes) -> str:
        return b"".join(self.pieces[np.frombuffer(token_ids, "<u4")].tolist()).decode("utf-8", "replace")

    def __call__(self, values: list[str]) -> tuple[list[bytes], list[str]]:
        cut = [self.words(v) for v in values]
        needed = set().union(*cut) if cut else set()
        new = [w for w in needed if w not in self.packed]
        if len(self.packed) + len(new) > CACHE_ENTRIES:
            self.packed = {w: self.packed[w] for w in needed if w in self.packed}
        plain = [w for w in new if w not in self.v.special]
        self._keep(dict(zip(plain, encode_words([w.encode() for w in plain], self.v))))
        self._keep({w: [self.v.special[w]] for w in new if w in self.v.special})
        tokens = [b"".join(map(self.packed.__getitem__, words)) for words in cut]
        for w in [w for w in new if len(w) > CACHE_CHARS]:
            del self.packed[w]
        if len(self.packed) > CACHE_ENTRIES:
            self.packed = {}
        return tokens, list(map(self.decode, tokens))


def _worker(table: Broadcast, vocabulary: str) -> Encoder:
    if _state.get("of") != vocabulary:
        _state.update(of=vocabulary, encoder=Encoder(table.value))
    return _state["encoder"]


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (little-endian unsigned 32-bit integers) and ``decoded``, the text they give back."""
    table = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    added = "token_ids binary, decoded string"
    return add_columns(texts(docs, text), text, added, lambda values: list(_worker(table, vocabulary)(values)))


def decode(docs: DataFrame, vocabulary: str, token_ids: str = "token_ids") -> DataFrame:
    """``docs`` with ``decoded``, the text of the packed ids; bytes that aren't UTF-8 become U+FFFD. Null: empty."""
    table = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def make(values):
        encoder = _worker(table, vocabulary)
        return [[encoder.decode(v or b"") for v in values]]

    return add_columns(docs, token_ids, "decoded string", make)
