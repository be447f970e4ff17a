"""Longest previous factors beside a look at all pairs of suffixes."""

import random

import numpy as np
from terrace.llm import substring_dedup, suffix_dedup


def test_earlier_factors():
    rng = random.Random(1)
    for trial in range(60):
        data = "".join(rng.choice("ab" if trial % 2 else "abc") for _ in range(rng.randrange(1, 60)))
        length = rng.randrange(1, 6)
        suffixes = sorted(range(len(data)), key=lambda p: (data[p : p + length], rng.random()))  # ties in any order
        common = np.array([False] + [data[a : a + length] == data[b : b + length] and len(data[a : a + length]) == length for a, b in zip(suffixes, suffixes[1:])])
        found = suffix_dedup.earlier_factor(np.array(suffixes), common)
        for place, p in enumerate(suffixes):
            window = data[p : p + length]
            assert found[place] == (len(window) == length and any(data[q : q + length] == window for q in range(p)))
        before, reaches = suffix_dedup.previous_smaller(np.array(suffixes), common)
        for place, p in enumerate(suffixes):
            want = max((k for k in range(place) if suffixes[k] < p), default=-1)
            assert before[place] == want and reaches[place] == (want >= 0 and common[want + 1 : place + 1].all())


def test_matching_statistics():
    """Lengths of the longest string before each place that occurs twice, in contents with separators between."""
    rng = random.Random(2)
    for _ in range(30):
        parts = [[rng.randrange(3) for _ in range(rng.randrange(1, 15))] for _ in range(rng.randrange(1, 6))]
        data = np.array([x * 7919 for p in parts for x in p], np.uint64)
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        index = substring_dedup.FMIndex(data, starts)
        ends = index.at + 1
        want = []
        for p in parts:
            for e in range(1, len(p) + 1):
                count = lambda s: sum(q[k : k + len(s)] == s for q in parts for k in range(len(q) - len(s) + 1))
                want.append(max(n for n in range(e + 1) if n == 0 or count(p[e - n : e]) > 1))
        assert index.matching(ends, 20).tolist() == want
