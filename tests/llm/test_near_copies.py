"""Near copies of the pipeline beside brute force over all pairs."""

import random

import numpy as np
import pytest
from terrace.llm import components, near_copies, simhash
from terrace.llm.frames import Scratch

SCHEMA = "doc_id long, text string, node string, cluster string, blocks int, number int, mark int, mine int, Own string"


def rows_with_copies(seed=11):
    """Near copies, texts of the same words in another order or number, chains of edits, a hub, blank and short texts."""
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(150)] for _ in range(6)]
    texts = [" ".join(b) for b in base]

    def edited(words, most):
        words = list(words)
        for _ in range(rng.randrange(1, most)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        return words

    for b in base[:3]:
        texts += [" ".join(sorted(b)), " ".join(b[::-1]), " ".join(b + b), " ".join(b[75:] + b[:75])]
        for _ in range(12):  # each changes some words of the one before it
            b = edited(b, 4)
            texts.append(" ".join(b))
    texts += [" ".join(edited(base[4], 5)) for _ in range(60)]  # mostly like the first one, not like each other
    texts += ["a b c", "c b a", "A  b\tc", "", " \n", texts[0].upper(), texts[1], None]
    rows = list(enumerate(texts)) + [(None, texts[2]), (None, "nothing like it"), (3, texts[3]), (3, texts[3])]
    rng.shuffle(rows)
    return rows


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def groups(count, pairs):
    root = list(range(count))
    for i, j in pairs:
        root = [root[j] if r == root[i] else r for r in root]
    return root


@pytest.mark.parametrize("block", [7, near_copies.BLOCK])
def test_near_copies(spark, monkeypatch, block):
    """All candidates that are similar by 0.8 are joined, whatever the size of a block, and nothing that isn't similar."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "STANDS", 3)
    rows = rows_with_copies()
    sets, prints = [shingles(t) for _, t in rows], [near_copies.word_prints(t or "") for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    alike = {(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    low = (1 << 48) - 1
    near = {(i, j) for i, j in pairs if any(((a ^ b) & low).bit_count() <= 3 for a, b in zip(prints[i], prints[j]))}
    assert len(near - alike) > 9 and len(near & alike) > 60
    assert len(near & alike) >= 0.9 * len(alike)
    found = near_copies.keep_one(spark.createDataFrame([(i, t, "", "", 1, 1, 1, 1, "own") for i, t in rows], SCHEMA)).collect()
    assert set(found[0].asDict()) == {c.split()[0] for c in SCHEMA.split(", ")}
    least, most = groups(len(rows), near & alike), groups(len(rows), alike)
    order = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for (i, t), g in sorted(zip(rows, least), key=lambda r: order(r[0])):
        first.setdefault(g, (i, t or ""))
    kept = {(r["doc_id"], r["text"] or "") for r in found}
    assert len(kept) == len(found) and kept <= set(first.values())
    # what candidates did not bring together may still be joined in a cluster, by pairs that are similar
    firsts_of_all = {}
    for (i, t), g in sorted(zip(rows, most), key=lambda r: order(r[0])):
        firsts_of_all.setdefault(g, (i, t or ""))
    assert set(firsts_of_all.values()) <= kept


def test_sets_are_counted_exactly():
    rng = random.Random(2)
    for trial in range(30):
        sets = [sorted(rng.sample(range(60), rng.randrange(0, 30))) for _ in range(rng.randrange(1, 12))]
        first = rng.randrange(1, len(sets) + 1)
        arrays = [np.array(s, np.uint64) for s in sets]
        want = [[len(set(a) & set(b)) for b in sets] for a in sets[:first]]
        found = near_copies.shared(arrays, first)
        for i in range(first):
            for j in range(len(sets)):
                assert found[i, j] == want[i][j] or i == j and found[i, j] <= want[i][j]


def test_links_of_smaller_fingerprints():
    """Blocks of 12 bits connect what is within three bits, as blocks of 16 do."""
    rng = random.Random(5)
    centres = [rng.getrandbits(48) for _ in range(4)]
    prints = set(centres)
    for _ in range(150):
        p = rng.choice(centres)
        for _ in range(rng.randrange(5)):
            p ^= 1 << rng.randrange(48)
        prints.add(p)
    prints = sorted(prints)
    keys, values = simhash.variants(np.array(prints, np.uint64), 12)
    order = np.lexsort((values, keys))
    u, v = simhash.links_in(keys[order], values[order], 12)
    links = list(zip(u.tolist(), v.tolist()))
    assert links and all((a ^ b).bit_count() <= 3 for a, b in links)
    place = {p: k for k, p in enumerate(prints)}
    near = [(place[a], place[b]) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    same = lambda root: {tuple(k for k, r in enumerate(root) if r == x) for x in root}
    assert same(groups(len(prints), [(place[a], place[b]) for a, b in links])) == same(groups(len(prints), near))


def test_spanning_forest():
    rng = random.Random(8)
    for trial in range(40):
        count = rng.randrange(2, 40)
        links = [(rng.randrange(count), rng.randrange(count)) for _ in range(rng.randrange(1, 80))]
        tree, part = components.forest(*(np.array(c, np.int64) - 9 for c in zip(*links)))
        kept = [pair for pair, needed in zip(links, tree) if needed]
        root, own = groups(count, links), groups(count, kept)
        assert all((root[a] == root[b]) == (own[a] == own[b]) for a in range(count) for b in range(count))
        assert len(kept) == count - len(set(root))
        assert part.tolist() == [root.index(root[a]) - 9 for a, _ in links]


@pytest.mark.parametrize("most", [40, components.FOREST_LINKS])
def test_links_of_a_large_group(spark, monkeypatch, most):
    """A group of similar fingerprints gives a forest of links, and none is lost where the filter drops some of it."""
    monkeypatch.setattr(components, "FOREST_LINKS", most)
    rng = random.Random(17)
    centre = [rng.getrandbits(62) & ~(3 << 46) for _ in range(near_copies.SEEDS)]

    def flipped(value, number, bits):
        for bit in rng.sample(range(bits), number):
            value ^= 1 << bit
        return value

    # alike in the first fingerprint only, as whole ones all of them are close
    rows = [[flipped(centre[0], rng.randrange(4), 46), *(flipped(c, 7, 46) for c in centre[1:])] for _ in range(400)]
    # pairs with a third that is within three bits of both there, but far as a whole; links to it may come first
    met = []
    for _ in range(60):
        one = [rng.getrandbits(62) | 1 << 47 for _ in range(near_copies.SEEDS)]
        i, j = (1 << bit for bit in rng.sample(range(24), 2))
        met += [one, [one[0] ^ i ^ j, *(flipped(c, 7, 46) for c in one[1:])]]
        met.append([max(one[0] ^ i, one[0] ^ j) ^ (0xFFFF << 48 | 1 << 47), *(~c for c in one[1:])])

    def joined(some):
        low, small = (1 << 48) - 1, 1 << 64
        pairs = [(i, j) for i in range(len(some)) for j in range(i)]
        apart = lambda i, j, ks: sum((some[i][k] % small ^ some[j][k] % small).bit_count() for k in ks)
        near = [(i, j) for i, j in pairs if any(((a ^ b) & low).bit_count() <= 3 for a, b in zip(some[i], some[j]))]
        return groups(len(some), [(i, j) for i, j in near if min(apart(i, j, (0, 1)), apart(i, j, (2, 3))) <= near_copies.APART])

    for some in (rows, rows + met):
        names = ", ".join(f"print_{k} long" for k in range(near_copies.SEEDS))
        nodes = spark.createDataFrame([(k, *map(simhash.signed, (v % (1 << 64) for v in r))) for k, r in enumerate(some)], f"node long, {names}")
        scratch = Scratch(spark)
        found = [tuple(r) for r in near_copies.candidate_links(nodes, scratch, len(some)).collect()]
        scratch.drop()
        want, own = joined(some), groups(len(some), found)
        assert all((want[a] == want[b]) == (own[a] == own[b]) for a in range(len(some)) for b in range(a))
        if some is rows and most > 40:
            assert len(found) < len(some)


def test_of_nothing(spark):
    assert near_copies.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(None, None), (4, ""), (None, "")], "doc_id long, text string")
    assert [r["doc_id"] for r in near_copies.keep_one(one).collect()] == [4]
