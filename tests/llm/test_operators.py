"""The operators on small tables, beside brute force, the libraries or held-out labels; odd rows included."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from terrace.llm import bpe, components, decontaminate, fingerprints, html_extract, quality, simhash, substring_dedup
from terrace.llm import suffix_dedup, token_counts, url_filter, windows

BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, n_tokens string, Score string, kept string, fingerprint string, n_words string"


def made(count=60, seed=3):
    """Random texts with copies, shared passages, ties, nulls, empty and long texts."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma,", "délta", "Épsilon", "zeta|eta", "theta.", "x", "42", "漢字"]
    line = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "7"]) for _ in range(n))
    passage, short = line(60), line(22)
    texts = [line(rng.randint(0, 90)) for _ in range(count)]
    texts = [t + "\n" + passage + " " + line(5) if k % 7 == 0 else t for k, t in enumerate(texts)]
    texts = [t[: len(t) // 2] + " " + short + t[len(t) // 2 :] if k % 5 == 0 else t for k, t in enumerate(texts)]
    texts += [texts[3], texts[3], texts[0], None, "", "   \n\t", "<|endoftext|> a <s> ▁b  c ", passage, line(3000), texts[1] + " " + passage]
    return list(enumerate(texts)) + [(5, texts[5]), (None, texts[6]), (7, None)]


@pytest.fixture(scope="module")
def rows():
    return made()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "own", "own", "own", "own", "own") for i, t in rows], SCHEMA)


def by_row(result, *columns):
    return Counter(tuple(r[c] for c in columns) for r in result.collect())


def repeated(sequences, length):
    """Which places of each sequence a window that starts twice or more covers."""
    windows_ = Counter(s[p : p + length] for s in sequences for p in range(len(s) - length + 1))
    found = []
    for s in sequences:
        covered = np.zeros(len(s), bool)
        for p in range(len(s) - length + 1):
            covered[p : p + length] |= windows_[s[p : p + length]] > 1
        found.append(covered)
    return found


def test_token_counts(spark, rows):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    found = token_counts.count_tokens(frame(spark, rows), PIECES)
    assert found.columns.count("n_tokens") == 1 and "lang" in found.columns
    want = Counter((i, t or "", len(model.encode(t or ""))) for i, t in rows)
    assert by_row(found, "doc_id", "text", "n_tokens") == want


def test_bpe_round_trip(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    encoded = bpe.encode(frame(spark, rows), BYTE_BPE).cache()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r["doc_id"], bytes(r["token_ids"]), r["decoded"]) for r in encoded.collect()) == want
    again = bpe.decode(encoded.drop("decoded"), BYTE_BPE)
    assert by_row(again, "doc_id", "decoded") == by_row(encoded, "doc_id", "decoded")


def test_compatible_pairs_are_what_merging_keeps():
    v = bpe.load(BYTE_BPE)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3000, 4000), rng.integers(0, 3000, 4000)
    good = bpe.compatible(a, b, v)
    assert good.tolist() == [bpe.merge(v.pieces[i] + v.pieces[j], v) == [i, j] for i, j in zip(a.tolist(), b.tolist())]
    word = b"abcabcaaaa" * 20
    assert bpe.merge(word, v) == bpe.encode_words([word], v)[0] == bpe._merge_short([v.ids[bytes([c])] for c in word], v.made)


@pytest.mark.parametrize("hot", [windows.HOT, 1])
def test_suffix_dedup(spark, rows, monkeypatch, hot):
    """``hot`` of 1 splits every contested key down to single windows."""
    monkeypatch.setattr(windows, "HOT", hot)
    found = suffix_dedup.remove_repeats(frame(spark, rows), length=64)
    sequences = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), s, covered in zip(rows, sequences, repeated(sequences, 64)):
        want[(i, bytes(np.frombuffer(s, np.uint8)[~covered]) if s else b"")] += 1
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in found.collect()) == want


@pytest.mark.parametrize("hot", [windows.HOT, 1])
def test_suffix_dedup_keeps_the_first(spark, monkeypatch, hot):
    monkeypatch.setattr(windows, "HOT", hot)
    rows = [(i, t) for i, t in made(40, 9) if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())  # one row for each doc_id
    random.Random(1).shuffle(rows)
    found = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(frame(spark, rows), 64, "first").collect()}
    seen = set()
    for i, t in sorted(rows):
        s = (t or "").encode()
        covered = np.zeros(len(s), bool)
        for p in range(len(s) - 63):
            covered[p : p + 64] |= s[p : p + 64] in seen
            seen.add(s[p : p + 64])
        assert found[i] == (bytes(np.frombuffer(s, np.uint8)[~covered]) if s else b""), i


@pytest.mark.parametrize("hot", [windows.HOT, 1])
def test_substring_dedup(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(windows, "HOT", hot)
    found = substring_dedup.remove_repeats(frame(spark, rows), window=12)
    sequences = [tuple((t or "").encode().split()) for _, t in rows]
    want = Counter()
    for (i, _), s, covered in zip(rows, sequences, repeated(sequences, 12)):
        want[(i, len(s), b" ".join(w for w, c in zip(s, covered) if not c).decode())] += 1
    assert by_row(found, "doc_id", "n_words", "kept") == want


def linked(prints):
    """Smallest fingerprint that each can reach in steps of three bits."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for p in prints:
        for q in prints:
            if (p ^ q).bit_count() <= 3:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def test_ball_hashing_finds_all_links():
    rng = random.Random(5)
    for trial in range(12):
        centres = [rng.getrandbits(64) for _ in range(3)]
        block = rng.randrange(4) * 16
        prints = set()
        for _ in range(200):
            p = rng.choice(centres)
            for _ in range(rng.randrange(6)):
                p ^= 1 << (rng.randrange(64) if trial % 2 else block + rng.randrange(16))
            prints.add(p)
        keys, values = simhash.variants(np.array(sorted(prints), np.uint64))
        order = np.lexsort((values, keys))
        u, v = simhash.links_in(keys[order], values[order])
        assert (np.bitwise_count(u ^ v) <= 3).all()
        root = {p: p for p in prints}
        for _ in range(200):
            for a, b in zip(u.tolist(), v.tolist()):
                root[a] = root[b] = min(root[a], root[b])
        assert root == linked(prints)


def test_near_duplicates(spark, rows):
    import xxhash

    def fingerprint(text):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    found = simhash.near_duplicates(frame(spark, rows), words=3).collect()
    root = linked({fingerprint(t) for _, t in rows})
    name = {}
    for i, t in rows:
        if i is not None:
            r = root[fingerprint(t)]
            name[r] = min(i, name.get(r, i))
    want = Counter((i, simhash.signed(fingerprint(t)), name[root[fingerprint(t)]]) for i, t in rows)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == want


def test_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (5, 4), (4, 4), (3, 5), (9, 8)], "u long, v long")
    found = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    assert found == {9: 1, 8: 1, 7: 1, 5: 3, 4: 3}


def test_fingerprints(spark):
    rng = random.Random(2)
    base = [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(400)]
    rows = [(k, " ".join(base[: 400 - 12 * k] + [f"own{k}x{j % 9}" for j in range(12 * k)])) for k in range(30)]
    rows += [(30, rows[0][1]), (31, ""), (32, None), (33, " \n"), (None, "word word"), (30, "another text")]
    pairs = fingerprints.with_next(frame(spark, rows))
    prints = fingerprints.fingerprint_versions(pairs, ["_range", "_pos", "_guest", "_id", "_text"], {"print": ["_text"]})
    found = {r["_text"]: r["print"] for r in prints.collect()}
    assert len(found) == len({t for _, t in rows if t and t.strip()})
    error = []
    for _, a in rows[:30]:
        x, y = Counter(a.split()), Counter(rows[0][1].split())
        same = np.mean([found[a][8 * k : 8 * k + 8] == found[rows[0][1]][8 * k : 8 * k + 8] for k in range(fingerprints.SAMPLES)])
        error.append(same - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(error)) < 0.1 and np.std(error) < 0.13
    order = [(r["_id"], r["_text"], r["_next"]) for r in pairs.where("not _guest").orderBy("_range", "_pos").collect()]
    assert Counter(o[:2] for o in order) == Counter((i, t or "") for i, t in rows)
    assert [i for i, _, _ in order] == sorted((i for i, _ in rows), key=lambda i: (i is None, -(i or 0)))
    assert [o[2] for o in order] == [order[(k + 1) % len(order)][1] for k in range(len(order))]


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.learn(docs, labels)
    found = {r["doc_id"]: r["score"] for r in quality.score_quality(docs.select("doc_id", "text"), field).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(found[r["doc_id"]] >= quality.THRESHOLD) == (r["quality"] == 1) for r in held]) > 0.95


def test_quality_of_odd_rows(spark, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    field = quality.learn(frame(spark, rows), none)
    assert field.prior == 0.5
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = quality.score_quality(frame(spark, rows), quality.learn(frame(spark, rows), labels))
    assert found.columns.count("score") == 1 and found.count() == len(rows)
    assert all(0 <= r["score"] <= 1 for r in found.collect())


def test_quality_sample_has_one_row_for_each_id(spark):
    rows = [(7, f"copy {k % 3} of a hot id") for k in range(400)] + [(k, f"text {k}") for k in range(20, 40)]
    labels = spark.createDataFrame([(k, k % 2) for k in (7, *range(20, 40))], "doc_id long, quality int")
    samples = []
    for _ in range(2):
        found = quality.labelled_sample(frame(spark, rows), labels, "text", "doc_id", "quality").collect()
        assert len(found) == len({r["_id"] for r in found}) and 7 in {r["_id"] for r in found}
        samples.append(sorted((r["_id"], r["label"], r["text"]) for r in found))
        rows.reverse()
    assert samples[0] == samples[1]


PAGE = """<html><head><title>t</title><script>var a="<p>";</script></head><body><header><a href=x>Home</a></header>
<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="ad">Buy this now, it is cheap.</div>
<article><h1>Head &amp; line</h1><p><b>First   paragraph,<br>with words.<p>Short.</article>
<aside><p>Other things that are not part of the text at all.</p></aside><div id="comments"><p>I like this text a lot.</p></div>
<form><label>Name</label></form><footer>&copy; me</footer>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p"), (5, PAGE)], "page_id long, html string")
    found = {r["page_id"]: r["main_text"] for r in html_extract.extract(pages).collect()}
    assert found[1] == found[5] == "Head & line\n\nFirst paragraph, with words.\n\nShort."
    assert found[2] == found[3] == found[4] == ""


def test_min_cut_is_least():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(keep):
            own = sum(max(0, s) if not k else max(0, -s) for s, k in zip(scores, keep))
            return own + sum(w for a, b, w in edges if keep[a] != keep[b])

        least = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_extract.min_cut(scores, edges)) <= least + 0.05


def test_decontamination(spark, rows):
    items = [(1, "alpha betas gamma zeta eta thetas"), (2, None), (3, ""), (4, "x"), (1, "no such words"), (10, rows[0][1]), (9, "Épsilon7 x")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(frame(spark, rows), table, window=4).collect()
    want = Counter()
    for i, t in rows:
        words, hit, names = decontaminate.words_of(t or ""), set(), set()
        for item, text in items:
            own = decontaminate.words_of(text or "")
            for window in [own[k : k + 4] for k in range(max(1, len(own) - 3))] if own else []:
                for p in range(len(words) - len(window) + 1):
                    if words[p : p + len(window)] == window:
                        hit |= set(range(p, p + len(window)))
                        names.add(str(item))
        want[(i, len(words), len(hit), tuple(sorted(names)))] += 1
    got = Counter((r["doc_id"], r["n_words"], sum(b - a for a, b in r["hit_spans"]), tuple(r["hit_items"])) for r in found)
    assert got == want


def test_decontamination_without_a_lookup(spark, rows, monkeypatch):
    """More shingles than tasks may hold, hits that are not broadcast: the same results by shuffles alone."""
    items = [(k, t) for k, t in enumerate([rows[0][1], rows[7][1], "x", "alpha betas", "alpha betas gamma zeta", rows[7][1]])]
    table = spark.createDataFrame(items, "item_id long, text string").unionAll(spark.createDataFrame(items[:2] * 5, "item_id long, text string"))
    clashing = frame(spark, rows).withColumns({c: F.lit(c) for c in ("one", "other", "spans", "hit", "code", "words", "HIT_SPANS", "_items")})
    one = decontaminate.find_contamination(frame(spark, rows), table, window=4)
    want = Counter((r["doc_id"], str(r["hit_spans"]), str(r["hit_items"])) for r in one.collect())
    assert any(r[1] != "[]" for r in want)
    monkeypatch.setattr(decontaminate, "LOOKUP", 0)
    monkeypatch.setattr(decontaminate, "FOUND_BYTES", 0)
    more = decontaminate.find_contamination(clashing, table, window=4)
    assert more.columns.count("hit_spans") == 1 and {"one", "other", "spans", "hit", "_items"} <= set(more.columns)
    assert Counter((r["doc_id"], str(r["hit_spans"]), str(r["hit_items"])) for r in more.collect()) == want


def test_url_filter(spark):
    rules = [("com", "/", "allow"), ("a.com", "/x", "block"), ("a.com", "/x", "allow"), ("b.a.com", "/x/y", "allow"), (None, "/", "block")]
    urls = [None, "", "no scheme", "http://A.com/xyz?q", "https://c.b.a.com/x/yes#f", "ftp://b.a.com", "http://com/", "http://xa.com/x", "http://a.com/xyz"]
    pages = spark.createDataFrame([(k, u, "kept") for k, u in enumerate(urls + urls[3:4])], "page_id long, url string, head string")
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages, table).collect()}
    assert len(found) == len(urls) + 1 and {r["head"] for r in found.values()} == {"kept"}
    assert [(found[k]["rule"], found[k]["verdict"]) for k in range(9)] == [
        (None, "allow"), (None, "allow"), (None, "allow"), ("a.com/x", "block"), ("b.a.com/x/y", "allow"),
        (None, "allow"), ("com/", "allow"), ("com/", "allow"), ("a.com/x", "block"),
    ]
    clashing = pages.withColumns({c: F.lit(c) for c in ("judged", "_verdict", "block", "bits", "Rule", "labels")})
    again = url_filter.judge_urls(clashing, table)
    assert {r["_verdict"] for r in again.collect()} == {"_verdict"} and [c.lower() for c in again.columns].count("rule") == 1
    assert sorted((r["page_id"], str(r["rule"]), r["verdict"]) for r in again.collect()) == sorted((k, str(r["rule"]), r["verdict"]) for k, r in found.items())
    empty = url_filter.judge_urls(pages, table.where("false"))
    assert {r["verdict"] for r in empty.collect()} == {"allow"}


def test_long_lists_of_urls(spark, monkeypatch):
    """Thousands of rules of many lengths, broadcast and not, beside plain Python; the plan has no branch for each."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc.") for _ in range(n)).strip(".") or "a"
    rules = {(word(rng.randrange(1, 9)), "/" + word(rng.randrange(0, 40))): rng.choice(["allow", "block"]) for _ in range(3000)}
    urls = [f"x://{rng.choice(['', 'b.', 'a.c.'])}{h}{p}{word(3)}" for h, p in rng.sample(sorted(rules), 300)]
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "rule_host string, rule_path string, rule_verdict string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = []
    for k, u in enumerate(urls):
        host, _, path = u[4:].partition("/")
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        want.append((k, *max(fits, default=(0, None, "allow"))[1:]))
    for limit in (url_filter.BROADCAST_BYTES, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
        found = url_filter.judge_urls(pages, table)
        assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in found.collect()) == want


def test_empty_tables(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert token_counts.count_tokens(none, PIECES).count() == 0
    assert bpe.encode(none, BYTE_BPE).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert decontaminate.find_contamination(none, items).count() == 0
    assert fingerprints.with_next(none).count() == 0
    assert decontaminate.find_contamination(frame(spark, made(10)), items).where("size(hit_spans) > 0").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert found and len({r["doc_id"] for r in found}) == len(found)
    ids = np.frombuffer(found[0]["token_ids"], "<u4")
    assert len(ids) == found[0]["n_tokens"] and hashlib.sha256(found[0]["token_ids"]).hexdigest() == found[0]["ids_sha256"]
