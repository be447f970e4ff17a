"""Queries and pipeline stages at their own parameters beside plain Python, on a small table with odd rows.

The table has more columns, named like those that operators use or add.
"""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from terrace.llm import queries

LONG, TEXT = pa.int64(), pa.string()
CLASHING = ("_h", "_x", "_o", "_spans", "_both", "_id", "_own", "_hash", "_items", "_verdict", "removed_spans", "kept", "n_words", "token_ids", "node", "root")


def texts(seed=5):
    rng = random.Random(seed)
    stems = ["alpha", "béta", "gamma,", "delta.", "ζeta", "漢字", "x1", "the", "of", "🙂"]
    line = lambda n: " ".join(rng.choice(stems) + rng.choice(["", "", "s", "ly", str(rng.randrange(30))]) for _ in range(n))
    passages = [line(60), line(45), "é" * 150]
    found = [line(rng.randrange(0, 120)) for _ in range(40)]
    found = [t + rng.choice(["\n", " "]) + rng.choice(passages) + " " + line(rng.randrange(9)) if k % 3 == 0 else t for k, t in enumerate(found)]
    found += [found[1], found[1].upper(), passages[0], passages[0] + " " + passages[0], line(90)]
    near = found[-1].split()
    near[40] = "changed"
    found += [" ".join(near), "", None, "  \n\t ", "<|endoftext|> <s> ▁ a\u00a0b", "a" * 1000, "ab" * 3000, line(2500), "word", "word", "two words"]
    return found


def rows(seed=5):
    found = list(enumerate(texts(seed)))
    random.Random(seed).shuffle(found)
    return found + [(3, found[3][1]), (None, found[4][1]), (None, "no id here")]


def written(folder, documents, items=(), labels=(), pages=()):
    docs = {"doc_id": pa.array([r[0] for r in documents], LONG), "text": pa.array([r[1] for r in documents], TEXT)}
    size = len(documents)
    docs |= {"lang": pa.array(["en"] * size, TEXT), "source": pa.array(["s"] * size, TEXT), "n_chars": pa.array([len(r[1] or "") for r in documents], LONG)}
    docs |= {c: pa.array(["own"] * size, TEXT) for c in CLASHING}
    pq.write_table(pa.table(docs), f"{folder}/documents.parquet")
    tables = {
        "benchmark": {"item_id": pa.array([i for i, _ in items], LONG), "text": pa.array([t for _, t in items], TEXT)},
        "labels": {"doc_id": pa.array([i for i, _ in labels], LONG), "quality": pa.array([q for _, q in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())},
        "pages": {"page_id": pa.array([i for i, _ in pages], LONG), "url": pa.array([u for _, u in pages], TEXT), "html": pa.array([None] * len(pages), TEXT)},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns | {"_verdict": pa.array(["own"] * len(next(iter(columns.values()))), TEXT)}), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    found = rows()
    items = [(7, found[0][1] or "alpha"), (7, "two words"), (8, " ".join((texts()[44] or "").split()[20:40])), (9, None), (10, "!!"), (11, "word")]
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/a?b", "https://example.com/en/", "x://sub.www.example.com/en/x#y", "http://a.net/es/", "ftp://a.net/fr", "http://net/fr/x", "http://com", "http://.com/", "a://b?c"]
    folder = written(tmp_path_factory.mktemp("tables"), found, items, [(k, k % 2) for k in range(30)], list(enumerate(urls)))
    return folder, found, items, urls


def sha(data):
    return hashlib.sha256(data).hexdigest()


def covered(sequences, length, first=False):
    """Places covered by a window that starts elsewhere too; with ``first`` only if it has started before."""
    count, seen, found = Counter(s[p : p + length] for s in sequences for p in range(len(s) - length + 1)), set(), []
    for s in sequences:
        marks = np.zeros(len(s), bool)
        for p in range(len(s) - length + 1):
            window = s[p : p + length]
            if (window in seen) if first else count[window] > 1:
                marks[p : p + length] = True
            seen.add(window)
        found.append(marks)
    return found


def runs(marks):
    return int((np.diff(np.r_[0, marks.astype(int)]) == 1).sum())


def test_op2(spark, table):
    from sentencepiece import SentencePieceProcessor

    folder, found, _, _ = table
    model = SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = Counter()
    for i, t in found:
        n = len(model.encode(t or ""))
        want[(i, len((t or "").encode()), n, n > 4096)] += 1
    assert Counter(map(tuple, queries.op2_token_counts(spark, folder).collect())) == want


def test_op3(spark, table):
    folder, found, _, _ = table
    sequences, want = [(t or "").encode() for _, t in found], Counter()
    for (i, _), s, marks in zip(found, sequences, covered(sequences, 200)):
        rest = bytes(np.frombuffer(s, np.uint8)[~marks]) if s else b""
        want[(i, len(s), int(marks.sum()), runs(marks), sha(rest))] += 1
    assert sum(k[2] > 0 for k in want) > 12
    assert Counter(map(tuple, queries.op3_suffix_dedup(spark, folder).collect())) == want


def test_op4(spark, table):
    folder, found, _, _ = table
    blank = bytes([32, 9, 10, 11, 12, 13])
    sequences = [tuple((t or "").encode().translate(bytes.maketrans(blank, b" " * 6)).split(b" ")) for _, t in found]
    sequences = [tuple(w for w in s if w) for s in sequences]
    want = Counter()
    for (i, _), s, marks in zip(found, sequences, covered(sequences, 35)):
        want[(i, len(s), int(marks.sum()), sha(b" ".join(w for w, m in zip(s, marks) if not m)))] += 1
    assert sum(k[2] > 0 for k in want) > 12
    assert Counter(map(tuple, queries.op4_substring_dedup(spark, folder).collect())) == want


def test_op5(spark, table):
    folder, found, _, _ = table

    def fingerprint(text):
        words = (text or "").encode().lower().split()
        parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t) for _, t in found]
    root = list(range(len(found)))
    for a in range(len(found)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root = [root[b] if r == root[a] else r for r in root]
    least = {r: min((i for (i, _), q in zip(found, root) if q == r and i is not None), default=None) for r in set(root)}
    want = Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(found, prints, root))
    assert Counter(map(tuple, queries.op5_simhash(spark, folder).collect())) == want


def test_op9(spark, table):
    from tokenizers import Tokenizer

    folder, found, _, _ = table
    library, want = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), Counter()
    for i, t in found:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))] += 1
    assert Counter(map(tuple, queries.op9_bpe(spark, folder).collect())) == want


def test_op10(spark, table):
    folder, _, _, urls = table
    rules = {("com", ""): "allow", ("example.com", "/en/"): "block", ("www.example.com", "/en/"): "allow", ("net", "/es/"): "block", ("net", "/fr/"): "block"}
    want = []
    for k, url in enumerate(urls):
        rest = url.partition("://")[2] if url and "://" in url else ""
        cut = min((p for p in map(rest.find, "/?#") if p >= 0), default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].partition("?")[0].partition("#")[0]
        fits = [(len(h) + len(p), h + (p or "/"), v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p or "/")]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        want.append((k, host, path, rule, verdict))
    assert sorted(map(tuple, queries.op10_url_filter(spark, folder).collect())) == want


def windows_of(text, size=10):
    words = "".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    return words, [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []


def hits(found, items):
    """Marked words of each document, and the items that occur."""
    windows = {}
    for i, t in items:
        for w in windows_of(t)[1]:
            windows.setdefault(w, set()).add(str(i))
    result = []
    for _, t in found:
        words, marks, names = windows_of(t)[0], set(), set()
        for size in {len(w) for w in windows}:
            for p in range(len(words) - size + 1):
                if (w := tuple(words[p : p + size])) in windows:
                    marks |= set(range(p, p + size))
                    names |= windows[w]
        result.append((len(words), len(marks), sorted(names)))
    return result


def test_op8(spark, table):
    folder, found, items, _ = table
    want = Counter((i, n, m, len(s), sha(",".join(s).encode()), m > 0) for (i, _), (n, m, s) in zip(found, hits(found, items)))
    assert sum(k[5] for k in want) > 3
    assert Counter(map(tuple, queries.op8_decontamination(spark, folder).collect())) == want


# --- stages of the pipeline ---------------------------------------------------------------------


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def same_columns(found, docs):
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    assert found.where("lang <> 'en' OR _h <> 'own' OR kept <> 'own'").count() == 0
    return Counter((r["doc_id"], r["text"]) for r in found.collect())


def test_quality_stage(spark, table):
    folder, found, _, _ = table
    docs = documents(spark, folder)
    kept = same_columns(corpus_pipeline.quality_stage(spark, docs, folder), docs)
    predicted = queries.op6_quality(spark, folder).groupBy("doc_id").agg({"predicted": "sum"}).collect()
    assert Counter(dict.fromkeys((r[0] for r in predicted), 0) | {r[0]: r[1] for r in predicted}) == Counter({i: 0 for i, _ in found} | Counter(i for i, _ in kept.elements()))
    assert not kept - Counter(found)


def test_near_duplicate_stage(spark, table):
    folder, found, _, _ = table
    docs = documents(spark, folder)
    kept = same_columns(corpus_pipeline.near_duplicate_stage(spark, docs, folder), docs)
    words = [(t or "").encode().lower().split() for _, t in found]
    every = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(found)))
    for a in range(len(found)):
        for b in range(a):
            if 5 * len(every[a] & every[b]) >= 4 * len(every[a] | every[b]):
                root = [root[b] if r == root[a] else r for r in root]
    order = lambda r: (r[0] is None, r[0] or 0)
    firsts = Counter(min((f for f, q in zip(found, root) if q == r), key=order) for r in set(root))
    assert len(firsts) < len(found) - 6
    assert Counter((i, t or "") for i, t in kept.elements()) == Counter((i, t or "") for i, t in firsts)


def test_repeated_passage_stage(spark, table):
    folder, found, _, _ = table
    docs = documents(spark, folder).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()
    kept = corpus_pipeline.repeated_passage_stage(spark, docs, folder)
    own = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = Counter()
    for (i, t), marks in zip(own, covered([(t or "").encode() for _, t in own], 200, first=True)):
        data, out, at = (t or "").encode(), "", 0
        for c in t or "":  # a character goes if all of it is in one removed run
            size = len(c.encode())
            out += "" if marks[at : at + size].all() else c
            at += size
        assert at == len(data)
        want[(i, t if t is None else out)] += 1
    assert same_columns(kept, docs) == want
    assert kept.where("n_chars <> length(text)").count() == 0 and any(len(t or "") < len(dict(own)[i] or "") for i, t in want)


def test_decontamination_stage(spark, table):
    folder, found, items, _ = table
    docs = documents(spark, folder)
    kept = same_columns(corpus_pipeline.decontamination_stage(spark, docs, folder), docs)
    want = Counter((i, t or "") for (i, t), (_, marks, _) in zip(found, hits(found, items)) if not marks)
    assert Counter((i, t or "") for i, t in kept.elements()) == want


def test_encoding_stage(spark, table):
    from tokenizers import Tokenizer

    folder, found, _, _ = table
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = Counter((i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in found)
    rows_ = corpus_pipeline.encoding_stage(spark, documents(spark, folder), folder).collect()
    assert Counter((r["doc_id"], bytes(r["token_ids"])) for r in rows_) == want
    assert all(r["ids_sha256"] == sha(r["token_ids"]) and r["n_tokens"] * 4 == len(r["token_ids"]) for r in rows_)


def test_run_is_its_stages_in_turn(spark, table):
    folder, _, _, _ = table
    docs = documents(spark, folder)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    rows_ = lambda df: Counter((r["doc_id"], bytes(r["token_ids"])) for r in df.collect())
    assert rows_(corpus_pipeline.run(spark, folder)) == rows_(docs)


def test_empty_tables(spark, tmp_path):
    folder = written(tmp_path, [])
    for name in [n for n in queries.QUERIES if n.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12")]:
        assert queries.QUERIES[name](spark, folder).count() == 0, name
    assert corpus_pipeline.run(spark, folder).count() == 0
