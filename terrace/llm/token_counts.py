"""Token counts of whole texts by a two-tier lookup on the map side; no pre-token is ever shuffled.

A text is cut into pre-tokens that no merge of the model can cross. The first tier is a compact table of
frequent pre-tokens and their token counts, which is broadcast: the commonest ones of a bounded sample of texts
(``SAMPLE_TEXTS``, those that hash lowest), counted where they are read, and every piece of the vocabulary that starts
a word, as a BPE vocabulary is itself the list of strings that were frequent in its training text. Both are bounded.
What the table lacks is encoded by the library once and kept in a cache of bounded size in each worker. Counts
do not depend on the table.

Null and empty texts have no tokens. Repeated rows are counted each for itself. Texts are never cut: a long one
only makes a slice of its own. Empty tables give empty results; a column named ``n_tokens`` is replaced, all others
pass through.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import add_columns, ship, slices, texts

SPACE = "▁"
#: Texts that frequent pre-tokens are counted in, and pre-tokens of them in the broadcast table.
SAMPLE_TEXTS, FREQUENT = 2000, 1 << 17
#: Entries of a worker's cache, and the longest pre-token it keeps; longer ones are encoded each time.
CACHE_ENTRIES, CACHE_CHARS = 1 << 20, 64
RUNS = re.compile(" +[^ ]*")

_state: dict = {}


def pre_tokens(text: str) -> list[str]:
    """The parts of a text that the model encodes independently, each without the one space that begins it.

    The model puts a space before a text and writes spaces as U+2581, which a text may also contain itself. Its
    pieces hold that sign only at their start, or nothing else, so merges never cross the start of a run of
    spaces. An empty part is a lone space at the end.
    """
    text = text.replace(SPACE, " ")
    if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
        return text.split(" ") if text else []
    return [run[1:] for run in RUNS.findall(" " + text)]


def frequent_pre_tokens(docs: DataFrame, text: str) -> list[str]:
    """The commonest pre-tokens of a sample of texts, the most frequent first."""
    own = docs.select(F.col(text).alias("text")).where("text <> ''").withColumn("mark", F.xxhash64("text"))
    last = own.select("mark").distinct().orderBy("mark").limit(SAMPLE_TEXTS).agg(F.max("mark")).first()[0]
    if last is None:
        return []

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for rows in slices(batch, "text"):
                for value in rows.column("text").to_pylist():
                    total.update(p for p in pre_tokens(value) if len(p) <= CACHE_CHARS and "\n" not in p)
        some = [(p, n) for p, n in total.items() if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["part", "n"])

    ship(docs.sparkSession)
    # copies of a text count once, so no more than SAMPLE_TEXTS are read
    sample = own.where(F.col("mark") <= last).dropDuplicates(["mark"]).select("text")
    total: Counter = Counter()
    for part, n in sample.mapInArrow(run, "part string, n long").collect():
        total[part] += n
    return [p for p, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]]


def frequent_table(model_file: str, parts: list[str]) -> tuple[str, bytes]:
    """Pre-tokens, one a line, and their token counts, one a byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    words = [p[1:] for p in pieces if p.startswith(SPACE) and p[1:] and SPACE not in p[1:] and "\n" not in p]
    keys = list(dict.fromkeys([*parts, *words]))
    counts = [len(ids) for ids in model.encode(keys, num_threads=1)]
    kept = [(k, n) for k, n in zip(keys, counts) if n < 256]
    return "\n".join(k for k, _ in kept), bytes(n for _, n in kept)


def check_model(model_file: str) -> None:
    """Refuse a model whose merges could cross the cuts that ``pre_tokens`` makes."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, proto = SentencePieceProcessor(model_file=model_file), pb.ModelProto()
    with open(model_file, "rb") as file:
        proto.ParseFromString(file.read())
    rules = proto.normalizer_spec
    inside = any(re.search(f"[^{SPACE}]{SPACE}|{SPACE}{SPACE}[^{SPACE}]", model.id_to_piece(i)) for i in range(len(model)))
    own = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in proto.pieces)
    spec = proto.trainer_spec
    if inside or own or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
        raise ValueError(f"{model_file}: texts of this model can't be cut at spaces")
    if spec.model_type != pb.TrainerSpec.BPE or spec.treat_whitespace_as_suffix or not rules.escape_whitespaces:
        raise ValueError(f"{model_file}: not a BPE model with leading spaces")


def _worker(shared: Broadcast, table: str):
    """The model, the frequent table as a dict and the cache of this worker process."""
    if _state.get("of") != table:
        from sentencepiece import SentencePieceProcessor

        keys, counts, proto = shared.value
        frequent = dict(zip(keys.split("\n"), counts)) | {"": 1}
        _state.update(of=table, model=SentencePieceProcessor(model_proto=proto), frequent=frequent, cache={})
    return _state["model"], _state["frequent"], _state["cache"]


def count(values: list[str], model, frequent: dict[str, int], cache: dict[str, int]) -> list[int]:
    """Tokens of each text."""
    parts = [pre_tokens(v) for v in values]
    misses = {p for keys in parts for p in keys if p not in frequent and p not in cache}
    new = list(misses)
    here = dict(zip(new, map(len, model.encode(new, num_threads=1)))) if new else {}
    if len(cache) + len(here) > CACHE_ENTRIES:
        # what this slice needs of the cache moves over before the cache starts anew
        here |= {p: cache[p] for keys in parts for p in keys if p in cache}
        cache.clear()
    long = {p: n for p, n in here.items() if len(p) > CACHE_CHARS}
    cache.update((p, n) for p, n in here.items() if len(p) <= CACHE_CHARS)
    totals = []
    for keys in parts:
        first = list(map(frequent.get, keys))
        rest = (cache[p] if p in cache else long[p] for p, n in zip(keys, first) if n is None)
        totals.append(sum(filter(None, first)) + sum(rest))
    if len(cache) > CACHE_ENTRIES:
        cache.clear()
    return totals


def count_tokens(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, the model's count for each whole text, without begin and end tokens."""
    check_model(model_file)
    with open(model_file, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast((*frequent_table(model_file, frequent_pre_tokens(docs, text)), file.read()))

    table = uuid.uuid4().hex  # tells a worker that it holds another one

    def make(values):
        return [count(values, *_worker(shared, table))]

    return add_columns(texts(docs, text), text, "n_tokens long", make)
