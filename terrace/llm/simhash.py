"""SimHash near-duplicates: fingerprints link at three or fewer differing bits, found by ball hashing.

Every distinct fingerprint emits all its variants within half the radius, that is one bit, and fingerprints that
share a variant meet there. Two of them that differ in two bits meet in the middle. The third bit is taken up by
leaving out one of four blocks of 16 bits from the variants: three differing bits lie either in different
blocks, and then some block holds just one of them, or all in the same. So 4 * 49 variants of 48 bits suffice
where whole balls of radius two would take 2,081 of each fingerprint. In a bucket, which holds at most one row
for each fingerprint,

- members with the same left-out bits differ in two bits at most: all are linked to the smallest of them;
- members whose left-out bits differ in one bit differ in three at most: the smallest of each value are linked;
- members that are the bucket's variant themselves differ in the left-out bits only: links of three bits.

Two fingerprints meet in several buckets; a link is made in the first of them alone, so none is made twice. That
keeps everything connected: if the first bucket of a pair has a smaller member, both are linked to that, there or
in the first bucket of their own, and so on to ever smaller ones.

These are verified links, as many as connect what is linked; all pairs of a bucket are never formed. Equal
fingerprints are one row before the shuffle, however many documents have them.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lower-cased, shingles are joined by one space, and
repeated shingles count each time. A text with fewer words is one shingle of all of them; one without words
(null, empty or blank) has fingerprint zero, which links like any other. Repeated rows share their component.
A null doc_id is never a component's name unless the component has no other. Texts of any length are used whole, in
pieces of bounded size; empty tables give empty results. Only the two columns named are looked at, so others may have
any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .components import connected_components
from .frames import add_columns, settled, ship, texts

SEED = 42
BLOCKS, BITS = 4, 16
#: Members of a bucket up to which links of three bits in the left-out block are found by comparing them in turn;
#: beyond, by looking up all 560 triples of bits.
IN_TURN = 256


def shingles(text: str, words: int) -> list[bytes]:
    parts = text.encode().lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    if len(parts) <= words:
        return [joined]
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    return [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist())]


def fingerprint(text: str, words: int) -> int:
    """64 bits: each is 1 if it is set in over half of the shingles' XXH64."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles(text, words)], "<u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # long texts in bounded pieces
        bits = np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, the 64 bits as a signed long."""
    return add_columns(
        texts(docs, text), text, "fingerprint long", lambda values: [[signed(fingerprint(v, words)) for v in values]]
    )


def without_block(values: np.ndarray, block: int, bits: int = BITS) -> np.ndarray:
    """What is left of unsigned values of four blocks of ``bits`` bits without one of them."""
    low = values & np.uint64((1 << (bits * block)) - 1)
    high = (values >> np.uint64(bits * block)) >> np.uint64(bits)
    return low | (high << np.uint64(bits * block))


def variants(values: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Keys (block and rest) and fingerprints: every variant within one bit, for every left-out block."""
    rest_bits = (BLOCKS - 1) * bits
    flips = np.r_[np.uint64(0), np.uint64(1) << np.arange(rest_bits, dtype=np.uint64)]
    keys = [(without_block(values, b, bits)[:, None] ^ flips) | np.uint64(b << rest_bits) for b in range(BLOCKS)]
    return np.concatenate(keys, 1).ravel(), np.repeat(values, BLOCKS * len(flips))


def first_meeting(keys: np.ndarray, u: np.ndarray, v: np.ndarray, alone: int, bits: int = BITS) -> np.ndarray:
    """Whether a bucket is the first in which a link is found that has ``alone`` of its bits in the left-out block.

    Its block is the first with that many of the differing bits, its variant the smaller one between both.
    """
    rest_bits, mask = (BLOCKS - 1) * bits, np.uint64((1 << bits) - 1)
    differ = u ^ v
    block = (keys >> np.uint64(rest_bits)).astype(np.int64)
    in_block = np.stack([np.bitwise_count(differ >> np.uint64(bits * b) & mask) for b in range(BLOCKS)])
    good = (in_block == alone).argmax(0) == block
    for b in range(BLOCKS):
        own = block == b
        x, y = without_block(u[own], b, bits), without_block(v[own], b, bits)
        low = (x ^ y) & -(x ^ y)
        good[own] &= np.minimum(x ^ low, y ^ low) == keys[own] & np.uint64((1 << rest_bits) - 1)
    return good


def links_in(keys: np.ndarray, values: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links among the members of whole buckets, given in the order of their keys and values."""
    bucket = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
    many = (np.bincount(bucket) > 1)[bucket]
    keys, values, bucket = keys[many], values[many], bucket[many].astype(np.uint64)
    if not len(keys):
        return values, values
    rest_bits = (BLOCKS - 1) * bits
    block = (keys >> np.uint64(rest_bits)) & np.uint64(3)
    left_out = (values >> (block * np.uint64(bits))) & np.uint64((1 << bits) - 1)
    code = (bucket << np.uint64(bits)) | left_out
    order = np.argsort(code, kind="stable")  # keeps the smallest value of a code first
    code, values, keys, block, bucket = code[order], values[order], keys[order], block[order], bucket[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    group = np.cumsum(np.r_[False, code[1:] != code[:-1]])
    smallest = values[first][group]
    star = np.flatnonzero(values != smallest)
    star = star[first_meeting(keys[star], values[star], smallest[star], 0, bits)]
    u, v = [values[star]], [smallest[star]]
    codes, least = code[first], values[first]
    for bit in range(bits):
        other = codes ^ np.uint64(1 << bit)
        place = np.minimum(np.searchsorted(codes, other), len(codes) - 1)
        found = np.flatnonzero((codes[place] == other) & (codes < other))
        # those of fewer than three bits are linked in a bucket that leaves out none of them
        found = found[np.bitwise_count(least[found] ^ least[place[found]]) == 3]
        found = found[first_meeting(keys[first][found], least[found], least[place[found]], 1, bits)]
        u.append(least[found])
        v.append(least[place[found]])
    rest = np.empty_like(values)
    for b in range(BLOCKS):
        own = block == b
        rest[own] = without_block(values[own], b, bits)
    centre = rest == (keys & np.uint64((1 << rest_bits) - 1))
    c_values, c_bucket, c_code = values[centre], bucket[centre], code[centre]
    if len(c_values) > 1:
        largest = int(np.bincount(np.unique(c_bucket, return_inverse=True)[1]).max())
        for step in range(1, min(largest, IN_TURN)):
            pair = np.flatnonzero((c_bucket[step:] == c_bucket[:-step]) & (np.bitwise_count(c_values[step:] ^ c_values[:-step]) == 3))
            u.append(c_values[pair])
            v.append(c_values[pair + step])
        if largest > IN_TURN:
            triples = [1 << i | 1 << j | 1 << k for i in range(bits) for j in range(i) for k in range(j)]
            for triple in triples:
                other = c_code ^ np.uint64(triple)
                place = np.minimum(np.searchsorted(c_code, other), len(c_code) - 1)
                found = np.flatnonzero((c_code[place] == other) & (c_code < other))
                u.append(c_values[found])
                v.append(c_values[place[found]])
    u, v = np.concatenate(u), np.concatenate(v)
    pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def near_links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Links ``u``, ``v`` that connect all fingerprints within three bits; ``prints`` has distinct ``fingerprint``s.

    They are of four blocks of ``bits`` bits.
    """

    def emit(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 12):
                part = batch.column(0).slice(start, 1 << 12).to_numpy().view(np.uint64)
                keys, values = variants(part, bits)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(values.view(np.int64))], names=["key", "value"])

    def link(batches):
        rest_keys = rest_values = np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([rest_keys, batch.column(0).to_numpy().view(np.uint64)])
            values = np.concatenate([rest_values, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            # the last bucket may go on in the next batch; its size is bound by the distinct fingerprints of one ball
            whole = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
            rest_keys, rest_values = keys[whole:], values[whole:]
            if whole:
                yield _links(keys[:whole], values[:whole], bits)
        if len(rest_keys):
            yield _links(rest_keys, rest_values, bits)

    ship(prints.sparkSession)
    spread = prints.select("fingerprint").mapInArrow(emit, StructType.fromDDL("key long, value long"))
    return spread.repartition("key").sortWithinPartitions("key", "value").mapInArrow(link, StructType.fromDDL("u long, v long"))


def _links(keys: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    u, v = links_in(keys, values, bits)
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def near_duplicates(docs: DataFrame, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: ``doc_id``, ``text_hash`` (xxhash64), ``fingerprint`` and ``component_id``.

    The component is named by the smallest doc_id in it. ``text_hash`` tells rows of one doc_id apart.
    """
    own = texts(docs, text).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = fingerprints(own, words).select("doc_id", F.xxhash64("text").alias("text_hash"), "fingerprint")
    rows = settled(rows)
    prints = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = connected_components(near_links(prints))
    named = prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = named.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = settled(named.join(least, "root").select("fingerprint", "component_id", "root"))
    return rows.join(named, "fingerprint").select("doc_id", "text_hash", "fingerprint", "component_id", "root")
