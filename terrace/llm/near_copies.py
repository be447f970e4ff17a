"""One document of each group of near copies: sets of shingles of five words with a Jaccard similarity of 0.8 or more.

Candidates come from SimHash ball hashing (``simhash.near_links``). A changed word changes five shingles but one word,
so it is the words that are fingerprinted: twice as a set, which texts that repeat themselves share, and twice with
each occurrence as one of its own. Texts that are similar by 0.8 are about 4 of 64 bits apart then. ``4 * BLOCK_BITS``
bits of each fingerprint are hashed, and texts are candidates if one of them differs in three bits at most. Of n
texts about 3e-10 * n meet by chance; such links are dropped by the whole fingerprints, of which unrelated texts
differ in half of the bits (``APART``). A group's links are thinned to a spanning forest before that, as their number
grows faster than the group.

Candidates make clusters, and what decides is the exact similarity of the texts in a cluster (of 64-bit hashes of their
shingles), by products of their sets in blocks:

1. A cluster is dealt to blocks, most of them to one. All texts of a block are compared, which makes star links to
   the first text of each of its components. A text is sent once, pairs are never written.
2. From the blocks of a larger cluster the texts with most similar ones go on to be compared with each other, a
   sixteenth each time, until they fit one block. So the large components of the blocks meet.
3. What is not in the largest component of its cluster by then is compared with all blocks of the cluster.

After that any two similar texts of a cluster are joined: either both are in its largest component, or one of them was
compared with all others. The work is the size of a cluster times a block for close copies, plus its size times the
number of texts that stay apart, which nothing but comparing them can tell.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lower-cased; fewer than five are one shingle. Null and
empty texts have none and are copies of each other. Texts with equal sets of shingles are one node before anything
is dealt. The document with the smallest doc_id stays (null last), of repeated rows one; very long texts are
reduced to hashes one by one; empty tables give empty results; columns of any name pass through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .components import connected_components, marked_forest
from .frames import Scratch, add_columns, ship, texts, unused
from .simhash import near_links, shingles, signed

#: Near copies share that many per cent of their sets of shingles of so many words.
SIMILAR, SHINGLE_WORDS = 80, 5
#: Fingerprints of sets of words and of their occurrences, bits in one of the four blocks that are hashed of each,
#: and bits of both of a kind (128) in which a link's texts differ at most.
SEEDS, BLOCK_BITS, APART = 4, 12, 42
#: Texts and shingles of a block, and one of so many texts that stands for a block in the next round.
BLOCK, BLOCK_SHINGLES, STANDS = 256, 1 << 20, 16
#: Shingles of a product of sets; rows of a batch that a task passes on.
STEP, ROWS = 4096, 4096
ODD = np.uint64(0x9E3779B97F4A7C15)
OFFSETS = [np.uint64((k + 1) * int(ODD) % (1 << 64)) for k in range(SEEDS)]
ROW = "cluster long, part int, other int, side int, node long, text string"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Hashes of the distinct shingles, in ascending order."""
    parts = shingles(text, SHINGLE_WORDS)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts)))


def word_prints(text: str) -> list[int]:
    """Fingerprints of the distinct words (two) and of all their occurrences (two): a bit is 1 if it is set in over
    half of the hashes."""
    counts = Counter(text.encode().lower().split())
    times = np.fromiter(counts.values(), np.int64, len(counts))
    words = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts))
    total = int(times.sum())
    ones = np.zeros((SEEDS, 64), np.int64)
    for begin in range(0, len(words), 1 << 15):  # long texts in bounded pieces
        _count(ones, words[begin : begin + (1 << 15)], range(SEEDS // 2))
    ends = np.cumsum(times)
    for begin in range(0, total, 1 << 15):
        place = np.arange(begin, min(begin + (1 << 15), total))
        word = np.searchsorted(ends, place, side="right")
        nth = (place - (ends - times)[word]).astype(np.uint64)
        _count(ones, _mixed(words[word] + nth * ODD), range(SEEDS // 2, SEEDS))
    most = [len(words)] * (SEEDS // 2) + [total] * (SEEDS // 2)
    return [signed(int(np.packbits(2 * own > n, bitorder="little").view("<u8")[0])) for own, n in zip(ones, most)]


def _count(ones: np.ndarray, hashes: np.ndarray, seeds: range) -> None:
    """Add the bits of the hashes by each seed."""
    for k in seeds:
        own = _mixed(hashes + OFFSETS[k]).view(np.uint8).reshape(-1, 8)
        ones[k] += np.unpackbits(own, axis=1, bitorder="little").sum(0, dtype=np.int64)


def described(values: list[str]) -> list[list]:
    """Of each text: a name and the size of its set of shingles, and its fingerprints."""
    names, sizes, prints = [], [], []
    for value in values:
        own = shingle_set(value)
        names.append(signed(xxhash.xxh64_intdigest(own.tobytes(), len(own))))
        sizes.append(len(own))
        prints.append(word_prints(value))
    return [names, sizes, *(list(c) for c in zip(*prints))]


def shared(sets: list[np.ndarray], first: int) -> np.ndarray:
    """How many shingles each of the first sets has in common with each of all."""
    lengths = [len(s) for s in sets]
    owner = np.repeat(np.arange(len(sets)), lengths)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times[token] > 1
    owner, token = owner[several], np.unique(token[several], return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    found = np.zeros((first, len(sets)), np.int64)
    for begin in range(0, int(token[-1]) + 1 if len(token) else 0, STEP):
        a, b = np.searchsorted(token, [begin, begin + STEP])
        has = np.zeros((len(sets), min(STEP, int(token[b - 1]) - begin + 1)), np.float32)
        has[owner[a:b], token[a:b] - begin] = 1
        found += (has[:first] @ has.T).astype(np.int64)
    return found


def joined(sets: list[np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the first one that it is joined to by similar pairs, one of them among the first; and its degree."""
    sizes = np.array([len(s) for s in sets])
    common = shared(sets, first)
    alike = 100 * common >= SIMILAR * (sizes[:first, None] + sizes[None, :] - common)
    alike[np.arange(first), np.arange(first)] = False
    label = np.arange(len(sets))
    while True:
        before = label.copy()
        label[:first] = np.minimum(label[:first], np.where(alike, label[None, :], len(sets)).min(1, initial=len(sets)))
        label = np.minimum(label, np.where(alike, label[:first, None], len(sets)).min(0, initial=len(sets)))
        if (label == before).all():
            return label, alike.sum(1)


def compared(rows: DataFrame) -> DataFrame:
    """``cluster``, ``part``, ``node``, ``label`` (the node it is joined to) and ``degree`` of the nodes of each group.

    A group is a ``cluster``, ``part`` and ``other``. Its nodes of ``side`` 0 are compared with each other and with those
    of ``side`` 1.
    """

    def run(batches):
        key, sets, nodes, first, out = None, [], [], 0, []

        def finished():
            label, degree = joined(sets, first)
            degree = np.r_[degree, np.zeros(len(sets) - first, np.int64)]
            own = np.array(nodes, np.int64)
            out.append((np.full(len(sets), key[0]), np.full(len(sets), key[1]), own, own[label], degree))

        def passed():
            arrays = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["cluster", "part", "node", "label", "degree"])

        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            groups = zip(*(batch.column(c).to_pylist() for c in ("cluster", "part", "other")))
            for row, (group, side, node) in enumerate(zip(groups, batch.column("side").to_pylist(), batch.column("node").to_pylist())):
                if group != key:
                    if first:
                        finished()
                    if sum(len(o[0]) for o in out[-1:]) and sum(len(o[0]) for o in out) >= ROWS:
                        yield passed()
                    key, sets, nodes, first = group, [], [], 0
                sets.append(shingle_set(batch.column("text")[row].as_py()))
                nodes.append(node)
                first += not side
        if first:
            finished()
        if out:
            yield passed()

    ship(rows.sparkSession)
    result = StructType.fromDDL("cluster long, part int, node long, label long, degree long")
    dealt = rows.select(*StructType.fromDDL(ROW).names).repartition("cluster", "part", "other")
    return dealt.sortWithinPartitions("cluster", "part", "other", "side").mapInArrow(run, result)


def candidate_links(nodes: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """Links ``u``, ``v`` that connect nodes with a fingerprint in common within three bits.

    Of the links of a kind only a spanning forest is joined to the whole fingerprints, so a group gives about as many
    rows as it has texts. The other links of a part count only where one of its forest's links is dropped.
    """
    names = [f"print_{k}" for k in range(SEEDS)]
    apart = [F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in names]
    close = F.least(sum(apart[: SEEDS // 2], F.lit(0)), sum(apart[SEEDS // 2 :], F.lit(0))) <= APART
    ends = [F.col("a.node").alias("u"), F.col("b.node").alias("v")]
    whole = F.struct("node", *names)
    found = None
    for name in names:
        hashed = F.col(name).bitwiseAND(F.lit((1 << 4 * BLOCK_BITS) - 1))
        # one node stands for all with the same fingerprint, and is linked to each of them
        stands = scratch.keep(f"stands-{name}", nodes.groupBy(hashed.alias("fingerprint")).agg(F.min(whole).alias("stand")), most)
        counted, dropped = Observation(), Observation()
        near = scratch.keep(f"near-{name}", near_links(stands, BLOCK_BITS).observe(counted, F.count("*").alias("n")))
        marked = scratch.keep(f"marked-{name}", marked_forest(near, counted.get["n"]))
        ones, others = stands.toDF("u", "a"), stands.toDF("v", "b")
        same = nodes.select(whole.alias("a"), hashed.alias("fingerprint")).join(stands.withColumnRenamed("stand", "b"), "fingerprint")
        same = same.where("a.node <> b.node").select(*ends, close.alias("close"), F.lit(None).cast("long").alias("part"))
        between = marked.where("tree").join(ones, "u").join(others, "v").select(*ends, close.alias("close"), "part")
        # a table for each kind, so that no job has the plans of all
        lost = F.expr("not close and part is not null")
        met = scratch.keep(f"met-{name}", between.unionAll(same).observe(dropped, F.count_if(lost).alias("n")), most)
        links = met.where("close").select("u", "v")
        if dropped.get["n"]:
            rest = marked.where("not tree").join(met.where(lost).select("part").distinct(), "part", "leftsemi")
            rest = rest.join(ones, "u").join(others, "v").where(close).select(*ends)
            links = links.unionAll(scratch.keep(f"rest-{name}", rest))
        scratch.drop(f"stands-{name}", f"near-{name}", f"marked-{name}")
        found = links if found is None else found.unionAll(links)
    return found


def _blocks(number, shingles_):
    return F.greatest(F.ceil(number / BLOCK), F.ceil(shingles_ / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _dealt(members: DataFrame, blocks: str = "blocks") -> DataFrame:
    block = F.pmod(F.xxhash64("node", blocks), F.col(blocks)).cast("int")
    return members.withColumns({"part": block, "other": F.lit(0), "side": F.lit(0)})


def similar_links(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Links that join all similar nodes of each cluster.

    ``members`` has ``node``, ``cluster``, its number of ``blocks``, ``size`` and ``text``.
    """
    whole = scratch.keep("whole", compared(_dealt(members)))
    links = whole.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v"))
    large = members.where("blocks > 1")
    if large.isEmpty():
        return links
    level, found, depth = large.select("cluster", "node", "blocks"), whole, 0
    while True:
        depth += 1
        order = Window.partitionBy("cluster", "part").orderBy(F.desc("degree"), "node")
        ranked = found.join(level.select("cluster", "node", "blocks"), ["cluster", "node"]).withColumn("k", F.row_number().over(order))
        ranked = ranked.withColumn("most", F.ceil(F.count("*").over(Window.partitionBy("cluster", "part")) / STANDS))
        stands = ranked.where("k <= most").select("cluster", "node", F.col("blocks").alias("before"))
        sized = members.select("cluster", "node", "size", "text").join(stands, ["cluster", "node"])
        number = sized.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        fewer = F.greatest(F.least(_blocks(F.col("n"), F.col("s")), F.floor(F.col("before") / 2)), F.lit(1)).cast("int")
        level = scratch.keep(f"level-{depth}", sized.join(number, "cluster").select("cluster", "node", "size", "text", fewer.alias("blocks")))
        found = scratch.keep(f"found-{depth}", compared(_dealt(level)))
        links = links.unionAll(found.where("node <> label").select("node", "label"))
        level = level.where("blocks > 1")
        if level.isEmpty():
            break
    roots = connected_components(links)
    grouped = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    grouped = scratch.keep("grouped", grouped.select("cluster", "node", "size", "blocks", "root"))
    parts = grouped.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("main")).select("cluster", "main.root")
    apart = grouped.join(main.withColumnRenamed("root", "main"), "cluster").where("root <> main")
    apart = scratch.keep("apart", apart.select("cluster", "node", "size", "blocks"))
    number = apart.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    chunks = scratch.keep("chunks", number.select("cluster", _blocks(F.col("n"), F.col("s")).alias("chunks")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = apart.join(chunks, "cluster").join(members.select("node", "text"), "node")
    asking = asking.withColumn("other", F.pmod(F.xxhash64("node", F.lit("asking")), F.col("chunks")).cast("int")).withColumn("part", every("blocks"))
    asked = _dealt(large.join(chunks, "cluster")).withColumn("other", every("chunks")).withColumn("side", F.lit(1))
    names = StructType.fromDDL(ROW).names
    last = compared(asking.withColumn("side", F.lit(0)).select(*names).unionAll(asked.select(*names)))
    return links.unionAll(last.where("node <> label").select("node", "label"))


def near_copies(own: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents (``doc_id``, ``text_hash``, ``node``) and the ``root`` of each node that has a smaller near copy."""
    names = [f"print_{k}" for k in range(SEEDS)]
    added = "node long, size int, " + ", ".join(f"{n} long" for n in names)
    rows = add_columns(own, "text", added, described)
    counted = Observation()
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "node", "size", *names).observe(counted, F.count("*").alias("n"))
    rows, most = scratch.keep("rows", rows), counted.get["n"]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    nodes = scratch.keep("nodes", rows.groupBy("node").agg(first, *[F.min(c).alias(c) for c in ("size", *names)]), most)
    clusters = connected_components(candidate_links(nodes, scratch, most))
    scratch.drop(*[f"{kind}-{name}" for kind in ("met", "rest") for name in names])
    together = clusters.select("node", F.col("root").alias("cluster"))
    together = scratch.keep("together", together.unionAll(clusters.select("root", "root")).distinct(), most)
    sizes = nodes.join(together, "node").groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    blocks = sizes.select("cluster", _blocks(F.col("n"), F.col("s")).alias("blocks"))
    # only texts of nodes that have candidates are fetched, each once
    wanted = nodes.join(together, "node").join(blocks, "cluster").select(
        "node", "cluster", "blocks", "size", F.col("first.text_hash").alias("a"), _id_hash("first.doc_id").alias("b")
    )
    once = own.select("text", F.xxhash64("text").alias("a"), _id_hash("doc_id").alias("b")).dropDuplicates(["a", "b"])
    members = scratch.keep("members", once.join(wanted, ["a", "b"]).drop("a", "b"))
    return rows, connected_components(similar_links(members, scratch))


def _id_hash(column: str):
    return F.xxhash64(F.col(column), F.lit("id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without all but one document of each group of near copies."""
    scratch = Scratch(docs.sparkSession)
    own = texts(docs, text).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows, roots = near_copies(own, scratch)
    grouped = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    one, other = unused(docs, "one", "other")
    kept = grouped.groupBy("root").agg(F.min(order).alias("k"))
    kept = Scratch(docs.sparkSession).keep("kept", kept.select(F.col("k.text_hash").alias(one), _id_hash("k.doc_id").alias(other)), rows.count())
    scratch.drop()
    marked = docs.withColumns({one: F.xxhash64(F.coalesce(F.col(text), F.lit(""))), other: _id_hash(doc_id)})
    # repeated rows go before the shuffle; both steps deal documents by the same two columns, so texts are dealt once
    return marked.dropDuplicates([one, other]).join(kept, [one, other], "leftsemi").drop(one, other)
