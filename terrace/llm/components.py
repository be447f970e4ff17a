"""Connected components of a graph of links, by alternating large and small stars until nothing changes.

Each round replaces every link by one to the smallest neighbour, so hubs lose their links instead of gathering
them, and the number of rounds grows with the logarithm of the size at most. Minima are combined before each
shuffle. A round is written as a table, counted while it is written, and the table of the round before goes; the
driver sees two numbers of each round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .frames import Scratch, ship

#: Links of which a task makes a spanning forest at a time.
FOREST_LINKS = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which links make a spanning forest of all, and of each link the smallest node that its ends can reach."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(names)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    tree = np.zeros(len(u), bool)
    for k, (a, b) in enumerate(zip(ends[: len(u)].tolist(), ends[len(u) :].tolist())):
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            tree[k] = True
    return tree, names[np.array([top(x) for x in ends[: len(u)].tolist()], np.int64)]


def marked_forest(links: DataFrame, number: int) -> DataFrame:
    """``links`` (``u``, ``v``; about ``number`` rows) with ``tree``, whether a link is needed to connect what the links
    beside it connect, and ``part``, the smallest node that these reach.

    A forest is made of ``FOREST_LINKS`` links at a time, so it has fewer links than they have nodes.
    """

    most = FOREST_LINKS

    def run(batches):
        held, size = [], 0

        def marked():
            u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in "uv")
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (u, v, *forest(u, v))], names=["u", "v", "tree", "part"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                yield marked()
                held, size = [], 0
        if size:
            yield marked()

    ship(links.sparkSession)
    few = links.select("u", "v").coalesce(max(1, -(-number // most)))
    return few.mapInArrow(run, StructType.fromDDL("u long, v long, tree boolean, part long"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("big").alias("u"), F.col("small").alias("v"))
    both = both.unionAll(links.select(F.col("small").alias("u"), F.col("big").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("big"), F.col("m").alias("small"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("big").agg(F.min("small").alias("m"))
    moved = links.join(least, "big").where("small > m").select(F.col("small").alias("big"), F.col("m").alias("small"))
    return moved.unionAll(least.select("big", F.col("m").alias("small")))


def _kept(scratch: Scratch, name: str, links: DataFrame, before: int | None) -> tuple[DataFrame, int, object]:
    """Distinct links as a table, their number and a checksum of all of them."""
    counted = Observation()
    digest = F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))
    links = links.distinct().observe(counted, F.count("*").alias("n"), digest.alias("digest"))
    return scratch.keep(name, links, before), counted.get["n"], counted.get["digest"]


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has two long columns ``u`` and ``v``; returns ``node`` and ``root``, the smallest node it can reach.

    Loops and repeated links count for nothing; nodes that are their own root are left out.
    """
    scratch = Scratch(links.sparkSession)
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("big"), F.least("u", "v").alias("small"))
    now, *state = _kept(scratch, "0", ordered, None)
    k = 0
    while True:
        k += 1
        before = state
        now, *state = _kept(scratch, str(k), _small_star(_large_star(now)), state[0])
        scratch.drop(str(k - 1))
        if state == before:
            return now.select(F.col("big").alias("node"), F.col("small").alias("root"))
