"""URL filter: a blocked Bloom filter of the listed URLs lets possible hits through to an exact hash join.

Rules are pairs of a host and a path prefix with a verdict. A rule fits its host and every subdomain of it, where
the url's path starts with the rule's path; the longest rule (host and path together) wins, then the greater one
as text; the same rule with both verdicts blocks. Every url gives one candidate for each number of host labels that
it has and each path length, up to its own, that a rule with as many labels has, so any listed prefix is found, not
only whole folders. The lengths are held in arrays: the plan does not grow with the list.

The filter is a table of 64-bit blocks: a key's hash picks its block and four bits in it, so one look-up in one
block decides. Built-in functions only; no Python touches a row. The filter and the rules are broadcast only if
their bytes, which are counted, are under ``BROADCAST_BYTES``; larger lists are joined by a shuffle.

Null urls and urls without ``://`` have an empty host and path, and fit no rule. Rows are kept as they are,
repeated ones too; columns with the names of the new ones are replaced, all others pass through. Empty tables give
empty results, and without rules every url has the default verdict. Urls of any length are looked at whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import settled, unused, without

BROADCAST_BYTES = 64 << 20
#: Bits of the filter for each rule, at least; with four bits a key this passes about 1 in 400 others.
BITS_PER_KEY = 16


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def _bits(key: Column) -> Column:
    """The four bits of a key in its block, as a mask."""
    one = F.lit(1).cast("long")
    mask = F.lit(0).cast("long")
    for shift in (34, 40, 46, 52):
        place = F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, place))
    return mask


def bloom_filter(rules: DataFrame, keys: int) -> tuple[DataFrame, int]:
    """The blocks (``block``, ``word``) that listed keys set, and the number of all blocks."""
    blocks = 1 << max(0, (max(1, keys) * BITS_PER_KEY // 64).bit_length())
    key = _hash(F.col("rule_host"), F.col("rule_path"))
    made = rules.select(key.bitwiseAND(F.lit(blocks - 1)).alias("block"), _bits(key).alias("bits"))
    return made.groupBy("block").agg(F.bit_or("bits").alias("word")), blocks


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the winning rule, else null) and ``verdict``.

    ``rules`` has ``rule_host``, ``rule_path`` and ``rule_verdict`` (``allow`` or ``block``).
    """
    rules = rules.where("rule_host is not null and rule_path is not null")
    # of a rule listed twice with different verdicts, block is the greater text and wins
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    labels, chars = F.size(F.split("rule_host", r"\.")), F.length("rule_path")
    width = F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + 48).alias("bytes")
    # one row for each depth that rules have, with their path lengths: no more numbers than a path is long
    shapes = rules.groupBy(labels.alias("labels")).agg(F.sort_array(F.collect_set(chars)).alias("lengths"), F.count("*").alias("n"), width).collect()
    urls = without(pages, ["host", "path", "rule", "verdict"])
    urls = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not shapes:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    longest, deepest = max(r["lengths"][-1] for r in shapes), max(r["labels"] for r in shapes)
    lengths = F.create_map(*[F.lit(x) for r in shapes for x in (r["labels"], r["lengths"])])
    filter_, blocks = bloom_filter(rules, sum(r["n"] for r in shapes))
    small = sum(r["bytes"] for r in shapes) + 32 * blocks <= BROADCAST_BYTES
    near = F.broadcast if small else lambda frame: frame

    depth = F.least(F.size(F.split("host", r"\.")), F.lit(deepest))

    def of_depth(n: Column) -> Column:
        tail = F.call_function("substring_index", F.col("host"), F.lit("."), -n)
        fitting = F.filter(F.coalesce(F.try_element_at(lengths, n), F.array().cast("array<int>")), lambda c: c <= F.length("head"))
        return F.transform(fitting, lambda c: F.struct(tail.alias("rule_host"), F.call_function("substring", F.col("head"), F.lit(1), c).alias("rule_path")))

    heads = urls.select("host", F.substring("path", 1, longest).alias("head"))
    found = F.flatten(F.transform(F.sequence(F.lit(1), depth), of_depth))
    candidates = heads.withColumn("c", F.explode(found)).select("host", "head", "c.*")
    key = _hash(F.col("rule_host"), F.col("rule_path"))
    candidates = candidates.withColumns({"block": key.bitwiseAND(F.lit(blocks - 1)), "bits": _bits(key)})
    possible = candidates.join(near(filter_), "block").where(F.col("word").bitwiseAND(F.col("bits")) == F.col("bits"))
    exact = possible.join(near(rules), ["rule_host", "rule_path"])
    text = F.concat("rule_host", "rule_path")
    best = exact.groupBy("host", "head").agg(F.max(F.struct(F.length(text), text.alias("rule"), "rule_verdict")).alias("best"))
    head, judged = unused(urls, "head", "judged")
    best = settled(best.select("host", F.col("head").alias(head), "best.rule", F.col("best.rule_verdict").alias(judged)))
    joined = urls.withColumn(head, F.substring("path", 1, longest)).join(best, ["host", head], "left")
    joined = joined.withColumn("verdict", F.coalesce(judged, F.lit(default)))
    return joined.select(*without(pages, ["host", "path", "rule", "verdict"]).columns, "host", "path", "rule", "verdict")
