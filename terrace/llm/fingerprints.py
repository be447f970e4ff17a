"""Document fingerprints by consistent weighted sampling; built-in functions only.

A document is a set of words (``\\S+`` of the whole text, as it stands) weighted by how often they occur. For each
of ``SAMPLES`` samples every word draws r and c from Gamma(2, 1) and b from [0, 1), all from hashes of the word
and the sample's number, and with its weight w

    t = floor(ln w / r + b),   a = c * exp(-r * (t - b + 1)),

the word with the least a is the sample, together with its t. Two documents have the same sample with a
probability equal to their generalised Jaccard similarity, sum of min weights over sum of max weights, so the
share of equal samples estimates it. The fingerprint writes 32 bits of each sample as eight hex digits.

A draw from Gamma(2, 1) is the negative logarithm of a product of two uniform numbers u. Since a is at least
(2 - u3 - u4) * u1 * u2 / w, most words are seen to be no sample before a logarithm is taken: the least a of a
document with weights of sum W is over BAR / W with probability exp(-BAR), below 1e-13; in that case the sample
would read ``ffffffff``. The value of a is kept in 31 bits at a resolution of 2**-28; of equal ones the smaller
hash wins, for every document alike.

Texts that share a piece (an edited text and its original) are counted together: the words of the shared piece
are read and hashed once for both.

Words are counted where the rows are: documents are dealt once, and all sums of a document stay in its task.
``with_next`` deals documents in ranges of doc_id whose borders come from quantiles of the ids, so no task sorts
all of them; the first row of each range is copied to the range before it. An id that takes several ranges, and
null ids, are split further by hashes of their rows.

Null and empty texts, and texts of blanks, have no words and a fingerprint of zeros, which is like itself only.
Repeated doc_ids are ordered by hashes of their texts, in parts if they take several ranges, null ids come last in descending order; ids that are not whole
numbers are ordered by their hashes. Equal texts have equal fingerprints. Texts are used whole. Empty tables give empty
results. Only the two columns named are looked at, so others may have any names.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

SAMPLES = 48
#: Samples that one row draws. More would make the generated method too long to be compiled.
GROUP = 2
SCALE, MOST = 1 << 28, (1 << 31) - 1
BAR = 30.0
LOW = (1 << 32) - 1
#: Ranges of ids for each shuffle partition; their number has an upper bound, so that the driver's list of borders has.
RANGES_PER_PARTITION, MOST_RANGES = 4, 20_000


def _uniform(source: str, shift: int) -> Column:
    """24 bits of a hash as a number between 0 and 1."""
    bits = F.shiftrightunsigned(source, shift).bitwiseAND(F.lit((1 << 24) - 1))
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-24)


def _draws(rows: DataFrame, versions: int) -> DataFrame:
    """What a word offers for each sample of its part and each version, ``_s0_0`` on; null where it can't be the least.

    ``rows`` have ``_word``, ``_part``, ``_bar`` and ``_log0`` on. An offer is a in the upper 31 bits, and 32 bits
    of the word and its t in the lower ones. The columns come in steps, so that each number is computed once.
    """
    each, both = range(GROUP), [(k, v) for k in range(GROUP) for v in range(versions)]
    step = rows.withColumns({f"_h{k}": F.xxhash64("_word", "_part", F.lit(k)) for k in each})
    step = step.withColumns({f"_g{k}": F.xxhash64(f"_h{k}") for k in each})
    step = step.withColumns({f"_u{k}": _uniform(f"_h{k}", 0) * _uniform(f"_h{k}", 24) for k in each})
    step = step.withColumns({f"_v{k}": _uniform(f"_g{k}", 0) for k in each} | {f"_w{k}": _uniform(f"_g{k}", 24) for k in each})
    able = {k: (F.lit(2.0) - F.col(f"_v{k}") - F.col(f"_w{k}")) * F.col(f"_u{k}") <= F.col("_bar") for k in each}
    step = step.withColumns({f"_r{k}": F.when(able[k], -F.ln(f"_u{k}")) for k in each})
    step = step.withColumns({f"_c{k}": F.when(F.col(f"_r{k}").isNotNull(), -F.ln(F.col(f"_v{k}") * F.col(f"_w{k}"))) for k in each})
    step = step.withColumns({f"_b{k}": F.shiftrightunsigned(f"_h{k}", 48).cast("double") * F.lit(2.0**-16) for k in each})
    step = step.withColumns({f"_t{k}_{v}": F.floor(F.col(f"_log{v}") / F.col(f"_r{k}") + F.col(f"_b{k}")) for k, v in both})
    step = step.withColumns(
        {f"_a{k}_{v}": F.col(f"_c{k}") * F.exp(F.col(f"_r{k}") * (F.col(f"_b{k}") - F.col(f"_t{k}_{v}") - F.lit(1.0))) for k, v in both}
    )
    kept = {(k, v): F.least(F.floor(F.col(f"_a{k}_{v}") * F.lit(float(SCALE))), F.lit(MOST).cast("long")) for k, v in both}
    name = {(k, v): F.shiftrightunsigned(f"_g{k}", 20).bitwiseXOR(F.col(f"_t{k}_{v}") * F.lit(2654435761)) for k, v in both}
    return step.withColumns({f"_s{k}_{v}": F.shiftleft(kept[k, v], 32).bitwiseOR(name[k, v].bitwiseAND(F.lit(LOW))) for k, v in both})


def fingerprint_versions(rows: DataFrame, keys: list[str], versions: dict[str, list[str]]) -> DataFrame:
    """``keys`` and a fingerprint for each version; rows without any word are left out, versions without are zeros.

    A version is a list of columns of text, pieces whose words together are its words; versions may share them.
    ``keys`` tell rows apart. If the rows are already dealt by some of the keys, nothing is shuffled.
    """
    pieces = list(dict.fromkeys(p for parts in versions.values() for p in parts))
    names, every = list(versions), range(len(versions))
    cut = rows.select(*keys, *[F.split(p, r"\s+").alias(f"_w{i}") for i, p in enumerate(pieces)])
    size = {v: sum(F.size(f"_w{pieces.index(p)}") for p in versions[names[v]]) for v in every}
    cut = cut.withColumn("_words", F.least(*size.values()) if len(size) > 1 else size[0])
    split = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_w{i}").alias("w")) for i in range(len(pieces))]))
    words = cut.select(*keys, "_words", split.alias("p")).select(*keys, "_words", F.col("p.i").alias("_piece"), F.explode("p.w").alias("_word"))
    words = words.where("_word <> ''").select(*keys, "_words", "_piece", F.xxhash64("_word").alias("_word"))
    inside = {v: F.col("_piece").isin([pieces.index(p) for p in versions[names[v]]]) for v in every}
    counted = words.groupBy(*keys, "_words", "_word").agg(*[F.count(F.when(inside[v], F.lit(1))).alias(f"_n{v}") for v in every])
    most = F.greatest(*[F.col(f"_n{v}") for v in every]) if len(names) > 1 else F.col("_n0")
    spread = counted.select(
        *keys,
        "_word",
        (most * F.lit(BAR) / F.greatest("_words", F.lit(1))).alias("_bar"),
        # of a count of zero, null: no offer
        *[F.ln(f"_n{v}").alias(f"_log{v}") for v in every],
        F.explode(F.array(*map(F.lit, range(SAMPLES // GROUP)))).alias("_part"),
    )
    columns = [f"_s{k}_{v}" for v in every for k in range(GROUP)]
    least = _draws(spread, len(names)).groupBy(*keys, "_part").agg(*[F.min(c).alias(c) for c in columns])
    digits = [
        F.concat(*[F.lpad(F.lower(F.hex(F.coalesce(f"_s{k}_{v}", F.lit(LOW)).bitwiseAND(F.lit(LOW)))), 8, "0") for k in range(GROUP)])
        for v in every
    ]
    ordered = F.array_sort(F.collect_list(F.struct("_part", *[digits[v].alias(f"d{v}") for v in every])))
    joined = least.groupBy(*keys).agg(ordered.alias("_parts"))
    none, zeros = "f" * 8 * SAMPLES, "0" * 8 * SAMPLES
    texts = {n: F.array_join(F.col(f"_parts.d{v}"), "") for v, n in enumerate(names)}
    return joined.select(*keys, *[F.when(t == none, zeros).otherwise(t).alias(n) for n, t in texts.items()])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints, an estimate of the generalised Jaccard similarity."""
    same = sum(
        F.when(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8), F.lit(1)).otherwise(F.lit(0)) for k in range(SAMPLES)
    )
    return same / F.lit(float(SAMPLES))


def _range_of(own: DataFrame, wanted: int) -> Column:
    """The number of the range of a row: greatest ids first, null ids last.

    Borders are quantiles. An id that is several of them gets as many ranges, dealt by ``_row``; so do null ids.
    """
    fractions = [k / wanted for k in range(1, wanted)] or [0.5]
    found = own.agg(
        F.percentile_approx("_id", fractions, max(10_000, 10 * wanted)).alias("cuts"), F.count("*").alias("n"), F.count("_id").alias("known")
    ).first()
    times = Counter(found["cuts"] or [] if wanted > 1 else [])  # at most MOST_RANGES numbers
    hot = {c: m for c, m in times.items() if m > 1}
    cuts = sorted(times.keys() | {c + 1 for c in hot})
    parts = max(1, round(wanted * (found["n"] - found["known"]) / max(1, found["n"])))
    widest = max([1, parts, *hot.values()])
    place = F.lit(0)
    if cuts:
        # two steps of about the root of the number of borders, instead of a look at each of them
        step = math.isqrt(len(cuts)) + 1
        coarse = F.size(F.filter(F.lit(cuts[::step]), lambda c: c <= F.col("_id")))
        fine = F.size(F.filter(F.slice(F.lit(cuts), F.greatest((coarse - 1) * step + 1, F.lit(1)), step), lambda c: c <= F.col("_id")))
        below = F.when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)
        place = F.lit(len(cuts)) - below
    many = F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("_id")) if hot else F.lit(1)
    many = F.when(F.col("_id").isNull(), F.lit(parts)).otherwise(F.coalesce(many, F.lit(1)))
    place = F.when(F.col("_id").isNull(), F.lit(len(cuts) + 1)).otherwise(place)
    return (place * widest + F.pmod(F.col("_row"), many)).cast("int")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id``, ``_text``, ``_next`` (the next document's text, by descending doc_id; after the last the first), ``_range``, ``_pos``.

    ``_range`` and ``_pos`` tell rows apart, and rows are dealt by ``_range``. Rows with ``_guest`` are copies of the
    first row of the following range, which ``following`` needs and drops.
    """
    spark = docs.sparkSession
    number = F.col(doc_id).cast("long") if isinstance(docs.schema[doc_id].dataType, IntegralType) else F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id))
    names = [F.col(doc_id).alias("_doc"), number.alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")]
    try:  # where a row lies only tells equal rows apart, whose order makes no difference
        own = docs.select(*names, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_row"))
    except AnalysisException:  # rows that are not read from files as they are
        own = docs.select(*names).withColumn("_row", F.xxhash64("_text"))
    own = own.withColumn("_hash", F.xxhash64("_text"))
    wanted = min(MOST_RANGES, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = own.withColumn("_range", _range_of(own, wanted))
    # one row for each range: its first one
    top = F.min(F.struct((-F.col("_id")).alias("_minus"), "_hash", "_row")).alias("_top")
    tops = own.groupBy("_range").agg(top).orderBy("_range").select("_range", "_top._hash", "_top._row").collect()
    if not tops:
        return own.select(F.col("_doc").alias("_id"), "_text", F.col("_text").alias("_next"), "_range", F.lit(0).alias("_pos"), F.lit(False).alias("_guest"))
    before = [(r["_range"], r["_hash"], r["_row"], tops[k - 1]["_range"]) for k, r in enumerate(tops)]
    edges = spark.createDataFrame(before, "_at int, _first long, _first_row long, _before int")
    # each range's first row also goes, as a guest, to the range before it (of the first range: the last)
    is_top = (F.col("_range") == F.col("_at")) & (F.col("_hash") == F.col("_first")) & (F.col("_row") == F.col("_first_row"))
    spread = own.join(F.broadcast(edges), is_top, "left")
    places = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_range").alias("_range"), F.lit(False).alias("_guest"))))
    places = places.otherwise(
        F.array(
            F.struct(F.col("_range").alias("_range"), F.lit(False).alias("_guest")),
            F.struct(F.col("_before").alias("_range"), F.lit(True).alias("_guest")),
        )
    )
    names = ["_doc", "_id", "_text", "_hash", "_row"]
    dealt = spread.select(*names, F.explode(places).alias("p")).select(*names, F.coalesce("p._range", F.lit(0)).alias("_range"), "p._guest")
    # with _doc, so that all that is made of these rows needs the same columns and they are dealt once
    order = Window.partitionBy("_range").orderBy("_guest", F.desc_nulls_last("_id"), "_hash", "_row", "_doc")
    both = dealt.withColumns({"_next": F.coalesce(F.lead("_text").over(order), F.lit("")), "_pos": F.row_number().over(order)})
    return both.select(F.col("_doc").alias("_id"), "_text", "_next", "_range", "_pos", "_guest")


def following(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` of ``with_next`` without guests, with ``name``: the next document's ``value``."""
    order = Window.partitionBy("_range").orderBy("_pos")
    return rows.withColumn(name, F.lead(value).over(order)).where("not _guest").drop("_guest")
