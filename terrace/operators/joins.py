"""Joins on free SQL conditions, with size-checked broadcast and salting for hot keys."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.operators.columns import quoted
from terrace.sizing import BROADCAST_LIMIT_BYTES, broadcast_if_small, fits_broadcast

# Accepted join texts and the Spark join type behind each. A cross join text always
# comes with a condition here, which makes it an inner join.
JOIN_TYPES = {
    "inner": "inner",
    "cross": "inner",
    "left": "left",
    "left outer": "left",
    "right": "right",
    "right outer": "right",
    "full": "full",
    "full outer": "full",
    "left semi": "left_semi",
    "semi": "left_semi",
    "left anti": "left_anti",
    "anti": "left_anti",
}

SALT = "__salt"
# Keys that the sketch of a hot side keeps count of; its error is a few 1 / SKETCH_KEYS of the rows.
SKETCH_KEYS = 10_000
MATCHED = "__matched"


def join_type(text: str) -> str:
    words = text.lower().replace("_", " ").split()
    if words and words[-1] == "join":
        words = words[:-1]
    try:
        return JOIN_TYPES[" ".join(words) or "inner"]
    except KeyError:
        raise ValueError(f"unknown join type: {text!r}") from None


def spread(df: DataFrame, buckets: int, hot: Column | None = None) -> DataFrame:
    """Add a salt to every row, or to those with a hot key (others get 0). A rerun task gives a row the same salt.

    Rows of parquet files are told apart by file and place, so equal rows get different salts; where a row has no
    such address, its content decides.
    """
    always = F.lit(True) if hot is None else hot
    try:
        row = F.xxhash64("_metadata.file_path", "_metadata.row_index")
        return df.withColumn(SALT, F.when(always, F.pmod(row, F.lit(buckets)).cast("int")).otherwise(0))
    except AnalysisException:
        hashable = [c for c, t in df.dtypes if not t.startswith("map") and "map<" not in t]
        row = F.xxhash64(*hashable)
        return df.withColumn(SALT, F.when(always, F.pmod(row, F.lit(buckets)).cast("int")).otherwise(0))


def _salts(buckets: int, hot: Column | None) -> Column:
    every = F.array(*[F.lit(i) for i in range(buckets)])
    return every if hot is None else F.when(hot, every).otherwise(F.array(F.lit(0)))


def replicate(df: DataFrame, buckets: int, hot: Column | None = None) -> DataFrame:
    """Repeat every row once per salt, or those with a hot key. The result is marked for a shuffle join: Spark does
    not count the copies when it estimates sizes and might broadcast them."""
    return df.withColumn(SALT, F.explode(_salts(buckets, hot))).hint("merge")


def heavy_keys(df: DataFrame, columns: Sequence[str], buckets: int) -> list[int]:
    """Hashes of the keys that have more than a 1 / (4 * buckets) share of the rows.

    A sketch of a bounded number of keys counts them in one pass, combined per task; its error is far below that
    share. At most ``4 * buckets`` keys can be that hot.
    """
    key = F.xxhash64(*[F.col(quoted(c)) for c in columns])
    known = df.where(reduce(lambda a, b: a & b, [F.col(quoted(c)).isNotNull() for c in columns])).select(key.alias("key"))
    top = F.expr(f"approx_top_k(key, {4 * buckets}, {SKETCH_KEYS})")
    row = known.agg(F.count(F.lit(1)).alias("n"), top.alias("top")).first()
    return [t["item"] for t in row["top"] or [] if t["count"] * 4 * buckets > row["n"]]


_EQUALITY = re.compile(r"\s*(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)\s*")


def equal_columns(condition: str, aliases: Sequence[str]) -> list[tuple[str, str]] | None:
    """Column pairs of a condition that is nothing but ``a.x = b.y AND ...``, else None."""
    pairs = []
    for part in re.split(r"\s+and\s+", condition.strip(), flags=re.IGNORECASE):
        match = _EQUALITY.fullmatch(part)
        if not match or {match[1], match[3]} != set(aliases):
            return None
        pairs.append((match[2], match[4]) if match[1] == aliases[0] else (match[4], match[2]))
    return pairs


def with_match_flag(
    left: DataFrame, right: DataFrame, aliases: Sequence[str], condition: str, buckets: int
) -> DataFrame:
    """``left`` with ``__matched``: does any row of a hot ``right`` meet the condition?

    For plain equalities the distinct keys of ``right`` answer that; they are reduced per task, so a
    hot key is one row. For other conditions pairs are looked for in salted tasks and reduced to
    distinct left rows: equal left rows have the same matches, so joining those back is exact.
    """
    first, second = aliases
    pairs = equal_columns(condition, aliases)
    if pairs:
        found = right.select(*[F.col(quoted(r)).alias(f"k{i}") for i, (_, r) in enumerate(pairs)])
        same = [F.col(f"rows.{quoted(l)}") == F.col(f"found.k{i}") for i, (l, _) in enumerate(pairs)]
    else:
        salted = replicate(left, buckets).alias(first).join(
            spread(right, buckets).alias(second),
            F.expr(f"({condition}) AND {first}.{SALT} = {second}.{SALT}"),
            "left_semi",
        )
        found = salted.drop(SALT)
        names = [quoted(c) for c in left.columns]
        same = [F.col(f"rows.{n}").eqNullSafe(F.col(f"found.{n}")) for n in names]
    found = found.distinct().withColumn(MATCHED, F.lit(True)).alias("found")
    flag = F.coalesce(F.col(f"found.{MATCHED}"), F.lit(False))
    joined = left.alias("rows").join(found, reduce(lambda a, b: a & b, same), "left")
    return joined.select("rows.*", flag.alias(MATCHED))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    aliases: Sequence[str],
    condition: str,
    how: str,
    hot: str,
    buckets: int,
) -> DataFrame:
    """Join with the ``hot`` side ("left" or "right") spread over ``buckets`` tasks per hot key.

    For plain equalities a sketch of the hot side picks the keys to spread, and only their rows on the other side are
    replicated; without hot keys the join is a plain one. For other conditions all keys count as hot.

    The other side is replicated. Where it is the preserved side of the join, a row without a match
    would come out once per bucket, so its matches are looked up first and a row without any is not
    replicated.
    """
    first, second = aliases
    if how == "right" or (how == "full" and hot == "left"):
        how, hot = "left" if how == "right" else how, "left" if hot == "right" else "right"
        left, right, first, second = right, left, second, first
    salted = F.expr(f"({condition}) AND {first}.{SALT} = {second}.{SALT}")
    of_left = of_right = None
    pairs = equal_columns(condition, (first, second))
    if pairs and all(left.schema[a].dataType == right.schema[b].dataType for a, b in pairs):
        side, names = (left, [a for a, _ in pairs]) if hot == "left" else (right, [b for _, b in pairs])
        heavy = heavy_keys(side, names, buckets)
        if not heavy:
            return left.alias(first).join(right.alias(second), F.expr(condition), how)
        of_left, of_right = (F.xxhash64(*[F.col(quoted(p[k])) for p in pairs]).isin(heavy) for k in (0, 1))
    if hot == "left":
        a, b = spread(left, buckets, of_left), replicate(right, buckets, of_right)
        return a.alias(first).join(b.alias(second), salted, how)
    if how == "inner":
        a, b = replicate(left, buckets, of_left), spread(right, buckets, of_right)
        return a.alias(first).join(b.alias(second), salted, how)
    flagged = with_match_flag(left, right, (first, second), condition, buckets)
    if how == "left_semi":
        return flagged.where(F.col(MATCHED)).drop(MATCHED).alias(first)
    if how == "left_anti":
        return flagged.where(~F.col(MATCHED)).drop(MATCHED).alias(first)
    salts = F.when(F.col(MATCHED), _salts(buckets, of_left)).otherwise(F.array(F.lit(0)))
    copies = flagged.withColumn(SALT, F.explode(salts))
    joined = copies.hint("merge").alias(first).join(spread(right, buckets, of_right).alias(second), salted, how)
    return joined.where(~F.col(f"{first}.{MATCHED}") | F.col(f"{second}.{SALT}").isNotNull())


def join_sources(
    sources: Mapping[str, DataFrame],
    conditions: str | Sequence[str],
    how: str | Sequence[str] = "inner",
    broadcast: str | Sequence[str] = (),
    salt: Mapping[str, int] | None = None,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Join aliased sources in order.

    ``conditions`` and ``how`` are one value for all joins or one per later source. ``broadcast``
    names the aliases to send to every executor; each is only honoured below ``broadcast_limit``.
    ``salt`` maps hot aliases to a number of buckets, one of the first two and any later one (of an inner or right
    join); when the other one of the first two can be broadcast below ``broadcast_limit``, it is, and the hot side
    needs no shuffle.
    """
    aliases = list(sources)
    later = aliases[1:]
    condition_list = [conditions] * len(later) if isinstance(conditions, str) else list(conditions)
    how_list = [how] * len(later) if isinstance(how, str) else list(how)
    if not (len(condition_list) == len(how_list) == len(later)):
        raise ValueError("give one condition and join type, or one per source after the first")
    if not all(c and c.strip() for c in condition_list):
        raise ValueError("every join needs a condition")
    wanted = {broadcast} if isinstance(broadcast, str) else set(broadcast)
    if wanted - set(aliases):
        raise ValueError(f"broadcast of unknown alias: {sorted(wanted - set(aliases))}")

    frames = {
        a: broadcast_if_small(df, broadcast_limit) if a in wanted else df for a, df in sources.items()
    }
    joined = frames[aliases[0]].alias(aliases[0])
    start, salt = 0, dict(salt or {})
    if set(salt) - set(aliases) or len(set(salt) & set(aliases[:2])) > 1:
        raise ValueError("salt names sources, and one of the first two at most")
    for hot in [a for a in aliases[:2] if a in salt]:
        buckets = salt[hot]
        kind, side = join_type(how_list[0]), "left" if hot == aliases[0] else "right"
        cold = aliases[1] if side == "left" else aliases[0]
        build_cold = kind == "inner" or kind != "full" and (kind == "right") == (side == "right")
        if build_cold and fits_broadcast(sources[cold], broadcast_limit):
            frames[cold] = F.broadcast(sources[cold])
            joined = frames[aliases[0]].alias(aliases[0])
        else:
            first, second = (sources[a] for a in aliases[:2])
            joined = salted_join(first, second, aliases[:2], condition_list[0], kind, side, buckets)
            start = 1
    for position, (alias, condition, kind) in list(enumerate(zip(later, condition_list, how_list)))[start:]:
        if alias in salt and position:
            joined = _salted_later(joined, sources[alias], aliases[: position + 1], alias, condition, join_type(kind), salt[alias])
        else:
            joined = joined.join(frames[alias].alias(alias), F.expr(condition), join_type(kind))
    return joined


def _salted_later(
    joined: DataFrame, hot: DataFrame, before: Sequence[str], alias: str, condition: str, how: str, buckets: int
) -> DataFrame:
    """Join a hot third or later source: its rows are spread, those joined so far are replicated."""
    if how not in ("inner", "right"):
        raise ValueError("a later source can be salted in inner and right joins only: others keep rows of the joined ones")
    of_joined = of_hot = None
    partner, pairs = next(((b, p) for b in before if (p := equal_columns(condition, (b, alias)))), (None, None))
    if pairs and all(joined.select(f"{partner}.{quoted(a)}").dtypes[0][1] == dict(hot.dtypes)[b] for a, b in pairs):
        heavy = heavy_keys(hot, [b for _, b in pairs], buckets)
        if not heavy:
            return joined.join(hot.alias(alias), F.expr(condition), how)
        of_joined = F.xxhash64(*[F.col(f"{partner}.{quoted(a)}") for a, _ in pairs]).isin(heavy)
        of_hot = F.xxhash64(*[F.col(quoted(b)) for _, b in pairs]).isin(heavy)
    mark = f"{SALT}_{alias}"
    copies = joined.withColumn(mark, F.explode(_salts(buckets, of_joined))).hint("merge")
    return copies.join(spread(hot, buckets, of_hot).alias(alias), F.expr(f"({condition}) AND {mark} = {alias}.{SALT}"), how)
