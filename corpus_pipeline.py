"""A training corpus from the documents table: five stages, each on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import bpe, decontaminate, near_copies, quality, suffix_dedup
from terrace.llm.frames import read
from terrace.session import scratch_path

#: Bytes that a passage must have to be removed where it occurs again, and words of a benchmark window.
PASSAGE_BYTES, WINDOW_WORDS = 200, 10


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, whether that is null (operators take it for an empty one), and all other columns in one,
    so that these keep out of the way of an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.col("text").isNull(), F.struct(*others or [F.lit(0)])).alias("rest"))


def _unpacked(found: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    values = {c: F.col(f"rest.col2.`{c}`") for c in docs.columns if c not in ("doc_id", "text")}
    values |= {"doc_id": F.col("doc_id"), "text": F.when(~F.col("rest.col1"), F.col("text"))} | changed
    return found.select(*[values[c].alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled documents of the tables, takes for good ones.

    Null and empty texts have the score that the field gives an empty line; repeated rows stay or go together.
    """
    field = quality.learn(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    scored = quality.score_quality(_packed(docs), field)
    return _unpacked(scored.where(F.col("score") >= quality.THRESHOLD), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: that with the smallest doc_id, null last, of repeated rows
    one. Null and empty texts are copies of each other."""
    return near_copies.keep_one(docs).select(*docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; ``n_chars`` follows the text.

    Passages are cut at whole characters: a span that begins or ends within one keeps that character. Documents come in
    the order of doc_id, null last; no row goes, also if nothing of its text is left.
    """
    found = suffix_dedup.remove_repeats(_packed(docs), length=PASSAGE_BYTES, keep="first")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    # each removed run, moved to the next start of a character on both sides; at most three bytes follow the first
    inside = lambda at: F.substring(F.hex(F.substr(data, at + 1, F.lit(1))), 1, 1).isin("8", "9", "A", "B")
    def start(at):
        one, two = at + 1, at + 2
        return F.when(~inside(at), at).when(~inside(one), one).when(~inside(two), two).otherwise(at + 3)
    def end(at):
        one, two = at - 1, at - 2
        return F.when(~inside(at), at).when(~inside(one), one).when(~inside(two), two).otherwise(at - 3)
    cuts = F.transform("removed_spans", lambda s: F.array(start(s[0].cast("int")), end(s[1].cast("int"))))
    ends = F.concat(F.array(F.lit(0)), F.flatten(cuts), F.array(F.octet_length("text")))
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("removed_spans")),
        lambda k: F.decode(F.substr(data, F.get(ends, 2 * k) + 1, F.get(ends, 2 * k + 1) - F.get(ends, 2 * k)), "UTF-8"),
    )
    text = F.when(F.size("removed_spans") == 0, F.col("text")).otherwise(F.array_join(pieces, ""))
    kept = found.withColumn("text", text)
    length = F.when(~F.col("rest.col1"), F.length("text")).cast(dict(docs.dtypes)["n_chars"])
    return _unpacked(kept, docs, n_chars=length)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; texts without words have none."""
    found = decontaminate.find_contamination(_packed(docs), read(spark, sf_dir, "benchmark"), window=WINDOW_WORDS)
    return _unpacked(found.where(F.size("hit_spans") == 0), docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (packed, little-endian, 32 bits), their number and digests of them and of their text.

    Null and empty texts have no ids; repeated rows are encoded each for itself.
    """
    import public_tokenizers

    encoded = bpe.encode(docs.select("doc_id", "text"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return encoded.select(
        "doc_id",
        F.expr("octet_length(token_ids) div 4").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "token_ids",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", repeated_passage_stage),
    ("benchmark decontamination", decontamination_stage),
    ("token encoding", encoding_stage),
]

#: A classifier, fingerprints and a tokenizer's merges: no stage but one could be written in SQL. Each is tested against
#: plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
