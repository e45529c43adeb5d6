"""A corpus pipeline: quality rules, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before kept, and returns a DataFrame;
all but the last return the columns of documents. Nulls, empty and very long texts, repeated rows, clashing extra columns
and empty tables are handled as the operators' modules say; what a stage adds to that is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, mixing, piece_codec, quality_rules, substring_dedup
from tessera.llm.common import cut, drop, load, scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep; null and empty texts go."""
    docs = docs.select(*COLUMNS)
    rules = quality_rules.fit(docs, load(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: that with the smallest id; of repeated rows one. Texts without
    words stay, once for each id and text. A group without ids keeps one of its documents."""
    docs = docs.select(*COLUMNS)
    found = jaccard_join.join(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    alone = F.when(F.col("group").isNull(), F.struct("doc_id", "tie"))  # no words: in no group
    keep = found.groupBy("group", alone).agg(F.min(F.struct("doc_id", "tie")).alias("one"))
    keep = cut(keep.select(F.col("one.doc_id").alias("id"), F.col("one.tie").alias("tie")), "pipeline-kept")
    hashed = docs.withColumn("own", F.xxhash64("text"))
    kept = hashed.join(keep, hashed["doc_id"].eqNullSafe(keep["id"]) & (hashed["own"] == keep["tie"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "own"]).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier, the rest joined by one space; texts with nothing to remove
    stay as they are, and those that lose all words go. n_chars is the new length. Of rows alike in id and text, all get
    one's lang and source."""
    docs = docs.select(*COLUMNS)
    done = substring_dedup.dedup(docs, untouched=True).filter("n_removed = 0 or n_removed < n_words")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rest = docs.select(F.col("doc_id").alias("id"), F.crc32(text).alias("crc"), "lang", "source").dropDuplicates(["id", "crc"])
    out = done.join(rest, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("crc")))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to twice, or not at all; the rows of a part of a shard are together, in
    the order of their places."""
    return mixing.laid_out(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and digests of its ids and of what they decode to."""
    return piece_codec.encode_decode(docs.select("doc_id", "lang", "source", "text"), piece_codec.default_model(), digests=True)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", tokens),
]

ORACLE_SQL = None  # learned rules, hashes and merges have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what an earlier one wrote is removed once the documents that it kept are written."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope() as made:
            before, docs = docs, cut(stage(spark, docs, sf_dir), "pipeline")
        drop(before, *(x for x in made if x is not docs))
    return STAGES[-1][1](spark, docs, sf_dir)
