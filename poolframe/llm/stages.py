"""From raw documents to packed training sequences, in stages over Parquet.

Each stage works on all rows that the one before kept, and all but the last return the columns
of the documents as they are: columns of a table's own that happen to have names which an operator
adds are set aside and put back. Null texts count as empty, rows without a key or with one key are
documents of their own where a stage doesn't say otherwise, and empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolframe.llm import mixing, ngram_join, packing, quality, substring_dedup
from poolframe.llm.store import discard, fresh_path, scratch, set_aside, unused


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are good enough on the whole; those that the classifier rejects go.

    It learns from labels whose CRC-32 of the key modulo 5 isn't 0. Every row has its own verdict, from its text
    alone: null and empty texts have that of an empty line.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = quality.train(docs, labels, ~quality.held_out(F.col("doc_id")))
    # The verdict travels with the row: scoring passes all columns on.
    apart, restored = set_aside(docs, "score", "predicted")
    return restored(quality.scored_rows(apart, field, threshold=0.3).where("predicted = 1"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by the likeness of five-word shingles, that of the smallest key.

    Texts without words and rows without a key all stay; rows of one key stay or go together.
    """
    return ngram_join.deduplicate(docs, width=5, part=75, of=100)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of smaller key has, or the text itself further up.

    Of the documents that are cut those go that have no word left. `n_chars` is that of the new text, where there
    is such a column. Null and empty texts stay as they are, and so do rows without a key.
    """
    apart, restored = set_aside(docs, "n_removed", "removed")
    cut = substring_dedup.remove_repeats(apart)
    kept = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(mixing.WORD))
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return restored(kept)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight has it, up to twice.

    Rows of one key are taken alike; a null source is one of its own; texts without words count for nothing,
    and are taken as their source's documents are.
    """
    apart, restored = set_aside(docs, "size", "source_size", "target", "copies", "taken")
    copies = mixing.mix(apart, weights=(3, 1, 2), share=1.5, most=2).where("copies > 0")
    return restored(copies.withColumn(unused("copy", copies), F.explode(F.sequence(F.lit(1), F.col("copies")))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids; columns of the documents but the key are left out."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048, end_id=1, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_near_copies),
    ("substring dedup", without_repeated_passages),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: The quality classifier is trained and the tokenizer is a library's: SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read again as the next one's.

    What a stage stores meanwhile is deleted when it is written, and so is its input if a stage wrote that.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark, "stage"):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
