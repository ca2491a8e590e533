"""A training-corpus pipeline: language, exact copies, near copies, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textveil.llm import language, packing, pii, simhash
from textveil.llm.common import SPACE, documents, durable, text_of
from textveil.llm.exact_dedup import exact_groups

#: No SQL can state language predictions, fingerprints or packing: the stages are tested against brute force.
ORACLE_SQL = None


def _one_row_each(docs: DataFrame, kept: DataFrame, keys: dict) -> DataFrame:
    """Rows of docs whose keys (name to column) are in kept, one row for each key; nulls are equal.

    Both sides are of any size, so they are merged, and the window reuses the order of the merge.
    """
    own = [f"_key_{name}" for name in keys]
    keyed = docs.withColumns({f"_key_{name}": column for name, column in keys.items()})
    wanted = kept.select(*(F.col(name).alias(own_) for name, own_ in zip(keys, own, strict=True))).hint("merge")
    found = keyed.join(wanted, own, "left_semi")
    first = F.row_number().over(Window.partitionBy(*own).orderBy(*own))
    return found.withColumn("_row", first).where("_row = 1").drop("_row", *own)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter, and so a language among those of the labelled rows; the others go.

    Null and empty texts go too, and all documents if no row has a language to learn from. Repeated rows stay.
    """
    return language.keep(docs, language.train(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the one that op9's contract keeps; of rows equal in id and text one stays."""
    body = F.sha2(F.encode(F.regexp_replace(text_of(), SPACE + "+", ""), "UTF-8"), 256)
    kept = exact_groups(docs).where("kept").select(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.isnull("doc_id").alias("none"), F.col("text_sha256").alias("body"))
    return _one_row_each(docs, kept, {"id": F.coalesce("doc_id", F.lit(-1)), "none": F.isnull("doc_id"), "body": body})


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, a known one before null; ties by text.

    Groups are op2's. Documents without near copies stay, whatever their ids; of repeated rows one stays; no rows give none.
    """
    kept = simhash.representatives(docs).select(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.isnull("doc_id").alias("none"), F.col("key").alias("body"))
    return _one_row_each(docs, kept, {"id": F.coalesce("doc_id", F.lit(-1)), "none": F.isnull("doc_id"), "body": simhash.text_key()})


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised or not, becomes its kind in brackets; every row stays, null and empty texts as they are."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row with their sequences and offsets, as op8 gives them; null texts are one end token each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mask_pii", mask_pii),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all rows of documents; what a stage keeps is written before the next one reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
