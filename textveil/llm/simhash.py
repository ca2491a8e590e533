"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 3 bits meet halfway. Every distinct fingerprint emits itself and all its
one-bit variants; with these, pairs of up to 2 bits meet. Pairs of exactly 3 bits have one fingerprint with an even number
of ones and one with an odd number; the even ones also emit their two-bit variants, and since two of any three positions
share a half of the word, both flips within one half suffice (992 instead of 2016). Variants are the shuffle key. Under a
variant stand at most 65 + 992 distinct fingerprints, whatever the input: those within one bit of it link to each other
and to those at two bits, so links to the smallest near one give the group's whole connectivity without its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from textveil.llm.common import durable, text_of
from textveil.llm.components import components

WORDS, SEED, RADIUS = 3, 42, 3
#: Fingerprints whose variants one task makes, about.
EMITTED_TOGETHER = 20_000


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of the word shingles, as a signed 64-bit integer; 0 without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and ASCII blanks only
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    count = max(1, len(tokens) - words + 1)
    starts = np.concatenate(([0], ends[: count - 1])).tolist()
    stops = (ends[len(tokens) - count :] - 1).tolist()
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, count, 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, key (the text's md5) and fp (signed long) of every row; null texts are empty. Whole texts are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [fingerprint(t or "", words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(found, pa.int64())], ["doc_id", "key", "fp"])

    read = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key().alias("key"), docs["text"].alias("text"))
    return read.mapInArrow(work, "doc_id long, key string, fp long")


def text_key() -> Column:
    """What tells texts of one id apart."""
    return F.md5(F.encode(text_of(), "UTF-8"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


#: Flips of a variant: none and one bit, which every fingerprint emits; two bits, which even ones emit too.
NEAR = [0, *(_signed(1 << i) for i in range(64))]
FAR = [_signed(1 << (base + i) | 1 << (base + j)) for base in (0, 32) for i in range(32) for j in range(i)]


def links(distinct: DataFrame, tasks: int) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) whose components are those of all pairs within RADIUS bits.

    tasks: that make the variants, of which there are hundreds for every fingerprint.
    """
    flips = F.when(F.bit_count("fp") % 2 == 0, F.lit(NEAR + FAR)).otherwise(F.lit(NEAR))
    variants = distinct.repartition(tasks).select("fp", F.posexplode(flips).alias("flip", "mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "flip")
    variants = variants.repartition("variant").sortWithinPartitions("variant")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held, masks = (none, np.zeros(0, np.int32)), np.array(NEAR + FAR, np.int64)

        def stars(variant: np.ndarray, flip: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
            size = np.diff(np.append(first, len(variant)))
            rows = np.flatnonzero(np.repeat(size > 1, size))
            variant, flip, size = variant[rows], flip[rows], size[size > 1]
            if not len(rows):
                return pa.RecordBatch.from_arrays([pa.array(none), pa.array(none)], ["a", "b"])
            near, fp = flip < len(NEAR), variant ^ masks[flip]
            center = np.minimum.reduceat(np.where(near, fp, np.iinfo(np.int64).max), np.cumsum(size) - size)
            has = np.repeat(np.logical_or.reduceat(near, np.cumsum(size) - size), size)
            center = np.repeat(center, size)
            use = has & (fp != center)
            return pa.RecordBatch.from_arrays([pa.array(fp[use]), pa.array(center[use])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]
            variant, flip = (np.concatenate(both) for both in zip(held, new, strict=True))
            cut = int(np.searchsorted(variant, variant[-1], "left"))  # the last group may go on in the next batch
            held = (variant[cut:], flip[cut:])
            if cut:
                yield stars(variant[:cut], flip[:cut])
        if len(held[0]):
            yield stars(*held)

    found = variants.mapInArrow(work, "a long, b long")
    return found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def classed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, key (of the text), fp, root (a fingerprint that names the group), component_id."""
    prints = durable(fingerprints(docs, words), "fingerprints")
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() // EMITTED_TOGETHER))
    found = components(links(classes.select("fp"), tasks)).withColumnsRenamed({"node": "fp"})
    rooted = durable(classes.join(found.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = durable(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    by_print = durable(rooted.join(least.hint("merge"), "root").select("fp", "root", "component_id"), "groups")
    return prints.join(by_print.hint("merge"), "fp")  # two plain exchanges: many copies of one fingerprint are split over tasks


def near_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows get equal results; of null ids the
    smallest is unknown and a group of nothing else has a null component_id. Extra columns are ignored. No rows give none.
    """
    return classed(docs, words).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and key (text_key) of one row of each group: the smallest doc_id's, a known one before null; ties by text."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("fp"), F.col("key")]
    ranked = classed(docs, words).withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(*order)))
    return ranked.where("place = 1").select("doc_id", "key")
