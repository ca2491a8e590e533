"""Exact duplicates by distributed most-significant-byte-first radix partitioning.

The key of a document is its text without ASCII white space, as UTF-8 bytes. A level splits every open group by the next
slice of bytes; a group that a slice leaves with one member is settled as unique, a group whose slice ends before the
level's width is settled as equal (its members agree in every byte and in their end), and the rest goes to the next level
with a wider slice. Only equality of bytes decides; no digest takes part. Slices are counted before the shuffle, so a
group of copies costs one row per task there, and adaptive execution splits its rows in the join that labels them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import SPACE, durable, text_of

#: Bytes of the first slice, and how many times wider each next slice is.
FIRST_WIDTH, WIDENING = 32, 32


def exact_groups(docs: DataFrame, first_width: int = FIRST_WIDTH, widening: int = WIDENING) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest doc_id (null last). Null texts count as
    empty. A repeated row (same doc_id and text) counts in group_size; of equal rows with equal doc_id all carry
    kept = true, since the rows can't be told apart. Extra columns of docs are ignored. No rows give no rows.
    """
    text = text_of()
    rows = docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.encode(F.regexp_replace(text, SPACE + "+", ""), "UTF-8").alias("body"))
    active = rows.select("*", F.lit(0).cast("long").alias("gid"))
    settled, offset, width, level = [], 0, first_width, 0
    while True:
        keyed = active.withColumn("piece", F.substring("body", offset + 1, width))
        repeated = keyed.groupBy("gid", "piece").count().where("count > 1").select("gid", "piece", F.monotonically_increasing_id().alias("next"))
        repeated = durable(repeated, f"radix-groups-{level}")
        ended = F.octet_length("piece") < width
        labelled = keyed.join(repeated.hint("merge"), ["gid", "piece"], "left")  # of unknown size: never broadcast
        open_ = F.col("next").isNotNull() & ~ended
        level_rows = durable(
            labelled.select(
                "doc_id", "n_chars", F.when(open_, F.lit(None)).otherwise(F.sha2("body", 256)).alias("text_sha256"),
                F.when(open_, F.col("body")).alias("body"), F.col("next").alias("gid"), open_.alias("open"), F.lit(level).alias("level"),
            ),
            f"radix-rows-{level}",
        )
        settled.append(level_rows.where("not open").drop("body", "open"))
        active = level_rows.where("open").select("doc_id", "n_chars", "body", "gid")
        if active.isEmpty():
            break
        offset, width, level = offset + width, width * widening, level + 1
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    # Unique rows pass by; groups and their rows meet as two plain exchanges, which adaptive execution splits where one is hot.
    alone = done.where("gid is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    grouped = done.where("gid is not null")
    best = F.min(F.struct((-F.col("n_chars")).alias("size"), F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("keep_id")))
    classes = durable(grouped.groupBy("level", "gid").agg(F.count("*").alias("group_size"), best.alias("best")), "radix-classes")
    out = grouped.join(classes.hint("merge"), ["level", "gid"])
    keep = F.col("best.keep_id")
    return alone.unionByName(out.select("doc_id", keep.alias("keep_id"), "group_size", keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256"))
