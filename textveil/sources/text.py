"""Whole-text files, sample and gold documents, and batches with default source names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textveil.functions import spans

SAMPLE = "Nurse Ida Corso found MRN-731605 on the desk on 7/29/1994 and filed it on October 6, 2021. Dial (555) 846-0933. It had lain there for 3 weeks."
QUESTION = "Which entries need an answer?"
#: Hand-marked texts: parts in order, with labels.
GOLD = [
    ("ward letter", "Dr. Hale saw Ana Duval on 04/02/2023 in Nordheim; plan 61-7720-345.", [("Hale", "NAME"), ("Ana Duval", "NAME"), ("04/02/2023", "DATE"), ("Nordheim", "LOCATION"), ("61-7720-345", "HEALTHPLAN")]),
    ("run sheet", "EMS-2019-7712 left at noon on 5/6/2022, Hale driving, Hale signing.", [("EMS-2019-7712", "ID_OTHER"), ("5/6/2022", "DATE"), ("Hale", "NAME"), ("Hale", "NAME")]),
    ("front desk", "Account OR-17-9034-208, PCG-660917, age 93, fax 555-846-0934.", [("OR-17-9034-208", "ACCOUNT"), ("PCG-660917", "MRN"), ("93", "AGE"), ("555-846-0934", "FAX")]),
    ("no one", "Pulse 72, pressure 120/80, next visit in 3 weeks.", []),
]


def read(spark: SparkSession, path: str) -> DataFrame:
    """text and source of every file under path, a file a document."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("source"))


def sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, SAMPLE, QUESTION)], "doc_id long, text string, question string")


def gold(spark: SparkSession) -> DataFrame:
    """doc_id, source, text, entities (spans, located from the marked parts)."""
    rows = [(n, source, text, [{"part": p, "label": label} for p, label in parts]) for n, (source, text, parts) in enumerate(GOLD, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, wanted array<struct<part: string, label: string>>")
    return docs.select("doc_id", "source", "text", spans.locate("text", "wanted").alias("entities"))


def _below(key: str, cuts: list, before: int = 0) -> Column:
    """How many of some sorted values are below a column's, by halves: an array of them would be looked through for each row."""
    if not cuts:
        return F.lit(before)
    half = len(cuts) // 2
    return F.when(F.col(key) > F.lit(cuts[half]), _below(key, cuts[half + 1 :], before + half + 1)).otherwise(_below(key, cuts[:half], before))


def placed(docs: DataFrame, key: str = "doc_id", ranges: int = 200) -> DataFrame:
    """docs with place, each row's number from 0 in the order of key (unique; null first), without one task for all rows.

    Rows are dealt to ranges of the key by its approximate quantiles, ranges are counted, and a row's place is its rank in
    its range behind the counts of those before. Only the ranges' bounds and counts reach the driver.
    """
    cuts = docs.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)]).alias("cuts")).first().cuts or []
    dealt = docs.withColumn("_range", _below(key, sorted(set(cuts))))
    dealt = dealt.withColumn("_range", F.when(F.isnull(key), -1).otherwise(F.col("_range")))
    before, total = {}, 0
    for number, count in sorted(map(tuple, dealt.groupBy("_range").count().collect())):  # a row for each range
        before[number], total = total, total + count
    starts = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return dealt.withColumn("place", (rank + F.element_at(starts, F.col("_range"))).cast("long")).drop("_range")


def named(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with example_<i> for missing sources, i being the row's place in the batch, in the order of key from 0."""
    return placed(docs, key).withColumn("source", F.coalesce("source", F.concat(F.lit("example_"), F.col("place").cast("string")))).drop("place")
