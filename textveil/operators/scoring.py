"""Exact-span scores. Predictions and gold are tables of key columns, doc_id, s, e, label; keys such as detector come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.spans import SPANS

PLACE = ["doc_id", "s", "e", "label"]


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def verdicts(predicted: DataFrame, gold: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, doc_id, s, e, label, kind (tp, fp, fn). Spans that are listed twice count once; a wrong label is fp and fn.

    gold has the same key columns as predicted (cross-join it with the detectors beforehand).
    """
    on = [*keys, *PLACE]
    one = predicted.select(*on).withColumn("p", F.lit(1)).unionByName(gold.select(*on).withColumn("p", F.lit(2)))
    kind = F.when(F.col("both") == 3, "tp").when(F.col("both") == 1, "fp").otherwise("fn")
    return one.groupBy(*on).agg(F.bit_or("p").alias("both")).select(*on, kind.alias("kind"))


def measures(tp: Column, fp: Column, fn: Column) -> list[Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = ratio(2 * precision * recall, precision + recall)
    return [x.alias(n) for x, n in ((tp, "tp"), (fp, "fp"), (fn, "fn"), (precision, "p"), (recall, "r"), (f1, "f1"))]


def overall(found: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, tp, fp, fn, p, r, f1 over all documents."""
    counted = found.groupBy(*keys).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")))
    return counted.select(*keys, *measures(F.col("tp"), F.col("fp"), F.col("fn")))


def per_label(found: DataFrame, keys: tuple[str, ...] = (), across_docs: bool = True) -> DataFrame:
    """keys, label, tp, fp, fn, p, r, f1, support. across_docs: equal places in several documents count once."""
    place = F.struct("s", "e") if across_docs else F.struct("doc_id", "s", "e")
    counted = found.groupBy(*keys, "label").agg(*(F.count_distinct(F.when(F.col("kind") == k, place)).alias(k) for k in ("tp", "fp", "fn")))
    return counted.select(*keys, "label", *measures(F.col("tp"), F.col("fp"), F.col("fn")), (F.col("tp") + F.col("fn")).alias("support"))


def report(docs: DataFrame, keys: tuple[str, ...], found: str = "found", gold: str = "gold") -> DataFrame:
    """keys, tp, fp, fn, p, r, f1, docs, leaking, leak_rate of documents that hold both their arrays of spans, in one pass.

    Spans that are listed twice count once, null arrays are empty; every key that has a document has a row.
    """
    p, g = (F.expr(f"array_distinct(coalesce({c}, cast(array() as {SPANS})))") for c in (found, gold))
    sizes = docs.select(*keys, F.size(F.array_intersect(p, g)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn"))
    counted = sizes.groupBy(*keys).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")), F.count("*").alias("docs"), F.count_if(F.col("fn") > 0).alias("leaking"))
    return counted.select(*keys, *measures(F.col("tp"), F.col("fp"), F.col("fn")), "docs", "leaking", ratio(F.col("leaking"), F.col("docs")).alias("leak_rate"))


def leak_rate(found: DataFrame, docs: DataFrame) -> DataFrame:
    """docs, leaking, leak_rate: documents with a missed span among all; 0 of none."""
    missed = found.where("kind = 'fn'").select("doc_id").distinct().withColumn("leak", F.lit(1))
    joined = docs.select("doc_id").join(missed, "doc_id", "left")
    return joined.agg(F.count("*").alias("docs"), F.count("leak").alias("leaking")).select("*", ratio(F.col("leaking"), F.col("docs")).alias("leak_rate"))


def missed(found: DataFrame, docs: DataFrame, limit: int = 8) -> DataFrame:
    """A report of the first missed spans, with their text and source."""
    joined = found.where("kind = 'fn'").join(docs.select("doc_id", "text", "source"), "doc_id")
    part = F.expr("substring(text, s + 1, e - s)").alias("part")
    return joined.select("doc_id", "s", "e", "label", part, F.coalesce("source", F.lit("synthetic")).alias("source")).orderBy("doc_id", "s", "e", "label").limit(limit)
