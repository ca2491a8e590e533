"""Latency summaries and the best epoch of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measures(value: Column) -> dict[str, Column]:
    """n, p50, p95, mean_s, max_s of some seconds; percentiles are exact and interpolated."""
    value = value.cast("double")
    return {
        "n": F.count(value), "p50": F.coalesce(F.percentile(value, 0.5), F.lit(0.0)), "p95": F.coalesce(F.percentile(value, 0.95), F.lit(0.0)),
        "mean_s": F.avg(value), "max_s": F.max(value),
    }


def summary(timings: DataFrame, stage: str = "stage", seconds: str = "seconds", *more: Column) -> DataFrame:
    """stage, n, p50, p95, mean_s, max_s, and more aggregates. No rows give no rows.

    Both percentiles come of one list of a stage's different values, which an exact percentile needs.
    """
    own = measures(F.col(seconds))
    both = F.percentile(F.col(seconds).cast("double"), [0.5, 0.95])
    every = timings.groupBy(F.col(stage).alias("stage")).agg(*(own[n].alias(n) for n in ("n", "mean_s", "max_s")), both.alias("_both"), *more)
    found = {f"p{p}": F.coalesce(F.col("_both")[k], F.lit(0.0)).alias(f"p{p}") for k, p in enumerate((50, 95))}
    return every.select("stage", "n", found["p50"], found["p95"], "mean_s", "max_s", *(c for c in every.columns if c not in ("stage", "n", "mean_s", "max_s", "_both")))


def table(rows: list[dict]) -> str:
    """Markdown of a summary, which has a row for each stage."""
    lines = ["| stage | n | p50 | p95 | mean | max |", "| --- | --- | --- | --- | --- | --- |"]
    lines += [f"| {r['stage']} | {r['n']} | {r['p50']:.3f} | {r['p95']:.3f} | {r['mean_s']:.3f} | {r['max_s']:.3f} |" for r in rows]
    return "\n".join(lines) + "\n"


def best_epoch(log: DataFrame) -> DataFrame:
    """epoch and recall of the first row with the highest recall."""
    return log.agg(F.min_by(F.struct("epoch", "recall"), F.struct(-F.col("recall"), F.col("ord"))).alias("best")).select("best.*")
