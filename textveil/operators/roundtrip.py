"""Batches through masking, a responder and restoring, with warnings, timings of each document and a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textveil.functions import dates
from textveil.operators import detectors, latency, masking, responder, restore
from textveil.sources import report

Responder = Callable[[Column], Column] | responder.Caller  # prompts to responses, or calls of a service
STAGES = ("deidentify", "response", "rehydrate", "total")


def masked(docs: DataFrame, secret: str, detector: detectors.Detector = detectors.patterns, check: bool = True, shift_days: int | None = None) -> DataFrame:
    """doc_id, source, masked, entries (ordinal, masked, original), shift, leaks (a number) for docs (doc_id, text, source).

    Columns whose names begin with an underscore are carried along.
    """
    days = F.lit(shift_days) if shift_days is not None else dates.keyed_shift(F.col("doc_id"), secret)
    carried = [c for c in docs.columns if c.startswith("_")]
    ready = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), *carried).withColumn("shift", days)
    done = masking.mask(detector(ready, "text", "spans"))
    done = masking.selfcheck(done) if check else done.withColumn("leaks", F.expr("slice(items, 1, 0)"))
    return done.select("doc_id", "source", "masked", masking.entries().alias("entries"), "shift", F.size("leaks").cast("long").alias("leaks"), *carried)


def answered(batch: DataFrame, question: str, respond: Responder = restore.dry_run) -> DataFrame:
    """batch with response: what the responder says to each masked text with the question; answer too, if it is a Caller."""
    prompt = restore.prompt("masked", F.lit(question))
    if isinstance(respond, responder.Caller):
        return respond.add(batch, prompt).withColumn("response", F.col("answer.response"))
    return batch.withColumn("response", respond(prompt))


def restored(batch: DataFrame) -> DataFrame:
    """batch with restored (the response with the originals) and warnings (its tokens that no mapping knows)."""
    return batch.withColumn("restored", restore.rehydrated()).withColumn("warnings", restore.warnings())


def run(docs: DataFrame, question: str, secret: str, respond: Responder = restore.dry_run, **options) -> DataFrame:
    """doc_id, source, masked, entries, shift, leaks, response, restored, warnings (and a Caller's answer) of every document: one projection, no shuffle."""
    return restored(answered(masked(docs, secret, **options), question, respond))


def _clock(*after: str) -> Column:
    """Nanoseconds of the executor's clock once the named columns of the row are there.

    Not deterministic, so that it is read once a row where it stands; that it looks at the columns keeps their projection
    below its own.
    """
    there = " and ".join(f"{c} is not null" for c in after) or "true"
    now = "cast(java_method('java.lang.System', 'nanoTime') as bigint)"
    return F.expr(f"if({there}, {now}, {now})")


def timed(docs: DataFrame, question: str, secret: str, respond: Responder = restore.dry_run, **options) -> DataFrame:
    """run() with timing: a struct of the seconds that each of STAGES took for the document, total being their sum.

    The clock is read before and after each stage of a row, in the task that works on it. Where a stage is a Python one,
    its rows wait for their batch, and that counts; of a Caller the seconds of the call itself are taken.
    """
    began = masked(docs.withColumn("_began", _clock()), secret, **options)
    sent = began.withColumn("_masked", _clock("masked", "entries"))
    said = answered(sent, question, respond)
    said = said.withColumn("_answered", _clock("response"))
    done = restored(said).withColumn("_restored", _clock("restored", "warnings"))
    seconds = lambda a, b: (F.col(b) - F.col(a)) / 1e9
    own = F.col("answer.seconds") if isinstance(respond, responder.Caller) else seconds("_masked", "_answered")
    parts = [seconds("_began", "_masked").alias("deidentify"), own.alias("response"), seconds("_answered", "_restored").alias("rehydrate")]
    staged = done.withColumn("timing", F.struct(*parts)).drop("_began", "_masked", "_answered", "_restored")
    return staged.withColumn("timing", F.struct("timing.*", F.expr("timing.deidentify + timing.response + timing.rehydrate").alias("total")))


def timings(results: DataFrame, *more: str) -> DataFrame:
    """doc_id, more columns, stage, seconds of the rows of timed()."""
    stacked = F.expr(f"stack({len(STAGES)}, " + ", ".join(f"'{s}', timing.{s}" for s in STAGES) + ") as (stage, seconds)")
    return results.select("doc_id", *more, stacked)


def warned(results: DataFrame) -> DataFrame:
    """docs, warned, leaks: documents, those with warnings, and spans that only the self-check found. No rows: zeros."""
    return results.agg(*counts())


def counts() -> list[Column]:
    return [F.count("*").alias("docs"), F.count_if(F.size("warnings") > 0).alias("warned"), F.coalesce(F.sum("leaks"), F.lit(0)).alias("leaks")]


def observed(results: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows of timed(), and what is counted when they are written: docs, warned, leaks and each stage's latency.

    Everything comes of the one pass that writes the rows; percentiles are exact, of as many numbers as there are documents.
    """
    seen = Observation()
    latencies = [column.alias(f"{stage}_{name}") for stage in STAGES for name, column in latency.measures(F.col(f"timing.{stage}")).items()]
    return results.observe(seen, *counts(), *latencies), seen


def summary(seen: Observation) -> list[dict]:
    """stage, n, p50, p95, mean_s, max_s of an observation; none if there were no documents."""
    got = seen.get
    return [{"stage": s} | {k: got[f"{s}_{k}"] for k in ("n", "p50", "p95", "mean_s", "max_s")} for s in STAGES] if got["docs"] else []


def transcripts(results: DataFrame) -> DataFrame:
    """doc_id and transcript: a document's masked text, response and restored response, and its warnings."""
    told = lambda title, name: F.concat(F.lit(f"**{title}**\n```\n"), F.coalesce(name, F.lit("")), F.lit("\n```\n"))
    leaks = F.when(F.col("leaks") > 0, F.concat(F.lit("The self-check found "), F.col("leaks").cast("string"), F.lit(" more.\n"))).otherwise("")
    unknown = F.when(F.size("warnings") > 0, F.concat(F.lit("**Unknown tokens:** "), F.array_join("warnings", ", "), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("### "), F.coalesce("source", F.lit("?")), F.lit("\nshift of dates: "), F.col("shift").cast("string"), F.lit(" days\n"))
    return results.select("doc_id", F.concat(head, leaks, told("Sent", "masked"), told("Response", "response"), told("Restored", "restored"), unknown).alias("transcript"))


def write_report(results: DataFrame, path: str) -> dict:
    """A report of the rows of timed() under path, in the order of doc_id, and what was counted: see sources.report.

    Documents are worked on in one pass, in which counts and latencies are observed; it leaves the transcripts under path,
    where they are put in order, since a sort by ranges looks at its rows twice.
    """
    rows, seen = observed(results)
    transcripts(rows).write.mode("overwrite").parquet(f"{path}/_rows")
    got = seen.get
    head = f"# Batch report\n\nDocuments: {got['docs']}\nWith warnings: {got['warned']}\nFound by the self-check alone: {got['leaks']}\n\n"
    report.write(results.sparkSession.read.parquet(f"{path}/_rows"), path, "doc_id", "transcript", head + latency.table(summary(seen)))
    report.remove(f"{path}/_rows")
    return got


def write_config(spark, path: str, **settings) -> None:
    """One line of JSON with a run's settings and measures; null ones are kept."""
    row = spark.createDataFrame([(1,)], "n int").select(*(F.lit(v).alias(k) for k, v in settings.items()))
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
