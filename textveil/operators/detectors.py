"""Detectors: anything that adds a column of spans (s, e, label) to documents, and how to choose among them.

The patterns are native columns. A model is a function from texts to spans, loaded once in each worker process when the
first batch asks for it; its labels may be another catalogue's. An ensemble is the patterns with a model's spans beside
them that touch none of theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from textveil.functions import spans
from textveil.functions.labels import FOREIGN

#: A model: texts to lists of (start, end, label).
Model = Callable[[list[str]], list[list[tuple[int, int, str]]]]
Detector = Callable[[DataFrame, str, str], DataFrame]  # documents, name of their text column, name of the new column


def patterns(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """The fourteen grammars. Null and empty texts have no spans."""
    return spans.with_spans(docs, text, into)


def model(load: Callable[[], Model], rename: dict[str, str] | None = None) -> Detector:
    """A detector of what load() returns. rename: labels of another catalogue to ours; those that it lacks are dropped.

    load must be importable or picklable; it runs on the executors, so weights are read there and never sent.
    """
    held: list[Model] = []

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not held:
            held.append(load())
        for texts in batches:
            every = held[0]([t or "" for t in texts])
            yield pd.Series([[{"s": s, "e": e, "label": label if rename is None else rename[label]} for s, e, label in sorted(one) if rename is None or label in rename] for one in every])

    udf = F.pandas_udf(found, spans.SPANS)
    return lambda docs, text="text", into="spans": docs.withColumn(into, udf(F.col(text)))


def foreign(load: Callable[[], Model]) -> Detector:
    """A model with a common third-party catalogue's labels."""
    return model(load, FOREIGN)


def probe(spark: SparkSession, loads: dict[str, Callable[[], Model]], tasks: int | None = None) -> DataFrame:
    """detector, tasks, missing, reason: where models can be loaded, tried in so many tasks at once (as many as the cluster has cores).

    A package or a file that is not there makes a model absent in that task; any other error is one.
    """
    n = tasks or spark.sparkContext.defaultParallelism

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            reasons: list[str | None] = []
            for load in loads.values():
                try:
                    load()
                    reasons.append(None)
                except (ImportError, OSError) as error:
                    reasons.append(f"{type(error).__name__}: {error}")
            yield pd.DataFrame({"detector": list(loads), "reason": pd.Series(reasons, dtype=object)})

    every = spark.range(0, n, 1, n).mapInPandas(tried, "detector string, reason string")
    return every.groupBy("detector").agg(F.count("*").alias("tasks"), F.count("reason").alias("missing"), F.min("reason").alias("reason"))


def present(spark: SparkSession, loads: dict[str, Callable[[], Model]], rename: dict[str, str] | None = None) -> tuple[dict[str, Detector], list[Row]]:
    """Detectors of the models that every task of probe() could load, and the rows of those that are left out, with the reason."""
    rows = probe(spark, loads).collect() if loads else []  # a row for each model
    absent = sorted((r for r in rows if r.missing), key=lambda r: r.detector)
    return {name: model(load, rename) for name, load in loads.items() if name not in {r.detector for r in absent}}, absent


def ensemble(second: Detector, first: Detector = patterns) -> Detector:
    """The first detector's spans, and those of the second that touch neither these nor each other."""

    def both(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
        staged = second(first(docs, text, "_first"), text, "_second")
        return staged.withColumn(into, spans.ensemble("_first", "_second")).drop("_first", "_second")

    return both


def select(detector: Detector | None = None, load: Callable[[], Model] | None = None) -> Detector:
    """The detector given, else an ensemble with the model that load() returns, else the patterns alone."""
    if detector is not None:
        return detector
    return ensemble(model(load)) if load is not None else patterns
