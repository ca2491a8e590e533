"""A tagger of BIO labels: a weighted softmax over hashed features, fitted on the cluster, decoded by Viterbi.

Each epoch every task sums the gradient of its documents at the broadcast weights; the sums, whose size is fixed by CELLS,
meet in groups on executors and then, a few of them, on the driver, which takes one step. Missed identifiers weigh more:
the loss is that of bio.weighted_loss. The epoch with the best recall of spans on held-out documents is kept. Weights travel
as one file with a digest, which every worker checks before it uses them.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.functions import spans
from textveil.functions.labels import DEFAULT_WEIGHT, TAG_IDS, TAGS, WEIGHTS
from textveil.operators import detectors, latency, scoring

WORD = re.compile(r"\w+|[^\w\s]")
#: Cells of the hashed features; documents fitted on at most (the first by a hash of their ids); epochs; the step's size;
#: gradients that meet in a group.
CELLS, FITTED, EPOCHS, STEP, MET = 1 << 14, 4000, 12, 0.5, 16
WEIGHT = np.array([1.0 if t == "O" else WEIGHTS.get(t[2:], DEFAULT_WEIGHT) for t in TAGS])
#: Texts that are tagged together.
TOGETHER = 256
#: What may follow what: an inner tag only its own beginning or inside.
_LABEL = [t[2:] for t in TAGS]
FOLLOWS = np.array([[0.0 if b[0] != "I" or (a != "O" and _LABEL[i] == _LABEL[j]) else -np.inf for j, b in enumerate(TAGS)] for i, a in enumerate(TAGS)])


def shape(word: str) -> str:
    """Kinds of a word's letters, runs of one kind written twice at most."""
    return re.sub(r"(.)\1+", r"\1\1", "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word))


@lru_cache(1 << 15)
def _cell(told: str) -> int:
    return zlib.crc32(told.encode(errors="surrogatepass")) % CELLS


@lru_cache(1 << 15)
def _own(word: str) -> tuple:
    """A word in lower case, its shape, and the cells of the features that look at it alone."""
    low, form = word.lower(), shape(word)
    return low, form, *(_cell(x) for x in (f"w{low}", f"s{form}", f"p{low[:3]}", f"e{low[-3:]}", f"n{min(len(word), 12)}{form[0]}", f"b{low}", f"a{low}"))


def features(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Places of a text's words and signs, and the cells of each one's features."""
    found = [(m.start(), m.end()) for m in WORD.finditer(text)]
    every = [_own(w) for w in ("^", "^", *(text[a:b] for a, b in found), "$", "$")]
    rows, bias = [], _cell("")
    for k in range(2, len(every) - 2):
        (low2, form2, *_), (low1, form1, *_, before, _), (_, form, w, s, p, e, n, _, _), (_, then, *_, after) = every[k - 2 : k + 2]
        pair = _cell(f"c{form1}|{form}"), _cell(f"d{form}|{then}"), _cell(f"f{low2}|{low1}"), _cell(f"g{form2}|{low1}|{form}")
        rows.append((bias, w, s, p, e, n, before, after, *pair))
    return found, np.array(rows, np.int32).reshape(len(rows), 12)


def tags(found: list[tuple[int, int]], marked: list[dict]) -> np.ndarray:
    """Tag ids of words from spans; the later of two spans on a word wins."""
    out = np.zeros(len(found), np.int64)
    for span in marked:
        inside = [k for k, (a, b) in enumerate(found) if a < span["e"] and span["s"] < b]
        for n, k in enumerate(inside):
            out[k] = TAG_IDS[("B-" if n == 0 else "I-") + span["label"]]
    return out


def viterbi(logits: np.ndarray) -> np.ndarray:
    """The best allowed sequence of tag ids."""
    best, back = logits[0] + FOLLOWS[0], []
    for row in logits[1:]:
        every = best[:, None] + FOLLOWS
        back.append(every.argmax(0))
        best = every.max(0) + row
    out = [int(best.argmax())]
    for row in reversed(back):
        out.append(int(row[out[-1]]))
    return np.array(out[::-1])


def best_tags(logits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """viterbi() of many texts, step by step together: sizes are their numbers of words, whose logits follow each other.

    Only an inside has few tags before it; all others follow the best of all.
    """
    order = np.argsort(-sizes, kind="stable")
    long, first = sizes[order], (np.cumsum(sizes) - sizes)[order]
    out, backs = np.zeros(len(logits), np.int64), []
    there = int((long > 0).sum())
    best = logits[first[:there]] + FOLLOWS[0]
    rows, outer, inner = np.arange(there), np.arange(1, len(TAGS), 2), np.arange(2, len(TAGS), 2)
    for t in range(1, int(long.max(initial=0))):
        n = int(np.searchsorted(-long, -t, "left"))
        held, top = best[:n], best[:n].argmax(1)
        back = np.repeat(top[:, None], len(TAGS), 1)
        back[:, inner] = np.where(held[:, outer] >= held[:, inner], outer, inner)
        step = np.repeat(held[rows[:n], top][:, None], len(TAGS), 1)
        step[:, inner] = np.maximum(held[:, outer], held[:, inner])
        best[:n] = step + logits[first[:n] + t]
        backs.append(back.astype(np.int8))
    now = best.argmax(1)
    for t in range(len(backs), 0, -1):
        n = len(backs[t - 1])
        out[first[:n] + t] = now[:n]
        now[:n] = backs[t - 1][rows[:n], now[:n]]
    out[first[:there]] = now
    return out


def decoded(found: list[tuple[int, int]], ids: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of a sequence of tags."""
    out: list[tuple[int, int, str]] = []
    for (a, b), k in zip(found, ids.tolist(), strict=True):
        if TAGS[k][0] == "B":
            out.append((a, b, TAGS[k][2:]))
        elif TAGS[k][0] == "I":
            out[-1] = (out[-1][0], b, out[-1][2])
    return out


@dataclass
class Model:
    """Weights by cell and tag; a function from texts to spans."""

    weights: np.ndarray

    def logits(self, cells: np.ndarray) -> np.ndarray:
        return self.weights[cells].sum(1)

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        out = []
        for at in range(0, len(texts), TOGETHER):
            some = [features(text) for text in texts[at : at + TOGETHER]]
            sizes = np.array([len(found) for found, _ in some])
            cells = np.concatenate([c for _, c in some])
            # a long text's logits are made bit by bit: those of a word take 3 KB on the way
            logits = np.concatenate([self.logits(cells[a : a + 2000]) for a in range(0, max(len(cells), 1), 2000)])
            ids = np.split(best_tags(logits, sizes), np.cumsum(sizes)[:-1])
            out += [decoded(found, own) for (found, _), own in zip(some, ids, strict=True)]
        return out

    def save(self, path: str) -> str:
        """Write the weights; their sha256."""
        held = io.BytesIO()
        np.save(held, self.weights.astype(np.float32))
        Path(path).write_bytes(held.getvalue())
        return hashlib.sha256(held.getvalue()).hexdigest()


def source(spark: SparkSession, path: str | None, sha256: str | None = None) -> detectors.Detector:
    """A detector of saved weights beside the patterns; without a file at path the patterns alone.

    The file is sent to every executor; a worker whose copy has another digest fails instead of finding less.
    """
    if path is None or not os.path.exists(path):
        return detectors.patterns
    wanted, name = sha256 or hashlib.sha256(Path(path).read_bytes()).hexdigest(), os.path.basename(path)
    spark.sparkContext.addFile(path)

    def load() -> Model:
        data = Path(SparkFiles.get(name)).read_bytes()
        if hashlib.sha256(data).hexdigest() != wanted:
            raise ValueError(f"{name} is not the file that was named")
        return Model(np.load(io.BytesIO(data)).astype(np.float64))

    return detectors.ensemble(detectors.model(load))


def _prepared(docs: DataFrame, gold: str) -> DataFrame:
    """cells and tags (packed numbers) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, marked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, cells = features(text or "")
                rows.append((cells.tobytes(), tags(found, marked or []).astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], names=["cells", "tags"])

    return docs.select("text", F.col(gold).alias("gold")).mapInArrow(run, "cells binary, tags binary")


def gradient(cells: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float, float]:
    """The summed gradient of the weighted loss, the loss, and the sum of weights."""
    logits = weights[cells].sum(1)
    logits -= logits.max(1, keepdims=True)
    chances = np.exp(logits)
    chances /= chances.sum(1, keepdims=True)
    each, own = WEIGHT[ids], chances[np.arange(len(ids)), ids]
    chances[np.arange(len(ids)), ids] -= 1
    chances *= each[:, None]
    flat = np.stack([np.bincount(cells.ravel(), np.repeat(chances[:, k], cells.shape[1]), CELLS) for k in range(len(TAGS))], 1)
    return flat, float(-(each * np.log(np.maximum(own, 1e-300))).sum()), float(each.sum())


def _summed(ready: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float, float]:
    """The gradient over all documents: a sum a task, sums of MET tasks on executors, and the rest on the driver."""
    spark = ready.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    names = ["part", "flat", "loss", "weight"]

    def pack(part: int, held: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([held[0].astype(np.float32).tobytes()], pa.binary()), pa.array([held[1]]), pa.array([held[2]])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        flat, loss, weight = np.zeros_like(shared.value), 0.0, 0.0
        for batch in batches:
            cells = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).reshape(-1, 12)
            ids = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32)
            for a in range(0, len(ids), 20_000):
                more = gradient(cells[a : a + 20_000], ids[a : a + 20_000], shared.value)
                flat, loss, weight = flat + more[0], loss + more[1], weight + more[2]
        if weight:
            yield pack(TaskContext.get().partitionId() // MET, (flat, loss, weight))

    def meet(table: pa.Table) -> pa.Table:
        flat = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("flat").to_pylist())
        return pa.Table.from_batches([pack(table.column("part")[0].as_py(), (flat, sum(table.column("loss").to_pylist()), sum(table.column("weight").to_pylist())))])

    fields = "part int, flat binary, loss double, weight double"
    met = ready.mapInArrow(run, fields).groupBy("part").applyInArrow(meet, fields).toLocalIterator()
    flat, loss, weight = np.zeros_like(weights), 0.0, 0.0
    for row in met:
        flat += np.frombuffer(row["flat"], np.float32).reshape(flat.shape)
        loss, weight = loss + row["loss"], weight + row["weight"]
    shared.unpersist()
    return flat, loss, weight


def fit(docs: DataFrame, held_out: DataFrame, gold: str = "gold", epochs: int = EPOCHS, fitted: int = FITTED, step: float = STEP) -> tuple[Model, DataFrame]:
    """The tagger of the epoch with the best recall on held_out, and the log: ord, epoch, loss, p, recall, f1.

    docs and held_out: doc_id, text and the array of spans. At most `fitted` documents are learnt from, the first by a
    hash of doc_id. Null texts teach nothing; without documents all is O.
    """
    spark = docs.sparkSession
    chosen = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitted)
    ready = _prepared(chosen.repartition(spark.sparkContext.defaultParallelism), gold).persist()
    weights, power = np.zeros((CELLS, len(TAGS))), np.full((CELLS, len(TAGS)), 1e-8)
    held_out = held_out.select("doc_id", "text", gold).persist()  # every epoch looks at it
    kept, log = [], []
    for turn in range(epochs):
        flat, loss, total = _summed(ready, weights)
        if not total:
            break
        flat /= total
        power += flat * flat
        weights = weights - step * flat / np.sqrt(power)
        kept.append(weights)
        found = scores(held_out, detector(Model(weights)), gold).first()
        log.append((turn, float(turn + 1), loss / total, found["p"], found["r"], found["f1"]))
    ready.unpersist()
    held_out.unpersist()
    frame = spark.createDataFrame(log, "ord int, epoch double, loss double, p double, recall double, f1 double")
    best = latency.best_epoch(frame).first() if log else None
    return Model(kept[int(best["epoch"]) - 1] if log else weights), frame


def detector(model: Model) -> detectors.Detector:
    """The tagger alone; its weights, of a fixed size, go with the plan."""
    return detectors.model(lambda: model)


def scores(docs: DataFrame, found: detectors.Detector, gold: str = "gold", label: str | None = None) -> DataFrame:
    """tp, fp, fn, p, r, f1 of a detector's spans against gold ones; label: of these only."""
    rows = found(docs.select("doc_id", "text", F.col(gold).alias("gold")), "text", "spans")
    both = rows.select("doc_id", F.expr("array_distinct(spans)").alias("found"), F.expr(f"coalesce(array_distinct(gold), cast(array() as {spans.SPANS}))").alias("gold"))
    kinds = """concat(transform(found, x -> named_struct('label', x.label, 'kind', if(exists(gold, g -> g = x), 'tp', 'fp'))),
        transform(filter(gold, g -> not exists(found, x -> x = g)), x -> named_struct('label', x.label, 'kind', 'fn')))"""
    listed = both.select(F.inline_outer(F.expr(kinds))).where("label is not null")
    return scoring.overall(listed if label is None else listed.where(F.col("label") == label))
