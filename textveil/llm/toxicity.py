"""Toxicity from two class-conditional Kneser-Ney models over letters.

Texts are read as 26 letters and blanks: accents are dropped, and letters of other scripts than Latin are dealt to the 26 by
their code, so that every script has sequences of its own. Each class has its own counts of five-symbol sequences, which
run across words; below the full order both share one backoff chain of continuation counts pooled over the classes, so an
expression rare in either class gets the same smoothed estimate there. A document's evidence is the difference of its
length-normalised log-likelihoods under the toxic and the ordinary model, over the whole text and, so that a long text does
not hide one, at its strongest passage; a logistic link fitted on labelled documents kept out of the counts turns both into
a score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import crc_mod, durable

SYMBOLS, ORDER, DISCOUNT = 27, 5, 0.75
#: Bounds of the labelled sample: rows of each class, chosen by a hash of the id; of these a fifth sets the link.
TOXIC_ROWS, ORDINARY_ROWS, LINK_SHARE = 5_000, 10_000, 5
#: Symbols of the passage whose evidence counts on its own.
PASSAGE = 16


@lru_cache(maxsize=1)
def fold() -> np.ndarray:
    """Symbol of each code point: 1 to 26 for letters, 0 for all else. Marks of scripts that write vowels so are letters."""
    table = np.zeros(0x110000, dtype=np.int32)
    for code in range(0x250):
        base = unicodedata.normalize("NFD", chr(code).lower())[0]
        if "a" <= base <= "z":
            table[code] = ord(base) - ord("a") + 1
    table[ord("ß")] = ord("s") - ord("a") + 1
    for code in range(0x250, len(table)):
        char = chr(code)
        if char.isalpha() or 0x900 <= code < 0x3000 and unicodedata.category(char)[0] == "M":
            table[code] = 1 + ord(char.lower()[0]) % 26
    return table


def sequences(text: str) -> np.ndarray:
    """Codes of the five-symbol sequences that end at each letter and at the blank after each word.

    The four symbols before go back over word ends to the start of the text, with blanks before it; runs of blanks are one.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    symbols = np.concatenate((np.zeros(1, np.int32), fold()[code], np.zeros(1, np.int32)))
    keep = symbols != 0
    keep[1:] |= keep[:-1]
    keep[0] = True
    symbols = symbols[keep]
    count = len(symbols) - 1
    padded, out = np.concatenate((np.zeros(ORDER - 2, np.int32), symbols)), np.zeros(max(0, count), np.int32)
    for back in range(ORDER):  # the symbol itself is the lowest digit
        out += padded[ORDER - 1 - back : ORDER - 1 - back + count] * SYMBOLS**back
    return out


def backoff(counts: np.ndarray) -> np.ndarray:
    """Shared probabilities of a symbol after three, from which of all sequences occur (pooled over the classes)."""
    return shared_backoff((counts > 0).reshape(SYMBOLS, -1).sum(0, dtype=np.float64))


def shared_backoff(kinds: np.ndarray) -> np.ndarray:
    """The same from how many symbols come before each sequence of four."""
    levels = []
    while kinds.size >= SYMBOLS:
        levels.append(kinds)
        kinds = (kinds > 0).reshape(SYMBOLS, -1).sum(0, dtype=np.float64)
    lower = np.full(1, 1.0 / SYMBOLS)
    for kinds in reversed(levels):
        table = kinds.reshape(-1, SYMBOLS)
        total, successors = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
        below = np.broadcast_to(np.tile(lower, len(table) * SYMBOLS // lower.size).reshape(-1, SYMBOLS) if lower.size > 1 else lower, table.shape)
        with np.errstate(invalid="ignore", divide="ignore"):
            mixed = (np.maximum(table - DISCOUNT, 0) + DISCOUNT * successors * below) / total
        lower = np.where(total > 0, mixed, below).reshape(-1)
    return lower


def log_ratios(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log P(symbol | four before, toxic) - the same for ordinary, for every sequence; half precision."""
    lower = backoff(toxic + ordinary)
    out = np.zeros(SYMBOLS**ORDER, dtype=np.float16)
    for at in range(0, len(out), len(lower)):
        part = slice(at, at + len(lower))
        out[part] = slab_ratios(toxic[part], ordinary[part], lower)
    return out


def slab_ratios(toxic: np.ndarray, ordinary: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The ratios of the sequences with one first symbol."""
    logs, lower = [], lower.reshape(-1, SYMBOLS)
    for counts in (toxic, ordinary):
        table = counts.reshape(-1, SYMBOLS).astype(np.float64)
        total, successors = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            mixed = (np.maximum(table - DISCOUNT, 0) + DISCOUNT * successors * lower) / total
        logs.append(np.log(np.where(total > 0, mixed, lower)))
    return (logs[0] - logs[1]).reshape(-1)


def evidence(text: str, ratios: np.ndarray) -> tuple[float, float]:
    """Mean log ratio of the whole text and of its strongest passage; zeros without letters."""
    codes = sequences(text)
    if not len(codes):
        return 0.0, 0.0
    run = np.concatenate(([0.0], np.cumsum(ratios[codes].astype(np.float64))))
    width = min(PASSAGE, len(codes))
    return float(run[-1] / len(codes)), float((run[width:] - run[:-width]).max() / PASSAGE)


@dataclass
class Model:
    ratios: np.ndarray
    link: np.ndarray  # bias, weight of the whole text, weight of the passage

    def score(self, text: str) -> float:
        mean, most = evidence(text, self.ratios)
        return float(1 / (1 + np.exp(-np.clip(self.link @ (1.0, 100 * mean, 10 * most), -40, 40))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridged logistic regression by Newton steps; x has a leading column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Fit on labelled rows (doc_id, toxic) whose crc32(doc_id) mod 5 is not 0, at most so many of each class.

    The chosen ids are broadcast (bounded by the parameters); counting runs in tasks over whole texts, and so do the ratios;
    what comes back is a bit and a ratio of each sequence, whatever the input. Null labels and ids are left out; of several labels of one id the
    toxic one holds, and each row of a repeated id is counted. Without both classes every score is the prior.
    """
    usable = labels.where("toxic is not null and doc_id is not null").where(crc_mod("doc_id", 5) != 0)
    usable = usable.groupBy("doc_id").agg(F.max((F.col("toxic").cast("int") > 0).cast("int")).alias("toxic"))
    drawn = F.xxhash64("doc_id", F.lit("toxicity sample"))
    chosen = [usable.where(F.col("toxic") == k).orderBy(drawn, "doc_id").limit(n) for k, n in ((1, toxic_rows), (0, ordinary_rows))]
    chosen_ids = chosen[0].unionByName(chosen[1]).withColumn("link", F.pmod(F.xxhash64("doc_id", F.lit("link")), F.lit(LINK_SHARE)) == 0)
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen_ids), "doc_id")  # bounded by the two row limits
    slab = SYMBOLS ** (ORDER - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.array(batch.column("toxic").to_pylist(), dtype=int)
            texts = batch.column("text").to_pylist()
            for kind in (0, 1):
                for at in range(0, len(texts), 1000):
                    codes = [sequences(texts[k]) for k in range(at, min(at + 1000, len(texts))) if kinds[k] == kind]
                    code, n = np.unique(np.concatenate([np.zeros(0, np.int32), *codes]), return_counts=True)
                    edges = np.searchsorted(code, slab * np.arange(SYMBOLS + 1))
                    used = np.flatnonzero(np.diff(edges))
                    packed = [[x[edges[k] : edges[k + 1]].tobytes() for k in used.tolist()] for x in (code.astype("<i4"), n.astype("<i4"))]
                    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([kind] * len(used), pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["first", "toxic", "codes", "counts"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = -1, np.zeros((2, slab), np.int64)

        def row() -> pa.RecordBatch:
            used = np.flatnonzero(held.any(0)).astype("<i4")
            data = np.minimum(held[:, used], np.iinfo(np.int32).max).astype("<i4")
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (used, data))], ["first", "codes", "counts"])

        for batch in batches:
            for first, toxic, codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first != last:
                    if last >= 0:
                        yield row()
                    last, held[:] = first, 0
                held[toxic, np.frombuffer(codes, "<i4") % slab] += np.frombuffer(counts, "<i4")
        if last >= 0:
            yield row()

    packed = sample.where("not link").select("toxic", "text").mapInArrow(count, "first int, toxic int, codes binary, counts binary")
    # the counts stay in tasks: the driver gets a bit for each sequence, which makes the backoff, and then the ratios
    united = durable(packed.repartition("first").sortWithinPartitions("first").mapInArrow(unite, "first int, codes binary, counts binary"), "toxicity")

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes in batch.column("codes").to_pylist():
                bits = np.zeros(slab, bool)
                bits[np.frombuffer(codes, "<i4")] = True
                yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    kinds = np.zeros(slab)
    for bits in united.select("codes").mapInArrow(occurring, "bits binary").toArrow().column("bits"):  # a bit for each of 27^5 sequences
        kinds += np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=slab)
    lower = docs.sparkSession.sparkContext.broadcast(shared_backoff(kinds))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = np.zeros((2, slab), np.int32)
                table[:, np.frombuffer(codes, "<i4")] = np.frombuffer(counts, "<i4").reshape(2, -1)
                data = slab_ratios(table[1], table[0], lower.value).astype("<f2").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([data], pa.binary())], ["first", "ratios"])

    ratios = np.zeros((SYMBOLS, slab), dtype=np.float16)
    told = united.mapInArrow(compare, "first int, ratios binary").toArrow()  # 27 rows of a megabyte, whatever the input
    for first, data in zip(told.column("first").to_pylist(), told.column("ratios"), strict=True):
        ratios[first] = np.frombuffer(data.as_buffer(), "<f2")
    del told
    lower.destroy()
    ratios = ratios.reshape(-1)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [evidence(t, shared.value) for t in batch.column("text").to_pylist()]
            columns = [batch.column("toxic"), *(pa.array([x[k] for x in both], pa.float64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "mean", "most"])

    held = sample.where("link").select("toxic", "text").mapInArrow(weigh, "toxic int, mean double, most double").toArrow()
    shared.destroy()
    y, mean, most = (held.column(c).to_numpy().astype(float) for c in ("toxic", "mean", "most"))
    return Model(ratios, logistic(np.column_stack((np.ones(len(y)), 100 * mean, 10 * most)), y) if len(y) else np.zeros(3))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for every row; null texts are empty, texts without letters have no evidence.

    Repeated rows get equal scores; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [shared.value.score(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(work, "doc_id long, score double")
