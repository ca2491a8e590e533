"""Language identification by a blended-spectrum string kernel.

k(x, y) is the share of n-grams (1 to 4 characters, lower-cased, digits and marks dropped, blanks as word ends) present in
both texts: |G(x) and G(y)| / sqrt(|G(x)| |G(y)|), with n-grams hashed into a fixed number of cells. A Nyström map over
landmark texts turns the kernel into features, ridge regression on them gives one scorer a language (one against the
rest), and whole batches are scored by two matrix products: presence x landmarks, then features x weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.llm.common import crc_mod

#: Cells of the hashed n-gram space, longest n-gram, landmark texts, ridge penalty.
CELLS, LONGEST, LANDMARKS, RIDGE = 8192, 4, 160, 1e-2
#: Bounds of the labelled sample: rows of a language and of all of them, and code points of a text that can be in it; of a
#: language without such texts, so many of its shortest.
SAMPLE_ROWS, ALL_ROWS, SAMPLE_CHARS, LONG_ROWS = 600, 40_000, 20_000, 3
#: Texts whose n-grams are in memory at once while fitting.
FITTED_TOGETHER = 512
UNKNOWN = "und"
#: Factor by which the regression's outputs are sharpened into a score from 0 to 1.
SHARPNESS = 6.0


def presence(texts: list[str], cells: int = CELLS) -> np.ndarray:
    """A row for each text: 1.0 in the cells of its n-grams. Whole texts are read."""
    out = np.zeros((len(texts), cells), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        # Below the letters all characters are blanks here, so that numbers, marks and line ends don't tell languages.
        code = np.where((code < 0x61) | ((code > 0x7A) & (code < 0xC0)), np.uint32(0x20), code)
        gram = np.zeros(len(code), dtype=np.uint32)
        for n in range(1, LONGEST + 1):
            if len(code) < n:
                break
            gram = gram[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
            mixed = gram ^ (gram >> np.uint32(15))
            row[((mixed * np.uint32(0x9E3779B1)) >> np.uint32(11)) % np.uint32(cells)] = 1.0
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # cells x landmarks, each column scaled to length 1
    weights: np.ndarray  # landmarks x languages: Nyström map and ridge weights
    bias: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        grams = presence(texts, self.landmarks.shape[0])
        size = np.sqrt(np.maximum(grams.sum(1, keepdims=True), 1))
        return (grams @ self.landmarks / size) @ self.weights + self.bias


def fit(labelled: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """labelled: pairs of language and text, in a fixed order. The first texts of each language are its landmarks.

    Every language has two landmarks at least, if it has two texts. Memory holds the landmarks' n-grams, those of a few
    texts at a time, and a row of features for each text.
    """
    languages = sorted({lang for lang, _ in labelled})
    if not labelled:
        return Model([], np.zeros((CELLS, 1), np.float32), np.zeros((1, 0), np.float32), np.zeros(0, np.float32))
    each = max(2, landmarks // len(languages))
    chosen, taken = [], dict.fromkeys(languages, 0)
    for lang, text in labelled:
        if taken[lang] < each:
            taken[lang] += 1
            chosen.append(text)

    def scaled(texts: list[str]) -> np.ndarray:
        grams = presence(texts)
        grams /= np.sqrt(np.maximum(grams.sum(1, keepdims=True), 1))
        return grams

    marks = scaled(chosen).T.copy()
    kernel = (marks.T @ marks).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    held = values > 1e-6 * values.max()
    root = vectors[:, held] / np.sqrt(values[held])  # the Nyström map: kernel with the landmarks times its inverse root
    parts = [scaled([text for _, text in labelled[at : at + FITTED_TOGETHER]]) @ marks for at in range(0, len(labelled), FITTED_TOGETHER)]
    features = np.concatenate(parts) @ root
    wanted = np.array([[1.0 if lang == other else -1.0 for other in languages] for lang, _ in labelled])
    mean_x, mean_y = features.mean(0), wanted.mean(0)
    x = features - mean_x
    inner = np.linalg.solve(x.T @ x + ridge * len(x) / 100 * np.eye(x.shape[1]), x.T @ (wanted - mean_y))
    return Model(languages, marks, (root @ inner).astype(np.float32), (mean_y - mean_x @ inner).astype(np.float32))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, all_rows: int = ALL_ROWS) -> Model:
    """Fit on a sample of the rows of every language, chosen by a hash of the id.

    Learns from rows with a text and a language whose crc32(doc_id) mod 5 is not 0; null and repeated ids are rows like
    others. A language has at most sample_rows rows, or its part of all_rows where languages are many (but 2). Longer texts
    than SAMPLE_CHARS are not in the sample unless a language has no others (they are scored all the same). What comes to
    the driver is bounded by these parameters.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_mod("doc_id", 5) != 0) & (F.length("text") > 0))
    usable = usable.select(docs["doc_id"].alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].alias("text"))
    short = F.length("text") <= SAMPLE_CHARS
    counts = usable.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(short.cast("int")).alias("short")).collect()  # a row for each language
    each = max(2, min(sample_rows, all_rows // max(1, len(counts))))
    # A threshold on the hash, by language, keeps what is sorted small; the limit then takes the first of each.
    shares = [(r["lang"], min(1.0, (1.5 * each + 100) / r["short"]) if r["short"] else 1.0, not r["short"]) for r in counts]
    known = docs.sparkSession.createDataFrame(shares, "lang string, share double, long boolean")
    drawn = F.xxhash64("doc_id", F.lit("language sample"))
    some = usable.join(F.broadcast(known), "lang").where((short | F.col("long")) & (F.pmod(drawn, F.lit(1_000_000)) <= (F.col("share") * 1_000_000)))
    order = Window.partitionBy("lang").orderBy(F.when(F.col("long"), F.length("text")), drawn, "doc_id", "text")
    first = some.withColumn("place", F.row_number().over(order)).where(f"place <= {each}").where(f"not long or place <= {LONG_ROWS}")
    rows = first.select("lang", "place", "text").collect()
    return fit([(r["lang"], r["text"]) for r in sorted(rows, key=lambda r: (r["place"], r["lang"]))])


def _predicted(known: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text; `und` and 0 without a letter."""
    named, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
    lettered = [k for k, t in enumerate(texts) if known.languages and any(map(str.isalpha, t))]
    if lettered:
        outputs = known.scores([texts[k] for k in lettered])
        shares = np.exp(SHARPNESS * (outputs - outputs.max(1, keepdims=True)).astype(np.float64))
        shares /= shares.sum(1, keepdims=True)
        for k, share in zip(lettered, shares, strict=True):
            best = int(share.argmax())
            named[k], sure[k] = known.languages[best], min(1.0, float(share[best]))
    return named, sure


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs.

    `und` with score 0 for null texts, texts without a letter (empty ones too), and if there was nothing to learn from.
    score is the share of the chosen language among the sharpened outputs. Repeated rows get equal results; extra
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                named, sure = _predicted(shared.value, [t or "" for t in part.column("text").to_pylist()])
                columns = [part.column("doc_id"), pa.array(named, pa.string()), pa.array(sure, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(work, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs, all columns as they are, whose text has a predicted language; `und` ones go. No shuffle.

    `und`: null and empty texts, texts without a letter, and all if there was nothing to learn from. Repeated rows and
    null ids fare like others.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                named, _ = _predicted(shared.value, [t or "" for t in part.column(place).to_pylist()])
                yield part.filter(pa.array([n != UNKNOWN for n in named], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
