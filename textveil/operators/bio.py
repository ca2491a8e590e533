"""Tokens with offsets, BIO tags for spans, spans from tags, class weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from textveil.functions.labels import DEFAULT_WEIGHT, LABELS, TAG_IDS, TAGS, WEIGHTS
from textveil.functions.spans import SPANS, matches

TOKEN, LONGEST = r"(?U)\w+|[^\w\s]", 256
#: Documents that are tagged at once.
ROWS = 1000
#: Gold tag id of tokens that a loss leaves out.
IGNORED = -100


def tokens(text: str = "text", longest: int = LONGEST) -> Column:
    """Array of struct (s, m) of words and signs, at most longest a document (a model's input length)."""
    return F.expr(f"slice({matches(text, TOKEN)}, 1, {longest})")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Sizes of lists (0 of null), the row of each element, and the elements."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, np.repeat(np.arange(len(sizes)), sizes), column.flatten()


def _numbers(values: pa.StructArray, name: str) -> np.ndarray:
    return values.field(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _listed(sizes: np.ndarray, fields: dict[str, pa.Array], kind: pa.DataType) -> pa.Array:
    cast = [fields[f.name].cast(f.type) for f in kind.value_type]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(cast, fields=list(kind.value_type)), type=kind)


def _tags(tokens_: pa.Array, spans: pa.Array) -> tuple[np.ndarray, list[str]]:
    """The tag of every token of a batch, as a place among the tags of its labels: 0 for O, odd for B, even for I.

    A document's tokens are in order, so those that a span touches follow each other, and all are found in two searches.
    """
    (_, row, held), (_, owner, marked) = _flat(tokens_), _flat(spans)
    start, size, out = _numbers(held, "s"), pc.utf8_length(held.field("m")).to_numpy(zero_copy_only=False), np.zeros(len(row), np.int64)
    names = pc.unique(marked.field("label"))
    code, s, e = pc.index_in(marked.field("label"), names).to_numpy(zero_copy_only=False).astype(np.int64), _numbers(marked, "s"), _numbers(marked, "e")
    solid = np.flatnonzero(size)
    low = start[solid]
    wide = int(max(low.max(initial=0) + size.max(initial=0), s.max(initial=0), e.max(initial=0))) + 1
    low = row[solid] * wide + low
    first = np.searchsorted(low + size[solid], owner * wide + s, "right")
    n = np.maximum(np.searchsorted(low, owner * wide + e, "left") - first, 0)
    begins = np.cumsum(n) - n
    value = np.repeat(2 * code + 2, n)
    value[begins[n > 0]] -= 1
    out[solid[np.repeat(first - begins, n) + np.arange(len(value))]] = value  # of several the last one stays
    return out, ["O", *(f"{part}-{label}" for label in names.to_pylist() for part in "BI")]


def _runs(row: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, names: list[str], rows: int, kind: pa.DataType) -> pa.Array:
    """Lists of the spans of tokens' tags: B opens one, so does I after another label."""
    label = (ids + 1) // 2
    follows = np.zeros(len(ids), bool)
    follows[1:] = (ids[1:] % 2 == 0) & (row[1:] == row[:-1]) & (label[1:] == label[:-1])
    inner = np.flatnonzero(ids > 0)
    heads = np.flatnonzero(~follows[inner])
    own = inner[heads]
    last = inner[np.append(heads[1:], len(inner)) - 1] if len(own) else own
    fields = {"s": pa.array(start[own]), "e": pa.array(end[last]), "label": pa.array(names).take(pa.array(ids[own])) if len(own) else pa.array([], pa.string())}
    fields["label"] = pc.utf8_slice_codeunits(fields["label"], 2)
    return _listed(np.bincount(row[own], minlength=rows), fields, kind)


def _mapped(ready: DataFrame, columns: dict[str, str], work: Callable[[pa.RecordBatch, dict[str, pa.DataType]], list[pa.Array]], kept: int) -> DataFrame:
    """The first columns of ready and new ones (name and type), which work makes of some documents at a time."""
    schema = StructType([*ready.schema.fields[:kept], *(StructField(n, StructType.fromDDL(f"x {t}")[0].dataType) for n, t in columns.items())])
    kinds = {f.name: f.type for f in to_arrow_schema(schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *work(batch, kinds)], names=list(kinds))

    return ready.mapInArrow(run, schema)


def tagged(docs: DataFrame, spans: str, key: str = "doc_id", cut: Column | None = None) -> DataFrame:
    """key and tagged, the array of struct (pos, ts, te, tag, tag_id) of each document's tokens.

    docs: columns key, text and the array of spans s, e, label. cut: the tokens in order, an array of struct (s, m, ...) such
    as subwords.add() makes; else words and signs. Their further fields are kept. A span's first token is B, the rest I; of
    two spans on a token the later in the array wins. Tokens that stand for no text are O. All of it is inside a document:
    tokens are cut once, batches of documents are tagged together, and no rows meet in a shuffle. Null texts have no tokens
    of their own.
    """
    ready = docs.select(key, F.col(spans).alias("_spans"), (tokens() if cut is None else cut).alias("_tokens"))
    more = {f.name: f.dataType.simpleString() for f in ready.schema["_tokens"].dataType.elementType.fields if f.name not in ("s", "m")}
    kind = "array<struct<pos: int, ts: int, te: int, tag: string, tag_id: int" + "".join(f", {n}: {t}" for n, t in more.items()) + ">>"

    def work(batch: pa.RecordBatch, kinds: dict[str, pa.DataType]) -> list[pa.Array]:
        sizes, row, held = _flat(batch.column(2))
        ids, names = _tags(batch.column(2), batch.column(1))
        start = _numbers(held, "s")
        numbers = np.array([0, *(2 * (LABELS.index(n[2:]) + 1 if n[2:] in LABELS else 0) - (n[0] == "B") for n in names[1:])])
        fields = {
            "pos": pa.array(np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)), "ts": pa.array(start), "te": pc.add(pa.array(start), pc.cast(pc.utf8_length(held.field("m")), pa.int64())),
            "tag": pa.array(names).take(pa.array(ids)), "tag_id": pa.array(numbers[ids]), **{n: held.field(n) for n in more},
        }
        return [_listed(sizes, fields, kinds["tagged"])]

    return _mapped(ready, {"tagged": kind}, work, 1)


def align(docs: DataFrame, spans: str, key: str = "doc_id", cut: Column | None = None) -> DataFrame:
    """key, pos, ts, te, tag, tag_id of each token of docs (columns key, text and the array of spans s, e, label), a row each.

    As tagged() does it; the tokens' further fields become columns.
    """
    return tagged(docs, spans, key, cut).select(key, F.inline_outer("tagged")).where("pos is not null")


def entities(docs: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """key and, for each named column of spans, the spans that its tags on words and signs spell: decode(align()) in one step."""
    ready = docs.select(key, *columns, tokens().alias("_tokens"))

    def work(batch: pa.RecordBatch, kinds: dict[str, pa.DataType]) -> list[pa.Array]:
        _, row, held = _flat(batch.column("_tokens"))
        start = _numbers(held, "s")
        end = start + pc.utf8_length(held.field("m")).to_numpy(zero_copy_only=False)
        return [_runs(row, start, end, *_tags(batch.column("_tokens"), batch.column(c)), batch.num_rows, kinds[c]) for c in columns]

    return _mapped(ready, {c: SPANS for c in columns}, work, 1)


def merged(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and spans of documents' arrays of sub-words in order (tagged: ts, te, tag, tag_id, word, score): decode(merge()) in one step."""

    def work(batch: pa.RecordBatch, kinds: dict[str, pa.DataType]) -> list[pa.Array]:
        _, row, held = _flat(batch.column(1))
        there = np.flatnonzero(held.field("word").is_valid().to_numpy(zero_copy_only=False))
        row, held = row[there], held.take(pa.array(there))
        word, start, end = (_numbers(held, n) for n in ("word", "ts", "te"))
        order = np.lexsort((_numbers(held, "tag_id"), -held.field("score").to_numpy(zero_copy_only=False), word, row))
        head = np.ones(len(row), bool)
        head[1:] = (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])
        best, at = order[head], np.flatnonzero(head)
        found = pc.unique(held.field("tag")).to_pylist()
        names = ["O", *(f"{part}-{label}" for label in sorted({t[2:] for t in found if t != "O"}) for part in "BI")]
        ids = pc.index_in(held.field("tag").take(pa.array(best)), pa.array(names)).to_numpy(zero_copy_only=False).astype(np.int64)
        low, high = (np.minimum.reduceat(start[order], at), np.maximum.reduceat(end[order], at)) if len(at) else (start, end)
        return [_runs(row[best], low, high, ids, names, batch.num_rows, kinds["spans"])]

    return _mapped(docs.select(key, "tagged"), {"spans": SPANS}, work, 1)


def merge(tagged: DataFrame, key: str = "doc_id", score: str = "score") -> DataFrame:
    """key, pos, ts, te, tag of words from their sub-words (key, pos, ts, te, tag, tag_id, word, score).

    A word takes the tag of its best sub-word, of equals the one with the smallest tag id; it reaches from its first to its
    last sub-word. Tokens of no word are left out.
    """
    best = F.max_by("tag", F.struct(F.col(score), -F.col("tag_id"))).alias("tag")
    return tagged.where("word is not null").groupBy(key, F.col("word").alias("pos")).agg(F.min("ts").alias("ts"), F.max("te").alias("te"), best)


def decode(tagged: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, s, e, label of the runs of tags: B opens one, so does I after another label."""
    order = Window.partitionBy(key).orderBy("pos")
    label, part = F.substring("tag", 3, 100), F.substring("tag", 1, 1)
    before = F.lag("tag", 1, "O").over(order)
    opens = (F.col("tag") != "O") & ((part == "B") | (before == "O") | (F.substring(before, 3, 100) != label))
    runs = tagged.withColumn("run", F.sum(opens.cast("int")).over(order)).where("tag <> 'O'")
    return runs.groupBy(key, "run").agg(F.min("ts").alias("s"), F.max("te").alias("e"), F.min(label).alias("label")).drop("run")


def argmax_tags(logits: str) -> str:
    """SQL for the tag ids of an array of arrays of logits."""
    return f"transform({logits}, l -> cast(array_position(l, array_max(l)) - 1 as int))"


def class_weights(spark) -> DataFrame:
    """tag_id, tag, weight: 1 for O, else the label's."""
    rows = [(TAG_IDS[t], t, _weight(t)) for t in TAGS]
    return spark.createDataFrame(rows, "tag_id int, tag string, weight double")


def _weight(tag: str) -> float:
    return 1.0 if tag == "O" else WEIGHTS.get(tag[2:], DEFAULT_WEIGHT)


def weighted_loss(rows: DataFrame, gold: str = "tag_id", logits: str = "logits") -> DataFrame:
    """loss, tokens: the weighted cross-entropy of arrays of logits against gold tag ids; IGNORED ones don't count.

    The sum of each token's weight times its negative log-likelihood, divided by the sum of weights; null without tokens.
    """
    weights = F.array(*(F.lit(_weight(t)) for t in TAGS))
    used = rows.where(F.col(gold) != IGNORED).select(F.get(weights, F.col(gold)).alias("w"), F.expr(f"{logits}[{gold}]").alias("own"), F.col(logits).alias("l"))
    top = used.withColumn("top", F.array_max("l"))
    loss = F.col("top") - F.col("own") + F.log(F.aggregate("l", F.lit(0.0), lambda sum_, x: sum_ + F.exp(x - F.col("top"))))
    return top.select("w", (F.col("w") * loss).alias("wl")).agg((F.sum("wl") / F.sum("w")).alias("loss"), F.count("*").alias("tokens"))


__all__ = ["IGNORED", "LABELS", "align", "argmax_tags", "class_weights", "decode", "entities", "merge", "merged", "tagged", "tokens", "weighted_loss"]
