"""Repeated passages across documents by suffix sorting, exact at every byte.

A byte goes if a window of WINDOW bytes over it also starts earlier in the corpus. Every window has an anchor, the
KEY-byte string in it with the least hash (the leftmost of equals), so equal windows have equal anchors at equal places.
Anchors that occur once settle their windows at once; for the others the text around them meets under the anchor: the
suffixes that start there and the reversed text before it are put in order by deep-shallow sorting, and with the lengths
of common prefixes every window of an anchor is looked up among those of earlier occurrences.

Anchors with many occurrences are first resolved within the task that read them; only windows without an earlier
occurrence there go on, each under its own key, which then has one row per task at most. A text that equals an earlier
one in full is covered by it and takes no part in the search.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from textveil.llm import deep_shallow
from textveil.llm.common import durable, text_of

WINDOW, KEY = 100, 32
#: Occurrences of an anchor in one batch, and over all tasks, from which it is resolved in two steps.
LOCAL_MANY, MANY = 16, 2000
#: Bytes of text that are hashed at once and resolved together, and rows that are resolved together.
BLOCK, TOGETHER, ROWS = 1 << 18, 8 << 20, 50_000
#: From here on numbers stand for texts without an id; below are halves of ids.
NO_ID = 1 << 62
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(BLOCK + WINDOW + 1, base, np.uint64)
        row[0] = 1
        out.append(np.cumprod(row))
    return out[0], out[1]


def anchors(bodies: list[bytes], window: int = WINDOW, key: int = KEY) -> tuple[np.ndarray, ...]:
    """hash, index of the body, offset, lo, hi for every anchor: it serves the windows that start lo to hi bytes before it."""
    sizes = np.array(list(map(len, bodies)), np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(bodies), np.uint8)
    usable = np.ones(len(data), bool)
    for begin, size in zip(begins.tolist(), sizes.tolist(), strict=True):
        usable[max(begin, begin + size - window + 1) : begin + size] = False
    power, inverse = _powers()
    width, found = window - key + 1, []
    for at in range(0, len(data) - window + 1, BLOCK):
        part = data[at : at + BLOCK + window - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * inverse[: len(part)], out=sums[1:])
        hashes = (sums[key:] - sums[:-key]) * power[: len(part) - key + 1]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        least, span = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64), 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        starts = np.flatnonzero(usable[at : at + len(least)])
        if not len(starts):
            continue
        chosen = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.append(first[1:], len(chosen)) - 1
        where = chosen[first]
        found.append((hashes[where], where + at, where - starts[last], where - starts[first]))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    hashes, where, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    index = np.searchsorted(begins, where, "right") - 1  # of empty bodies the last that begins there, which is not empty
    return hashes, index, where - begins[index], lo, hi


def slices(batch: pa.RecordBatch, column: str = "body", size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about size bytes of the column, a row at least."""
    lengths = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], np.int64)
    begin, total = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > begin and total + n > size:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def resolve(doc: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, around: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of occurrences of anchors also start earlier (smaller doc, then at) among the rows.

    around: the hi bytes before the anchor and the window - lo bytes from it. Returns row and j (the window starts j
    bytes before the anchor) of each such window.
    """
    rank = np.lexsort((at, doc))
    same_place = np.concatenate(([False], (doc[rank][1:] == doc[rank][:-1]) & (at[rank][1:] == at[rank][:-1])))
    place = np.zeros(len(rank), np.int64)
    place[rank] = np.cumsum(~same_place)
    before, after = [], []
    for text, n in zip(around, hi.tolist(), strict=True):
        before.append(text[:n][::-1])
        after.append(text[n:])
    classes = []
    for suffixes in (before, after):
        order, shared = deep_shallow.sort(suffixes)
        classes.append((order, shared))
    rows, js = [], []
    for j in range(int(lo.min(initial=window)), int(hi.max(initial=-1)) + 1):
        served = (lo <= j) & (hi >= j)
        if np.count_nonzero(served) < 2:
            continue
        ids = []
        for (order, shared), depth in zip(classes, (j, window - j), strict=True):
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(shared < depth)
            ids.append(number)
        some = rank[served[rank]]
        code = (ids[1][some] << 32) | ids[0][some]
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
        repeated = place[some] > place[some[first]][group]
        rows.append(some[repeated])
        js.append(np.full(np.count_nonzero(repeated), j))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *js])


def covered(count: int, rows: np.ndarray, js: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the flagged windows: the rows that have any, and the largest and smallest j of each."""
    most, least = np.full(count, -1, np.int64), np.full(count, 1 << 30, np.int64)
    np.maximum.at(most, rows, js)
    np.minimum.at(least, rows, js)
    any_ = np.flatnonzero(most >= 0)
    return any_, most[any_], least[any_]


def _signed(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, np.uint64).view(np.int64))


def _candidates(docs: DataFrame, window: int, key: int, local_many: int) -> DataFrame:
    """anchor, doc, at, info of every anchor. info: bit 0: known to be repeated; bit 1: a marker of many; then lo, hi.

    at: the upper half tells texts of one id apart, the lower is the offset. Of an anchor with many occurrences in a
    batch one marker goes to the anchor's other occurrences; its own go under keys of their own.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, version = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "version"))
                hashes, index, offset, lo, hi = anchors(part.column("body").to_pylist(), window, key)
                if not len(hashes):
                    continue
                _, first, group, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                many = count > local_many
                known = many[group]
                at, info = (version[index] << 32) | offset, (lo << 2) | (hi << 12)
                own = (np.arange(len(hashes), dtype=np.uint64) + doc[index].view(np.uint64)) * np.uint64(_BASE) ^ at.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                marks = first[many]
                columns = [np.concatenate(x) for x in ((np.where(known, own, hashes).view(np.int64), hashes[marks].view(np.int64)), (doc[index], doc[index[marks]]), (at, at[marks]), (info | known, info[marks] | 2))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "doc", "at", "info"])

    return docs.mapInArrow(work, "anchor long, doc long, at long, info long")


def _repeated(candidates: DataFrame, most_few: int) -> DataFrame:
    """doc, version, place of the anchors that occur more than once; place: offset, above it bit 32: many, then lo, hi."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(4))

        def settle(anchor: np.ndarray, doc: np.ndarray, at: np.ndarray, info: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            size = np.diff(np.append(first, len(anchor)))
            known, marker = info & 1, (info >> 1) & 1
            many = np.repeat((size > most_few) | (np.maximum.reduceat(marker, first) > 0), size) | (known > 0)
            use = ((np.repeat(size, size) > 1) | (known > 0)) & (marker == 0)
            place = (at & 0xFFFFFFFF) | (many.astype(np.int64) << 32) | ((info >> 2) << 33)
            return pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (doc, at >> 32, place)], ["doc", "version", "place"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = tuple(np.concatenate((a, b.to_numpy(zero_copy_only=False))) for a, b in zip(held, batch.columns, strict=True))
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last group may go on in the next batch
            if cut:
                yield settle(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if len(held[0]):
            yield settle(*held)

    return candidates.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(work, "doc long, version long, place long")


_ROW = "key long, doc long, at long, lo int, hi int, around binary"


def _surroundings(found: DataFrame, window: int, key: int) -> DataFrame:
    """Text around repeated anchors, by a hash of the anchor. Rows with null text are settled: hi bytes from at go."""

    def pack(keys: list[int], doc: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, around: list) -> pa.RecordBatch:
        columns = [_signed(keys), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(around, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["key", "doc", "at", "lo", "hi", "around"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, version, body, places in zip(*(part.column(c).to_pylist() for c in ("doc", "version", "body", "places")), strict=True):
                    for place in set(places):
                        offset, lo, hi = place & 0xFFFFFFFF, (place >> 33) & 0x3FF, place >> 43
                        for column, value in zip(rows, (place >> 32 & 1, doc, version << 32 | offset, lo, hi, body[offset - hi : offset + window - lo]), strict=True):
                            column.append(value)
                many, doc, at, lo, hi = (np.array(x, np.int64) for x in rows[:5])
                around = rows[5]
                few = np.flatnonzero(many == 0)
                if len(few):
                    texts = [around[k] for k in few.tolist()]
                    keys = [xxh64_intdigest(t[h : h + key]) for t, h in zip(texts, hi[few].tolist(), strict=True)]
                    yield pack(keys, doc[few], at[few], lo[few], hi[few], texts)
                hot = np.flatnonzero(many)
                if not len(hot):
                    continue
                doc, at, lo, hi, around = doc[hot], at[hot], lo[hot], hi[hot], [around[k] for k in hot.tolist()]
                rows_, js = resolve(doc, at, lo, hi, around, window)
                any_, most, least = covered(len(hot), rows_, js)
                if len(any_):
                    keys = [xxh64_intdigest(b"%d %d" % x) for x in zip(doc[any_].tolist(), at[any_].tolist(), strict=True)]
                    yield pack(keys, doc[any_], at[any_] - most, np.zeros(len(any_)), window + most - least, [None] * len(any_))
                open_ = np.repeat(np.arange(len(hot)), hi - lo + 1)
                step = np.arange(len(open_)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[open_]
                left = ~np.isin(open_ * 1024 + step, rows_ * 1024 + js)
                open_, step = open_[left], step[left]
                for begin in range(0, len(open_), 100_000):
                    row, j = open_[begin : begin + 100_000], step[begin : begin + 100_000]
                    texts = [around[r][h : h + window] for r, h in zip(row.tolist(), (hi[row] - j).tolist(), strict=True)]
                    yield pack([xxh64_intdigest(t, 1) for t in texts], doc[row], at[row] - j, np.zeros(len(row)), np.zeros(len(row)), texts)

    return found.mapInArrow(work, _ROW)


def _covered(rows: DataFrame, window: int) -> DataFrame:
    """doc, version, span (start in the upper half, length in the lower) of repeated windows under each key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(table: pa.Table) -> pa.RecordBatch:
            key, doc, at, lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "doc", "at", "lo", "hi"))
            around = table.column("around").to_pylist()
            done = np.array([t is None for t in around], bool)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            some = np.flatnonzero((np.repeat(size, size) > 1) & ~done)
            rows_, js = resolve(doc[some], at[some], lo[some], hi[some], [around[k] for k in some.tolist()], window)
            any_, most, least = covered(len(some), rows_, js)
            some = some[any_]
            docs_ = np.concatenate((doc[done], doc[some]))
            starts = np.concatenate((at[done], at[some] - most))
            lengths = np.concatenate((hi[done], window + most - least))
            columns = [docs_, starts >> 32, ((starts & 0xFFFFFFFF) << 32) | lengths]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "version", "span"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield settle(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield settle(pa.Table.from_batches(held))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(work, "doc long, version long, span long")


def _cut(found: DataFrame, window: int) -> DataFrame:
    """doc, version, n_bytes, spans and kept of rows with doc, version, body and covered (array of spans; -1: the whole text)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def merged(covered: list[int] | None, size: int) -> list[tuple[int, int]]:
        if not covered:
            return []
        if -1 in covered:
            return [(0, size)] if size >= window else []
        out: list[tuple[int, int]] = []
        for span in sorted(covered):
            start, end = span >> 32, (span >> 32) + (span & 0xFFFFFFFF)
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], end))
            else:
                out.append((start, end))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                spans, kept = [], []
                bodies = part.column("body").to_pylist()
                for body, covered_ in zip(bodies, part.column("covered").to_pylist(), strict=True):
                    runs = merged(covered_, len(body))
                    edges = [0, *(x for run in runs for x in run), len(body)]
                    kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    spans.append([{"start": a, "end": b} for a, b in runs])
                columns = [part.column("doc"), part.column("version"), pa.array(list(map(len, bodies)), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "version", "n_bytes", "spans", "kept"])

    return found.select("doc", "version", "body", "covered").mapInArrow(work, "doc long, version long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: int = KEY, local_many: int = LOCAL_MANY, many: int = MANY) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (maximal removed runs, in bytes, end exclusive), kept (bytes).

    Null texts are empty; texts shorter than the window lose nothing. Null ids stand after all others, in the order of a
    hash of their texts of more than 90 bits. Rows equal in id and text are one document that is listed again, with equal
    results; different texts of one id are apart, in the order of a hash of 30 bits. Extra columns are ignored; no rows
    give no rows. Ids may be any long.
    """
    if window > 1023:
        raise ValueError("windows have 1023 bytes at most")
    body, bits, own = F.encode(text_of(), "UTF-8"), F.lit(NO_ID - 1), docs["doc_id"].cast("long")
    # An id's last bit goes before the hash of its text, so that any id leaves half the numbers to texts without one.
    texts = docs.select(
        F.coalesce(F.shiftright(own, 1), F.xxhash64(text_of(), F.lit("no id")).bitwiseAND(bits).bitwiseOR(F.lit(NO_ID))).alias("doc"),
        F.coalesce(F.shiftleft(own.bitwiseAND(F.lit(1)), 30).bitwiseOR(F.shiftrightunsigned(F.xxhash64(text_of()), 34)), F.shiftrightunsigned(F.xxhash64(text_of()), 33)).alias("version"),
        body.alias("body"),
    )
    place = ["doc", "version"]
    equal = texts.select(*place, F.sha2("body", 256).alias("sha"))
    firsts = equal.groupBy("sha").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    # Written, so that two plain exchanges meet and adaptive execution can split a text with many copies.
    copies = equal.join(durable(firsts, "first-copies").hint("merge"), "sha").where(F.struct(*place) != F.col("first")).select(*place)
    # The three joins share one exchange of the texts.
    fresh = texts.join(copies.hint("merge"), place, "left_anti")
    repeated = _repeated(_candidates(fresh, window, key, local_many), many).groupBy(*place).agg(F.collect_list("place").alias("places"))
    around = _surroundings(texts.join(repeated.hint("merge"), place).select(*place, "body", "places"), window, key)
    spans = _covered(around, window).unionByName(copies.withColumn("span", F.lit(-1).cast("long")))
    found = texts.join(spans.groupBy(*place).agg(F.collect_list("span").alias("covered")).hint("merge"), place, "left")
    doc_id = F.when(F.col("doc") < NO_ID, F.shiftleft("doc", 1).bitwiseOR(F.shiftrightunsigned("version", 30)))
    return _cut(found, window).select(doc_id.alias("doc_id"), "n_bytes", "spans", "kept")
