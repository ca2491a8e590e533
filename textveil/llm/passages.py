"""Repeated passages of words across documents: fixed blocks as anchors, probed by every rolling window.

Each text is cut into non-overlapping blocks of half a window, so that every window holds a whole block of its text. The
hashes of all rolling windows of a block's width go to buckets, those that are blocks marked as such; a bucket answers with
the hashes that are a block of one document and stand in another one too. Around these hits the full windows are taken, in
the text with the block and in the one that was probed, and their digests of 96 bits go to buckets with the smallest id
that has them. A hit so grows to both sides as far as the windows over it are found in a document with a smaller id. It is
settled for all documents at once by their smallest id: extending it document by document would make pairs, whose number
grows with the square of a passage's copies.

Texts lie in shards of bounded size, by a hash of the text, so that exact copies meet; a text whose copies would fill a
shard is spread over several. Shards and buckets exchange packed arrays in which a hash stands once a shard, however often
the passage occurs. Nothing else identifies a row, so every step can be done again after a loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import text_of

WINDOW = 50
#: Bytes of text in a shard, least numbers of shards and buckets, texts that are spread at most.
SHARD, SHARDS, BUCKETS, SPREAD = 12 << 20, 512, 512, 1_000_000
#: Bytes whose words are hashed at once; bits of a hash beside its bucket.
BLOCK, BITS = 1 << 20, 30
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse modulo 2 ** 64."""
    held = _tables.get(base)
    if held is None or len(held[0]) < size:
        rows = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(max(size, BLOCK + 1), b, np.uint64)
            row[0] = 1
            rows.append(np.cumprod(row))
        held = _tables[base] = rows[0], rows[1]
    return held


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(values: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * inverse[: len(values)], out=out[1:])
    return out


def words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the bodies, one after the other, and where each body's words begin (with the end, last)."""
    data = np.frombuffer(b" ".join(bodies) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        upto = max(done + 1, int(np.searchsorted(ends, starts[done] + BLOCK, "right")))
        at, s, e = starts[done], starts[done:upto] - starts[done], ends[done:upto] - starts[done]
        power, inverse = _powers(_BASES[0], int(e[-1]) + 1)
        sums = _sums(data[at : at + e[-1]].astype(np.uint64) + np.uint64(1), inverse)
        hashes[done:upto] = _mixed((sums[e] - sums[s]) * power[s] + (e - s).astype(np.uint64))
        done = upto
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
    begins = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    return hashes, begins


def rolling(hashes: np.ndarray, begins: np.ndarray, width: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of so many words inside one body, and the places where they start."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.empty(len(hashes) - width + 1, np.uint64)
    power, inverse = _powers(base, BLOCK + width + 1)
    for at in range(0, len(out), BLOCK):
        part = hashes[at : at + BLOCK + width - 1]
        sums = _sums(part, inverse)
        out[at : at + BLOCK] = _mixed((sums[width:] - sums[:-width]) * power[: len(part) - width + 1])
    inside = np.ones(len(out), bool)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        inside[max(a, b - width + 1) : b] = False
    places = np.flatnonzero(inside)
    return out[places], places


class Texts:
    """The different texts of a shard with their ids, as arrays of words."""

    def __init__(self, table: pa.Table, known: bool) -> None:
        self.rows: dict[bytes, list] = {}
        for doc_id, body in zip(table.column("doc_id").to_pylist(), table.column("body").to_pylist(), strict=True):
            if doc_id is not None or not known:
                self.rows.setdefault(body, []).append(doc_id)
        self.bodies = list(self.rows)
        self.hashes, self.begins = words(self.bodies)
        ids = [[d for d in some if d is not None] for some in self.rows.values()]
        far = np.iinfo(np.int64).max
        self.least = np.array([min(some, default=far) for some in ids], np.int64)
        self.most = np.array([max(some, default=far) for some in ids], np.int64)

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, "right") - 1


def _groups(*sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    new = np.zeros(len(sorted_[0]), bool)
    new[:1] = True
    for column in sorted_:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _pieces(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """bucket, begin, end of the runs of a sorted array."""
    if not len(bucket):
        return
    begins = _groups(bucket)
    yield from zip(bucket[begins].tolist(), begins.tolist(), np.append(begins[1:], len(bucket)).tolist(), strict=True)


def probes(table: pa.Table, bits: int, half: int) -> Iterator[dict]:
    """bucket, shard, sent: the hashes of a shard's rolling windows; two low bits mark blocks, and hashes of several documents."""
    texts = Texts(table, True)
    hashes, places = rolling(texts.hashes, texts.begins, half, _BASES[1])
    if not len(hashes):
        return
    cut = hashes >> np.uint64(64 - bits - BITS)
    order = np.argsort(cut, kind="stable")
    cut, owner = cut[order], texts.owner(places)
    block = ((places - texts.begins[owner]) % half == 0)[order]
    begins = _groups(cut)
    least, most = np.minimum.reduceat(texts.least[owner][order], begins), np.maximum.reduceat(texts.most[owner][order], begins)
    keys = cut[begins]
    marks = np.logical_or.reduceat(block, begins).astype(np.uint32) * 2 + (least < most)
    sent = ((keys & np.uint64((1 << BITS) - 1)).astype(np.uint32) << np.uint32(2)) | marks.astype(np.uint32)
    shard = table.column("shard")[0].as_py()
    for bucket, a, b in _pieces((keys >> np.uint64(BITS)).astype(np.int64)):
        yield {"bucket": bucket, "shard": shard, "sent": sent[a:b].tobytes()}


def answers(table: pa.Table) -> Iterator[dict]:
    """shard, bucket, sent: those of its hashes that are a block and stand in several documents."""
    shards = table.column("shard").to_pylist()
    parts = [np.frombuffer(x, np.uint32) for x in table.column("sent").to_pylist()]
    sent, whose = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(sent >> np.uint32(2), kind="stable")
    keys, marks = sent[order] >> np.uint32(2), sent[order] & np.uint32(3)
    begins = _groups(keys)
    sizes = np.diff(np.append(begins, len(keys)))
    marks = np.bitwise_or.reduceat(marks, begins)
    shared = np.repeat((marks >= 2) & ((sizes > 1) | (marks & 1 > 0)), sizes)
    keys, whose = keys[shared], whose[order][shared]
    order = np.argsort(whose, kind="stable")
    keys, bucket = keys[order], table.column("bucket")[0].as_py()
    for k, a, b in _pieces(whose[order]):
        yield {"shard": shards[k], "bucket": bucket, "sent": keys[a:b].tobytes()}


def windows(table: pa.Table, replies: pa.Table, bits: int, half: int, window: int) -> Iterator[dict]:
    """bucket, shard, high, low, least: digests of a shard's windows over hits, with the smallest id here that has each."""
    if not replies.num_rows or not table.num_rows:
        return
    hits = np.concatenate([np.frombuffer(s, np.uint32).astype(np.uint64) | np.uint64(b << BITS) for s, b in zip(replies.column("sent").to_pylist(), replies.column("bucket").to_pylist(), strict=True)])
    hits.sort()
    texts = Texts(table, True)
    hashes, places = rolling(texts.hashes, texts.begins, half, _BASES[1])
    found = places[hits[np.minimum(np.searchsorted(hits, cut := hashes >> np.uint64(64 - bits - BITS)), len(hits) - 1)] == cut]
    high, places = rolling(texts.hashes, texts.begins, window, _BASES[1])
    low, _ = rolling(texts.hashes, texts.begins, window, _BASES[2])
    # a window over the block at p starts from p - (window - half) to p
    turns = np.zeros(len(texts.hashes) + 2, np.int64)
    np.add.at(turns, np.maximum(found - (window - half), texts.begins[texts.owner(found)]), 1)
    np.add.at(turns, found + 1, -1)
    some = np.cumsum(turns)[places] > 0
    high, low, places = high[some], (low[some] >> np.uint64(32)).astype(np.uint32), places[some]
    if not len(places):
        return
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    begins = _groups(high, low)
    least = np.minimum.reduceat(texts.least[texts.owner(places)][order], begins)
    high, low, shard = high[begins], low[begins], table.column("shard")[0].as_py()
    for bucket, a, b in _pieces((high >> np.uint64(64 - bits)).astype(np.int64)):
        yield {"bucket": bucket, "shard": shard, "high": high[a:b].tobytes(), "low": low[a:b].tobytes(), "least": least[a:b].tobytes()}


def smallest(table: pa.Table) -> Iterator[dict]:
    """shard, high, low, least: of the digests that some other shard has under a smaller id, that id."""
    shards = table.column("shard").to_pylist()
    columns = [[np.frombuffer(x, kind) for x in table.column(name).to_pylist()] for name, kind in (("high", np.uint64), ("low", np.uint32), ("least", np.int64))]
    whose = np.repeat(np.arange(len(shards)), [len(x) for x in columns[0]])
    high, low, least = (np.concatenate(x) for x in columns)
    order = np.lexsort((low, high))
    high, low, least, whose = high[order], low[order], least[order], whose[order]
    begins = _groups(high, low)
    best = np.repeat(np.minimum.reduceat(least, begins), np.diff(np.append(begins, len(high))))
    told = best < least
    high, low, best, whose = high[told], low[told], best[told], whose[told]
    order = np.argsort(whose, kind="stable")
    high, low, best = high[order], low[order], best[order]
    for k, a, b in _pieces(whose[order]):
        yield {"shard": shards[k], "high": high[a:b].tobytes(), "low": low[a:b].tobytes(), "least": best[a:b].tobytes()}


def _least(texts: Texts, window: int, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of a shard, and the smallest id that has each."""
    high, places = rolling(texts.hashes, texts.begins, window, _BASES[1])
    low = (rolling(texts.hashes, texts.begins, window, _BASES[2])[0] >> np.uint64(32)).astype(np.uint32)
    best = texts.least[texts.owner(places)]
    if not len(places):
        return places, best
    columns = [[np.frombuffer(x, kind) for x in replies.column(name).to_pylist()] for name, kind in (("high", np.uint64), ("low", np.uint32), ("least", np.int64))]
    there, lows, ids = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(columns, (np.uint64, np.uint32, np.int64), strict=True))
    high, low, ids = np.concatenate([high, there]), np.concatenate([low, lows]), np.concatenate([best, ids])
    order = np.argsort(high, kind="stable")
    same = np.concatenate(([False], high[order][1:] == high[order][:-1]))
    order = order[same | np.append(same[1:], False)]  # the others stand alone
    if len(order):
        order = order[np.lexsort((low[order], high[order]))]
        begins = _groups(high[order], low[order])
        ids[order] = np.repeat(np.minimum.reduceat(ids[order], begins), np.diff(np.append(begins, len(order))))
    return places, ids[: len(places)]


def removals(table: pa.Table, replies: pa.Table, window: int) -> Iterator[dict]:
    """doc_id, n_words, spans, kept of a shard's rows."""
    if not table.num_rows:
        return
    texts = Texts(table, False)
    places, best = _least(texts, window, replies)
    cuts = np.searchsorted(places, texts.begins)
    for k, (body, ids) in enumerate(texts.rows.items()):
        parts = body.split()
        own, first = places[cuts[k] : cuts[k + 1]] - texts.begins[k], best[cuts[k] : cuts[k + 1]]
        whole = b" ".join(parts)
        for doc_id in ids:
            gone = own[first < doc_id] if doc_id is not None else own[:0]
            if not len(gone):
                yield {"doc_id": doc_id, "n_words": len(parts), "spans": [], "kept": whole}
                continue
            opens = np.concatenate(([True], gone[1:] > gone[:-1] + window))
            begins, ends = gone[opens].tolist(), (gone[np.append(opens[1:], True)] + window).tolist()
            kept = [p for a, b in zip([0, *ends], [*begins, len(parts)], strict=True) for p in parts[a:b]]
            yield {"doc_id": doc_id, "n_words": len(parts), "spans": [{"start": a, "end": b} for a, b in zip(begins, ends, strict=True)], "kept": b" ".join(kept)}


def _in_parts(rows: Iterator[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(list(rows), schema=schema)


def sharded(docs: DataFrame, shard_bytes: int = SHARD, shards: int = SHARDS) -> tuple[DataFrame, int]:
    """doc_id, body, shard of docs, and the number of shards."""
    rows = docs.select("doc_id", text_of().cast("binary").alias("body"))
    key, size = F.xxhash64("body").alias("key"), F.octet_length("body").cast("long")
    copies = rows.select(key, size.alias("size")).groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("copies"))
    total = rows.agg(F.sum(size)).first()[0] or 0
    count = max(shards, -(-total // shard_bytes))
    room = max(1, total // count // 4, total // SPREAD)
    spread = copies.where((F.col("size") > room) & (F.col("copies") > 1)).select("key", F.ceil(F.col("size") / room).cast("int").alias("ways"))
    # at most SPREAD rows, since each of them stands for more than total / SPREAD bytes
    ways = F.coalesce("ways", F.lit(1))
    number = F.when(F.isnull("doc_id"), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id"))  # rows without id ask nothing, any shard will do
    salt: Column = F.pmod(number, ways)
    dealt = rows.withColumn("key", key).join(F.broadcast(spread), "key", "left")
    return dealt.select("doc_id", "body", F.pmod(F.xxhash64("key", salt), F.lit(count)).cast("int").alias("shard")), count


def remove_passages(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD, shards: int = SHARDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, spans (start and end among the words), kept (UTF-8 of the other words, a space between) of every row.

    A word goes if a window over it also starts in a document with a smaller doc_id. Null texts have no words; rows
    without a doc_id keep all words, and no other row loses any to them; rows with one doc_id lose none to each other.
    Other columns are left out; no rows give none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    half = (window + 1) // 2
    dealt, count = sharded(docs, shard_bytes, shards)
    bits = (max(buckets, count // 16) - 1).bit_length()
    kind = dict(docs.dtypes)["doc_id"]

    def schema(text: str) -> tuple[pa.Schema, str]:
        return to_arrow_schema(StructType.fromDDL(text)), text

    asked, told = schema("bucket long, shard int, sent binary"), schema("shard int, bucket long, sent binary")
    seen, best = schema("bucket long, shard int, high binary, low binary, least binary"), schema("shard int, high binary, low binary, least binary")
    out = schema(f"doc_id {kind}, n_words long, spans array<struct<start: long, end: long>>, kept binary")
    sent = dealt.groupBy("shard").applyInArrow(lambda t: _in_parts(probes(t, bits, half), asked[0]), asked[1])
    hits = sent.groupBy("bucket").applyInArrow(lambda t: _in_parts(answers(t), told[0]), told[1])
    around = dealt.groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(lambda t, r: _in_parts(windows(t, r, bits, half, window), seen[0]), seen[1])
    firsts = around.groupBy("bucket").applyInArrow(lambda t: _in_parts(smallest(t), best[0]), best[1])
    return dealt.groupBy("shard").cogroup(firsts.groupBy("shard")).applyInArrow(lambda t, r: _in_parts(removals(t, r, window), out[0]), out[1])
