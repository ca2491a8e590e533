"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Words, word pairs and the distinct successors of words in the training texts are counted, counts are quantised on a logarithmic scale, and a filter holds an
n-gram once for every step of its count (Talbot and Osborne, 2007): a probe for step 1, 2, 3 ... answers until one fails.
The filter is cut into segments; an n-gram's bits lie in one of them, so tasks build segments apart. Its size follows the
training tokens, and every n-gram is held whatever its count. Up to MAX_BITS the driver strings the segments together and
broadcasts them; a larger filter stays in Spark as rows of segments, and the n-grams of blocks of texts are sent to them.
Both ways probe the same bits, so they give the same scores.

A pair's probability is discounted, and what the discount takes from the pairs of a word goes back to all words by their
own probability: (max(c(v w) - D, 0) + (D s(v) + K) p(w)) / (c(v) + K), s(v) being the distinct successors of v, all counts
by probes. With exact counts it sums to 1 over the known words and an unknown one. The exact unigram base score is apart:
commonest words from a table of bounded size, all others by a join on the word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from textveil.llm.common import crc_mod, durable, forget, text_of
from textveil.llm.repeats import slices

#: Bounds of the filter, its segments, bits for each training token (at which false hits raise scores by 0.02 a token at most),
#: and hash functions of the first and later steps.
MIN_BITS, MAX_BITS, SEGMENTS, BITS_A_TOKEN, FIRST, LATER = 1 << 20, 1 << 31, 1 << 10, 13, 6, 3
#: Binary logarithm of the most bits of a segment (larger filters have more segments), and bytes of an n-gram within one.
SEGMENT_LOG, LOW = 24, 5
#: Steps of the scale that double a count.
STEPS = 2
#: Most words whose exact counts are broadcast, and steps of the scale of counts, a doubling, that is cut to reach that.
COMMON, FINE = 1 << 20, 4
#: Discount of a seen pair, further weight of a word's own probability, and the base's added count.
DISCOUNT, PRIOR, ADDED = 0.75, 2.0, 0.1
#: Bytes of text worked on at once, and where the whole filter is held beside them.
TEXT_BYTES, BESIDE_FILTER = 8 << 20, 2 << 20
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Bits of a word that stand for it in its count of successors, and the owner of n-grams that are no pairs.
OWNER_SHIFT, NO_OWNER = np.uint64(64 - 8 * LOW), np.uint64((1 << 8 * LOW) - 1)
_NEXT = np.uint64(0x2545F4914F6CDD1D)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def tokens(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens; index of every token, text by text, each with an end; tokens of each text."""
    index: dict[bytes, int] = {b"": 0}  # the end; no word is empty
    ids, sizes = [], []
    for body in bodies:
        words = body.lower().split()  # of bytes: ASCII letters and ASCII blanks only
        row = [index.setdefault(w, len(index)) for w in words]
        row.append(0)
        ids.append(np.array(row, np.int32))
        sizes.append(len(row))
    hashes = np.array([xxh64_intdigest(w) for w in index], np.uint64)
    hashes[0] = _END
    return hashes, np.concatenate([np.zeros(0, np.int32), *ids]), np.array(sizes, np.int64)


def pairs(hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the word before each token (a start before the first), and of the pair."""
    word = hashes[ids]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(sizes) - sizes] = _START
    return before, _mix(before * _A + word)


def successors(owners: np.ndarray) -> np.ndarray:
    """N-grams that hold the numbers of distinct successors; owners: the leading bits of words."""
    return _mix(owners * _A ^ _NEXT)


def level(counts: np.ndarray) -> np.ndarray:
    """Steps of counts of at least 1."""
    return np.floor(STEPS * np.log2(counts)).astype(np.int64) + 1


def value(levels: np.ndarray) -> np.ndarray:
    """The count that a number of steps stands for: the middle of those it can be; 0 for none."""
    low = np.ceil(2.0 ** ((levels - 1) / STEPS) - 1e-9)
    high = np.maximum(low, np.ceil(2.0 ** (levels / STEPS) - 1e-9) - 1)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def _places(grams: np.ndarray, step: int, number: int, size: int) -> np.ndarray:
    """Bit within its segment for each n-gram (its low part); size: any number below 2 ** 32."""
    return ((_mix((grams + np.uint64(step * 16 + number)) * _A) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def segment(grams: np.ndarray, levels: np.ndarray, size: int) -> bytes:
    """Bits of one segment of size bits."""
    bits = np.zeros(size, bool)
    for step in range(1, int(levels.max(initial=0)) + 1):
        some = grams[levels >= step]
        for number in range(FIRST if step == 1 else LATER):
            bits[_places(some, step, number, size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def probe(bits: np.ndarray, base: np.ndarray, low: np.ndarray, size: int) -> np.ndarray:
    """Steps held for each n-gram, by probes until one fails; base: the first bit of its segment."""
    levels, alive, step = np.zeros(len(low), np.int64), np.arange(len(low)), 1
    while len(alive) and step < 64 * STEPS:
        for number in range(FIRST if step == 1 else LATER):
            at = base[alive] + _places(low[alive], step, number, size)
            alive = alive[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        levels[alive] = step
        step += 1
    return levels


def geometry(total: int) -> tuple[int, int]:
    """Bits of the filter, and how many leading bits of an n-gram name its segment. Both follow the training tokens alone.

    There are BITS_A_TOKEN for each token at every size, rounded up to whole bytes of the segments.
    """
    bits = max(MIN_BITS, BITS_A_TOKEN * total)
    lead = max(SEGMENTS.bit_length() - 1, bits.bit_length() - 1 - SEGMENT_LOG)
    return -(-bits // (8 << lead)) * (8 << lead), lead


def _low(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(6)) & np.uint64((1 << 8 * LOW) - 1)


def _pack(numbers: np.ndarray) -> np.ndarray:
    """Numbers of LOW bytes, a row each."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :LOW])


def _unpack(packed: bytes) -> np.ndarray:
    low = np.frombuffer(packed, np.uint8).reshape(-1, LOW)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :LOW] = low
    return wide.view("<u8").reshape(-1).astype(np.uint64)


@dataclass
class LogFilter:
    bits: np.ndarray  # bytes of all segments
    total: int  # training tokens
    distinct: int

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """Quantised counts of n-gram hashes."""
        size = 8 * len(self.bits) // SEGMENTS
        return value(probe(self.bits, (grams >> np.uint64(65 - SEGMENTS.bit_length())) * np.uint64(size), _low(grams), size))


def asked(hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All n-grams whose counts log10 needs, in order."""
    words = np.append(hashes, _START)
    return np.unique(np.concatenate((pairs(hashes, ids, sizes)[1], _mix(words), successors(words >> OWNER_SHIFT))))


def token_logs(counts: Callable[[np.ndarray], np.ndarray], total: int, distinct: int, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of every token after the one before it, from counts of n-grams."""
    words = np.append(hashes, _START)
    single = counts(_mix(words))
    follow = np.minimum(counts(successors(words >> OWNER_SHIFT)), single)
    own = (single[:-1] + ADDED) / (total + ADDED * (distinct + 1))
    before = np.empty(len(ids), np.int64)  # index of the word before each token
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = len(hashes)
    context = single[before]
    grams, back = np.unique(pairs(hashes, ids, sizes)[1], return_inverse=True)
    seen = np.minimum(counts(grams)[back], context)
    return np.log10((np.maximum(seen - DISCOUNT, 0) + (DISCOUNT * follow[before] + PRIOR) * own[ids]) / (context + PRIOR))


def log10(counts: Callable[[np.ndarray], np.ndarray], total: int, distinct: int, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of every text."""
    logs = token_logs(counts, total, distinct, hashes, ids, sizes)
    return np.add.reduceat(logs, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """token and n of the commonest words: those from the lowest step of a scale of counts above which there are at most most."""
    step = F.floor(F.log2(F.col("n").cast("double")) * FINE)
    amounts = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)  # at most 64 * FINE rows
    least, held = None, 0
    for at, amount in amounts:
        held += amount
        if held > most:
            break
        least = at
    return counts.where(step >= least) if least is not None else counts.where("false")


def _bodies(docs: DataFrame) -> DataFrame:
    return docs.select(F.encode(text_of(), "UTF-8").alias("body"))


def word_counts(docs: DataFrame) -> DataFrame:
    """token (hash) and n of every distinct token of the texts, ends included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=TEXT_BYTES):
                hashes, ids, _ = tokens(part.column("body").to_pylist())
                n = np.bincount(ids, minlength=len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return _bodies(docs).mapInArrow(work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def segments(docs: DataFrame, bits: int, lead: int) -> DataFrame:
    """segment and bits: the filter of all words, pairs and numbers of successors of docs, whatever their counts.

    Tasks send their counts packed, a row for each part of the n-gram space; parts grow in number with the shuffle. Pairs
    bring along the leading bits of their first word: where a pair's counts meet it is one successor of that word, and
    these ones are summed in the same way in a second shuffle.
    """
    fine = max(0, (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) >> lead).bit_length())

    def parts(grams: np.ndarray, *more: np.ndarray) -> list[pa.Array]:
        """Numbers of parts, and for each the packed n-grams (ascending) and slices of the other columns."""
        edges = np.searchsorted(grams >> np.uint64(64 - lead - fine), np.arange((1 << lead + fine) + 1, dtype=np.uint64))
        used = np.flatnonzero(np.diff(edges))
        packed = [[x[edges[k] : edges[k + 1]].tobytes() for k in used.tolist()] for x in (_pack(_low(grams)), *more)]
        return [pa.array(used, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=TEXT_BYTES):
                hashes, ids, sizes = tokens(part.column("body").to_pylist())
                if not len(ids):
                    continue
                before, pair = pairs(hashes, ids, sizes)
                starts = np.full(len(sizes), _mix(np.full(1, _START))[0])
                grams, first, n = np.unique(np.concatenate((pair, _mix(hashes)[ids], starts)), return_index=True, return_counts=True)
                owners = np.where(first < len(pair), before[np.minimum(first, len(pair) - 1)] >> OWNER_SHIFT, NO_OWNER)
                yield pa.RecordBatch.from_arrays(parts(grams, n.astype("<u4"), _pack(owners)), ["part", "grams", "counts", "owners"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """bits of each part, and of the pairs' owners the packed counts by part (bits null)."""

        def settle(part: int, held: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            grams = _unpack(b"".join(x[0] for x in held))
            order = np.argsort(grams, kind="stable")
            grams = grams[order]
            n = np.frombuffer(b"".join(x[1] for x in held), "<u4").astype(np.int64)[order]
            first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            made = segment(grams[first], level(np.add.reduceat(n, first)), bits >> lead)
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([part >> fine], pa.int32()), pa.array([made], pa.binary()), none, none], MERGED)
            owners = _unpack(b"".join(x[2] for x in held))
            if len(owners):
                owners, times = np.unique(owners[order][first], return_counts=True)
                real = owners != NO_OWNER
                grams, times = successors(owners[real]), times[real].astype("<u4")
                order = np.argsort(grams)
                number, low, n = parts(grams[order], times[order])
                yield pa.RecordBatch.from_arrays([number, pa.nulls(len(number), pa.binary()), low, n], MERGED)

        last, held = -1, []
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last and held:
                    yield from settle(last, held)
                    held = []
                last = part
                held.append(row)
        if held:
            yield from settle(last, held)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, made = -1, None
        for batch in batches:
            for number, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != last and made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([made.tobytes()], pa.binary())], ["segment", "bits"])
                    made = None
                new = np.frombuffer(more, np.uint8)
                last, made = number, new if made is None else made | new
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([made.tobytes()], pa.binary())], ["segment", "bits"])

    def merged(packed: DataFrame) -> DataFrame:
        return packed.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "number int, bits binary, grams binary, counts binary")

    once = durable(merged(_bodies(docs).mapInArrow(count, "part int, grams binary, counts binary, owners binary")), "lm-counts")
    follow = merged(once.where("bits is null").select(F.col("number").alias("part"), "grams", "counts", F.lit(b"").alias("owners")))
    every = once.where("bits is not null").unionByName(follow).select(F.col("number").alias("segment"), "bits")
    return every.repartition("segment").sortWithinPartitions("segment").mapInArrow(unite, "segment int, bits binary")


def build(docs: DataFrame, total: int, distinct: int) -> LogFilter:
    """The whole filter; only for such as have MAX_BITS at most."""
    bits, lead = geometry(total)
    out = np.zeros((1 << lead, bits >> lead + 3), np.uint8)
    made = segments(docs, bits, lead)
    forget(docs.sparkSession)  # the counts' shuffle is written as a table by now
    for row in made.toLocalIterator(True):  # a partition's segments at a time
        out[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return LogFilter(out.reshape(-1), total, distinct)


def answers(whole: DataFrame, held: DataFrame, bits: int, lead: int) -> DataFrame:
    """block, segment and levels (a byte each) of the n-grams that blocks of texts ask for, in order within a segment."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _blocks(batches):
            grams = asked(*tokens(part.column("body").to_pylist()))
            edges = np.searchsorted(grams >> np.uint64(64 - lead), np.arange((1 << lead) + 1, dtype=np.uint64))
            low, used = _pack(_low(grams)), np.flatnonzero(np.diff(edges))
            packed = [low[edges[k] : edges[k + 1]].tobytes() for k in used.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), block)), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["block", "segment", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle() -> pa.RecordBatch:
            low = _unpack(b"".join(x for _, x in waiting))
            found = probe(filled, np.zeros(len(low), np.uint64), low, bits >> lead).astype(np.uint8)
            ends = np.cumsum([len(x) // LOW for _, x in waiting])[:-1]
            parts = [x.tobytes() for x in np.split(found, ends)]
            blocks = pa.array([b for b, _ in waiting], pa.int64())
            return pa.RecordBatch.from_arrays([blocks, pa.array(np.full(len(parts), last, np.int32)), pa.array(parts, pa.binary())], ["block", "segment", "levels"])

        none = np.zeros(bits >> lead + 3, np.uint8)
        last, filled, waiting, size = -1, none, [], 0
        for batch in batches:
            for block, number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and (number != last or size > TEXT_BYTES):
                    yield settle()
                    waiting, size = [], 0
                if number != last:
                    last, filled = number, none
                if block < 0:  # the segment itself comes before what is asked of it
                    filled = np.frombuffer(data, np.uint8)
                else:
                    waiting.append((block, data))
                    size += len(data)
        if waiting:
            yield settle()

    both = whole.mapInArrow(ask, "block long, segment int, data binary").unionByName(held.select(F.lit(-1).cast("long").alias("block"), "segment", F.col("bits").alias("data")))
    return both.repartition("segment").sortWithinPartitions("segment", "block").mapInArrow(answer, "block long, segment int, levels binary")


def _blocks(batches: Iterator[pa.RecordBatch], size: int = TEXT_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of texts, each with the number of its first row."""
    for batch in batches:
        for part in slices(batch, size=size):
            yield part.column("row")[0].as_py(), part


def answered(whole: DataFrame, held: DataFrame, bits: int, lead: int) -> DataFrame:
    """The texts and the answers to their n-grams, block by block, in order within partitions."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, block)), *part.columns], ["block", *part.schema.names])

    texts = whole.mapInArrow(place, "block long, row long, doc_id long, body binary")
    both = texts.withColumn("segment", F.lit(-1)).unionByName(answers(whole, held, bits, lead), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "segment", "row")


def _reunited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Callable[[np.ndarray], np.ndarray], tuple]]:
    """Texts of each block, the counts of its n-grams, and its tokens."""

    def settle(parts: list[pa.RecordBatch]) -> tuple[pa.Table, Callable[[np.ndarray], np.ndarray], tuple]:
        table = pa.Table.from_batches(parts)
        is_text = pc.is_null(table.column("levels"))
        texts = table.filter(is_text)
        known = tokens(texts.column("body").to_pylist())
        grams = asked(*known)
        levels = np.frombuffer(b"".join(table.filter(pc.invert(is_text)).column("levels").to_pylist()), np.uint8)
        if len(levels) != len(grams):
            raise ValueError(f"{len(levels)} answers for the {len(grams)} n-grams of a block: its rows came in another order when read again")
        counts = value(levels.astype(np.int64))
        return texts, lambda some: counts[np.searchsorted(grams, some)], known

    last, held = None, []
    for batch in batches:
        block = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and block[a] != last:
                yield settle(held)
                held = []
            last = block[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield settle(held)


def score(docs: DataFrame, training: DataFrame, common: int = COMMON) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    training: the texts to learn from. Null and empty texts are one end token. Without training texts every word is
    unknown. Repeated rows get equal scores (each is scored); extra columns are ignored.
    """
    spark = docs.sparkSession
    whole = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.encode(text_of(), "UTF-8").alias("body"))
    counts = durable(word_counts(training), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits, lead = geometry(total)
    small = bits <= MAX_BITS
    if small:
        model = spark.sparkContext.broadcast(build(training, total, distinct))
    else:
        whole = durable(whole, "lm-texts")  # read twice: rows keep their numbers even if a task is run again
        held = segments(training, bits, lead)
        forget(spark)
        source = answered(whole, durable(held, "lm-segments"), bits, lead)
    top = commonest(counts, common).select("token", "n").toArrow()  # bounded by common
    known, n = (top.column(c).to_numpy() for c in ("token", "n"))
    order = np.argsort(known)
    table = spark.sparkContext.broadcast((known[order], n[order]))
    norm = total + ADDED * (distinct + 1)

    def rows_of(part: pa.RecordBatch | pa.Table, of: Callable[[np.ndarray], np.ndarray], known: tuple) -> Iterator[pa.RecordBatch]:
        names, amounts = table.value
        hashes, ids, sizes = known
        rows = part.column("row").to_numpy()
        signed = hashes.view(np.int64)
        at = np.minimum(np.searchsorted(names, signed), max(0, len(names) - 1))
        listed = names[at] == signed if len(names) else np.zeros(len(signed), bool)
        logs = np.where(listed, np.log10((amounts[at] + ADDED) / norm) if len(names) else 0.0, 0.0)
        firsts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        base, known_ = np.add.reduceat(logs[ids], firsts), np.add.reduceat(listed[ids].astype(np.int64), firsts)
        doc_id = pa.array(part.column("doc_id").to_pylist(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(rows), pa.array(np.zeros(len(rows), np.int32)), pa.array(sizes), doc_id, pa.array(known_), pa.array(base), pa.array(log10(of, total, distinct, *known))],
            FIELDS,
        )
        rare = np.flatnonzero(~listed[ids])
        code, tf = np.unique(owner[rare] * len(hashes) + ids[rare], return_counts=True)
        row, token = np.divmod(code, len(hashes))
        empty = pa.nulls(len(code), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[row]), pa.array(signed[token]), pa.array(np.ones(len(code), np.int32)), pa.array(tf), empty, empty, empty.cast(pa.float64()), empty.cast(pa.float64())],
            FIELDS,
        )

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _blocks(batches, BESIDE_FILTER):
            yield from rows_of(part, model.value.counts, tokens(part.column("body").to_pylist()))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, of, known in _reunited(batches):
            yield from rows_of(part, of, known)

    fields = "row long, token long, rare int, tokens long, doc_id long, known long, base double, score double"
    found = whole.mapInArrow(probed, fields) if small else source.mapInArrow(joined, fields)
    looked = found.join(counts.select("token", F.lit(1).alias("rare"), "n").hint("merge"), ["token", "rare"], "left")
    rare = F.col("rare") == 1
    summed = looked.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(~rare, F.col("tokens"))).alias("n_tokens"),
        F.sum(F.when(rare & F.col("n").isNotNull(), F.col("tokens")).when(~rare, F.col("known"))).alias("n_known"),
        F.sum(F.when(rare, F.col("tokens") * F.log10((F.coalesce("n", F.lit(0)) + ADDED) / norm)).otherwise(F.col("base"))).alias("base_score"),
        F.max("score").alias("score"),
    )
    return summed.select("doc_id", "n_tokens", F.coalesce("n_known", F.lit(0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


MERGED = ["number", "bits", "grams", "counts"]
FIELDS = ["row", "token", "rare", "tokens", "doc_id", "known", "base", "score"]


def split(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts to learn from and held-out ones, by crc32 of the id modulo 10 (0: held out; null ids are learnt from)."""
    return docs.where(crc_mod("doc_id", 10) != 0), docs.where(crc_mod("doc_id", 10) == 0)
