"""Packing documents into token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fit one sequence. The program asks for the fewest configurations that
cover the histogram of lengths; its size is bounded by the capacity, whatever the input's. Multiplicative weights solve
it: lengths carry prices, knapsack dynamic programs find the dearest configurations, which are used until a length has
its share of the round, and what stays behind gets dearer. The prices also give the dual's bound. Whole multiples and the
largest residues are kept, and the program is solved again for the pieces that rounding leaves over; the last few, and the
shortest pieces, fill the gaps by best fit. The documents themselves never reach the driver: a piece learns its place from
its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from textveil.llm.bpe import WHITE
from textveil.llm.common import durable

CAPACITY, END_ID = 4096, 1
#: Fewest and most rounds of the price updates, the knapsacks that set them between these, the strength of the updates, how
#: near the dearest a configuration must come, and how often all rounds run at most.
ROUNDS, KNAPSACKS, STRENGTH, NEAR, PASSES = (4, 24), 12_000, 0.002, 0.003, 5
#: Share of its size that a nearly free length costs.
FREE = 1e-3
#: Fewest and most lengths priced by one knapsack, the lengths priced in all rounds that set it between these, and how few
#: lengths may repeat without a bound.
BLOCK, WORK, FEW = (32, 256), 400_000, 6
#: Share of the tokens that the shortest lengths may hold to be in no configuration: they fill what these leave open.
CRUMBS = 0.002
#: Times that the program is solved at most, and the share of the pieces that makes another time worth it.
PHASES, LEAST_PLACED = 3, 0.1
#: Emptiness that a kept configuration may have (below none: none is kept); of these the one with the fewest sequences in all
#: holds, so there are never more than best fit alone would make.
GAPS = (1.0, 0.05, 0.02, 0.01, 0.005, 0.002, -1.0)
#: First prices by steps: most pieces of one length in a sequence that they tell apart, and places of the step tried for each.
MOST_ALIKE, STEPS_TRIED = 6, 12
#: Pieces of text remembered in each of two generations of a worker, and the longest that stay.
MEMO_WORDS, MEMO_CHARS = 400_000, 64
#: Pieces of one length that one task ranks, about.
RANKED_TOGETHER = 100
#: Groups that a length's pieces are ranked in at most; one task sums up so many groups' sizes.
RANK_GROUPS = 1 << 16
#: Python's str.split takes these four for white space, the tokenizer's pattern doesn't (fixed values).
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
WORD = re.compile(f"[^{WHITE}]+")
#: Letters that lower-casing and composition map one to one, then punctuation: cut there, without the normaliser.
PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([!-&(-/:-@\[-`{-~]*)")


class Encoder:
    """Little-endian 32-bit ids of texts; each spelling between blanks is encoded once while remembered."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        cut = [WORD.findall(t) if any(s in t for s in SEPARATORS) else t.split() for t in texts]
        wanted = set().union(*cut)
        if len(self.memo) + len(wanted) > MEMO_WORDS:
            self.older, self.memo = self.memo, {}
        memo, older, fresh = self.memo, self.older, []
        for word in wanted.difference(memo):
            if word in older:
                memo[word] = older[word]
            else:
                fresh.append(word)
        self._learn(fresh)
        try:
            for words in cut:
                yield b"".join(map(memo.__getitem__, words))
        finally:
            for word in fresh:
                if len(word) > MEMO_CHARS:
                    del memo[word]

    def _learn(self, fresh: list[str]) -> None:
        memo, older, halves, rest, parts = self.memo, self.older, [], [], set()
        for word in fresh:
            if plain := PLAIN.fullmatch(word):
                core, tail = plain.groups()
                core = core.lower()
                halves.append((word, core, tail))
                parts.add(core)
                parts.add(tail)
            else:
                rest.append(word)
        parts.difference_update(memo)
        parts.discard("")
        memo.update((part, older[part]) for part in parts.intersection(older))
        memo.update(self._ids(self.bare, list(parts.difference(older))))
        memo.update(self._ids(self.library, rest))
        for word, core, tail in halves:
            memo[word] = (memo[core] if core else b"") + (memo[tail] if tail else b"")

    @staticmethod
    def _ids(library: Tokenizer, words: list[str]) -> dict[str, bytes]:
        found = {}
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            coded = library.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(coded.ids, "<u4")
            cuts = np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(len(part) + 1)).tolist()
            for k, word in enumerate(part):
                found[word] = ids[cuts[k] : cuts[k + 1]].tobytes()
        return found


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker process: what it remembers outlives a task."""
    return Encoder(path)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every row; a null text has the end id alone."""
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode_batch(texts), strict=True):
                    ids += end
                    for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[start : start + 4 * capacity]
                        rows.append((doc_id, n, start // 4, len(cut) // 4, zlib.crc32(cut)))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def dearest(prices: np.ndarray) -> float:
    """Best total price of any configuration; prices: by length, the first of length 1. Lengths may repeat."""
    best = np.zeros(len(prices) + 1)
    for room in range(1, len(best)):
        best[room] = max(best[room - 1], (best[room - 1 :: -1] + prices[:room]).max())
    return float(best[-1])


def knapsack(sizes: list[int], prices: list[float], copies: list[int], capacity: int) -> tuple[float, Counter]:
    """The dearest configuration of these lengths, each so often at most: its price, and copies by index."""
    best, taken = np.zeros(capacity + 1, np.float32), []
    for k, (size, price, most) in enumerate(zip(sizes, prices, copies, strict=True)):
        times = 1
        while most > 0 and size * (times := min(times, most)) <= capacity:  # 1, 2, 4 ... copies make every number
            grown = best[: capacity + 1 - size * times] + np.float32(price * times)
            tail = best[size * times :]
            taken.append((k, times, grown > tail))
            np.maximum(tail, grown, out=tail)
            most, times = most - times, 2 * times
    chosen, room = Counter(), capacity
    for k, times, better in reversed(taken):
        if (rest := room - sizes[k] * times) >= 0 and better[rest]:
            chosen[k] += times
            room = rest
    return float(best[capacity]), chosen


Configuration = tuple[tuple[int, int], ...]  # (length, copies) pairs, longest first


@dataclass
class Solution:
    """A fractional covering of the histogram: how often each configuration is used."""

    amounts: dict[Configuration, float]
    closing: dict[Configuration, float]  # far from the dearest: what covers the lengths that are left at the end
    bound: float  # of the dual: no covering, whole or fractional, has fewer sequences


def program(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 0) -> Solution:
    """The configuration linear program by multiplicative weights: every length covered exactly, and the dual's bound.

    Lengths carry prices. In each round every length may be covered up to the round's share of its count. In random blocks
    of lengths a knapsack finds the dearest configuration through the longest open length; it is used until one of its
    lengths has its share, if its price is near the block's dearest. Lengths behind their share get dearer, so emptier
    configurations come near where fuller ones cannot hold them. While prices are met that give a better bound than the
    first ones, all rounds run again from these, with stronger updates. The program starts with best fit's configurations,
    as column generation does with a heuristic's: where the priced ones cover at a higher cost, these are the answer.
    rounds: 0 for as many as KNAPSACKS allows.
    """
    sizes = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(s)] for s in sizes], dtype=float)
    rounds = rounds or int(np.clip(KNAPSACKS // len(sizes), *ROUNDS))
    known, prices, strength = 0.0, first_prices(sizes, counts, capacity), STRENGTH
    for _ in range(PASSES):
        solution, better = _rounds(sizes, counts, prices, capacity, rounds, strength)
        solution.bound = max(known, solution.bound)
        if better is None:
            break
        known, prices, strength = solution.bound, better, 3 * strength
    columns = best_fit(Counter(), histogram, capacity)
    if sum(n for _, n in columns) < sum(solution.amounts.values()) + sum(solution.closing.values()):
        found = {tuple(sorted(Counter(lengths).items(), reverse=True)): float(n) for lengths, n in columns}
        return Solution(found, {}, solution.bound)
    return solution


def first_prices(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Of the prices that no configuration exceeds for some length e up to half the capacity, those with the best bound.

    Lengths below e are nearly free, those that leave less than e cost a whole sequence, all others their share of it. Or
    prices rise in a line from 0 through 1 / (m + 1) at that share of the capacity to 1 / m at some length, and stay there:
    for lengths of which m + 1 fit with others that are shorter, else m. These are scaled by the dearest configuration.
    """
    best, found = -1.0, sizes / capacity
    for e in [1, *(int(s) for s in sizes if s <= capacity // 2), capacity // 2 + 1]:
        prices = np.where(sizes > capacity - e, 1.0, np.where(sizes < e, FREE, 1.0) * sizes / capacity)
        if counts @ prices > (1 + NEAR) * best:
            best, found = float(counts @ prices), prices
    for m in range(1, MOST_ALIKE + 1):
        low, high = capacity / (m + 1), capacity / m
        if not ((sizes > low / 2) & (sizes <= high)).any():
            continue
        for top in np.linspace(low, high, STEPS_TRIED + 1)[1:]:
            prices = np.clip(1 / (m + 1) + (1 / m - 1 / (m + 1)) * (sizes - low) / (top - low), FREE * sizes / capacity, 1 / m)
            if counts @ prices <= (1 + NEAR) * best:
                continue  # the dearest configuration seldom costs less than 1
            every = np.zeros(capacity)
            every[sizes - 1] = prices
            prices = prices / dearest(every)
            if counts @ prices > (1 + NEAR) * best:
                best, found = float(counts @ prices), prices
    return found


def _rounds(sizes: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int, rounds: int, strength: float) -> tuple[Solution, np.ndarray | None]:
    """A solution from these first prices, and the best prices met if they are better than the first by NEAR or more."""
    pick, covered = np.random.default_rng(0), np.zeros(len(sizes))
    amounts, closing, near, turn, first, best, better = defaultdict(float), defaultdict(float), NEAR, 0, 0.0, 0.0, None
    while True:
        turn += 1
        every = np.zeros(capacity)
        every[sizes - 1] = prices
        top = dearest(every)
        bound = float(counts @ prices) / top
        first = first or bound
        if bound > max(best, (1 + NEAR) * first):
            better = prices
        best = max(best, bound)
        share = counts * min(1.0, turn / rounds) - covered
        behind = share > 1e-9 * counts
        if turn > rounds:
            near *= 2
            if not behind.any():
                return Solution(dict(amounts), dict(closing), best), better
        used_by = amounts if turn <= rounds else closing
        some = pick.permutation(np.flatnonzero(behind))
        block = int(np.clip(WORK // (rounds * max(1, len(some))), *BLOCK))
        for part in np.array_split(some, max(1, -(-len(some) // block))):
            open_, most = part[np.argsort(-sizes[part])].tolist(), 0.0
            while open_:
                wide = capacity if len(open_) <= FEW else max(1, BLOCK[0] // len(open_))
                copies = [int(min(counts[i], capacity // sizes[i], wide)) for i in open_]
                copies[0] -= 1
                worth, chosen = knapsack([int(sizes[i]) for i in open_], [prices[i] for i in open_], copies, capacity - int(sizes[open_[0]]))
                chosen[0] += 1
                worth += prices[open_[0]]
                most = max(most, worth)
                if worth < (1 - near) * most:
                    open_ = open_[1:]  # no good room for this length in this block
                    continue
                used = {open_[k]: n for k, n in chosen.items()}
                step = min(share[i] / n for i, n in used.items())
                used_by[tuple((int(sizes[i]), used[i]) for i in sorted(used, reverse=True))] += step
                for i, n in used.items():
                    share[i] -= n * step
                    covered[i] += n * step
                open_ = [i for i in open_ if share[i] > 1e-9 * counts[i]]
        # A block that has no room for a length is chance, so what is behind by one round's share costs the same.
        prices = prices * np.exp(strength * np.maximum(share * rounds / counts - 1, 0)) / top


def whole(solution: Solution, left: dict[int, int]) -> tuple[Counter, dict[int, int]]:
    """Configurations taken a whole number of times, and the counts that remain: floors first, then the largest residues."""
    left, taken = dict(left), Counter()
    listed = sorted(solution.amounts.items(), key=lambda x: (-x[1], x[0]))
    for config, amount in listed:
        if times := min(int(amount), *(left[s] // n for s, n in config)):
            taken[config] += times
            for s, n in config:
                left[s] -= n * times
    for config, _ in sorted(listed, key=lambda x: (-(x[1] % 1), x[0])):
        if all(left[s] >= n for s, n in config):
            taken[config] += 1
            for s, n in config:
                left[s] -= n
    return taken, {s: n for s, n in left.items() if n}


@dataclass
class Plan:
    """Configurations (lengths, descending) with the sequences of each, which hold exactly the histogram."""

    sequences: list[tuple[tuple[int, ...], int]]
    bound: float  # of the linear program's dual and the tokens; full pieces are in it
    by_program: int  # pieces that stand where a configuration of the program put them, full pieces included
    pieces: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 0) -> Plan:
    """Solve and round the program, again for what rounding leaves while that places much of it; best fit for the rest."""
    full = histogram.get(capacity, 0)
    left = {s: n for s, n in histogram.items() if 0 < s < capacity and n}
    pieces, bound, taken = full + sum(left.values()), float(full), Counter()
    room, crumbs = CRUMBS * sum(s * n for s, n in left.items()), {}
    for size in sorted(left):
        if (room := room - size * left[size]) < 0:
            break
        crumbs[size] = left.pop(size)
    for phase in range(PHASES):
        waiting = sum(left.values())
        if not waiting:
            break
        solution = program(left, capacity, rounds)
        bound += 0 if phase else solution.bound
        more, left = whole(solution, left)
        taken += more
        if sum(left.values()) > (1 - LEAST_PLACED) * waiting:
            break
    made = []
    for gap in GAPS:
        kept = Counter({c: times for c, times in taken.items() if capacity - sum(s * n for s, n in c) <= gap * capacity})
        loose = Counter(left | crumbs)
        for config, times in (taken - kept).items():
            for s, n in config:
                loose[s] += n * times
        by_program = full + sum(n * times for config, times in kept.items() for _, n in config)
        filled = best_fit(kept, loose, capacity)
        made.append((sum(times for _, times in filled), -by_program, filled))
    _, by_program, filled = min(made, key=lambda x: x[:2])
    bound = max(bound, sum(s * n for s, n in histogram.items()) / capacity)
    return Plan(([((capacity,), full)] if full else []) + filled, bound, -by_program, pieces)


def best_fit(taken: Counter, left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Put what is left into the fullest sequences that have the room, largest pieces first, then into new ones."""
    open_: dict[int, list[list]] = defaultdict(list)  # by room: [lengths, how many]
    for config, times in sorted(taken.items()):
        lengths = tuple(s for s, n in config for _ in range(n))
        open_[capacity - sum(lengths)].append([lengths, times])
    rooms = sum(1 << room for room, groups in open_.items() if groups)
    for size in sorted(left, reverse=True):
        many = left[size]
        while many:
            fit = rooms >> size
            if fit:
                room = size + (fit & -fit).bit_length() - 1
                lengths, times = open_[room].pop()
                if not open_[room]:
                    rooms &= ~(1 << room)
                used = min(times, many)
                if used < times:
                    open_[room].append([lengths, times - used])
                    rooms |= 1 << room
                added = 1
            else:  # new sequences, each with as many of this length as fit
                room, lengths, added = capacity, (), min(capacity // size, many)
                used = many // added
            many -= used * added
            room -= size * added
            open_[room].append([lengths + (size,) * added, used])
            rooms |= 1 << room
    merged: Counter = Counter()
    for groups in open_.values():
        for lengths, times in groups:
            merged[tuple(sorted(lengths, reverse=True))] += times
    return sorted(merged.items())


def places(sequences: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows of length, first rank, copies in a sequence, first sequence, first offset; sorted."""
    rows, ranks, sequence = [], Counter(), 0
    for lengths, times in sequences:
        offset = 0
        for size, copies in sorted(Counter(lengths).items(), reverse=True):
            rows.append((size, ranks[size], copies, sequence, offset))
            ranks[size] += copies * times
            offset += size * copies
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, rounds: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents longer than the capacity are cut; every other document is one piece. Null and empty texts are a piece of
    the end id. Repeated rows are packed once each, null ids too; equal lengths are ranked by doc_id and piece, ties in any
    order. No rows give no rows. Extra columns are ignored. rounds: of the program's solution, 0 for as many as its size allows.
    """
    pieces = durable(pieces_of(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    table = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity, rounds).sequences))
    # A length has as many salts as its pieces need; the table of salts has at most capacity rows.
    salts = docs.sparkSession.createDataFrame([(s, min(RANK_GROUPS, -(-n // RANKED_TOGETHER))) for s, n in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "salts")).drop("salts")
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(sums.select("length", "salt", before.alias("before")), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("rank"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        keys = (known[:, 0] << 44) + known[:, 1]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = known[np.searchsorted(keys, (size << 44) + rank, "right") - 1]
            turn, copy = np.divmod(rank - row[:, 1], np.maximum(row[:, 2], 1))
            columns = [*batch.columns[:5], pa.array(row[:, 3] + turn), pa.array(row[:, 4] + copy * size)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
