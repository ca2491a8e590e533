"""Spelling variants: words at one edit from each other, found by automata over the halves of words.

One edit leaves one half of a word whole, at the start or at the end of the other word. Halves are dealt out to shards by
their hash, and each word to the shards of the halves that its length allows; a shard builds an automaton of its halves,
scans its words, and keeps hits whose place and lengths fit. Words that share a half are told apart by what is left of
them: strings with one letter taken out are looked up, so that many words with one half are no matter of pairs. Shards
answer with a count and the best variant for each word, never with pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import durable

RUN = re.compile(r"[a-zÀ-ÿ]+")
#: Runs whose hash this divides lose a letter; words have so many letters and occurrences at least; a form is so much commoner.
DAMAGE, LETTERS, TIMES, COMMONER = 199, 6, 5, 5
#: Different words held by a task before they go on; halves in a shard; code points up to which what is left of a word is indexed.
HELD, SHARD, INDEXED = 400_000, 20_000, 64


def runs(doc_id, text: str, damage: int = DAMAGE) -> Counter:
    """The damaged words of a text with their numbers; a null doc_id is an empty string."""
    lowered = text.encode(errors="surrogatepass").lower().decode(errors="surrogatepass")  # bytes: A to Z only
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(m.group() for m in RUN.finditer(lowered)).items():
        h = zlib.crc32(run.encode(), head)
        if h % damage == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LETTERS:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, times: int = TIMES, damage: int = DAMAGE) -> DataFrame:
    """word, n of the damaged words of docs that occur so often. Tasks count first: at most HELD words at a time are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.update(runs(key, text.as_py() or "", damage))
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def near(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1 :] or a[at + 1 :] == b[at + 1 :]


class Family:
    """Words with one half in common, found by what is left of them."""

    def __init__(self) -> None:
        self.rest: dict[str, tuple[str, int]] = {}
        self.without: dict[str, list[tuple[int, str]]] = defaultdict(list)
        self.long: dict[int, list[str]] = defaultdict(list)

    def add(self, rest: str, word: str, n: int) -> None:
        self.rest[rest] = (word, n)

    def index(self) -> None:
        if len(self.rest) <= 8:
            return
        for rest in self.rest:
            if len(rest) > INDEXED:
                self.long[len(rest)].append(rest)
            else:
                for k in range(len(rest)):
                    self.without[rest[:k] + rest[k + 1 :]].append((k, rest))

    def near(self, rest: str) -> set[str]:
        """What is left of the words one edit from that of another one."""
        if len(self.rest) <= 8:
            return {x for x in self.rest if near(x, rest)}
        found = {x for size in range(len(rest) - 1, len(rest) + 2) for x in self.long.get(size, ()) if near(x, rest)}
        if len(rest) <= INDEXED + 1:
            found |= {x for _, x in self.without.get(rest, ())}  # a letter more
            for k in range(len(rest)):
                less = rest[:k] + rest[k + 1 :]
                if less in self.rest and len(less) <= INDEXED:
                    found.add(less)
                found |= {x for at, x in self.without.get(less, ()) if at == k and x != rest}
        return found


def scan(halves: list[tuple[str, str, str, int]], words: list[str]) -> list[tuple[str, int, str, int]]:
    """word, number of near words, best one, its n among the halves (side, half, word, n), for the words that have any."""
    families: dict[str, dict[str, Family]] = defaultdict(dict)
    for side, half, word, n in halves:
        families[half].setdefault(side, Family()).add(word[len(half) :] if side == "L" else word[: len(word) - len(half)], word, n)
    automaton = ahocorasick.Automaton()
    for half, sides in families.items():
        automaton.add_word(half, half)
        for family in sides.values():
            family.index()
    out = []
    if not families:
        return out
    automaton.make_automaton()
    for y in words:
        count, best = 0, None
        for end, half in automaton.iter(y):
            size = len(half)
            for side, family in families[half].items():
                # the place of the half, and lengths at which it would be half of a word one letter shorter or longer
                if end + 1 != (size if side == "L" else len(y)) or not 2 * size - 2 <= len(y) <= 2 * size + 2:
                    continue
                rest = y[size:] if side == "L" else y[: len(y) - size]
                for other in family.near(rest):
                    word, n = family.rest[other]
                    if side == "R" and y.startswith(word[: len(word) // 2]):
                        continue  # its left half finds it
                    count += 1
                    if best is None or (-n, word) < best:
                        best = (-n, word)
        if best is not None:
            out.append((y, count, best[1], -best[0]))
    return out


def neighbours(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n_near, best (a struct of n and word) of the words (word, n) that have near ones."""
    size = F.length("word")
    sides = {"L": lambda k: F.substring("word", F.lit(1), k), "R": lambda k: F.expr("substring(word, -_k)")}
    left, right = F.floor(size / 2).cast("int"), (size - F.floor(size / 2)).cast("int")
    # a half of words of lengths size - 1 to size + 1
    possible = {"L": [F.floor((size - 1) / 2), F.floor(size / 2), F.floor((size + 1) / 2)], "R": [F.ceil((size - 1) / 2), F.ceil(size / 2), F.ceil((size + 1) / 2)]}
    halves, scans = [], []
    for side, own in (("L", left), ("R", right)):
        cut = lambda df: df.withColumn("half", sides[side](F.col("_k")))  # noqa: B023, E731
        halves.append(cut(words.select("word", "n", F.lit(side).alias("side"), own.alias("_k"))))
        lengths = F.explode(F.array_distinct(F.array(*(x.cast("int") for x in possible[side])))).alias("_k")
        scans.append(cut(words.select("word", "n", F.lit(side).alias("side"), lengths)))
    halves, scans = (a.unionByName(b).drop("_k") for a, b in (halves, scans))
    count = words.count()
    shards = max(1, -(-2 * count // shard))
    # a half that more words share than a shard should hold is split over several; so few there are that they fit in 2 * count / shard rows
    hot = halves.groupBy("side", "half").count().where(F.col("count") > shard).select("side", "half", F.ceil(F.col("count") / shard).cast("int").alias("ways"))
    ways = F.coalesce("ways", F.lit(1))
    place = lambda salt: F.pmod(F.xxhash64("side", "half", salt), F.lit(shards)).cast("int").alias("shard")
    kept = halves.join(hot, ["side", "half"], "left").select("side", "half", "word", "n", F.pmod(F.xxhash64("word"), ways).cast("int").alias("salt")).select(place("salt"), "side", "half", "word", "n")
    asked = scans.join(hot, ["side", "half"], "left").select("side", "half", "word", F.explode(F.sequence(F.lit(0), ways - 1)).alias("salt")).select(place("salt"), F.lit("S").alias("side"), F.lit("").alias("half"), "word", F.lit(0).cast("long").alias("n"))

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("side", "half", "word", "n")), strict=True))
        found = scan([r for r in rows if r[0] != "S"], sorted({r[2] for r in rows if r[0] == "S"}))
        names = ("word", "n_near", "best", "best_n")
        return pa.table({name: pa.array([r[k] for r in found], pa.string() if name in ("word", "best") else pa.int64()) for k, name in enumerate(names)})

    found = kept.unionByName(asked).groupBy("shard").applyInArrow(run, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.struct((-F.col("best.minus")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the links (word, form): a chain is halved in each round, and is at most as long as counts can grow by COMMONER."""
    links = durable(forms.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        links = durable(links.join(ahead, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.isnotnull("_further").alias("_moved")), "spelling-links")
        if not links.where("_moved").limit(1).count():
            return links.drop("_moved")
        links = links.drop("_moved")


def variants(docs: DataFrame, times: int = TIMES, damage: int = DAMAGE, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs (doc_id, text) after the contract's damage.

    Null texts have no words; a null doc_id is an empty string in the damage; repeated rows count again; other columns are
    left out; no rows give none. Of near words equally common the smallest is the form. A word without a form is its own
    root.
    """
    words = durable(vocabulary(docs, times, damage), "spelling-words")
    found = neighbours(words, shard)
    commoner = F.col("best.n") >= COMMONER * F.col("n")
    picked = durable(
        words.join(found, "word", "left").select(
            "word", F.when(commoner, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(commoner, F.col("best.n")).alias("form_n")
        ),
        "spelling-forms",
    )
    ends = roots(picked.where("form is not null"))
    return picked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
