"""Passages, spelling and conversations against brute force, with nulls, empty and long texts, ties, repeats, other columns."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textveil.llm import conversations, passages, spelling

DOCS = "doc_id long, text string, word string, shard string, body string"


def brute_passages(rows, window):
    first = defaultdict(lambda: 1 << 70)
    cut = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, ws in cut:
        for p in range(len(ws) - window + 1):
            if d is not None:
                key = tuple(ws[p : p + window])
                first[key] = min(first[key], d)
    out = []
    for d, ws in cut:
        gone = {p + k for p in range(len(ws) - window + 1) if d is not None and first[tuple(ws[p : p + window])] < d for k in range(window)}
        out.append((d, len(ws), sorted(gone), " ".join(w for k, w in enumerate(ws) if k not in gone).encode()))
    return sorted(out, key=repr)


def odd_documents(seed=5):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(["uno", "dos", "trés", "cuatro", "ß", "x" * 40]) + str(rng.randrange(40)) for _ in range(n))
    shared, twice = some(70), some(12)
    rows = [(k, some(rng.randrange(90)) + rng.choice([" ", "\n", "\t\x0b"]) + (shared if k % 3 == 0 else "") + " " + some(rng.randrange(30))) for k in range(40)]
    rows += [(100 + k, rows[7][1]) for k in range(60)]  # a large group of copies
    rows += [(200, None), (201, ""), (202, " \n\t "), (None, shared), (None, rows[3][1]), (None, None), (203, f"{twice} {twice} {twice}"), (204, some(3000)), (205, "a b c " * 60)]
    rows += [rows[3], rows[3], (-5, rows[9][1]), (2**62 + 7, shared), (9, shared)]
    return rows


@pytest.mark.parametrize(("window", "shards", "buckets"), [(50, 512, 512), (50, 3, 2), (5, 7, 4), (2, 1, 1)])
def test_passages(spark, window, shards, buckets):
    rows = odd_documents()
    docs = spark.createDataFrame([(d, t, "w", "s", "b") for d, t in rows], DOCS)
    got = passages.remove_passages(docs, window, shards=shards, buckets=buckets).collect()
    told = [(r.doc_id, r.n_words, [p for s in r.spans for p in range(s.start, s.end)], bytes(r.kept)) for r in got]
    assert sorted(told, key=repr) == brute_passages(rows, window)


def test_passages_of_nothing(spark):
    assert passages.remove_passages(spark.createDataFrame([], DOCS)).isEmpty()


def test_passages_spread_copies(spark):
    """Copies of one text are dealt to many shards, all others lie with their copies."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 60)).otherwise(F.concat(F.lit("text "), (F.col("id") % 7).cast("string"))).alias("text"))
    dealt, count = passages.sharded(docs, shards=64)
    sizes = {bytes(r.body): r.n for r in dealt.groupBy("body").agg(F.count_distinct("shard").alias("n")).collect()}
    assert count == 64 and sizes[b"hot " * 60] > 32
    got = passages.remove_passages(docs).agg(F.sum(F.size("spans")), F.min("n_words")).first()
    assert tuple(got) == (999, 2)


def brute_words(rows, times, damage=199):
    count = Counter()
    for d, t in rows:
        low = re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")
        for run in re.findall(r"[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % damage == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= times}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(vocabulary):
    form, near = {}, {}
    for w, n in vocabulary.items():
        others = [x for x in vocabulary if x != w and one_edit(x, w)]
        near[w] = len(others)
        best = min(others, key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best and vocabulary[best] >= 5 * n else None
    out = []
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], vocabulary[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("shard", [20_000, 40, 3])
def test_spelling(spark, shard):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(60)] + ["prefix" + "".join(rng.choice("xyzß") for _ in range(4)) for _ in range(120)]
    base += ["q" * 90, "q" * 91, "q" * 89 + "r", "q" * 20 + "s" + "q" * 70, "longer" * 300, "longer" * 300 + "x"]
    rows = [(k, " ".join(rng.choice(base) for _ in range(60))) for k in range(60)]
    rows += [(1, "chains chainss chainsss " + "chainss " * 80 + "chainsss " * 500 + "chains " * 5), (2, "ÀÉcolé àécolé " * 6), (3, None), (4, ""), (None, "Zebras zebra1 ZEBRAS zebras zebras zebras"), (5, "123 ++ ab"), (1, "chains " * 3), (1, "chains " * 3)]
    docs = spark.createDataFrame([(d, t, "w", "s", "b") for d, t in rows], DOCS)
    wanted = brute_variants(brute_words(rows, 5))
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, spelling.variants(docs, shard=shard).select(*columns).collect())) == wanted
    assert any(r[2] != (r[1] or r[0]) for r in wanted)  # a chain of two forms


def test_spelling_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).isEmpty()
    assert spelling.variants(spark.createDataFrame([(1, "no, word", "", "", "")], DOCS)).isEmpty()


def test_near():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(5))) for _ in range(2))
        assert spelling.near(a, b) == one_edit(a, b)


def brute_repair(rows):
    """Every order of edits by rising cost, then audit; the first that is accepted."""
    found, seen = [], set()
    for role, text in rows:
        rest = text.rstrip(" \t\n\x0b\x0c\r")
        found.append("b" if not rest else "d" if (role, text) in seen else "" if rest[-1] in ".!?" else "t")
        seen.add((role, text))
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, row, initials, out = heapq.heappop(heap)
        if row == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return found, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
        steps = [("I", 3, 0, r, f"{r}:") for r in ("user", "assistant")]
        if row < len(rows):
            role, text = rows[row]
            steps.append(("D", 4, 1, "", None))
            if found[row] not in ("b", "d"):
                late = 3 * (found[row] == "t")
                steps += [("K", late, 1, role, f"{role}:{text}")] + [("R", 3 + late, 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for letter, more, on, role, line in steps:
            word = initials + (role[:1] or "?" if line is not None else "")
            if re.fullmatch("s?(ua)*u?", word):
                heapq.heappush(heap, (cost + more, audit + letter, row + on, word, out if line is None else (*out, line)))


def brute_conversation(rows):
    """rows: turn, role, text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1][:40], r[2][:40], hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
    if not rows:
        return (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    turns = [r[0] for r in rows if r[0] is not None]
    found, cost, audit, sha = brute_repair([r[1:] for r in rows])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, sha)


def brute_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            own += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def odd_conversations():
    rng = random.Random(8)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(5)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "uncle"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 9]), role, rng.choice(["Yes.", "Yes.", "No", "", None, " \n", "A\nb!  ", "?", "é" * 50 + "."])))
    return rows + rows[:5] + [(200, 1, "user", None), (201, None, None, None)]


CONVERSATIONS = "conv_id long, turn long, role string, text string, part string, fault string, copy string"


@pytest.mark.parametrize("block_rows", [conversations.BLOCK_ROWS, 1, 2, 3])
def test_conversations(spark, block_rows):
    rows = odd_conversations()
    table = spark.createDataFrame([(*r, "p", "f", "c") for r in rows], CONVERSATIONS).repartition(5)
    got = {r[0]: tuple(r[1:]) for r in conversations.repair(table, block_rows).collect()}
    assert got == {conv: brute_conversation(own) for conv, own in brute_damage(rows).items()}


def test_long_conversation(spark):
    """One conversation lies in several tasks and blocks; the same answer as in one piece."""
    rng = random.Random(4)
    rows = [(7, k, rng.choice(["user", "assistant", "user", "system"]), f"Word {rng.randrange(400)}" + rng.choice([".", ""])) for k in range(3000)]
    rows += [(8, 0, "user", "Hi."), (6, 0, "system", "Be kind.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r[0]: tuple(r[1:]) for r in conversations.repair(table, 64).collect()}
    own = sorted(brute_damage(rows)[7], key=lambda r: r[0])
    assert got[7] == conversations._whole(*(list(c) for c in zip(*own, strict=True)))
    assert {r.conv_id for r in conversations.repair(table, 64, damage=False).where("cost = 3").collect()} == {8}


def test_conversations_of_nothing(spark):
    assert conversations.repair(spark.createDataFrame([], CONVERSATIONS)).isEmpty()
