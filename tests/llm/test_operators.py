"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows, other columns."""

import hashlib
import math
import re
import statistics
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from textveil.llm import bpe, deep_shallow, language, lm, packing, pii, quality, queries, repeats, simhash, toxicity
from textveil.llm.exact_dedup import exact_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sample(spark):
    """Real rows and odd ones; a column called body clashes with names inside the operators."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("body"))
    long_ = "ab cd " * 30_000
    odd = spark.createDataFrame(
        [(1001, None, None, None), (1002, "", "en", None), (1003, " \n\t", None, "x"), (1004, long_, "en", "y"), (1005, long_.replace(" ", "  "), None, None), (None, "no id here", None, None), (1006, "12 + 34 = 46", None, None), (1007, "é" * 150 + "\0" * 120, None, None)],
        "doc_id long, text string, lang string, body string",
    )
    rows = docs.unionByName(odd)
    return rows.unionByName(rows.where("doc_id in (3, 1004)"))


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


EMPTY = "doc_id long, text string, lang string"


def test_exact_groups(spark, sample):
    rows = [(r.doc_id, r.text or "") for r in sample.collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t)].append((-len(t), d is None, d or 0, d))
    for r in exact_groups(sample, 4, 2).collect():
        body = re.sub(r"[\x20\x09-\x0D]+", "", dict(rows)[r.doc_id])
        keep = min(groups[body])[3]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(groups[body]), keep == r.doc_id, hashlib.sha256(body.encode()).hexdigest())
    assert exact_groups(spark.createDataFrame([], EMPTY)).isEmpty()


def brute_repeats(docs, window=100):
    first, out = set(), {}
    for d, text in sorted(docs.items(), key=lambda x: (x[0] is None, x[0] or 0)):
        b = text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if b[p : p + window] in first:
                gone[p : p + window] = b"\1" * window
            first.add(b[p : p + window])
        out[d] = bytes(c for c, g in zip(b, gone, strict=True) if not g)
    return out


def test_repeats_digests(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute_repeats(docs)
    for r in queries.QUERIES["op10_suffix_dedup"](spark, SF).collect():
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(docs[r.doc_id].encode()), len(docs[r.doc_id].encode()) - len(want[r.doc_id]), hashlib.sha256(want[r.doc_id]).hexdigest())


def test_bpe_digests(spark):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op5_byte_bpe"](spark, SF).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "é a\u3000b", "z")], "doc_id long, text string, ids string")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert sorted(len(r.ids) for r in bpe.encode(odd, path, public_tokenizers.PATTERN).collect())[:2] == [0, 0]
    assert bpe.encode(spark.createDataFrame([], EMPTY), path, public_tokenizers.PATTERN).isEmpty()


@pytest.mark.parametrize("many", [(16, 2000), (1, 2)])
def test_repeats(sample, many):
    want = brute_repeats(texts(sample))
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(sample, local_many=many[0], many=many[1]).collect()}
    assert got == want


def test_repeats_without_ids(spark):
    """Null ids stand last, each text on its own; what is left of them depends on an order among them, which is fixed."""
    shared = "a passage that is well over one hundred bytes long and occurs in many documents, with ids and without them. "
    rows = [(None, shared + f"tail {k}", "x", 1) for k in range(4)] + [(5, "head " + shared, "y", 2), (None, shared + "tail 0", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version string, at int")
    got = Counter((r.doc_id, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect())
    assert got[5, rows[4][1].encode()] == 1  # the only known id is first
    assert sum(n for (d, _), n in got.items() if d is None) == 5 and all(len(kept) <= 60 for d, kept in got if d is None)
    assert max(n for (d, _), n in got.items() if d is None) == 2  # the repeated row


def test_repeats_of_any_id(spark):
    """Neighbouring, negative and the largest ids keep their order and their names; null ones come after them all."""
    shared = "a passage that is well over one hundred bytes long and occurs in many documents, whatever their ids may be. "
    ids = [2**63 - 1, 2**63 - 2, 2**62 + 5, 2**62, 7, 6, -1, -2, -(2**63), None]
    docs = spark.createDataFrame([(d, f"head {k} " + shared) for k, d in enumerate(ids)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(docs).collect()}
    whole = {d for d, kept in got.items() if shared.encode() in kept}
    assert set(got) == set(ids) and whole == {-(2**63)}
    less = docs.where("doc_id is null or doc_id >= 6")
    assert {r.doc_id for r in repeats.remove_repeats(less).collect() if shared.encode() in bytes(r.kept)} == {6}
    with pytest.raises(ValueError, match="1023"):
        repeats.remove_repeats(docs, window=1024)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], EMPTY)).isEmpty()


def test_deep_shallow():
    import os.path
    import random

    pick = random.Random(5)
    some = [bytes(pick.choices(b"ab\0", k=pick.randint(0, 50))) for _ in range(400)] + [b"x" * 40 + bytes([k % 7]) for k in range(50)]
    order, shared = deep_shallow.sort(some)
    ordered = [some[k] for k in order]
    assert ordered == sorted(some)
    assert all(n == len(os.path.commonprefix([a, b])) for a, b, n in zip(ordered, ordered[1:], shared[1:], strict=False))


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, sample):
    docs = {d: t for d, t in texts(sample).items() if d is not None}
    prints = {d: plain_fingerprint(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(sample.where("doc_id is not null")).collect()}
    assert got == {d: (f"{prints[d]:016x}", find(d)) for d in docs}
    assert simhash.near_groups(spark.createDataFrame([], EMPTY)).isEmpty()


def test_lm_base_and_score(spark, sample):
    docs = texts(sample)
    train = lm.split(sample)[0]
    rows = [(r.doc_id, r.text or "") for r in train.collect()]
    cut = lambda t: t.encode().lower().split() + [b""]
    counts = Counter(w for _, t in rows for w in cut(t))
    total, distinct = sum(counts.values()), len(counts)
    for common in (lm.COMMON, 20):
        for r in lm.score(sample, train, common).collect():
            words = cut(docs[r.doc_id])
            base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
            assert math.isclose(r.base_score, base, rel_tol=1e-9)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
            assert r.score < 0
    held = lm.score(lm.split(sample)[1], train).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]
    none = lm.score(sample, sample.where("false"))
    assert none.where("n_known > 0").isEmpty()


def test_simhash_links_by_distance(spark):
    """Pairs planted at 0 to 5 bits, chains of such steps and a hub: classes are those of all links of up to 3 bits."""
    import random

    pick = random.Random(4)
    prints, chain = set(), pick.getrandbits(64)
    for distance in range(6):
        for _ in range(40):
            one = pick.getrandbits(64)
            prints |= {one, one ^ sum(1 << b for b in pick.sample(range(64), distance))}
    hub = pick.getrandbits(64)
    prints |= {hub} | {hub ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20, 40, 3)}
    for _ in range(30):
        prints.add(chain := chain ^ sum(1 << b for b in pick.sample(range(64), 3)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    listed, root = sorted(prints), {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(listed):
        for b in listed[:k]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    frame = spark.createDataFrame([(signed(p),) for p in listed], "fp long")
    got = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(frame, 4)).collect()}
    groups, wanted = defaultdict(set), defaultdict(set)
    for p in listed:
        groups[got.get(p, signed(p))].add(p)
        wanted[find(p)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_simhash_null_ids(spark):
    near = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [(None, near, 1), (None, near + " now", 2), (7, near, 3), (None, "quite another text that stands alone", 4), (None, None, 5), (3, "", 6), (7, near, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long").withColumns({"key": F.lit("x"), "root": F.lit("y"), "variant": F.lit(1)})
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect())
    a, b, zero = (f"{plain_fingerprint(t):016x}" for t in (near, rows[3][1], ""))
    assert got[None, a, 7] == 1 and got[7, a, 7] == 2 and got[None, b, None] == 1 and got[None, zero, 3] == 1 and got[3, zero, 3] == 1
    apart = (plain_fingerprint(near) ^ plain_fingerprint(near + " now")).bit_count() > 3
    kept = Counter(r.doc_id for r in simhash.representatives(docs).collect())
    assert kept == {7: 1, 3: 1, None: 1 + apart}


def exact_pairs(rows):
    """Counts by n-gram hash, as the filter answers them but exact; all tokens, and distinct ones."""
    import numpy as np

    held, words, total = Counter(), set(), 0
    for body in rows:
        known = lm.tokens([body])
        hashes, ids, sizes = known
        before, pair = lm.pairs(*known)
        follow = lm.successors(before >> lm.OWNER_SHIFT)
        held.update(f for g, f in dict(zip(pair.tolist(), follow.tolist(), strict=True)).items() if not held[g])
        held.update([*pair.tolist(), *lm._mix(hashes)[ids].tolist(), *lm._mix(np.full(1, lm._START)).tolist()])
        words.update(hashes[ids].tolist())
        total += len(ids)
    return lambda grams: np.array([held[g] for g in grams.tolist()], float), total, len(words)


def test_lm_is_a_distribution():
    """With exact counts: the formula by hand, and a mass of 1 after every word, at a text's start too."""
    bodies = [b"a b a c", b"a b", b"", b"c a b b the end", b"The the the"]
    counts, total, distinct = exact_pairs(bodies)
    words, pairs_ = Counter(), Counter()
    follow = lambda v: sum(a == v for a, _ in pairs_)
    for body in bodies:
        cut = ["^", *body.decode().lower().split(), ""]
        words.update(cut)
        pairs_.update(zip(cut, cut[1:], strict=False))
    own = {w: (words[w] + 0.1) / (total + 0.1 * (distinct + 1)) for w in [*words, "unknown"] if w != "^"}
    chance = lambda v, w: (max(pairs_[v, w] - lm.DISCOUNT, 0) + (lm.DISCOUNT * follow(v) + lm.PRIOR) * own[w]) / (words[v] + lm.PRIOR)
    for v in ["a", "b", "c", "the", "end", "unknown"]:
        after = {w: 10 ** lm.token_logs(counts, total, distinct, *lm.tokens([f"{v} {w}".encode()]))[1] for w in own}
        first = {w: 10 ** lm.token_logs(counts, total, distinct, *lm.tokens([w.encode()]))[0] for w in own}
        assert all(math.isclose(after[w], chance(v, w), rel_tol=1e-9) for w in own)
        assert all(math.isclose(first[w], chance("^", w), rel_tol=1e-9) for w in own)
        assert math.isclose(sum(after.values()), 1, abs_tol=1e-6) and math.isclose(sum(first.values()), 1, abs_tol=1e-6)


def test_lm_score_against_exact_counts(sample):
    """The filter's counts are quantised in steps of a half doubling; so near are its scores to those of exact counts."""
    docs, train = texts(sample), lm.split(sample)[0]
    counts, total, distinct = exact_pairs([(r.text or "").encode() for r in train.collect()])
    far, tokens_ = 0.0, 0
    for r in lm.score(sample, train).collect():
        want = float(lm.log10(counts, total, distinct, *lm.tokens([docs[r.doc_id].encode()]))[0])
        assert abs(r.score - want) <= 0.16 * r.n_tokens
        far, tokens_ = far + abs(r.score - want), tokens_ + r.n_tokens
    assert far <= 0.03 * tokens_


def test_lm_geometry():
    """As many bits a token at every size."""
    for total in [200_000, 3_640_000, 67_000_000, 67_108_865, 74_000_000, 134_000_001, 10**12]:
        bits, lead = lm.geometry(total)
        assert lm.BITS_A_TOKEN <= bits / total < lm.BITS_A_TOKEN + 0.1 and bits % (8 << lead) == 0 and bits >> lead < 1 << 32


@pytest.mark.parametrize("broadcast", [True, False])
def test_lm_crowded_filter(spark, monkeypatch, broadcast):
    """With no bit to spare false hits raise the scores of new texts by 0.02 a token at most, on both sides of the switch."""
    import random

    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(800)}"  # nearly all pairs are different
    docs = spark.createDataFrame([(k, " ".join(word() for _ in range(200))) for k in range(900)], "doc_id long, text string")
    train = lm.split(docs)[0]
    counts, total, distinct = exact_pairs([r.text.encode() for r in train.collect()])
    assert lm.geometry(total)[0] > lm.MIN_BITS
    stepped = lambda grams: lm.value(np.where((n := counts(grams)) > 0, lm.level(np.maximum(n, 1)), 0))
    if not broadcast:
        monkeypatch.setattr(lm, "MAX_BITS", 1 << 19)
        monkeypatch.setattr(lm, "build", None)
    held = lm.split(docs)[1]
    want = {r.doc_id: float(lm.log10(stepped, total, distinct, *lm.tokens([r.text.encode()]))[0]) for r in held.collect()}
    got = lm.score(held, train).collect()
    bias = sum(r.score - want[r.doc_id] for r in got) / sum(r.n_tokens for r in got)
    assert 0.002 <= bias <= 0.02


def test_lm_commonest(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1] * 50 + [2] * 20 + [9] * 5 + [100])], "token long, n long")
    assert {r.n for r in lm.commonest(counts, 30).collect()} == {2, 9, 100}
    assert lm.commonest(counts, 100).count() == 76 and lm.commonest(counts, 0).isEmpty() and lm.commonest(counts.where("false"), 9).isEmpty()


def test_lm_filter_beyond_broadcast(spark, sample, monkeypatch):
    """However small the broadcast may be, no n-gram is dropped and the scores are the same."""
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    train = lm.split(sample)[0]
    want = sorted(lm.score(sample, train).collect(), key=key)
    monkeypatch.setattr(lm, "MAX_BITS", 1 << 13)
    monkeypatch.setattr(lm, "build", None)
    for log in (lm.SEGMENT_LOG, 9):  # 9: more segments than the least
        monkeypatch.setattr(lm, "SEGMENT_LOG", log)
        got = sorted(lm.score(sample, train).collect(), key=key)
        assert [(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got] == [(r.doc_id, r.n_tokens, r.n_known, pytest.approx(r.base_score)) for r in want]
        if log > 9:
            assert [r.score for r in got] == pytest.approx([r.score for r in want], rel=1e-9)
        else:  # other segments: other false hits, which may move a short text
            assert sum(abs(a.score - b.score) > 0.1 * abs(b.score) for a, b in zip(got, want, strict=True)) <= 0.01 * len(want)


def test_bloom_counts():
    import numpy as np

    low = np.arange(5000, dtype=np.uint64) * np.uint64(7919)
    counts = np.arange(5000) % 40 + 1
    made = lm.segment(low, lm.level(counts), 1 << 19)
    held = lm.LogFilter(np.concatenate([np.frombuffer(made, np.uint8), np.zeros((lm.SEGMENTS - 1) * len(made), np.uint8)]), 1, 1)
    got = held.counts(low << np.uint64(6))
    full = np.unpackbits(np.frombuffer(made, np.uint8)).mean()  # a step too many is a false hit of LATER probes
    assert (got >= 0.8 * counts).all() and (got[counts > 1] > 1.3 * counts[counts > 1]).mean() <= 1.5 * full**lm.LATER


def test_bpe(sample):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    wanted = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = texts(sample)
    coded = bpe.encode(sample, path, public_tokenizers.PATTERN)
    for r in coded.collect():
        assert r.ids == wanted.encode_ordinary(docs[r.doc_id])
    assert {r.doc_id: r.text for r in bpe.decode(coded, path, public_tokenizers.PATTERN).collect()} == docs


def test_packing(spark, sample):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    wanted, got, used = Counter(), Counter(), defaultdict(list)
    rows = sample.withColumns({"length": F.lit("x"), "salt": F.lit(1), "rank": F.lit(2), "n": F.lit(3)})
    for r in rows.select("doc_id", "text").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for n, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            wanted[r.doc_id, n, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    for r in packing.pack(rows, path).collect():
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        used[r.sequence_id].append((r.offset, r.length))
    assert got == wanted  # repeated rows and null ids too
    total = 0
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
        total += end
    assert len(used) <= -(-total // 4096) + 2
    assert packing.pack(spark.createDataFrame([], EMPTY), path).isEmpty()


def test_knapsack():
    import itertools
    import random

    pick = random.Random(2)
    for _ in range(60):
        sizes, copies = [pick.randint(1, 9) for _ in range(4)], [pick.randint(0, 3) for _ in range(4)]
        prices = [pick.random() for _ in range(4)]
        every = itertools.product(*(range(n + 1) for n in copies))
        best = max(sum(p * n for p, n in zip(prices, some, strict=True)) for some in every if sum(s * n for s, n in zip(sizes, some, strict=True)) <= 17)
        worth, chosen = packing.knapsack(sizes, prices, copies, 17)
        assert math.isclose(worth, best, rel_tol=1e-5) and math.isclose(sum(prices[k] * n for k, n in chosen.items()), best, rel_tol=1e-5)
        assert sum(sizes[k] * n for k, n in chosen.items()) <= 17 and all(n <= copies[k] for k, n in chosen.items())
        dense = packing.np.zeros(17)
        for s, p in zip(sizes, prices, strict=True):
            dense[s - 1] = max(dense[s - 1], p)
        assert packing.dearest(dense) >= best - 1e-9


#: Lengths of the kinds that occur: all different, one alone, halves that do not pair, and many of each.
HISTOGRAMS = {
    "different": {k * 37 % 4001 + 40: 1 for k in range(700)},
    "one": {1: 100_000},
    "halves": {2458: 100, 1229: 40, 10: 3},
    "large": {**{2100 + k: 5 for k in range(300)}, **{300 + k: 3 for k in range(200)}},
    "many": {200 + 7 * k: 50 + k % 13 for k in range(500)},
    "even, 20,000": {1 + k: 5 - (k % 9 == 0) for k in range(4095)},
    "even, 1,000,000": {1 + k: 244 + k % 3 for k in range(4095)},
    "1200 to 2000": {1200 + k: 120 + k * 7 % 11 for k in range(801)},
    "lognormal": Counter(min(4095, max(1, int(math.exp(5.8 + statistics.NormalDist().inv_cdf((k + 0.5) / 60_000))))) for k in range(60_000)),
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_packing_program(name):
    """The program covers every length within 0.5 % of the dual's bound and places most pieces; never more sequences than best fit."""
    histogram = HISTOGRAMS[name]
    solution = packing.program(histogram)
    covered = Counter()
    for config, amount in [*solution.amounts.items(), *solution.closing.items()]:
        assert sum(s * n for s, n in config) <= 4096
        for s, n in config:
            covered[s] += n * amount
    assert all(math.isclose(covered[s], n, rel_tol=1e-6) for s, n in histogram.items())
    value, tokens = sum(solution.amounts.values()) + sum(solution.closing.values()), sum(s * n for s, n in histogram.items())
    assert max(tokens / 4096, solution.bound - 1e-6) <= value * (1 + 1e-9)
    assert value <= 1.005 * solution.bound + 1
    made = packing.plan(histogram)
    held = Counter()
    for lengths, times in made.sequences:
        assert sum(lengths) <= 4096
        for s in lengths:
            held[s] += times
    assert held == histogram and made.pieces == sum(histogram.values())
    assert made.by_program >= (0.4 if name == "1200 to 2000" else 0.85) * made.pieces
    used = sum(n for _, n in made.sequences)
    plain = sum(n for _, n in packing.best_fit(Counter(), histogram, 4096))
    assert made.bound <= used <= plain


def test_pii_disguises():
    def parts(text):
        return {(k, text[a:b]) for k, a, b in pii.spans(text)[1]}

    assert ("email", "jane.roe (at) example (dot) org") in parts("write jane.roe (at) example (dot) org today")
    assert ("email", "jаne@example.org") in parts("see jаne@example.org now")  # a Cyrillic letter
    assert any(k == "phone" for k, _ in parts("call +1 five five five two one nine four four seven one please"))
    assert parts("4111 1111 1111 1111") == {("card", "4111 1111 1111 1111")}
    assert parts("256.1.1.1 and 10.0.0.1") == {("ip", "10.0.0.1")}
    assert parts("nothing at all. dot here") == set()


def test_pii_more_disguises():
    def parts(text):
        return {(k, text[a:b]) for k, a, b in pii.spans(text)[1]}

    for number in ("plus one.five.five.five.two.one.nine.four.four.seven.one", "+five,five,five,two,one,nine,four,four,seven,one"):
        assert ("phone", number) in parts(f"call {number} please")
    assert ("phone", "+1 double five five two one nine triple four one") in parts("call +1 double five five two one nine triple four one now")
    assert ("phone", "+1 five fİve ſix two one nine four four one") in parts("call +1 five fİve ſix two one nine four four one now")
    for letter in "αɑаᎪ":
        assert ("email", f"m{letter}ry@example.org") in parts(f"see m{letter}ry@example.org now")
    assert ("email", "saսl@exampӏe.org") in parts("see saսl@exampӏe.org now")
    assert ("email", "jane (dot) roe@example.org") in parts("write jane (dot) roe@example.org now")
    assert parts("the end . roe@example.org") == {("email", "roe@example.org")}
    assert parts("at +1 555 123 4567 one of us") == {("phone", "+1 555 123 4567")}


def test_pii_digits_of_other_scripts():
    """Arabic, Persian, Devanagari, Bengali and Thai digits; the same texts in words or shorter numbers hold nothing."""
    for zero in "\u0660\u06f0\u0966\u09e6\u0e50":
        own = str.maketrans("0123456789", "".join(chr(ord(zero) + k) for k in range(10)))
        for kind, plain in (("phone", "+49 301 234 5678"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.1")):
            shown = plain.translate(own)
            text = f"see {shown} now"
            base, found = pii.spans(text)
            assert base == [] and [(k, text[a:b]) for k, a, b in found] == [(kind, shown)]
        assert pii.spans("in 2024 and 1999, 300.300.300.300, 4111 1111 1111 1112".translate(own))[1] == []


def test_pii_gate():
    """The gate lets through every text in which a run with a digit spelled apart is found."""
    import random

    pick = random.Random(3)
    some = ["five", "Zéro", "fünf", "ſix", "double", "7", "un", " ", " ", ",", ".", "-", "(", "dot", "—", "“", "x", "_"]
    for _ in range(20_000):
        text = "".join(pick.choices(some, k=12))
        hit = any(pii.SPELLED_ONE.search(text, *run) for run in pii.runs(text))
        assert not hit or pii.maybe_spelled(text), text
        pii.spans(text)


LONG = ["{} ", "1", "one ", "1-", "1.", "1 . ", "one,", "one     ", "double ", "dot ", " . ", "at ", "a at ", "at-", "@", "a@", "a@-", "a@b", "a@b.", "a.", "a_at_b", "(at)", "a (at) ", "a (dot) ", "a at b dot ", "+1 ", "+1-", "+", "-", "plus ", "plus one ", "é", "а", "а@b.cc ", "jane@x.org ", "1.1.1.1 ", "one.one.one.one ", "4111 1111 1111 1111 а", "\u200b", "(((", "_-_-", "a at", "1 dot ", "1(dot)", "five)( "]


@pytest.mark.parametrize("unit", LONG)
def test_pii_time(unit):
    """Texts of 100,000 characters that try every pattern's repetitions."""
    import time

    text = ("one" + " " * 100_000 + "two 1" + " " * 50_000 + "." + " " * 50_000 + "two") if "{}" in unit else (unit * 100_000)[:100_000]
    began = time.process_time()
    pii.spans(text)
    pii.spans("x " + text + " one two three а@b.cc")
    assert time.process_time() - began < 3, unit  # two texts; about a second each on a slow machine


def plain_base(text):
    """The contract's patterns as they are written."""
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, *m.span()) for k, (p, good) in rules.items() for m in re.finditer(p, text) if good(m[0])]


def test_pii_base_by_the_patterns():
    import random

    pick = random.Random(11)
    some = ["1", "25", "255", "256", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "x@y.zz", "4111", "1111 1111", "٣", "é", "\n", "+1 555", "0001.", "%", "_"]
    for _ in range(30_000):
        text = "".join(pick.choices(some, k=pick.randint(1, 16)))
        assert pii.base_spans(text) == plain_base(text), text


#: Disguised identifiers by language, as their kind and the text around: {} is where they stand.
FRAMES = {"en": "You can reach me under {} until Friday.", "de": "Sie erreichen mich unter {} bis Freitag.", "fr": "Vous pouvez me joindre au {} avant vendredi.", "es": "Me puede encontrar en {} hasta el viernes."}
DISGUISES = {
    "en": [("email", "jane.roe at example dot com"), ("email", "jane (at) example (dot) org"), ("email", "jane [at] mail.example.net"), ("email", "jаne@exаmple.org"), ("email", "jane_at_example_dot_com"), ("phone", "plus one five five five two one nine four four seven one"), ("phone", "+1 five five five 219 four four seven one"), ("ip", "10 dot 0 dot 0 dot 7"), ("ip", "one nine two.168.0.one"), ("card", "four one one one 1111 1111 one one one one"), ("email", "jane\u200b@example.com"), ("phone", "+１ ５５５ ２１９ ４４７１")],
    "de": [("email", "max punkt muster (at) beispiel (punkt) de"), ("email", "max.muster at beispiel punkt de"), ("email", "max [ät] beispiel [punkt] de"), ("phone", "+49 drei null eins zwei drei vier fünf sechs sieben"), ("phone", "plus vier neun drei null eins zwei drei vier fünf"), ("ip", "zehn 10 punkt 1 punkt 2 punkt 3"), ("card", "vier eins eins eins 1111 1111 eins eins eins eins")],
    "fr": [("email", "marie (arobase) exemple (point) fr"), ("email", "marie [chez] exemple [point] fr"), ("email", "marie at exemple point fr"), ("phone", "+33 un deux trois quatre cinq six sept huit neuf"), ("phone", "plus trois trois un deux trois quatre cinq six sept"), ("ip", "10 point 1 point 2 point 3"), ("card", "quatre un un un 1111 1111 un un un un")],
    "es": [("email", "ana arroba ejemplo punto es"), ("email", "ana (arroba) ejemplo (punto) es"), ("email", "ana[arroba]ejemplo.es"), ("phone", "+34 nueve uno dos tres cuatro cinco seis siete ocho"), ("phone", "+34 nueve uno dos, tres cuatro cinco, seis siete ocho"), ("ip", "10 punto 1 punto 2 punto 3"), ("card", "cuatro uno uno uno 1111 1111 uno uno uno uno")],
}


def test_pii_recall_of_disguises():
    for lang, planted in DISGUISES.items():
        found = 0
        for kind, said in planted:
            text = FRAMES[lang].format(said)
            start = text.index(said)
            found += any(k == kind and a < start + len(said) and start < b and b - a >= 0.6 * len(said) for k, a, b in pii.spans(text)[1])
        assert found >= 0.9 * len(planted) - 0.5, (lang, [s for k, s in planted if not any(x[0] == k for x in pii.spans(FRAMES[lang].format(s))[1])])
    assert all(pii.spans(f.format("diesem Ort at home, point one, und dot"))[1] == [] for f in FRAMES.values())


def test_pii_find_of_rows(spark, sample):
    """All four kinds and the digests, over odd rows; an empty table."""
    docs = texts(sample)
    for r in queries.pii_digests(pii.find(sample.withColumns({"base": F.lit(1), "spans": F.lit("x")}))).collect():
        want = plain_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in pii.KINDS]
        listed = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert listed == [(k, str(a), str(b)) for k, a, b in pii.spans(docs[r.doc_id])[1]]
    assert pii.find(spark.createDataFrame([], EMPTY)).isEmpty() and pii.mask(spark.createDataFrame([], EMPTY)).isEmpty()


def test_pii_base(sample):
    docs = texts(sample)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    for r in pii.find(sample).collect():
        assert [(x.start, x.end) for x in r.base if x.kind == "email"] == [m.span() for m in email.finditer(docs[r.doc_id])]
        assert all(x in r.spans for x in r.base)


def test_language(spark, sample):
    docs = sample.where("doc_id < 1000")
    odd = sample.withColumns({"lang_pred": F.lit("x"), "score": F.lit("y")})
    found = {r.doc_id: r for r in language.predict(odd, language.train(docs)).collect()}
    assert all(found[d].lang_pred == "und" for d in (1001, 1002, 1003, 1006))
    held = docs.where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.9 * len(held)
    none = spark.createDataFrame([], EMPTY)
    assert language.predict(sample, language.train(none)).where("lang_pred <> 'und'").isEmpty()
    assert language.predict(none, language.train(docs)).isEmpty() and language.keep(none, language.train(docs)).isEmpty()


def test_language_kernel():
    """Presence by its definition, and scores against kernel ridge regression written out (all texts are landmarks)."""
    import numpy as np

    def cells(text):
        out = set()
        code = [0x20 if c < 0x61 or 0x7A < c < 0xC0 else c for c in map(ord, text.lower())]
        for n in range(1, language.LONGEST + 1):
            for k in range(len(code) - n + 1):
                h = 0
                for c in code[k : k + n]:
                    h = (h * 0x01000193 + c) & 0xFFFFFFFF
                h ^= h >> 15
                out.add(((h * 0x9E3779B1 & 0xFFFFFFFF) >> 11) % language.CELLS)
        return out

    known = [("de", "Der schnelle Fuchs springt über den Hund"), ("en", "The quick fox jumps over the dog"), ("fr", "Le renard rapide saute par-dessus le chien"), ("en", "A calm and sunny day at the sea"), ("de", "Ein ruhiger und sonniger Tag am Meer"), ("fr", "Une journée calme et ensoleillée à la mer")]
    new = ["The dog and the fox", "Der Hund und der Fuchs", "Le chien et le renard", "12 3", "d"]
    for text in [*new, *(t for _, t in known)]:
        assert set(np.flatnonzero(language.presence([text])[0]).tolist()) == cells(text)
    model = language.fit(known, landmarks=len(known))
    kernel = lambda a, b: len(cells(a) & cells(b)) / math.sqrt(len(cells(a)) * len(cells(b)))
    every = [t for _, t in known]
    square = np.array([[kernel(a, b) for b in every] for a in every])
    middle = np.eye(len(every)) - 1 / len(every)
    y = np.array([[1.0 if lang == other else -1.0 for other in model.languages] for lang, _ in known])
    dual = np.linalg.solve(middle @ square @ middle + language.RIDGE * len(every) / 100 * np.eye(len(every)), y - y.mean(0))
    for text, got in zip(new, model.scores(new), strict=True):
        row = np.array([kernel(text, b) for b in every])
        want = (row - square.mean(0)) @ middle @ dual + y.mean(0)
        assert np.allclose(got, want, atol=2e-3), (text, got, want)


def test_language_many(spark):
    """No bound on the number of languages; one that has only long texts is learnt too."""
    words = {k: [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in ("ino", "ara", "est", "um", "ok")] for k in range(70)}
    rows = [(100 * k + j, " ".join((words[k] * 6)[j : j + 20]) * (1500 if k == 69 else 1), f"l{k}") for k in range(70) for j in range(8)]
    docs = spark.createDataFrame(rows, EMPTY.replace("lang", "lang"))
    model = language.train(docs)
    assert len(model.languages) == 70
    found = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert sum(found[d] == lang for d, _, lang in rows) >= 0.9 * len(rows)
    assert sum(found[6900 + j] == "l69" for j in range(8)) >= 6


def test_toxicity(spark):
    docs = spark.createDataFrame([(k, ("you vile dirty scum " if k % 2 else "a calm and sunny day ") * 3 + str(k)) for k in range(200)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((scored[k] >= 0.5) == bool(k % 2) for k in range(200)) and 0 <= scored[900] <= 1
    untrained = toxicity.score(docs, toxicity.train(docs, labels.where("false"))).collect()
    assert all(0 <= r.score <= 1 for r in untrained)


def test_toxicity_models(spark):
    """Counts, backoff and ratios against Kneser-Ney written out over a few texts; the score against its formula."""
    import numpy as np

    kinds = {1: ["you vile scum", "vile scum you are", "Ты мерзкий"], 0: ["a calm day", "you are a calm one", "Ты добрый"]}

    def symbols(text):
        out = [0]
        for c in text:
            n = int(toxicity.fold()[ord(c)])
            if n or out[-1]:
                out.append(n)
        return [0] * 3 + out + ([0] if out[-1] else [])

    def grams(text):
        line = symbols(text)
        return [tuple(line[k - 4 : k + 1]) for k in range(4, len(line))]

    counts = {k: Counter(g for t in some for g in grams(t)) for k, some in kinds.items()}
    tables = np.zeros((2, toxicity.SYMBOLS**toxicity.ORDER), np.int32)
    for k, some in kinds.items():
        for t in some:
            np.add.at(tables[k], toxicity.sequences(t), 1)
    code = lambda g: sum(c * 27**p for p, c in enumerate(reversed(g)))
    assert all({code(g): n for g, n in counts[k].items()} == {int(c): int(tables[k][c]) for c in np.flatnonzero(tables[k])} for k in kinds)

    def lower(gram):
        """The shared chain: distinct longer sequences that end so, over both classes."""
        if not gram:
            return 1 / 27
        longer = {0: {g for k in kinds for g in counts[k]}}
        for n in range(1, 5):
            longer[n] = {g[1:] for g in longer[n - 1]}
        kinds_of = Counter(g[1:] for g in longer[4 - len(gram)])
        total = sum(n for g, n in kinds_of.items() if g[:-1] == gram[:-1])
        if not total:
            return lower(gram[1:])
        after = sum(g[:-1] == gram[:-1] for g in kinds_of)
        return (max(kinds_of[gram] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * after * lower(gram[1:])) / total

    def chance(kind, gram):
        same = {g: n for g, n in counts[kind].items() if g[:-1] == gram[:-1]}
        if not same:
            return lower(gram[1:])
        return (max(same.get(gram, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(same) * lower(gram[1:])) / sum(same.values())

    ratios = toxicity.log_ratios(tables[1], tables[0])
    for text in ["vile calm", "you are scum", "Ты", "zz"]:
        for g in grams(text):
            assert math.isclose(ratios[code(g)], math.log(chance(1, g) / chance(0, g)), abs_tol=0.01), g
    assert math.isclose(sum(chance(1, (*grams("you")[2][:4], c)) for c in range(27)), 1, abs_tol=1e-9)


def test_toxicity_labels_and_scripts(spark):
    """Other scripts have evidence, repeated labels count once and the toxic one holds, other columns don't matter."""
    foul, mild = ("ты мерзкая дрянь", "σκουπίδι είσαι", "你 是 垃圾 废物"), ("тихий ясный день", "ήσυχη μέρα", "今天 天气 很 好")
    rows = [(k, (foul if k % 2 else mild)[k // 2 % 3] + " " + "один два три"[: k % 7]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"toxic": F.lit(1), "link": F.lit("x"), "score": F.lit(2)})
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(1, 0), (3, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == 300
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == bool(r.doc_id % 2) for r in held) >= 0.95 * len(held)
    assert toxicity.score(spark.createDataFrame([], EMPTY), toxicity.train(docs, labels)).isEmpty()


def test_toxicity_counts_stay_in_tasks(spark):
    """The driver held both tables of counts, 115 MB of each kind of copy, on a handful of rows too."""
    docs = spark.createDataFrame([(k, ("you foul rat " if k % 2 else "a fine day ") * 9) for k in range(100)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as toxic")
    toxicity.fold()
    tracemalloc.start()
    model = toxicity.train(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6 and model.score("foul rat") > 0.5 > model.score("fine day")


def test_toxicity_held_out(spark):
    """Some four in ten toxic labels stand on texts without any foul word, so half of them is much."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.train(docs, labels)).where("crc32(cast(doc_id as string)) % 5 = 0")
    found = found.join(labels, "doc_id").join(docs.select("doc_id", F.coalesce(F.expr(r"text rlike '(?i)\\b(idiot|moron|scum|trash|loser)\\b'"), F.lit(False)).alias("foul")), "doc_id").collect()
    caught = lambda rows: sum(r.score >= 0.5 for r in rows) / len(rows)
    assert caught([r for r in found if r.foul]) >= 0.95
    assert caught([r for r in found if r.toxic == 1]) >= 0.5 and caught([r for r in found if r.toxic == 0]) <= 0.02


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen = Counter(windows)
    inside = {k + i for k, w in enumerate(windows) if seen[w] > 1 for i in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality(spark, sample):
    docs = texts(sample)
    trusted = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    for r in quality.judge(sample, quality.log_ratios(sample, trusted)).collect():
        want = plain_rules(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels", "conversations"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=str) == sorted(want.select(*sorted(want.columns)).fetchall(), key=str)


def test_quality_verdict_and_filter(spark):
    """Held-out labels agree with the verdict, and a filter on it costs no second computation."""
    import time

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit = F.expr("crc32(cast(doc_id as string)) % 2 = 0")
    ratios = quality.log_ratios(docs, labels.where("quality = 1").where(fit))
    judged = quality.judge(docs, ratios)
    seconds = []
    for frame in (judged, judged, judged.where("kept").select("doc_id"), judged.where("kept")):
        began = time.time()
        frame.write.format("noop").mode("overwrite").save()
        seconds.append(time.time() - began)
    assert max(seconds[2:]) <= 1.5 * seconds[1] + 1
    held = judged.join(labels, "doc_id").where(~fit).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    share = {r.quality: r.kept for r in held.collect()}
    assert share[1] >= 0.95 and share[0] <= 0.1


def test_quality_in_one_reading(spark, sample):
    """Verdicts from written measures are those of judge() by log_ratios(); null, empty and repeated rows, any extra columns."""
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a a b"), (3, "a " * 40), (3, "a " * 40)], "doc_id long, text string")
    docs = sample.select("doc_id", "text").unionByName(odd).withColumns({c: F.lit(7) for c in ("marks", "weights", "h", "cells", "score")})
    trusted = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    one, two = quality.verdicts(docs, trusted), quality.judge(docs, quality.log_ratios(docs, trusted))
    assert one.columns == two.columns
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    assert one.count() == docs.count()
    assert quality.verdicts(docs.where("false"), trusted).isEmpty()


def test_quality_of_nothing(spark):
    none, labels = spark.createDataFrame([], EMPTY), spark.createDataFrame([(1,)], "doc_id long")
    assert quality.judge(none, quality.log_ratios(none, labels)).isEmpty()
    odd = spark.createDataFrame([(1, "a b c " * 9, 1, 2, "x"), (None, None, 3, 4, "y")], "doc_id long, text string, cells int, weights int, words string")
    assert {r.n_words for r in quality.judge(odd, quality.log_ratios(odd, labels.where("false"))).collect()} == {27, 0}


def test_quality_sees_word_order(spark):
    """A stutter of trusted words that the base rules pass."""
    plain = "This is the first of many calm and sunny days that we have seen here this year".split()
    good = [(k, " ".join(plain[k % 5 :] + plain[: k % 5])) for k in range(60)]
    stutter = " ".join(w for w in plain for _ in range(2))
    docs = spark.createDataFrame([*good, *((100 + k, stutter) for k in range(3))], "doc_id long, text string")
    trusted = spark.createDataFrame([(k,) for k in range(60)], "doc_id long")
    found = {r.doc_id: r for r in quality.judge(docs, quality.log_ratios(docs, trusted)).collect()}
    assert all(found[k].kept for k in range(60))
    assert not any(found[k].base_failed or found[k].kept for k in range(100, 103))


def test_every_query_returns_every_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in queries.QUERIES.items():
        if name not in ("op12_spelling", "op13_conversations"):  # of words and conversations
            assert query(spark, SF).select("doc_id").distinct().count() == n, name


def test_pipeline(spark):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in packed.select("doc_id").collect()}
    docs = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    bodies = Counter(re.sub(r"[\x20\x09-\x0D]+", "", docs[d]) for d in kept)
    assert max(bodies.values()) == 1
    prints = [plain_fingerprint(docs[d]) for d in kept]
    assert all((a ^ b).bit_count() > 3 for k, a in enumerate(prints) for b in prints[:k])


def test_pipeline_by_brute_force(spark, sample):
    """Every stage over odd rows: null and repeated ids, nulls, empty and long texts, repeated rows, clashing columns."""
    import corpus_pipeline

    near = "the calm quiet morning by the sea was followed by one loud and windy evening in the harbour of the old town"
    more = [(None, near, "en"), (None, near + " again", "en"), (2000, near, "en"), (2001, near + " again", "en"), (2002, "write to max.muster@beispiel.de or call +49 301 234 567 8", "de"), (2003, "something else entirely, which nobody wrote before", "en"), (2003, "and another text that has the same id as the one before it", "en")]
    docs = sample.unionByName(spark.createDataFrame(more, EMPTY), allowMissingColumns=True).withColumns({"key": F.lit("k"), "fp": F.lit(1), "root": F.lit(2), "place": F.lit(3)})
    stages = dict(corpus_pipeline.STAGES)
    lettered = stages["language_id"](spark, docs, SF)
    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    want = Counter({k: n for k, n in pairs(docs).items() if k[1] and any(map(str.isalpha, k[1]))})
    assert pairs(lettered) == want and lettered.columns == docs.columns

    unique = stages["exact_dedup"](spark, lettered, SF)
    groups = defaultdict(list)
    for d, t in want:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t)].append((-len(t), d is None, d or 0, d, t))
    got = pairs(unique)
    assert max(got.values()) == 1 and unique.columns == docs.columns
    assert all(min(g)[3:] in got for g in groups.values()) and len(got) == len(groups)

    apart = stages["near_dedup"](spark, unique, SF)
    left, rows = pairs(apart), list(got)
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(prints):
        for j in range(k):
            if (a ^ prints[j]).bit_count() <= 3:
                root[find(k)] = find(j)
    classes = defaultdict(list)
    for k, row in enumerate(rows):
        classes[find(k)].append(row)
    assert max(left.values()) == 1 and len(left) == len(classes) and apart.columns == docs.columns
    for members in classes.values():
        stays = [row for row in members if row in left]
        known = [d for d, _ in members if d is not None]
        assert len(stays) == 1 and (stays[0][0] == min(known) if known else stays[0][0] is None)

    masked = stages["mask_pii"](spark, apart, SF)
    assert pairs(masked) == Counter((d, pii.mask_text(t)) for d, t in left)
    assert (2002, "write to [EMAIL] or call [PHONE]") in pairs(masked)
    packed = stages["pack"](spark, masked, SF)
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter(d for d, _ in left)
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).isEmpty()


def test_release(spark):
    import os

    from textveil.llm import common

    path = common.durable(spark.range(3), "some").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and common.release(spark) >= 1 and not os.path.exists(path)
