"""Long documents: the ways for many spans give what the plain ones give, in time that grows with the document."""

import random
import time

import pytest
from pyspark.sql import functions as F

from test_detection import greedy
from textveil.functions import long, spans
from textveil.operators import masking, restore, roundtrip

PIECES = ["123-45-67{:02d}", "12-3456-{:03d}", "a{}@b.co", "http://x/{}", "10.0.0.{}", "fax 555-846-0{:03d}", "age 1{:02d}", "3/4/20{:02d}", "ems-2019-{:04d}", "é", "EMS-2019-77{:02d}", "(555) 846-0{:03d}", "fax", "\n"]


def document(n, seed=1):
    rng = random.Random(seed)
    return " ".join(rng.choice(PIECES).format(rng.randrange(10, 100)) for _ in range(n))


def brute_mask(text):
    """Masked text, and the mapping in order, of one document without dates or ages in it."""
    numbers, out, at, mapping = {}, [], 0, {}
    for s, e, label in greedy(text):
        own = numbers.setdefault(label, {})
        token = f"[{label}_{own.setdefault(text[s:e].lower(), len(own) + 1)}]"
        out += [text[at:s], token]
        mapping[token] = text[s:e]
        at = e
    return "".join(out) + text[at:], mapping


@pytest.mark.parametrize("n", [10, 70, 3000])
def test_detection(spark, n):
    docs = spark.createDataFrame([(1, document(n)), (2, document(n, 2))], "doc_id long, text string").repartition(2)
    for r in spans.with_spans(docs).collect():
        assert [tuple(x) for x in r.spans] == greedy(r.text)


@pytest.mark.parametrize("n", [70, 3000])
def test_masking(spark, n):
    text = document(n).replace("age", "aged").replace("3/4/", "3.4.")
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string").repartition(1)
    row = roundtrip.run(docs, "?", "key", lambda p: F.concat(p, F.lit(" [SSN_999999] [EMAIL_1]")), check=False).first()
    masked, mapping = brute_mask(text)
    assert row.masked == masked
    assert [(x.ordinal, x.masked, x.original) for x in row.entries] == [(k, m, o) for k, (m, o) in enumerate(mapping.items())]
    back = row.response
    for token in sorted(mapping, key=len, reverse=True):
        back = back.replace(token, mapping[token])
    assert row.restored == back and row.warnings == ["[SSN_999999]"]


def test_selfcheck_of_many(spark):
    """What only the second look finds is numbered from right to left behind the numbers there are."""
    none = f"cast(array() as {spans.SPANS})"
    text = " ".join(f"{k:03d}-45-6789" for k in range(900))
    docs = spark.createDataFrame([(text,)], "text string").withColumn("spans", F.expr(f"slice(transform(sequence(0, 4), k -> named_struct('s', k * 12, 'e', k * 12 + 11, 'label', 'SSN')), 1, 5)")).withColumn("shift", F.lit(1))
    done = masking.selfcheck(masking.mask(docs)).first().masked.split(" ")
    assert done[:5] == [f"[SSN_{k}]" for k in range(1, 6)] and done[5:] == [f"[SSN_{900 - k}]" for k in range(895)]
    assert masking.selfcheck(masking.mask(docs.withColumn("spans", F.expr(none)))).first().masked.split(" ")[0] == "[SSN_900]"


@pytest.mark.parametrize("n", [30, 400])
def test_ensemble(spark, n):
    rng = random.Random(n)
    taken, first = 0, []
    for _ in range(n):
        taken += rng.randrange(1, 9)
        first.append((taken, taken := taken + rng.randrange(1, 4), "A"))
    second = [(s, s + rng.randrange(1, 5), "B") for s in (rng.randrange(taken) for _ in range(n))]
    won = list(first)
    for c in sorted(second):
        if not any(s < c[1] and c[0] < e for s, e, _ in won):
            won.append(c)
    row = spark.createDataFrame([(first, second)], f"a {spans.SPANS}, b {spans.SPANS}")
    assert [tuple(x) for x in row.select(spans.ensemble("a", "b").alias("x")).first().x] == sorted(won)


def test_rehydration_of_many(spark):
    """An original that looks like a pseudonym or a date goes the plain way; so do chains of dates."""
    plain = [(k, f"[SSN_{k}]", f"{k:03d}") for k in range(1, 90)] + [(90, "01/11/2024", "01/06/2024"), (91, "01/06/2024", "01/01/2024")]
    odd = [(0, "[URL_1]", "http://x/[SSN_3]/01/06/2024"), *plain]
    text = "[SSN_3] [URL_1] [SSN_89] 01/11/2024 [ssn_1] [SSN_100]"

    def wanted(entries):
        out = text
        for _, masked, original in sorted(entries, key=lambda e: (-len(e[1]), e[0])):
            out = out.replace(masked, original)
        return out

    df = spark.createDataFrame([(text, plain), (text, odd)], "response string, entries array<struct<ordinal: int, masked: string, original: string>>")
    assert [r[0] for r in df.select(restore.rehydrated()).collect()] == [wanted(plain), wanted(odd)]
    assert [r[0] for r in df.select(restore.warnings()).collect()] == [["[URL_1]", "[SSN_100]"], ["[SSN_100]"]]


def test_parts(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("ab é\U0001f600\n") for _ in range(9000))
    places = [(rng.randrange(9000), rng.randrange(3000)) for _ in range(60)] + [(0, 0), (9000, 0), (1024, 1024), (1023, 1), (0, 9000)]
    df = spark.createDataFrame([(text, [(a, min(n, 9000 - a)) for a, n in places])], "t string, p array<struct<a: int, n: int>>").withColumn("c", F.expr(long.chunks("t")))
    got = df.select(F.expr(f"transform(p, x -> {long.cut('t', 'c', 'x.a', 'x.n')})")).first()[0]
    assert got == [text[a : a + min(n, 9000 - a)] for a, n in places]
    for n in (0, 1, 63, 64, 65, 4097):
        values = [rng.randrange(9) for _ in range(n)]
        sums = spark.createDataFrame([(values,)], "v array<int>").select(F.expr(long.starts("v"))).first()[0]
        assert sums == [sum(values[:k]) for k in range(n)]


def test_time(spark, tmp_path):
    """A document with 40,000 identifiers; the square of that would take minutes."""
    spark.createDataFrame([(1, document(46_000), "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    began = time.time()
    row = roundtrip.run(spark.read.parquet(str(tmp_path / "d")), "?", "key").select(F.size("entries"), F.length("restored")).first()
    assert row[0] > 500 and time.time() - began < 30
