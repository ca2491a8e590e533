"""Steps that take a document whole give what the same steps give on rows."""

import random

from pyspark.sql import functions as F
from textveil.functions import subwords
from textveil.operators import bio
from textveil.plans import queries

KIND = "doc_id long, text string, gold array<struct<s: int, e: int, label: string>>"


def odd(spark, n=60):
    pick = random.Random(5)
    rows = [(1, None, [(0, 3, "SSN")]), (2, "", None), (3, "a", []), (4, "é𝄞x yy", [(0, 3, "NAME"), (2, 4, "SSN"), (4, 4, "DATE")])]
    for k in range(5, n):
        text = "".join(pick.choice(["record", " ", "x", "12", "-", "\U0001d11e", "account "]) for _ in range(pick.randrange(90)))
        starts = [pick.randrange(len(text) + 1) for _ in range(pick.randrange(6))]
        rows.append((k, text, [(s, s + pick.randrange(7), pick.choice(["SSN", "DATE", "AGE"])) for s in starts]))
    return spark.createDataFrame(rows, KIND)


def plain(text_spans):
    """Tags of tokens, written out."""
    tokens, spans = text_spans
    out = []
    for i, (s, e) in enumerate(tokens):
        own = [g for g in spans or [] if s < g.e and g.s < e]
        out.append("O" if not own else ("B-" if i == 0 or tokens[i - 1][1] <= own[-1].s else "I-") + own[-1].label)
    return out


def test_tags_and_entities(spark):
    docs = odd(spark)
    got = {r.doc_id: r for r in bio.tagged(docs.withColumn("n", F.lit(0)), "gold").join(docs, "doc_id").collect()}
    assert len(got) == docs.count()
    for r in got.values():
        tokens = [(x.ts, x.te) for x in r.tagged or []]
        assert [x.tag for x in r.tagged or []] == plain((tokens, r.gold)) and [x.pos for x in r.tagged] == list(range(len(tokens)))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "s", "e", "label").collect()))
    flat = bio.entities(docs, ["gold"]).select("doc_id", F.inline("gold"))
    assert key(flat) == key(bio.decode(bio.align(docs, "gold"))) and not flat.isEmpty()


def test_subwords_of_a_document_in_one_step(spark):
    """One shuffle at least was made for each of merge() and decode(); none is now, and a batch of 10,000 notes is cut in parts."""
    docs = odd(spark)
    cut = subwords.add(docs, bio.tokens(), queries.vocabulary(), longest=40)
    told = "transform(tagged, x -> named_struct('pos', x.pos, 'ts', x.ts, 'te', x.te, 'tag', x.tag, 'tag_id', x.tag_id, 'word', x.word, 'score', (doc_id + x.pos * 7) % 5 / 5))"
    rows = bio.tagged(cut, "gold", cut=F.col("pieces")).withColumn("tagged", F.expr(told))
    assert {r.n for r in rows.select(F.size("tagged").alias("n")).collect()} == {40}
    flat = bio.merged(rows).select("doc_id", F.inline("spans"))
    same = bio.decode(bio.merge(rows.select("doc_id", F.inline("tagged"))))
    key = lambda df: sorted(map(tuple, df.select("doc_id", "s", "e", "label").collect()))
    assert key(flat) == key(same) and not flat.isEmpty()
    for name in ("bio_subwords", "subword_merge"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan
