"""Sub-words, and the tagger: gradients, decoding, what it finds in notes of other templates, and how its weights travel."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from textveil.functions import subwords
from textveil.operators import bio, detectors, latency, tagger
from textveil.plans import queries
from textveil.sources import synthetic

VOCABULARY = ["[PAD]", "[UNK]", "un", "##aff", "##able", "##a", "##ff", "run", "##n", "##ing", "a", "é", "."]


def test_trie():
    trie = subwords.Trie(VOCABULARY)
    assert trie.cut("unaffable") == [(0, 2, "un"), (2, 5, "##aff"), (5, 9, "##able")]
    assert trie.cut("Running") == [(0, 3, "run"), (3, 4, "##n"), (4, 7, "##ing")]
    assert trie.cut("unzip") == [(0, 5, "[UNK]")] and trie.cut("\u0130a") == [(0, 2, "[UNK]")] and trie.cut("a" * 101) == [(0, 101, "[UNK]")]
    assert trie.cut("É") == [(0, 1, "é")]


def test_subwords(spark):
    """Parts stand where they say; tokens without text are O and pad each document to the same length."""
    docs = spark.createDataFrame([(1, "Unaffable, running É."), (2, None), (3, ""), (4, "run " * 300), (5, "é" * 150 + " a")], "doc_id long, text string")
    cut = subwords.add(docs, bio.tokens(), VOCABULARY)
    for r in cut.collect():
        assert len(r.pieces) == 256 and (r.pieces[0].piece, r.pieces[-1].piece) == ("[CLS]", "[SEP]" if r.doc_id == 4 else "[PAD]")
        for x in r.pieces:
            assert (x.m == "") == (x.word is None) and (r.text or "")[x.s : x.s + len(x.m)] == x.m
            assert x.word is None or x.piece == "[UNK]" or x.piece.removeprefix("##") == x.m.lower()
    assert [x.piece for x in cut.where("doc_id = 1").first().pieces[:9]] == ["[CLS]", "un", "##aff", "##able", "[UNK]", "run", "##n", "##ing", "é"]
    marked = cut.withColumn("gold", F.expr("array(named_struct('s', 0, 'e', 9, 'label', 'NAME'), named_struct('s', 11, 'e', 18, 'label', 'AGE'))"))
    rows = bio.align(marked.where("doc_id = 1"), "gold", cut=F.col("pieces"))
    assert [r.tag for r in rows.orderBy("pos").limit(10).collect()] == ["O", "B-NAME", "I-NAME", "I-NAME", "O", "B-AGE", "I-AGE", "I-AGE", "O", "O"]
    assert rows.count() == 256 and rows.where("word is null and tag_id <> 0").isEmpty()


def test_merge(spark):
    rows = [(1, 1, 0, 2, "B-NAME", 1, 0, 0.2), (1, 2, 2, 5, "O", 0, 0, 0.9), (1, 3, 6, 8, "O", 0, 1, 0.5), (1, 4, 8, 9, "B-AGE", 3, 1, 0.5), (1, 5, 10, 12, "O", 0, 2, 0.1), (1, 6, 12, 14, "B-AGE", 3, 2, 0.3), (1, 0, 0, 0, "B-AGE", 3, None, 9.0)]
    merged = bio.merge(spark.createDataFrame(rows, "doc_id long, pos int, ts int, te int, tag string, tag_id int, word int, score double"))
    assert sorted(map(tuple, merged.collect())) == [(1, 0, 0, 5, "O"), (1, 1, 6, 9, "O"), (1, 2, 10, 14, "B-AGE")]


def test_gradient():
    rng = np.random.default_rng(1)
    cells, ids = rng.integers(0, 50, (30, 12)).astype(np.int32), rng.integers(0, len(tagger.TAGS), 30)
    weights = rng.normal(size=(tagger.CELLS, len(tagger.TAGS))) * 0.1
    flat, loss, total = tagger.gradient(cells, ids, weights)
    assert total == tagger.WEIGHT[ids].sum()
    for cell, tag in ((int(cells[0, 0]), int(ids[0])), (int(cells[3, 4]), 0), (7, 9)):
        moved = weights.copy()
        moved[cell, tag] += 1e-6
        assert abs((tagger.gradient(cells, ids, moved)[1] - loss) / 1e-6 - flat[cell, tag]) < 1e-3 * max(1, abs(flat[cell, tag]))


def test_viterbi():
    rng = np.random.default_rng(2)
    some = [0, 1, 2, 3, 4]  # O and two labels; the others never win
    for _ in range(20):
        logits = np.full((4, len(tagger.TAGS)), -99.0)
        logits[:, some] = rng.normal(size=(4, 5))
        allowed = lambda seq: all(tagger.FOLLOWS[a, b] == 0 for a, b in zip((0, *seq), seq))
        best = max((s for s in itertools.product(some, repeat=4) if allowed(s)), key=lambda s: sum(logits[k, t] for k, t in enumerate(s)))
        assert tuple(tagger.viterbi(logits)) == best


@pytest.fixture(scope="module")
def fitted(spark):
    learnt, tried = (synthetic.generate(spark, n, seed, split).withColumnRenamed("entities", "gold").persist() for n, seed, split in ((700, 1, "train"), (200, 2, "eval")))
    return *tagger.fit(learnt.withColumn("other", F.lit(1)), tried, epochs=4), tried


def test_tagger(spark, fitted):
    """Notes of templates that it has not seen: most identifiers are found, names more often than by a list of surnames."""
    model, log, tried = fitted
    rows = log.orderBy("ord").collect()
    best = latency.best_epoch(log).first()
    assert len(rows) == 4 and rows[-1].loss < rows[0].loss and best.recall == max(r.recall for r in rows) > 0.87
    assert tagger.scores(tried, tagger.detector(model)).first().r == best.recall
    names = tagger.scores(tried, tagger.detector(model), label="NAME").first().r
    stand_in = lambda docs, text, into: queries._surname_spans(docs.withColumn("source", F.lit("?"))).withColumnRenamed("model", into)
    assert names > 0.9 > tagger.scores(tried, stand_in, label="NAME").first().r


def test_weights_travel(spark, fitted, tmp_path):
    model, _, tried = fitted
    path = str(tmp_path / "weights.npy")
    digest = model.save(path)
    both = tagger.scores(tried, tagger.source(spark, path, digest)).first()
    assert both.r > tagger.scores(tried, tagger.source(spark, str(tmp_path / "absent"))).first().r  # patterns alone
    assert tagger.source(spark, None) is detectors.patterns
    other = str(tmp_path / "other.npy")
    model.save(other)
    with pytest.raises(Exception, match="not the file"):
        tagger.scores(tried, tagger.source(spark, other, "0" * 64)).collect()


def test_tagger_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", []), (3, "no one", None), (None, "Ida Ida", [(0, 3, "NAME")]), (None, "Ida Ida", [(0, 3, "NAME")])], "doc_id long, text string, gold array<struct<s: int, e: int, label: string>>")
    model, log = tagger.fit(docs, docs, epochs=2)
    assert log.count() == 2 and {len(r.spans) for r in tagger.detector(model)(docs, "text", "spans").where("coalesce(text, '') = ''").collect()} == {0}
    none, empty = tagger.fit(docs.where("false"), docs, epochs=2)
    assert empty.isEmpty() and none(["Ida"]) == [[]]


def test_many_texts_at_once():
    """Texts tagged together get the tags that each gets by itself."""
    pick = np.random.default_rng(3)
    sizes = np.array([0, 3, 1, 7, 0, 7, 2, 5])
    logits = pick.integers(-3, 4, (sizes.sum(), len(tagger.TAGS))).astype(float)  # whole numbers: ties
    one = [tagger.viterbi(x) for x in np.split(logits, np.cumsum(sizes)[:-1]) if len(x)]
    assert tagger.best_tags(logits, sizes).tolist() == np.concatenate(one).tolist()
    assert tagger.best_tags(logits[:0], np.zeros(2, int)).tolist() == []
    model = tagger.Model(pick.normal(size=(tagger.CELLS, len(tagger.TAGS))))
    texts = ["Dr. Gomes saw 123-45-6789", "", "x", "é𝄞 12"] * 100
    assert model(texts) == [model([t])[0] for t in texts]
