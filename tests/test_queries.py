"""Each query against its SQL, and the invariants of those without."""

import os
import re
from pathlib import Path

import duckdb
import pytest
from textveil.functions import spans
from textveil.operators import detectors, scoring
from textveil.plans.registry import ORACLE_SQL, QUERIES
from textveil.sources import synthetic
from textveil.sources import text as texts

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    tidy = lambda v: "" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return list(frame.columns), sorted(tuple(map(tidy, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).iterdir():
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


def test_synthetic(spark):
    train, held = synthetic.TEMPLATES["train"], synthetic.TEMPLATES["eval"]
    assert (len(train), len(held)) == (30, 20) and not set(train) & set(held)
    assert not any("{NAME_REV}" in t or "{SPECIALTY}" in t for t in held)
    docs = synthetic.generate(spark, 300, 777, "eval")
    assert docs.selectExpr("inline(entities)").where("e <= s or label is null").isEmpty()
    assert docs.collect() == synthetic.generate(spark, 300, 777, "eval").collect()
    upper = docs.where("text = upper(text)").count()
    assert 20 <= upper <= 75
    rows = synthetic.generate(spark, 2000).selectExpr("text", "inline(entities)").selectExpr("label", "substring(text, s + 1, e - s) as part").collect()
    doctors = {r.part.split()[-1] for r in rows if r.label == "NAME" and r.part.startswith("Dr. ")}
    assert doctors & set(synthetic.EPONYMS) and doctors - set(synthetic.EPONYMS)  # an eponym's surname is a name on a doctor only
    assert not any("disease" in r.part.lower() for r in rows)
    plates = [r.part for r in rows if r.label == "VEHICLE"]
    assert not any(set("IO") & set(p.upper()[:3]) for p in plates) and len({p.upper()[:3] for p in plates}) > 0.9 * len(plates)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert texts.read(spark, str(tmp_path)).first().text == "one\ntwo"
    named = texts.named(spark.createDataFrame([(5, None), (7, "x"), (9, None)], "doc_id long, source string"))
    assert [r.source for r in named.orderBy("doc_id").collect()] == ["example_0", "x", "example_2"]
    many = texts.placed(spark.range(5000).selectExpr("id * 3 as doc_id", "'x' as place_of").repartition(7), ranges=16)
    assert [r.place for r in many.orderBy("doc_id").collect()] == list(range(5000))
    assert texts.named(spark.createDataFrame([], "doc_id long, source string")).isEmpty()
    assert texts.sample(spark).count() == 1


def test_locate(spark):
    """Parts are sought after the one before, then from the start; a part that is not there is an error."""
    row = lambda *parts: spark.createDataFrame([("a b a c", [{"part": p, "label": "X"} for p in parts])], "text string, wanted array<struct<part: string, label: string>>")
    found = lambda *parts: [(x.s, x.e) for x in row(*parts).select(spans.locate("text", "wanted").alias("x")).first().x]
    assert found("a", "a") == [(0, 1), (4, 5)] and found("c", "b") == [(2, 3), (6, 7)]
    with pytest.raises(Exception, match="no such part"):
        found("z")


def test_detectors(spark):
    def shouted():
        """A model: words in capitals are names."""
        return lambda some: [[(m.start(), m.end(), "PERSON") for m in re.finditer(r"\b[A-Z]{3,}\b", t)] + [(0, 1, "ELSE")] * bool(t) for t in some]

    docs = spark.createDataFrame([(1, "ANNA has 123-45-6789"), (2, None), (3, ""), (4, "BOB wrote to bob@x.org")], "doc_id long, text string")
    found = lambda d: {r.doc_id: [(x.s, x.e, x.label) for x in r.spans] for r in d(docs, "text", "spans").collect()}
    assert found(detectors.foreign(shouted))[1] == [(0, 4, "NAME")]
    both = found(detectors.select(load=None, detector=detectors.ensemble(detectors.foreign(shouted))))
    assert both == {1: [(0, 4, "NAME"), (9, 20, "SSN")], 2: [], 3: [], 4: [(0, 3, "NAME"), (13, 22, "EMAIL")]}
    assert found(detectors.select()) == {1: [(9, 20, "SSN")], 2: [], 3: [], 4: [(13, 22, "EMAIL")]}
    assert found(detectors.select(load=shouted))[1][0] == (0, 1, "ELSE")


def test_report_of_odd_rows(spark):
    """Repeated spans count once, a wrong label is found and missed, nulls are empty, a key without a gold span has a row."""
    kind = "k string, doc_id long, found array<struct<s: int, e: int, label: string>>, gold array<struct<s: int, e: int, label: string>>"
    a, b, wrong = (0, 3, "SSN"), (5, 9, "DATE"), (5, 9, "AGE")
    docs = spark.createDataFrame([("x", 1, [a, a, wrong], [a, b]), ("x", 2, None, [b]), ("x", 3, [a], [a, a]), ("y", 4, [], None)], kind)
    got = {r.k: r.asDict() for r in scoring.report(docs, ("k",)).collect()}
    assert (got["x"]["tp"], got["x"]["fp"], got["x"]["fn"], got["x"]["docs"], got["x"]["leaking"]) == (2, 1, 2, 3, 2)
    assert got["y"] == {"k": "y", "tp": 0, "fp": 0, "fn": 0, "p": 0.0, "r": 0.0, "f1": 0.0, "docs": 1, "leaking": 0, "leak_rate": 0.0}
    assert scoring.report(docs.where("false"), ("k",)).isEmpty()


def test_absent_detectors(spark):
    """Models that an executor can't load are left out with the reason; other errors are not hidden."""

    def capitals():
        return lambda every: [[(0, 1, "NAME")] if t[:1].isupper() else [] for t in every]

    def package():
        import no_such_package_anywhere  # noqa: F401

    def weights():
        return open("/nowhere/weights.bin")

    def broken():
        raise ValueError("weights of another shape")

    kept, absent = detectors.present(spark, {"capitals": capitals, "package": package, "weights": weights})
    assert list(kept) == ["capitals"]
    assert [(r.detector, r.missing == r.tasks > 0, r.reason.split(":")[0]) for r in absent] == [("package", True, "ModuleNotFoundError"), ("weights", True, "FileNotFoundError")]
    docs = spark.createDataFrame([(1, "Anna"), (2, "ben"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: len(r.spans) for r in kept["capitals"](docs, "text", "spans").collect()} == {1: 1, 2: 0, 3: 0}
    assert detectors.present(spark, {}) == ({}, [])
    with pytest.raises(Exception, match="another shape"):
        detectors.present(spark, {"broken": broken})
