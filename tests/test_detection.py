import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textveil.functions import patterns, spans
from textveil.operators import masking, restore

CASES = {
    "id 123-45-6789 ok": [(3, 14, "SSN")],
    "123-45-6789-123": [(0, 11, "SSN")],
    "plan 12-3456-789": [(5, 16, "HEALTHPLAN")],
    "OR-31-5508-274": [(3, 14, "HEALTHPLAN")],
    "ACCT-1234567": [(0, 12, "ACCOUNT")],
    "EMS-2019-7712": [(0, 8, "VEHICLE")],
    "ems-2019-7712": [(0, 13, "ID_OTHER")],
    "CLAIM-2024-123": [(0, 14, "ID_OTHER")],
    "MRN-1234": [(0, 8, "VEHICLE")],
    "MRN-12345": [(0, 9, "MRN")],
    "https://u@h.com/x": [(8, 15, "EMAIL")],
    "see http://a.b/c.": [(4, 17, "URL")],
    "HTTPS://A.B/C": [],
    "http://10.0.0.1/x": [(0, 17, "URL")],
    "999.999.999.999": [(0, 15, "IP")],
    "age 95": [(4, 6, "AGE")],
    "age 150": [(4, 7, "AGE")],
    "age 89": [],
    "Age  90": [(5, 7, "AGE")],
    "95-year-old": [],
    "call (555) 846-0931": [(5, 19, "PHONE")],
    "fax: 555-846-0932": [(5, 17, "FAX")],
    "555-846-0932 fax": [(0, 12, "PHONE")],
    "telefax" + " " * 22 + "555-846-0932": [(29, 41, "FAX")],
    "fax" + " " * 23 + "555-846-0932": [(26, 38, "PHONE")],
    "fax 555-846-0932 555-846-0935": [(4, 16, "FAX"), (17, 29, "FAX")],
    "3/4/24": [(0, 6, "DATE")],
    "March 3, 2024": [(0, 13, "DATE")],
    "MARCH 3, 2024": [],
    "": [],
    "é123-45-6789": [],
}


def found(spark, texts):
    df = spans.with_spans(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string"))
    return {r.text: [tuple(x) for x in r.spans] for r in df.collect()}


def test_cases(spark):
    assert found(spark, CASES) == CASES


def masked(spark, text, days=1, check=False):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out, mapping = masking.deidentify(docs, "doc_id", "s", check=check, shift_days=days)
    return out.first().masked, {r.masked: r.original for r in mapping.collect()}


def test_masking(spark):
    assert masked(spark, "A@x.org a@X.org") == ("[EMAIL_1] [EMAIL_1]", {"[EMAIL_1]": "a@X.org"})
    assert masked(spark, "3/4/2024 03/04/2024") == ("03/05/2024 03/05/2024", {"03/05/2024": "03/04/2024"})
    assert masked(spark, "March 3, 2024", 5)[0] == "March 08, 2024"
    assert masked(spark, "1/1/68 1/1/69")[0] == "01/02/68 01/02/69"
    assert masked(spark, "13/45/2024 2/30/2024")[0] == "[DATE_1] [DATE_2]"
    assert masked(spark, "March 3,2024")[0] == "[DATE_1]"
    assert masked(spark, "age 95", check=True) == ("age [AGE_1]+", {"[AGE_1]": "90"})
    assert masked(spark, "age 95") == ("age 90+", {})
    assert masked(spark, None) == ("", {})


def test_selfcheck_numbers_right_to_left(spark):
    none = "cast(array() as array<struct<s: int, e: int, label: string>>)"
    docs = spark.createDataFrame([("123-45-6789 987-65-4321",)], "text string").withColumn("spans", F.expr(none)).withColumn("shift", F.lit(1))
    assert masking.selfcheck(masking.mask(docs)).first().masked == "[SSN_2] [SSN_1]"


def test_rehydration(spark):
    rows = [("[SSN_1] [SSN_9] [ssn_1]", [(0, "[SSN_1]", "1")]), ("01/11/2024 01/06/2024", [(0, "01/11/2024", "01/06/2024"), (1, "01/06/2024", "01/01/2024")])]
    df = spark.createDataFrame(rows, "response string, entries array<struct<ordinal: int, masked: string, original: string>>")
    got = [(r[0], r[1]) for r in df.select(restore.rehydrated(), restore.warnings()).collect()]
    assert got == [("1 [SSN_9] [ssn_1]", ["[SSN_9]"]), ("01/01/2024 01/01/2024", [])]


def greedy(text):
    """The claim by Python's own matcher."""
    won = []
    for p in patterns.PATTERNS:
        for m in re.finditer(p.regex, text, re.IGNORECASE if p.ignore_case else 0):
            start, end = m.span(1) if p.label == "AGE" else m.span()
            label = p.label
            if label == "PHONE_OR_FAX":
                label = "FAX" if re.search(patterns.FAX_WORD, text[max(0, start - patterns.FAX_WINDOW) : start], re.IGNORECASE) else "PHONE"
            if not any(s < end and start < e for s, e, _ in won):
                won.append((start, end, label))
    return sorted(won)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["123-45-6789", "12-3456-789", "a@b.co", "http://", "10.0.0.1", "fax ", "555-846-0932", "age 99", "3/4/24", " ", "-", "é", "1", "EMS-2019-7712"]), max_size=12).map("".join), min_size=40, max_size=40, unique=True))
def test_claim_equals_python(spark, texts):
    assert found(spark, texts) == {t: greedy(t) for t in texts}


def test_guards_are_narrow(spark):
    """A dash or a stroke alone let six patterns search a text; what a pattern finds passes its guard."""
    holds = lambda text: {p.label for p in patterns.PATTERNS if spark.createDataFrame([(text,)], "t string").selectExpr(p.guard.format(text="t")).first()[0]}
    assert holds("pulse 12, code I10, dose 12-34-56, ratio 3/4, well-known, 95-year-old") == set()
    every = "123-45-6789 a@b.co http://x 1.2.3.4 (555) 846-0931 MRN-12345 12-3456-789 ED-31-5508-274 NPI-123456789 SN12345-A ABC-1234 3/4/24 age 95 EMS-2019-7712"
    assert holds(every) == {p.label for p in patterns.PATTERNS}
    assert {"SSN", "DATE", "HEALTHPLAN"} <= holds("١٢٣-٤٥-٦٧٨٩ ٣/٤/٢٤ ١٢-٣٤٥٦-٧٨٩")
