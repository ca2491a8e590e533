"""Synthetic annotated notes from templates and a keyed hash; equal seeds give equal notes on any cluster and engine."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.sources.notes import MONTHS, SURNAMES

STREETS, SUFFIXES = ["Elm", "Mill", "Station", "Harbor"], ["Clinic", "Hospital", "Practice", "Pharmacy"]
GIVEN = ["Ida", "Jonas", "Mira", "Paul", "Rosa", "Tim"]
#: Diseases that bear a surname: untagged where they stand, while a doctor of that surname is a name.
EPONYMS = ["Parkinson", "Crohn", "Addison", "Hodgkin", "Graves"]
#: A vehicle's letters: none that looks like a digit.
LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
#: Slots of a row's own hash: template, casing, eponym, whether the doctor bears it, and the surname of doctor and facility.
TEMPLATE, CASING, EPONYM, BEARS, SURNAME = 1, 2, 3, 4, 5


class Dialect(NamedTuple):
    """How an engine writes what the expressions below need; all else they share."""

    number: str  # of 32 bits from the md5 of {text}
    array: str
    item: str  # of {array} at {at}, counted from 1
    struct: str  # of a {label} and a value {v}
    later: str  # the date {days} after 2020-01-01


SPARK = Dialect("cast(conv(left(md5({text}), 8), 16, 10) as bigint)", "array({items})", "element_at({array}, cast({at} as int))", "named_struct('label', {label}, 'v', {v})", "date_add(date'2020-01-01', cast({days} as int))")


class Slots:
    """SQL of hashed values in a dialect."""

    def __init__(self, dialect: Dialect = SPARK):
        self.dialect = dialect

    def h(self, slot: int, n: int) -> str:
        """An integer below n from the seed, the row and the slot."""
        text = f"concat(seed, ':', cast(id as varchar(20)), ':{slot}')"
        return f"({self.dialect.number.format(text=text)} % {n})"

    def pick(self, values: list[str], slot: int) -> str:
        return self.dialect.item.format(array=self.dialect.array.format(items=", ".join(f"'{v}'" for v in values)), at=f"1 + {self.h(slot, len(values))}")

    def text(self, number: str) -> str:
        return f"cast({number} as varchar(20))"

    def digits(self, slot: int, n: int) -> str:
        return f"lpad({self.text(self.h(slot, 10 ** min(n, 9)))}, {n}, '0')"

    def letter(self, slot: int) -> str:
        return f"substring('{LETTERS}', cast(1 + {self.h(slot, len(LETTERS))} as int), 1)"

    def facility(self, k: int) -> str:
        return f"(case when {self.h(k, 10)} < 4 then concat({self.pick(SURNAMES, SURNAME)}, ' ', {self.pick(SUFFIXES, k + 1)}) when {self.h(k, 10)} < 7 then concat({self.pick(STREETS, k + 2)}, ' County Hospital') else concat('Pharmacy No. ', {self.text('2 + ' + self.h(k + 3, 90))}) end)"

    def date(self, k: int) -> str:
        day = self.dialect.later.format(days=self.h(k, 1800))
        month, number, year = f"month({day})", self.text(f"day({day})"), self.text(f"year({day})")
        named = self.dialect.item.format(array=self.dialect.array.format(items=", ".join(f"'{m}'" for m in MONTHS)), at=month)
        return f"(case when {self.h(k + 1, 2)} = 0 then concat(lpad({self.text(month)}, 2, '0'), '/', lpad({number}, 2, '0'), '/', {year}) else concat({named}, ' ', {number}, ', ', {year}) end)"

    def value(self, kind: str, k: int) -> tuple[str | None, str]:
        """Label (None for negative controls) and SQL of a slot's value; k tells slots apart."""
        h, pick, digits, text = self.h, self.pick, self.digits, self.text
        dashed = lambda *sizes: "concat(" + ", '-', ".join(digits(k + i, n) for i, n in enumerate(sizes)) + ")"
        return {
            "NAME": ("NAME", f"concat({pick(GIVEN, k)}, ' ', {pick(SURNAMES, k + 1)})"),
            "NAME_REV": ("NAME", f"concat({pick(SURNAMES, k)}, ', ', {pick(GIVEN, k + 1)}, ' ', {self.letter(k + 2)}, '.')"),
            "NAME_TERSE": ("NAME", f"concat({pick(SURNAMES, k)}, ' ', left({pick(GIVEN, k + 1)}, 1))"),
            "DOCTOR": ("NAME", f"concat('Dr. ', case when {h(BEARS, 2)} = 0 then {pick(EPONYMS, EPONYM)} else {pick(SURNAMES, SURNAME)} end)"),
            "EPONYM": (None, f"concat({pick(EPONYMS, EPONYM)}, ' disease')"),
            "FACILITY": ("LOCATION", self.facility(k)),
            "LOCATION": ("LOCATION", f"(case when {h(k + 4, 2)} = 0 then concat({text('1 + ' + h(k + 5, 900))}, ' ', {pick(STREETS, k + 6)}, ' Street') else {self.facility(k)} end)"),
            "DATE": ("DATE", self.date(k)),
            "PHONE": ("PHONE", f"concat('(', {digits(k, 3)}, ') ', {digits(k + 1, 3)}, '-', {digits(k + 2, 4)})"),
            "FAX": ("FAX", dashed(3, 3, 4)),
            "EMAIL": ("EMAIL", f"concat(lower({pick(GIVEN, k)}), '.', lower({pick(SURNAMES, k + 1)}), '@mail', {text(h(k + 2, 4))}, '.example.org')"),
            "SSN": ("SSN", dashed(3, 2, 4)),
            "MRN": ("MRN", f"concat({pick(['MRN-', 'PCG-', 'MER-'], k)}, {digits(k + 1, 6)}, case when {h(k + 2, 2)} = 0 then '' else {digits(k + 3, 1)} end)"),
            "HEALTHPLAN": ("HEALTHPLAN", dashed(2, 4, 3)),
            "ACCOUNT": ("ACCOUNT", f"(case when {h(k + 4, 2)} = 0 then concat('ACCT-', {digits(k + 5, 7)}) else concat({pick(['ED-', 'OR-', 'PT-', 'RAD-'], k + 6)}, {dashed(2, 4, 3)}) end)"),
            "LICENSE": ("LICENSE", f"concat('NPI-', {digits(k, 5)}, {digits(k + 1, 5)})"),
            "VEHICLE": ("VEHICLE", f"concat({self.letter(k)}, {self.letter(k + 1)}, {self.letter(k + 2)}, '-', {digits(k + 3, 4)})"),
            "DEVICE": ("DEVICE", f"concat('SN', {digits(k, 6)}, '-', {pick(['A', 'B', 'C'], k + 1)})"),
            "URL": ("URL", f"concat('https://portal.example.org/r/', {digits(k, 6)})"),
            "IP": ("IP", "concat(" + ", '.', ".join(text(h(k + i, 256)) for i in range(4)) + ")"),
            "ID_OTHER": ("ID_OTHER", f"concat('EMS-', {text('2020 + ' + h(k, 6))}, '-', {digits(k + 1, 4)})"),
            "AGE": ("AGE", text(f"90 + {h(k, 15)}")),
            "AGE_NEG": (None, text(f"1 + {h(k, 89)}")),
            "RELTIME": (None, f"concat({text('2 + ' + h(k, 20))}, ' weeks ago')"),
            "VITALS": (None, f"concat('BP ', {text('100 + ' + h(k, 60))}, '/', {text('60 + ' + h(k + 1, 30))})"),
            "CODE": (None, f"concat('I', {digits(k, 2)}, '.', {text(h(k + 1, 10))})"),
            "SPECIALTY": (None, pick(["cardiology", "surgery", "pediatrics"], k)),
        }[kind]


# Own templates: train and eval share no body.
TEMPLATES = {
    "train": [
        "{NAME} was admitted to {FACILITY} on {DATE}. {VITALS} on arrival.", "Record {MRN}, SSN {SSN}, first seen by {DOCTOR} for {EPONYM}.", "Call {PHONE} or fax {FAX}; write to {EMAIL}.",
        "Plan {HEALTHPLAN} settles account {ACCOUNT}, code {CODE}.", "Patient of age {AGE} and a child of age {AGE_NEG} moved to {LOCATION} {RELTIME}.", "{NAME_REV} checked pump {DEVICE} from {IP}.",
        "Unit {VEHICLE} logged {ID_OTHER}; the report is at {URL}.", "{NAME_TERSE} holds licence {LICENSE} since {DATE}.", "On {DATE} the family of {NAME} asked for a bed near {LOCATION}.",
        "Discharge {DATE}, next visit {DATE} with {DOCTOR}.", "{DOCTOR} doubts {EPONYM} and sends {NAME} to {SPECIALTY}.", "Moved to {LOCATION} on {DATE}.",
        "Blood drawn {DATE}, read {DATE}, nothing to report.", "Crew {VEHICLE} under {ID_OTHER} left {LOCATION} at dawn.", "{NAME_REV} signed for {MRN} at {FACILITY}.",
        "Second copy of {SSN} went by fax {FAX} to {SPECIALTY}.", "Monitor {DEVICE} was last serviced on {DATE}; {VITALS} since.", "Bill {ACCOUNT} of {DATE} goes to plan {HEALTHPLAN}.",
        "Night desk {PHONE}, mail {EMAIL}, ask for {NAME_TERSE}.", "{NAME} lives at {LOCATION} and fell {RELTIME}.", "Seen by {DOCTOR} on {DATE} and by {NAME} on {DATE}.", "{NAME_REV} was born near {LOCATION} on {DATE}.",
        "Wound clean, stitches out {RELTIME}, says {DOCTOR}.", "A neighbour, {NAME}, found the keys at {LOCATION}.", "Transfer from {LOCATION} booked by {NAME}.", "On {DATE} nobody answered at {LOCATION}.",
        "{NAME} declined; {DOCTOR} was told at once.", "Meals go to {LOCATION} until further notice.", "Tests were moved to {DATE}.", "The ambulance waited outside {LOCATION} for {NAME}.",
    ],
    "eval": [
        "On {DATE} {DOCTOR} reviewed {MRN} at {FACILITY}.", "{NAME} ({SSN}) pays via {ACCOUNT}; {RELTIME} all was well.", "Reach {EMAIL}, {PHONE}, fax {FAX}, or {URL}.", "Crew of {VEHICLE} filed {ID_OTHER}; {NAME_TERSE} drove to {LOCATION}.",
        "At age {AGE} with {DEVICE}, plan {HEALTHPLAN}, {VITALS}, {CODE}.", "{IP} was used under {LICENSE} at age {AGE_NEG}.", "{EPONYM} was ruled out by {DOCTOR} on {DATE}.", "{NAME} travelled from {LOCATION} to {LOCATION}.",
        "Results of {DATE} were filed {DATE}.", "Visitors for {NAME} wait at {LOCATION}.", "{DOCTOR} wrote to {NAME} on {DATE}.", "Pain began {RELTIME} near {LOCATION}.", "{NAME} came back on {DATE}, {VITALS}.",
        "The file {MRN} lay at {FACILITY} until {DATE}.", "{NAME_TERSE} took the call from {PHONE}.", "Fax {FAX} belongs to {LOCATION}.", "Account {ACCOUNT} was closed on {DATE}.", "{DOCTOR} covers for {NAME} at {LOCATION}.",
        "Pump {DEVICE} alarmed twice on {DATE}.", "Nothing new since {DATE}, says {NAME}.",
    ],
}


def pieces(template: str, slots: Slots) -> list[tuple[str | None, str]]:
    out, k = [], 0
    for n, part in enumerate(template.replace("}", "{").split("{")):
        if n % 2:
            out.append(slots.value(part, 10 + 10 * k))
            k += 1
        elif part:
            out.append((None, "'" + part + "'"))
    return out


def parts_sql(split: str, dialect: Dialect = SPARK) -> str:
    """One expression for the pieces (label, v) of a row's template t."""
    slots = Slots(dialect)
    whole = lambda t: dialect.array.format(items=", ".join(dialect.struct.format(label=f"'{label}'" if label else "cast(null as varchar(20))", v=sql) for label, sql in pieces(t, slots)))
    return "case t " + " ".join(f"when {k} then {whole(t)}" for k, t in enumerate(TEMPLATES[split])) + " end"


def cased_sql(plain: str, dialect: Dialect = SPARK) -> str:
    """15 in 100 texts are upper-cased and 10 lower-cased as noise."""
    noise = Slots(dialect).h(CASING, 100)
    return f"case when {noise} < 15 then upper({plain}) when {noise} < 25 then lower({plain}) else {plain} end"


def generate(spark: SparkSession, n: int, seed: int = 13, split: str = "train") -> DataFrame:
    """doc_id, template_id, text, entities (s, e, label) of n notes."""
    base = spark.range(n).select("id", F.lit(str(seed)).alias("seed")).withColumn("t", F.expr(f"cast({Slots().h(TEMPLATE, len(TEMPLATES[split]))} as int)"))
    built = base.withColumn("parts", F.expr(parts_sql(split)))
    span = "aggregate(slice(parts, 1, {}), 0, (a, x) -> a + length(x.v))"
    built = built.withColumn("entities", F.expr(f"""filter(transform(parts, (x, i) -> named_struct('s', {span.format('i')}, 'e', {span.format('i + 1')}, 'label', x.label)), x -> x.label is not null)"""))
    plain = "array_join(transform(parts, x -> x.v), '')"
    return built.select(F.col("id").alias("doc_id"), F.col("t").alias("template_id"), F.expr(cased_sql(plain)).alias("text"), "entities")
