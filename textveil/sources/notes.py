"""Notes rendered from orders, customers and nations, with the spans that stand in them.

A note is a list of pieces: plain text, or a label and an SQL expression for the value. The expressions are integer
arithmetic and string functions that Spark and other engines share. Some pieces are traps that only look like
identifiers; a label of None marks a value that is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.sources.tables import tasks

SURNAMES = ["Alder", "Brandt", "Corso", "Duval", "Eklund", "Farrow", "Gomes", "Hale"]


def digits(n: int, a: int, b: int = 7) -> str:
    return f"lpad(cast((o_orderkey * {a} + o_custkey * {b} + {a}) % {10**n} as varchar(20)), {n}, '0')"


def _pick(values: list[str], a: int) -> str:
    return f"(case (o_orderkey * {a} + 3) % {len(values)} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end)"


MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_Y, _M, _D = "cast(year(o_orderdate) as varchar(9))", "cast(month(o_orderdate) as varchar(9))", "cast(day(o_orderdate) as varchar(9))"
DATE = f"concat({_M}, '/', {_D}, '/', {_Y})"
PADDED = f"concat(lpad({_M}, 2, '0'), '/', lpad({_D}, 2, '0'), '/', {_Y})"
SHORT = f"concat({_M}, '/', {_D}, '/', right({_Y}, 2))"
LONG = "concat((case month(o_orderdate) " + " ".join(f"when {k} then '{m}'" for k, m in enumerate(MONTHS, 1)) + f" end), ' ', {_D}, ', ', {_Y})"
NAME = f"concat('Dr. ', {_pick(SURNAMES, 3)})"
SSN = f"concat({digits(3, 31)}, '-', {digits(2, 17)}, '-', {digits(4, 13)})"
EMAIL = f"concat('user', {digits(5, 11)}, '@mail.example.org')"
PHONE = f"concat('(555) ', {digits(3, 19)}, '-', {digits(4, 23)})"
FAX = f"concat('555-', {digits(3, 29)}, '-', {digits(4, 37)})"

SHAPES: list[list] = [
    ["Seen by ", ("NAME", NAME), " with SSN ", ("SSN", SSN), " and record ", ("MRN", f"concat('MRN-', {digits(6, 41)})"), " on ", ("DATE", DATE), "."],
    ["Plan ", ("HEALTHPLAN", f"concat({digits(2, 43)}, '-', {digits(4, 47)}, '-', {digits(3, 53)})"), " billed to ", ("ACCOUNT", f"concat('ACCT-', {digits(7, 59)})"), " for ", ("NAME", NAME), "."],
    ["Triage ", ("ACCOUNT", f"concat('ED-', {digits(2, 61)}, '-', {digits(4, 67)}, '-', {digits(3, 71)})"), " opened ", ("DATE", LONG), ", BP 120/80, 37.2 C."],
    ["Run ", ("ID_OTHER", f"concat('EMS-2024-', {digits(4, 73)})"), " and again ", ("ID_OTHER", f"concat('ems-2024-', {digits(4, 79)})"), " by car ", ("VEHICLE", f"concat('KDT-', {digits(4, 83)})"), "."],
    ["Claims ", ("ID_OTHER", f"concat('CLAIM-2024-', {digits(5, 89)})"), " and ", ("ID_OTHER", f"concat('PI-2023-', {digits(3, 97)})"), " were filed by ", ("NAME", NAME), "."],
    ["See https://", ("EMAIL", EMAIL), "/inbox or ", ("URL", f"concat('https://portal.example.org/p/', {digits(5, 101)})"), " from ", ("IP", f"concat('10.0.', cast(o_custkey % 256 as varchar(9)), '.', cast(o_orderkey % 256 as varchar(9)))"), "."],
    ["Patient of age ", ("AGE", "cast(90 + o_orderkey % 15 as varchar(9))"), ", partner of age ", (None, "cast(20 + o_orderkey % 60 as varchar(9))"), ", aunt 95-year-old."],
    ["Call ", ("PHONE", PHONE), " at night; fax: ", ("FAX", FAX), " by day."],
    ["The telefax", " " * 22, ("FAX", FAX), " is old; a fax line of long ago, now gone for good, was ", ("PHONE", FAX), "."],
    ["Device ", ("DEVICE", f"concat('SN', {digits(6, 103)}, '-', {_pick(['A', 'B', 'C'], 5)})"), " set by ", ("LICENSE", f"concat('NPI-', {digits(9, 107)}, '1')"), " in ", ("LOCATION", "concat('the clinic of ', n_name)"), "."],
    ["Dates ", ("DATE", SHORT), ", ", ("DATE", DATE), " and ", ("DATE", PADDED), "; never ", ("DATE", f"concat('13/45/', {_Y})"), " or ", ("DATE", f"concat('2/30/', {_Y})"), "."],
    ["Mail ", ("EMAIL", EMAIL), " or ", ("EMAIL", f"upper({EMAIL})"), " and ", ("EMAIL", f"concat('other.', {EMAIL})"), " soon."],
    ["Chain ", ("DATE", f"concat('01/06/', {_Y})"), " then ", ("DATE", f"concat('01/01/', {_Y})"), " then ", ("DATE", f"concat('01/11/', {_Y})"), "."],
    ["No one is named here: pulse ", (None, digits(2, 109)), ", code I10, dose 12-34-56, ratio 3/4, room ", (None, digits(3, 113)), "."],
    ["SSN ", ("SSN", SSN), ", again ", ("SSN", SSN), ", other ", ("SSN", f"concat({digits(3, 127)}, '-', {digits(2, 131)}, '-', {digits(4, 137)})"), "."],
    ["Old cases 1/1/68 and 1/1/69 of ", ("NAME", NAME), " near ", ("LOCATION", "n_name"), ", seen at age ", ("AGE", "cast(150 + o_orderkey % 9 as varchar(9))"), "."],
]


def _sql(piece) -> str:
    return "'" + piece + "'" if isinstance(piece, str) else piece[1]


def text_sql() -> str:
    """One expression for the text of any note."""
    return f"case o_orderkey % {len(SHAPES)} " + " ".join(f"when {k} then concat({', '.join(map(_sql, shape))})" for k, shape in enumerate(SHAPES)) + " end"


def gold_sql(array: str, struct: str) -> str:
    """One expression for the note's spans as an array of struct; array and struct are the dialect's templates."""
    cases = []
    for k, shape in enumerate(SHAPES):
        found = []
        for i, piece in enumerate(shape):
            if isinstance(piece, str) or piece[0] is None:
                continue
            start = f"cast(length(concat('', {', '.join(map(_sql, shape[:i]))})) as int)"
            found.append(struct.format(s=start, e=f"{start} + cast(length({piece[1]}) as int)", label=f"'{piece[0]}'"))
        if found:
            cases.append(f"when {k} then " + array.format(", ".join(found)))
    return f"case o_orderkey % {len(SHAPES)} {' '.join(cases)} end"


def _told() -> tuple[str, str, str]:
    """SQL for the values of a note in an array _values, and of that for its text and its spans: text_sql() and gold_sql(), each value made once."""
    values, texts, golds = [], [], []
    for k, shape in enumerate(SHAPES):
        made, pieces, found, before = [], [], [], ["0"]
        for piece in shape:
            if isinstance(piece, str):
                pieces.append(_sql(piece))
                before.append(str(len(piece)))
                continue
            value = f"_values[{len(made)}]"
            start = " + ".join(before)
            if piece[0] is not None:
                found.append(f"named_struct('s', {start}, 'e', {start} + length({value}), 'label', '{piece[0]}')")
            made.append(piece[1])
            pieces.append(value)
            before.append(f"length({value})")
        values.append(f"when {k} then array({', '.join(made)})")
        texts.append(f"when {k} then concat({', '.join(pieces)})")
        if found:
            golds.append(f"when {k} then array({', '.join(found)})")
    return tuple(f"case o_orderkey % {len(SHAPES)} {' '.join(cases)} end" for cases in (values, texts, golds))


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey, o_orderdate, n_name of every order with a customer: what a note is made of, in narrow rows."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # The two dimensions are left to the optimiser, which knows their sizes.
    rows = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("o_orderkey", "o_custkey", "o_orderdate", "n_name")


def rendered(rows: DataFrame, n: int) -> DataFrame:
    """doc_id, text, source, gold of rows of drawn(), dealt out to n tasks; columns whose names begin with an underscore are carried along.

    Tasks have as many rows at every size: those of the join before would grow with the table, since they are merged by bytes.
    """
    carried = [c for c in rows.columns if c.startswith("_")]
    values, text, gold = _told()
    rows = rows.repartition(n, "o_orderkey").selectExpr("o_orderkey", "n_name", f"{values} as _values", *carried)
    none = "cast(array() as array<struct<s: int, e: int, label: string>>)"
    return rows.selectExpr("o_orderkey as doc_id", f"{text} as text", "n_name as source", f"coalesce({gold}, {none}) as gold", *carried)


def many(spark: SparkSession, sf_dir: str) -> int:
    """The number of tasks of the notes."""
    return tasks(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, source, gold (array of spans) of a note for every order with a customer."""
    return rendered(drawn(spark, sf_dir), many(spark, sf_dir))
