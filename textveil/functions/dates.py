"""Dates in texts: parsing, shifting, and a document's keyed shift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 180


def _forms(o: str) -> list[tuple[str, str, str]]:
    """Of each form the SQL condition that a string has it, the date that it then spells, and the format it is written in."""
    year = f"cast(right({o}, 2) as int)"
    full = f"concat(left({o}, length({o}) - 2), if({year} <= 68, '20', '19'), right({o}, 2))"
    return [
        (f"{o} rlike '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$'", f"try_to_date({o}, 'M/d/yyyy')", "MM/dd/yyyy"),
        (f"{o} rlike '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}$'", f"try_to_date({full}, 'M/d/yyyy')", "MM/dd/yy"),
        (f"{o} rlike '^[A-Z][a-z]+\\\\s+[0-9]{{1,2}},\\\\s+[0-9]{{4}}$'", f"try_to_date(regexp_replace({o}, '\\\\s+', ' '), 'MMMM d, yyyy')", "MMMM dd, yyyy"),
    ]


def parsed(o: str) -> str:
    """SQL for the date that a string spells, else null. Two-digit years up to 68 are of this century."""
    return "case " + " ".join(f"when {has} then {date}" for has, date, _ in _forms(o)) + " end"


def shifted(o: str, days: str) -> str:
    """SQL for the string's date so many days later, written in the form that was read; null if it is no date."""
    # each format stands alone: one that is chosen for each row would be read anew there
    return "case " + " ".join(f"when {has} then date_format(date_add({date}, {days}), '{form}')" for has, date, form in _forms(o)) + " end"


def keyed_shift(key: Column, secret: str) -> Column:
    """Days from -180 to 180, never 0 (then 1), from a keyed hash: the same on every retry."""
    digest = F.substring(F.sha2(F.concat(F.lit(secret), key.cast("string")).cast("binary"), 256), 1, 8)
    days = (F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(2 * LIMIT + 1)) - LIMIT).cast("int")
    return F.when(days == 0, 1).otherwise(days)
