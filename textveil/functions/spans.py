"""Span columns: matches with offsets, priority claim, ensembles. All native: one narrow projection, no UDF.

A span is a struct of s, e (code points, end exclusive) and label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.functions import long
from textveil.functions.patterns import FAX_WINDOW, FAX_WORD, PATTERNS

SPANS = "array<struct<s: int, e: int, label: string>>"
_CANDIDATES = "array<struct<prio: int, s: int, e: int, label: string>>"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str) -> str:
    """SQL for an array of struct (s, m) of the pattern's matches in the column called text.

    Spark has no function for the places of all matches; they are the summed lengths of what lies before. The text is only
    split where something was found, and not for a lone match: split compiles its pattern again for every text.
    """
    found, gaps = f"regexp_extract_all({text}, {quoted(pattern)}, 0)", f"split({text}, {quoted(pattern)}, -1)"
    lengths = "transform(f, (m, i) -> length(g[i]) + length(m))"
    placed = long.let(long.starts(lengths), "at", "transform(f, (m, i) -> named_struct('s', at[i] + length(g[i]), 'm', m))")
    alone = f"array(named_struct('s', length(regexp_replace({text}, {quoted(f'(?:{pattern})(?s:.*)')}, '')), 'm', f[0]))"
    return long.let(found, "f", f"case when size(f) = 0 then cast(array() as array<struct<s: int, m: string>>) when size(f) = 1 then {alone} else {long.let(gaps, 'g', placed)} end")


def candidates(text: str, labels: set[str] | None = None, chunks: str | None = None) -> Column:
    """Array of struct (prio, s, e, label) of all matches in order of priority, then place, before any claim.

    Ages shrink to their digits; phone numbers after the word fax are FAX. labels: only these patterns. chunks: the column
    with the text's chunks (functions.long), if there is one.
    """
    chunks = chunks or "cast(array() as array<string>)"
    parts = []
    for prio, p in enumerate(PATTERNS, 1):
        if labels is not None and p.label not in labels:
            continue
        if p.label == "AGE":
            shaped = f"named_struct('prio', {prio}, 's', x.s + length(x.m) - length(regexp_extract(x.m, '(?U)\\\\d+', 0)), 'e', x.s + length(x.m), 'label', 'AGE')"
        elif p.label == "PHONE_OR_FAX":
            before = long.cut(text, chunks, f"greatest(0, x.s - {FAX_WINDOW})", f"least({FAX_WINDOW}, x.s)")
            label = f"if({before} rlike {quoted('(?iU)' + FAX_WORD)}, 'FAX', 'PHONE')"
            shaped = f"named_struct('prio', {prio}, 's', x.s, 'e', x.s + length(x.m), 'label', {label})"
        else:
            shaped = f"named_struct('prio', {prio}, 's', x.s, 'e', x.s + length(x.m), 'label', '{p.label}')"
        guard = p.guard.format(text=text)
        parts.append(f"if({guard}, transform({matches(text, p.java)}, x -> {shaped}), cast(array() as {_CANDIDATES}))")
    return F.expr(f"coalesce(concat({', '.join(parts)}), cast(array() as {_CANDIDATES}))")


def claim(found: str) -> Column:
    """Greedy claim over a candidate column in its order: one that touches an earlier winner goes as a whole; by place.

    Matches of one grammar don't touch each other, so many candidates are taken a grammar at a time.
    """
    won = "named_struct('s', c.s, 'e', c.e, 'label', c.label)"
    plain = f"aggregate({found}, cast(array() as {SPANS}), (won, c) -> if(exists(won, w -> w.s < c.e and c.s < w.e), won, array_append(won, {won})))"
    added = f"sort_array(concat(won, transform(filter(cs, c -> not {long.touches('won', 'c')}), c -> {won})))"
    step = long.let(f"filter({found}, c -> c.prio = p)", "cs", f"if(size(cs) = 0, won, {added})")
    many = f"aggregate(sequence(1, {len(PATTERNS)}), cast(array() as {SPANS}), (won, p) -> {step})"
    return F.expr(f"case when size({found}) <= 1 then transform({found}, c -> {won}) when size({found}) <= {long.BLOCK} then sort_array({plain}) else sort_array({many}) end")


def with_spans(df, text: str = "text", into: str = "spans"):
    """df with the claimed spans of a text column; null and empty texts have none."""
    staged = df.withColumn("_chunks", F.expr(long.chunks(f"`{text}`"))).withColumn("_candidates", candidates(f"`{text}`", chunks="_chunks"))
    return staged.withColumn(into, claim("_candidates")).drop("_candidates", "_chunks")


def ensemble(first: str, second: str) -> Column:
    """Spans of the first column, and those of the second (in order) that touch neither these nor each other."""
    plain = f"aggregate(sort_array({second}), {first}, (won, c) -> if(exists(won, w -> w.s < c.e and c.s < w.e), won, array_append(won, c)))"
    # in order of their starts a span touches one taken before if it touches the last; taken ones are gathered block by block
    free = f"filter(sort_array({second}), c -> not {long.touches('own', 'c')})"
    inner = f"aggregate(slice(free, k * {long.BLOCK} + 1, {long.BLOCK}), named_struct('part', cast(array() as {SPANS}), 'e', acc.e), (b, c) -> if(c.s >= b.e, named_struct('part', array_append(b.part, c), 'e', c.e), b))"
    step = long.let(inner, "r", "named_struct('part', concat(acc.part, r.part), 'e', r.e)")
    taken = f"aggregate(sequence(0, int(size(free) div {long.BLOCK})), named_struct('part', cast(array() as {SPANS}), 'e', 0), (acc, k) -> {step}, acc -> acc.part)"
    many = long.let(f"sort_array({first})", "own", long.let(free, "free", f"concat(own, {taken})"))
    return F.expr(f"sort_array(if(size({first}) + size({second}) <= {long.BLOCK}, {plain}, {many}))")


def parts(text: str, spans: str, chunks: str) -> Column:
    """A column of spans with part, what stands there in the text."""
    return F.expr(f"transform({spans}, x -> named_struct('s', x.s, 'e', x.e, 'label', x.label, 'part', {long.cut(text, chunks, 'x.s', '(x.e - x.s)')}))")


def locate(text: str, wanted: str) -> Column:
    """Spans of an ordered array of struct (part, label) in a text: each is sought after the one before, then from the start.

    A part that isn't there is an error.
    """
    at = f"if(locate(w.part, {text}, a.at + 1) > 0, locate(w.part, {text}, a.at + 1), locate(w.part, {text}))"
    return F.expr(f"""array_sort(aggregate({wanted}, named_struct('at', 0, 'out', cast(array() as {SPANS})), (a, w) -> named_struct(
        'at', if({at} > 0, {at} - 1 + length(w.part), raise_error('no such part')),
        'out', concat(a.out, array(named_struct('s', {at} - 1, 'e', {at} - 1 + length(w.part), 'label', w.label)))), a -> a.out))""")
