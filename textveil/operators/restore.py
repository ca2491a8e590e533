"""Putting originals back into a response, and warnings about tokens that no mapping knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions import long
from textveil.functions.spans import quoted

TOKEN = r"(?U)\[[A-Z_]+_\d+\]"
DRY_RUN = "[dry run: no model was called; the masked prompt follows]\n\n"
BETWEEN = "\n\n---\n\n"


def entries(mapping: DataFrame, key: str) -> DataFrame:
    """key and entries (ordinal, masked, original), one row per document; a document's mapping is as large as its spans."""
    return mapping.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "masked", "original"))).alias("entries"))


def rehydrated(response: str = "response", entries_: str = "entries") -> Column:
    """Replacement after replacement, the longest masked string first, then the first mapped one.

    Of many entries all pseudonyms are put back in one pass, and then the dates one after the other. That gives the same
    where no original looks like a pseudonym or a date written with strokes, which only addresses can; else, and for few
    entries, it goes replacement after replacement.
    """
    ordered = "sort_array(transform({}, e -> named_struct('n', -length(e.masked), 'ordinal', e.ordinal, 'masked', e.masked, 'original', e.original)))"
    each = f"aggregate({{}}, {{}}, (text, e) -> replace(text, e.masked, e.original))"
    plain = each.format(ordered.format(entries_), response)
    tokens = f"sort_array(transform(filter({entries_}, e -> e.masked like '[%'), e -> named_struct('masked', e.masked, 'original', e.original)))"
    place = long.search("known_", "y_.masked < t")
    one = long.let(place, "p_", "if(p_ < size(known_), if(known_[p_].masked = t, known_[p_].original, t), t)")
    token = quoted(TOKEN)
    joined = f"array_join(transform(split({response}, {token}, -1), (g, i) -> concat(g, if(i < size(found_), {long.let('found_[i]', 't', one)}, ''))), '')"
    at_once = long.let(tokens, "known_", long.let(f"regexp_extract_all({response}, {token}, 0)", "found_", joined))
    dates = ordered.format(f"filter({entries_}, e -> not e.masked like '[%')")
    odd = f"exists({entries_}, e -> e.masked like '[%' and (contains(e.original, '[') or e.original rlike '[0-9]/[0-9]' or e.original rlike '[a-z] [0-9]{{1,2}}, [0-9]'))"
    many = each.format(dates, at_once)
    return F.expr(f"coalesce(case when coalesce(size({entries_}), 0) <= {long.BLOCK} then {plain} when {odd} then {plain} else {many} end, {response})")


def warnings(response: str = "response", entries_: str = "entries") -> Column:
    """Tokens in the response that the mapping doesn't have, in order, repeats included."""
    known = f"coalesce(transform({entries_}, e -> e.masked), cast(array() as array<string>))"
    known = f"if(coalesce(size({entries_}), 0) <= {long.FEW}, {known}, sort_array({known}))"
    unknown = long.let(known, "known_", f"filter(found_, t -> not {long.within('known_', 't')})")
    return F.expr(long.let(f"regexp_extract_all({response}, {quoted(TOKEN)}, 0)", "found_", f"if(size(found_) = 0, found_, {unknown})"))


def prompt(masked: str, question: Column) -> Column:
    return F.concat(F.col(masked), F.lit(BETWEEN), question)


def dry_run(prompt_: Column) -> Column:
    """What a call without a model answers: the prompt itself behind a fixed line."""
    return F.concat(F.lit(DRY_RUN), prompt_)
