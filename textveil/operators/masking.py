"""De-identification: pseudonyms, shifted dates, the mapping back, and the leak self-check.

Everything is per document, so it is one narrow projection: no shuffle, nothing on the driver. The mapping is returned
apart from the masked texts and must be stored apart from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions import dates, long, spans

_ITEM = "named_struct('s', x.s, 'e', x.e, 'label', x.label, 'o', x.o, 'm', {}, 'mapped', {})"
TOKENS = "array<struct<label: string, k: string, n: int>>"


def _spliced(text: str, items: str, chunks: str) -> str:
    """SQL for the text with each item's m in its place."""
    ends = f"if(i = 0, 0, {items}[i - 1].e)"
    pieces = f"transform({items}, (x, i) -> concat({long.cut(text, chunks, ends, f'(x.s - {ends})')}, x.m))"
    last = f"{items}[size({items}) - 1].e"
    rest = long.cut(text, chunks, last, f"(length({text}) - {last})")
    return f"if(size({items}) = 0, {text}, concat(array_join({pieces}, ''), {rest}))"


def _numbered(rows: DataFrame, found: str, spot: str) -> DataFrame:
    """rows with _tokens (label, k, n; sorted), the originals of found that have no number yet added to those there are.

    k: an original in lower case. Numbers of a label go on from the highest, in the order of spot, an SQL expression of an
    item x. Many originals are sorted and each run's first one counted, so that nothing is sought for each of them.
    """
    one = f"named_struct('label', x.label, 'k', x.k, 'n', size(filter(t_, y -> y.label = x.label)) + 1)"
    listed = f"sort_array(transform({found}, x -> named_struct('spot', {spot}, 'label', x.label, 'k', lower(x.o))))"
    few = f"aggregate({listed}, _tokens, (t_, x) -> if(exists(t_, y -> y.label = x.label and y.k = x.k), t_, array_append(t_, {one})))"
    lone = f"array(named_struct('label', {found}[0].label, 'k', lower({found}[0].o), 'n', 1))"
    many = f"if(size({found}) <= {long.FEW}, slice({found}, 1, 0), {found})"
    known = long.let(long.search("_tokens", _below("y_", "x")), "p_", "if(p_ < size(_tokens), _tokens[p_].label = x.label and _tokens[p_].k = x.k, false)")
    rows = rows.withColumn("_sorted", F.expr(f"sort_array(transform({many}, x -> named_struct('label', x.label, 'k', lower(x.o), 'spot', {spot})))"))
    first = "if(i = 0, true, _sorted[i - 1].label <> x.label or _sorted[i - 1].k <> x.k)"
    rows = rows.withColumn("_sorted", F.expr(f"filter(filter(_sorted, (x, i) -> {first}), x -> not {known})"))
    rows = rows.withColumn("_sorted", F.expr("sort_array(transform(_sorted, x -> named_struct('label', x.label, 'spot', x.spot, 'k', x.k)))"))
    # where each label begins, and how many numbers it has: a few entries
    rows = rows.withColumn("_heads", F.expr("filter(transform(_sorted, (x, i) -> named_struct('label', x.label, 'i', i)), (x, i) -> if(i = 0, true, _sorted[i - 1].label <> x.label))"))
    rows = rows.withColumn("_heads", F.expr("transform(_heads, h -> named_struct('label', h.label, 'i', h.i - size(filter(_tokens, t -> t.label = h.label))))"))
    number = "i - filter(heads_, h -> h.label = x.label)[0].i + 1"
    # named outside: a column that is used once may be worked out where it stands, here again for each element
    fresh = long.let("_heads", "heads_", f"transform(_sorted, (x, i) -> named_struct('label', x.label, 'k', x.k, 'n', {number}))")
    return rows.withColumn("_tokens", F.expr(f"case when size({found}) = 0 then _tokens when size({found}) = 1 and size(_tokens) = 0 then {lone} when size({found}) <= {long.FEW} then sort_array({few}) when size(_sorted) = 0 then _tokens else sort_array(concat(_tokens, {fresh})) end")).drop("_sorted", "_heads")


def _below(a: str, b: str) -> str:
    return f"({a}.label < {b}.label or ({a}.label = {b}.label and {a}.k < {b}.k))"


def _token() -> str:
    """SQL for an item x's [LABEL_n]."""
    few = "filter(_tokens, y_ -> y_.label = x.label and y_.k = lower(x.o))[0].n"
    many = long.let("named_struct('label', x.label, 'k', lower(x.o))", "z_", f"_tokens[{long.search('_tokens', _below('y_', 'z_'))}].n")
    return f"concat('[', x.label, '_', case when size(_tokens) = 1 then _tokens[0].n when size(_tokens) <= {long.FEW} then {few} else {many} end, ']')"


def _originals(found: str, text: str, chunks: str) -> str:
    return f"transform({found}, x -> named_struct('s', x.s, 'e', x.e, 'label', x.label, 'o', {long.cut(text, chunks, 'x.s', '(x.e - x.s)')}))"


def mask(df: DataFrame, text: str = "text", found: str = "spans", shift: str = "shift") -> DataFrame:
    """df with items (s, e, label, o, m, mapped), masked and _tokens, for its text, spans and shift columns.

    Ages become `90+` and are not mapped; dates move by shift days; all else, unreadable dates too, gets a pseudonym
    [LABEL_n]: n counts the label's distinct originals (in lower case) up to this one.
    """
    staged = df.withColumn("_chunks", F.expr(long.chunks(text))).withColumn("_o", F.expr(f"transform({found}, x -> {long.cut(text, '_chunks', 'x.s', '(x.e - x.s)')})"))
    # a struct for each item is most of what a note costs here, so there is one only where it is needed
    fixed = f"case when x.label = 'AGE' then '90+' when x.label = 'DATE' then {dates.shifted('_o[i]', shift)} end"
    staged = staged.withColumn("_fixed", F.expr(f"transform({found}, (x, i) -> named_struct('s', x.s, 'e', x.e, 'label', x.label, 'o', _o[i], 'f', {fixed}))"))
    staged = staged.withColumn("_tokens", F.expr(f"cast(array() as {TOKENS})")).withColumn("_raw", F.expr("filter(_fixed, x -> x.f is null)"))
    staged = _numbered(staged, "_raw", "x.s")
    staged = staged.withColumn("items", F.expr("transform(_fixed, x -> " + _ITEM.format(f"if(x.f is not null, x.f, {_token()})", "x.label <> 'AGE'") + ")"))
    return staged.withColumn("masked", F.expr(_spliced(text, "items", "_chunks"))).drop("_raw", "_o", "_fixed", "_chunks")


def selfcheck(df: DataFrame) -> DataFrame:
    """A second look at the masked text of mask(): what is still found and is no mapped string is masked too.

    Adds leaks (items, by place in the first masked text). New pseudonyms go on from the first ones, right to left.
    """
    staged = spans.with_spans(df, "masked", "_hits").withColumn("_chunks", F.expr(long.chunks("masked")))
    staged = staged.withColumn("_known", F.expr("transform(filter(items, y -> y.mapped), y -> y.m)")).withColumn("_known", F.expr(f"if(size(_known) <= {long.FEW}, _known, sort_array(array_distinct(_known)))"))
    staged = staged.withColumn("_raw", F.expr(_originals("_hits", "masked", "_chunks")))
    staged = staged.withColumn("_raw", F.expr(f"filter(_raw, x -> not {long.within('_known', 'x.o')})"))
    staged = _numbered(staged, "_raw", "-x.s")
    staged = staged.withColumn("leaks", F.expr("transform(_raw, x -> " + _ITEM.format(_token(), "true") + ")"))
    return staged.withColumn("masked", F.expr(_spliced("masked", "leaks", "_chunks"))).withColumn("items", F.expr("concat(items, reverse(leaks))")).drop("_raw", "_hits", "_known", "_chunks")


def entries() -> Column:
    """The mapping of a row's items as an array of ordinal, masked, original: the last original wins, the first place counts."""
    few = "transform(filter(f_, (x, i) -> not exists(slice(f_, 1, i), y -> y.m = x.m)), (x, t) -> named_struct('ordinal', t, 'masked', x.m, 'original', element_at(filter(f_, y -> y.m = x.m), -1).o))"
    ordered = "sort_array(transform(f_, (x, i) -> named_struct('m', x.m, 'i', i, 'o', x.o)))"
    heads = "filter(transform(sorted_, (x, j) -> named_struct('m', x.m, 'i', x.i, 'j', j)), (x, j) -> if(j = 0, true, sorted_[j - 1].m <> x.m))"
    last = "sorted_[if(t + 1 < size(heads_), heads_[t + 1].j, size(sorted_)) - 1].o"
    listed = f"sort_array(transform(heads_, (x, t) -> named_struct('i', x.i, 'm', x.m, 'o', {last})))"
    many = long.let(ordered, "sorted_", long.let(heads, "heads_", f"transform({listed}, (x, t) -> named_struct('ordinal', t, 'masked', x.m, 'original', x.o))"))
    return F.expr(long.let("filter(items, x -> x.mapped)", "f_", f"if(size(f_) <= {long.FEW}, {few}, {many})"))


def mapping(df: DataFrame, key: str) -> DataFrame:
    """key, ordinal, masked, original: a row for each masked string."""
    return df.select(key, F.inline_outer(entries())).where("masked is not null")


def deidentify(docs: DataFrame, key: str, secret: str, text: str = "text", check: bool = True, shift_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Masked texts (key, masked) and, apart, the mapping (key, ordinal, masked, original) of docs.

    Null texts are empty; texts without identifiers stay as they are. shift_days overrides the keyed shift.
    """
    days = F.lit(shift_days) if shift_days is not None else dates.keyed_shift(F.col(key), secret)
    ready = docs.select(key, F.coalesce(text, F.lit("")).alias("text")).withColumn("shift", days)
    done = mask(spans.with_spans(ready))
    done = selfcheck(done) if check else done
    return done.select(key, "masked"), mapping(done, key)
