"""SQL for arrays and texts that may be long: prefix sums, parts of a text, searches in sorted arrays. All native.

A higher-order function that looks through an array for each of its elements takes the square of its length, and so does
one that adds to an array or a string step by step. These take n log n at most; short arrays and texts take the plain way,
which costs less and gives the same.
"""

from __future__ import annotations

#: Code points of a chunk of a long text, and elements of a block of a long array.
CHUNK, BLOCK = 1024, 64
#: Texts of up to so many code points have no chunks.
SHORT = 4096
#: Elements of an array that is looked through for each of its own: a sort and a search cost more.
FEW = 8


def let(value: str, name: str, body: str) -> str:
    """body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def before(lengths: str, i: str) -> str:
    """SQL of a function body over index i: the sum of an int array's elements before it, by sums of blocks and of blocks of blocks."""
    total = "aggregate(slice({}, {}, {}), 0, (sum_, n_) -> sum_ + n_)"
    one, two = f"int({i} div {BLOCK})", f"int({i} div {BLOCK * BLOCK})"
    return " + ".join((
        total.format("sums2_", "1", two), total.format("sums1_", f"{two} * {BLOCK} + 1", f"{one} - {two} * {BLOCK}"),
        total.format(lengths, f"{one} * {BLOCK} + 1", f"{i} - {one} * {BLOCK}"),
    ))


def blocks(array: str) -> str:
    """Sums of an int array's blocks."""
    last = f"int((size({array}) - 1) div {BLOCK})"
    return f"if(size({array}) = 0, cast(array() as array<int>), transform(sequence(0, {last}), k_ -> aggregate(slice({array}, k_ * {BLOCK} + 1, {BLOCK}), 0, (sum_, n_) -> sum_ + n_)))"


def starts(lengths: str) -> str:
    """SQL for the array of the sums before each element of an int array."""
    plain = "slice(aggregate(lengths_, array(0), (sums_, n_) -> array_append(sums_, element_at(sums_, -1) + n_)), 1, size(lengths_))"
    summed = let(blocks("lengths_"), "sums1_", let(blocks("sums1_"), "sums2_", f"transform(lengths_, (x_, i_) -> {before('lengths_', 'i_')})"))
    return let(lengths, "lengths_", f"if(size(lengths_) <= {BLOCK}, {plain}, {summed})")


def chunks(text: str) -> str:
    """SQL for a text's chunks; none of a short one."""
    return f"if(length({text}) > {SHORT}, regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0), cast(array() as array<string>))"


def cut(text: str, parts: str, start: str, size: str) -> str:
    """SQL for size code points of a text behind the first start ones, without a walk through the whole text; parts: its chunks."""
    first, last = f"int({start} div {CHUNK})", f"int(({start} + {size} - 1) div {CHUNK})"
    inside = f"substring({parts}[{first}], int({start} % {CHUNK}) + 1, {size})"
    across = f"concat(substring({parts}[{first}], int({start} % {CHUNK}) + 1), array_join(slice({parts}, {first} + 2, {last} - {first} - 1), ''), substring({parts}[{last}], 1, int(({start} + {size} - 1) % {CHUNK}) + 1))"
    return f"case when size({parts}) = 0 then substring({text}, {start} + 1, {size}) when {size} <= 0 then '' when {first} = {last} then {inside} else {across} end"


def search(array: str, below: str) -> str:
    """SQL for the place of the first element of an array that is not below; below: a condition on y_ that holds for the first ones."""
    middle = "int((a_.lo + a_.hi) div 2)"
    halved = f"if({below}, named_struct('lo', {middle} + 1, 'hi', a_.hi), named_struct('lo', a_.lo, 'hi', {middle}))"
    step = f"if(a_.lo < a_.hi, {let(f'{array}[{middle}]', 'y_', halved)}, a_)"
    rounds = f"sequence(1, if(size({array}) = 0, 1, int(log2(size({array}))) + 1))"
    return f"aggregate({rounds}, named_struct('lo', 0, 'hi', size({array})), (a_, r_) -> {step}, a_ -> a_.lo)"


def within(array: str, value: str) -> str:
    """SQL for whether an array of strings, sorted if it has more than FEW, has a value."""
    return f"if(size({array}) <= {FEW}, array_contains({array}, {value}), {let(search(array, f'y_ < {value}'), 'p_', f'if(p_ < size({array}), {array}[p_] = {value}, false)')})"


def touches(sorted_: str, span: str) -> str:
    """SQL for whether a span touches one of some sorted spans, which don't touch each other."""
    far = let(search(sorted_, f"y_.e <= {span}.s"), "p_", f"if(p_ < size({sorted_}), {sorted_}[p_].s < {span}.e, false)")
    return f"if(size({sorted_}) <= 16, exists({sorted_}, w_ -> w_.s < {span}.e and {span}.s < w_.e), {far})"
