"""Quality rules with DataFrame functions alone.

Base rules count words, characters, symbols, repeated lines and repeated five-word windows. The verdict of documents that
pass them is a log-likelihood ratio: n-grams of two orders (words; pairs of words; case kept) are hashed into a fixed
number of cells an order, all pairs of equal words into one; one multinomial over an order's cells comes from a trusted
target, one from the raw corpus, and a document's mean log ratio per n-gram must reach a fixed threshold in both orders.
Hashes are the leading 32 bits of a word's md5, so that any engine gets the same cells. Every document is judged by the
same deterministic rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import SPACE, durable, text_of

#: Cells of each order's hashed n-gram space, and weight of a cell's prior count.
CELLS, PRIOR = 16384, 1.0
#: Lowest mean log ratio that is kept: below it the raw corpus gives each n-gram 1.65 times the chance that the target does.
THRESHOLD = -0.5
#: Bound of the trusted target: so many rows at most, chosen by a hash of their id.
TARGET_ROWS = 20_000
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _marks(cells: int) -> Column:
    """A number for each of a row's words: its cell, or -1 - its cell where the word before has the same hash."""
    hashed = "transform(words, w -> cast(conv(left(md5(w), 8), 16, 10) as bigint))"
    marked = f"transform(h, (x, i) -> cast(if(x = get(h, i - 1), -1 - x % {cells}, x % {cells}) as int))"
    return F.expr(f"transform(array({hashed}), h -> {marked})[0]")


#: Word cell of a mark x, and pair cell of two marks in a row, which follow those of the words. A stutter is the same pair whatever its word.
_WORD = "if(x < 0, -1 - x, x)"
_PAIR = "{cells} + if(x < 0, 0, (31 * if(before < 0, -1 - before, before) + x) % {cells})"


def _grams(cells: int) -> tuple[Column, Column]:
    """Cells of a row's words and of its word pairs, from its column marks."""
    words = F.expr(f"transform(marks, x -> {_WORD})")
    pairs = F.expr(f"""if(size(marks) < 2, cast(array() as array<int>),
                     zip_with(slice(marks, 1, size(marks) - 1), slice(marks, 2, size(marks) - 1), (before, x) -> {_PAIR.format(cells=cells)}))""")
    return words, pairs


def _score(cells: int) -> Column:
    """The lower of the mean weights of a row's words and word pairs, in one pass over its column marks; 0 without n-grams."""
    word = "if(x < 0, -1 - x, x)"
    pair = f"{cells} + if(x < 0, 0, (31 * a.last + x) % {cells})"
    return F.expr(f"""aggregate(marks, named_struct('words', 0D, 'pairs', 0D, 'last', -1),
        (a, x) -> named_struct('words', a.words + get(weights, {word}), 'pairs', if(a.last < 0, 0D, a.pairs + get(weights, {pair})), 'last', {word}),
        a -> least(if(size(marks) < 1, 0D, a.words / size(marks)), if(size(marks) < 2, 0D, a.pairs / (size(marks) - 1))))""")


def log_ratios(docs: DataFrame, trusted: DataFrame, cells: int = CELLS, prior: float = PRIOR, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row: weights, an array of log(target share / raw share) by cell, first of words, then of pairs.

    trusted: the ids (column doc_id) of trusted documents, of which at most target_rows are taken; null and repeated ones
    don't count. The raw counts cover every document. Without documents or trusted ones all weights are equal, which then
    leaves the base rules alone.
    """
    marked = docs.select("doc_id", _words(text_of()).alias("words")).select("doc_id", _marks(cells).alias("marks"))
    return _log_ratios(marked, trusted, cells, prior, target_rows)


def _log_ratios(marked: DataFrame, trusted: DataFrame, cells: int, prior: float, target_rows: int) -> DataFrame:
    """The same from rows that hold doc_id and marks."""
    ids = trusted.where("doc_id is not null").select("doc_id").distinct()
    chosen = ids.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(target_rows).withColumn("target", F.lit(1))
    read = marked.select("doc_id", "marks").join(F.broadcast(chosen), "doc_id", "left")  # bounded by target_rows
    read = read.select(F.coalesce("target", F.lit(0)).alias("target"), "marks")
    grams = read.select("target", F.explode(F.concat(*_grams(cells))).alias("cell"))
    counts = grams.groupBy("cell").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    every = marked.sparkSession.range(2 * cells).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left").na.fill(0)
    sums = {short: F.sum(F.when((F.col("cell") >= cells) == pair, F.col(name))).alias(short) for name, short, pair in (("raw", "r", False), ("target", "g", False), ("raw", "r2", True), ("target", "g2", True))}
    table = every.agg(F.array_sort(F.collect_list(F.struct("cell", "raw", "target"))).alias("t"), *sums.values())
    ratio = f"ln((x.target + {prior}) / (if(x.cell < {cells}, g, g2) + {prior * cells})) - ln((x.raw + {prior}) / (if(x.cell < {cells}, r, r2) + {prior * cells}))"
    return table.selectExpr(f"if(g = 0, transform(t, x -> 0D), transform(t, x -> cast({ratio} as double))) as weights")


def measure(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and marks, a small number for each word.

    This is all that reads texts. Null and empty ones have no words. Windows are compared by 64-bit hashes of their words.
    Repeated rows get equal results; extra columns are ignored. Each measure is computed once, whatever filters and columns
    follow.
    """
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    first = docs.select("doc_id", _words(text).alias("words"), lines.alias("lines"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("n_symbols"))
    gets = ", ".join(f"get(words, i + {k})" for k in range(WINDOW))
    second = first.select(
        "doc_id", "n_symbols", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), _marks(cells).alias("marks"),
        F.expr(f"if(size(words) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64({gets})))").alias("windows"),
    )
    third = second.select(
        "*",
        F.expr("""if(size(array_distinct(windows)) = size(windows), cast(array() as array<struct<h: bigint, i: int>>),
                     array_sort(transform(windows, (h, i) -> named_struct('h', h, 'i', i))))""").alias("ordered"),
    )
    same = "array_sort(filter(transform(ordered, (e, k) -> if(e.h = get(ordered, k - 1).h or e.h = get(ordered, k + 1).h, e.i, -1)), i -> i >= 0))"
    fourth = third.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(f"if(size(ordered) = 0, cast(array() as array<int>), {same})").alias("at"),
        "marks",
    )
    covered = f"aggregate(zip_with(at, slice(at, 2, size(at)), (a, b) -> least(coalesce(b - a, {WINDOW}), {WINDOW})), 0, (sum, n) -> sum + n)"
    measures = [*(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")), F.expr(f"if(size(at) = 0, 0L, cast({covered} as long))").alias("n_repeat_words"), "marks"]
    # A generator of one row: the optimiser takes no filter and no column through it, so none of the above is written out again.
    return fourth.select("doc_id", F.inline_outer(F.array(F.struct(*measures))))


def _judged(measured: DataFrame, ratios: DataFrame, cells: int, threshold: float) -> DataFrame:
    weighed = measured.withColumn("weights", ratios.select("weights").scalar())
    # As in measure(): the score is computed once.
    counted = weighed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.inline_outer(F.array(F.struct(_score(cells).alias("score")))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def judge(docs: DataFrame, ratios: DataFrame, cells: int = CELLS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept.

    Null and empty texts fail. score is the lower of the two orders' mean log ratios (0 without n-grams).
    """
    return _judged(measure(docs, cells), ratios, cells, threshold)


def verdicts(docs: DataFrame, trusted: DataFrame, cells: int = CELLS, prior: float = PRIOR, target_rows: int = TARGET_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """judge() by the log_ratios() of the same documents. Texts are read once: their measures and marks, some two bytes a
    word, are written to the shared folder, and counting and judging read these."""
    measured = durable(measure(docs, cells), "quality")
    return _judged(measured, _log_ratios(measured, trusted, cells, prior, target_rows), cells, threshold)
