"""Sub-words with offsets: the longest piece of a vocabulary first, as word-piece models cut words.

Words are cut natively (bio.tokens); their pieces are found in a trie, word by word over Arrow batches, each distinct word
once while it is remembered. A document then has a fixed number of tokens: a first one, its pieces as far as there is room,
a last one, and padding. Those that stand for no text have empty parts, so that no span touches them: their tag is O.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

# Special pieces, the sign of a piece inside a word, and the longest word that is cut.
FIRST, LAST, PADDING, UNKNOWN, INSIDE, LONGEST_WORD = "[CLS]", "[SEP]", "[PAD]", "[UNK]", "##", 100
PIECES = "array<struct<s: int, m: string, piece: string, word: int>>"
REMEMBERED = 200_000
#: Documents whose sub-words are held at once.
ROWS = 500


def read(path: str) -> list[str]:
    """A vocabulary file with a piece a line."""
    with open(path, encoding="utf-8") as lines:
        return [line.rstrip("\n") for line in lines]


class Trie:
    """Pieces by letters; a node is a dictionary, and None in it marks the end of a piece."""

    def __init__(self, pieces: list[str]) -> None:
        self.begin, self.inside = {}, {}
        for piece in pieces:
            node, letters = (self.inside, piece[len(INSIDE) :]) if piece.startswith(INSIDE) and len(piece) > len(INSIDE) else (self.begin, piece)
            for letter in letters:
                node = node.setdefault(letter, {})
            node[None] = True

    def longest(self, word: str, at: int) -> int:
        """Where the longest piece from a place in a word ends; 0 if there is none."""
        node, end, k = self.inside if at else self.begin, 0, at
        while k < len(word) and (node := node.get(word[k])) is not None:
            k += 1
            if None in node:
                end = k
        return end

    def cut(self, word: str) -> list[tuple[int, int, str]]:
        """start, end, piece of a word's pieces; a word that can't be cut to its end is one unknown piece."""
        lowered, out, at = word.lower(), [], 0
        if len(word) <= LONGEST_WORD and len(lowered) == len(word):
            while at < len(word):
                end = self.longest(lowered, at)
                if not end:
                    break
                out.append((at, end, (INSIDE if at else "") + lowered[at:end]))
                at = end
        return out if at == len(word) else [(0, len(word), UNKNOWN)]


def add(docs: DataFrame, tokens: Column, vocabulary: list[str], longest: int = 256, into: str = "pieces", padded: bool = True) -> DataFrame:
    """docs with an array of struct (s, m, piece, word) of `longest` tokens, from a column of words (s, m).

    m is the part of the text, word its word's number, null for tokens that stand for no text. Null words give a document
    without pieces of its own. padded: else padding is left out, for steps that look at words only.
    """
    schema = StructType([*docs.schema.fields, StructField(into, StructType.fromDDL(f"x {PIECES}")[0].dataType)])
    kind = to_arrow_schema(schema).field(into).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(vocabulary)
        known: dict[str, tuple[list[int], list[str], list[str]]] = {}
        for whole in batches:
            # a few rows at a time: each makes `longest` tokens
            for batch in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                *kept, words = batch.columns
                sizes = pc.fill_null(pc.list_value_length(words), 0).to_pylist()
                every = words.flatten()
                starts, parts = every.field("s").to_pylist(), every.field("m").to_pylist()
                s, m, piece, word, offsets, at = [], [], [], [], [0], 0
                for size in sizes:
                    s.append(0), m.append(""), piece.append(FIRST), word.append(None)
                    end = len(s) + longest - 2
                    for n in range(size):
                        if len(s) >= end:
                            break
                        own, start = parts[at + n], starts[at + n]
                        if own not in known:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            cut = trie.cut(own)
                            known[own] = [a for a, _, _ in cut], [own[a:b] for a, b, _ in cut], [x for _, _, x in cut]
                        places, letters, pieces = known[own]
                        s += [start + a for a in places]
                        m += letters
                        piece += pieces
                        word += [n] * len(places)
                    at += size
                    del s[end:], m[end:], piece[end:], word[end:]
                    rest = end - len(s) if padded else 0
                    s += [0] * (rest + 1)
                    m += [""] * (rest + 1)
                    piece += [LAST, *[PADDING] * rest]
                    word += [None] * (rest + 1)
                    offsets.append(len(s))
                fields = [pa.array(values, f.type) for values, f in zip((s, m, piece, word), kind.value_type, strict=True)]
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)), type=kind)
                yield pa.RecordBatch.from_arrays([*kept, listed], names=[*batch.schema.names[:-1], into])

    return docs.select("*", tokens.alias("_words")).mapInArrow(run, schema)
