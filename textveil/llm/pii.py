"""Personal data in whole texts, through disguises, as spans of source characters.

Two passes. The base pass finds e-mail addresses, IPv4 addresses, payment cards and phone numbers as they are written. The
second pass runs a chain of transducers over the text: (1) homoglyphs (Cyrillic, Greek, full-width and other compatibility
forms) and digits of all scripts become their ASCII look-alikes, and characters without width vanish; (2) at and dot disguises become `@` and `.`;
(3) runs of spelled digits become digits. Every output character carries the source interval it stands for, so a match
in the normalised text maps back to source characters. Matches that touch no rewritten character are the base pass's own.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A run of digits that fails at its start fails at every later digit too, so only starts of runs are tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like ASCII ones, without width, and spelled digits.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁɡһԛԝ", "ABESIJKMHOPCTYXaesijopcyxdghqw", strict=True))
LOOKALIKES |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧορν", "ABEZHIKMNOPTYXopv", strict=True))
LOOKALIKES |= dict(zip("αγικντυσορϲϳϱϒϹͿ", "ayikvtuoopcjpYCJ", strict=True))
LOOKALIKES |= dict(zip("ӀӏѴѵҮүԌԚԜԀЗӠбЬ", "llVvYyGQWd336b", strict=True))
LOOKALIKES |= dict(zip("ՕՍՏԼօսոհզգցյաք", "OUSLounhqqgjwf", strict=True))
LOOKALIKES |= dict(zip("ɑɡɩɪʋɣʏɯᴄᴏᴠᴡᴢᴜꜱ", "agiiuyywcovwzus", strict=True))
LOOKALIKES |= dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHiJKLMPRSTVWZ", strict=True))
LOOKALIKES |= dict(zip("ⲞⲟⲢⲣⲤⲥⲦⲘⲚⲎⲔⲒⲬⲨⲂ", "OoPpCcTMNHKIXYB", strict=True))
LOOKALIKES |= {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "．": ".", "＠": "@", "﹫": "@", "ı": "i", " ": " ", " ": " ", " ": " "}
WIDTHLESS = frozenset("­​‌‍⁠﻿᠎‎‏")
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

TIMES = {"double": 2, "doble": 2, "triple": 3}
_WORD, _TIMES = "|".join(sorted(SPELLED, key=len, reverse=True)), "|".join(TIMES)
#: Digits, or a spelled digit, once or more times, where no letter or digit touches it; and a spelled one in words.
DIGIT = re.compile(rf"(?<![^\W_])(?:(?:{_TIMES})[ -]++(?:[0-9]|{_WORD})|[0-9]++|{_WORD})(?![^\W_])", re.IGNORECASE)
SPELLED_ONE = re.compile(rf"\b(?:(?P<times>{_TIMES})[ -]++(?P<of>[0-9]|{_WORD})|(?P<one>{_WORD}))\b", re.IGNORECASE)
#: Light separators between two digits of a run. Each part takes all it can, so a gap is read once.
BETWEEN = re.compile(r"\)?+[ ,]*+(?:[-.(]|\bdot\b|\bpoint\b|\bpunkt\b|\bpunto\b)?+[ ]*+\(?+", re.IGNORECASE)
BEFORE_RUN = re.compile(r"(?:(?<![^\W_])plus[ ]+)?\(?\Z", re.IGNORECASE)
SAID_DOT = re.compile(r"(?<! )[ ]*+\b(?:dot|point|punkt|punto)\b[ ]*+", re.IGNORECASE)
SAID_PLUS = re.compile(r"\bplus[ ]+", re.IGNORECASE)
WIDE_GAP = re.compile(r"[ ]*,[ ]*|[ ]{2,}")
LEAST_RUN = 3
#: What a text with such a run has between characters that are no ASCII letters.
SPELLED_FORMS = frozenset(word.encode() for word in (*SPELLED, *TIMES) if word.isascii())
SPELLED_OTHER = tuple(word for word in SPELLED if not word.isascii())
LETTERS = bytes(c if 0x61 <= c <= 0x7A else 0x20 for c in range(256))
AT = r"(?:[ ]*[\[({<][ ]*(?:at|@|arroba|arobase|chez|ät)[ ]*[\])}>][ ]*|[ ]+(?:at|arroba|arobase)[ ]+|[ ]+@[ ]*|[ ]*@[ ]+|[ ]*[_-]at[_-][ ]*)"
DOT = r"(?:[ ]*[\[({<][ ]*(?:dot|\.|punkt|point|punto)[ ]*[\])}>][ ]*|[ ]+(?:dot|punkt|point|punto)[ ]+|[ ]+\.[ ]+|[ ]*[_-]dot[_-][ ]*)"
#: A disguised address: local part, at, host, and dots; either sign may be plain, but not both.
ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9_%+-]+(?:(?:\.|{DOT})[A-Za-z0-9_%+-]+){{0,3}})(?P<at>@|{AT})"
    rf"(?P<host>[A-Za-z0-9-]+(?:(?:\.|{DOT})[A-Za-z0-9-]+)+)(?![A-Za-z0-9])",
    re.IGNORECASE,
)
AT_WORD = re.compile(r"@|\bat\b|(?<=_)at(?=_)|\barroba\b|\barobase\b|\bchez\b|\bät\b", re.IGNORECASE)
#: What must follow an at sign or word, and how far around it an address is looked for first.
AFTER_AT = re.compile(rf"[\])}}>_ -]*+[A-Za-z0-9][A-Za-z0-9-]*(?:\.|{DOT})[A-Za-z0-9]", re.IGNORECASE)
REACH = 512
DOT_SIGN = re.compile(r"\.|dot|punkt|point|punto", re.IGNORECASE)
DOT_ONE = re.compile(DOT, re.IGNORECASE)
DOT_BETWEEN = re.compile(r"[0-9](?:[ ]*+[\[({<_-]?+[ ]*+(?:dot|punkt|point|punto)\b|[ ]*+[\[({<][ ]*+\.|[ ]++\.[ ])", re.IGNORECASE)
DOT_IN_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{DOT})[0-9]{{1,3}}){{3}}(?![0-9.])", re.IGNORECASE)
#: Last labels that make a host likely where the signs are bare words (fixed values); any two-letter one counts too.
ENDINGS = frozenset("com org net edu gov info biz dev app test example invalid local online site xyz".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) << (k & 1)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap, found from each `@`; runs of local characters are read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m.span()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end by kind and start."""
    found = [("email", *span) for span in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


class Tape:
    """Text with the source interval of every character, as two lists of offsets."""

    def __init__(self, text: str):
        self.text, self.changed = text, False
        self.starts, self.ends = range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace intervals (ascending, apart); each new character stands for the whole interval."""
        if not edits:
            return
        parts, starts, ends, at = [], [], [], 0
        for start, end, new in edits:
            parts += (self.text[at:start], new)
            starts.extend(self.starts[at:start])
            ends.extend(self.ends[at:start])
            if new:
                starts.extend([self.starts[start]] * len(new))
                ends.extend([self.ends[end - 1]] * len(new))
            at = end
        parts.append(self.text[at:])
        starts.extend(self.starts[at:])
        ends.extend(self.ends[at:])
        self.text, self.starts, self.ends, self.changed = "".join(parts), starts, ends, True


@lru_cache(maxsize=65536)
def _folded(c: str) -> str:
    """The ASCII form of a look-alike, a compatibility form or a decimal digit of any script; other characters as they are."""
    new = LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
    if new != c and new.isascii():
        return new
    digit = unicodedata.decimal(c, None)
    return c if digit is None else str(digit)


def fold(tape: Tape) -> None:
    """Homoglyphs, compatibility forms and digits of other scripts to ASCII; characters without width vanish. Other letters stay."""
    if tape.text.isascii():
        return
    edits = []
    for m in NOT_LATIN.finditer(tape.text):
        c = m[0]
        if c in WIDTHLESS:
            edits.append((m.start(), m.end(), ""))
        elif (new := _folded(c)) != c:
            edits.append((m.start(), m.end(), new))
    tape.rewrite(edits)


#: What fold looks at: all beyond Latin letters, and the soft hyphen and hard blank.
NOT_LATIN = re.compile(r"[\xa0\xadıɐ-\U0010ffff]")


def likely(m: re.Match) -> bool:
    """Whether a disguised address is one: bracketed signs say so; bare words need a known ending."""
    if "@" not in m["at"] and m["at"].strip()[:1] not in "[({<_-":
        last = re.split(r"[^A-Za-z0-9-]+", m["host"])[-1].lower()
        return bool(DOT_ONE.search(m["host"])) and (last in ENDINGS or len(last) == 2) or last in ENDINGS
    return bool(re.search(r"[A-Za-z]", re.split(r"[^A-Za-z0-9-]+", m["host"])[-1]))


def undisguise(tape: Tape) -> None:
    """`at` and `dot` in an address become signs; dots between the parts of an IP address too."""
    text, edits, done = tape.text, [], 0
    dot = 0  # where the next sign or word for a dot is
    for hit in AT_WORD.finditer(text):
        after, reach = hit.end(), hit.end() + REACH
        if dot < after:
            dot = m.start() if (m := DOT_SIGN.search(text, after)) else len(text) + REACH
        if hit.start() < done or dot >= reach or not AFTER_AT.match(text, after, reach):
            continue
        m = next((m for m in ADDRESS.finditer(text, max(done, hit.start() - REACH), hit.end() + REACH) if m.end("at") >= hit.end()), None)
        if m and m.end() == hit.end() + REACH:  # a host that goes on beyond the reach
            m = ADDRESS.match(text, m.start())
        if not m or m.start("at") > hit.start():
            continue
        done = m.end()
        if EMAIL.fullmatch(m[0]) or not likely(m):
            continue
        edits += [(m.start("local") + d.start(), m.start("local") + d.end(), ".") for d in DOT_ONE.finditer(m["local"])]
        if m["at"] != "@":
            edits.append((*m.span("at"), "@"))
        edits += [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in DOT_ONE.finditer(m["host"])]
    tape.rewrite(edits)
    if DOT_BETWEEN.search(tape.text):
        tape.rewrite([(m.start() + d.start(), m.start() + d.end(), ".") for m in DOT_IN_IP.finditer(tape.text) for d in DOT_ONE.finditer(m[0])])


def _lower(text: str) -> str:
    """In lower case; also the two letters that a pattern without case takes for s and i."""
    return text.lower() if text.isascii() else text.replace("ſ", "s").replace("İ", "I").replace("ı", "i").lower()


def maybe_spelled(text: str) -> bool:
    """Whether any digit may be spelled out: true wherever a run holds a spelled one that stands apart."""
    low = _lower(text)
    words = low.encode("utf-8", "surrogatepass").translate(LETTERS).split()
    return not SPELLED_FORMS.isdisjoint(words) or not low.isascii() and any(w in low for w in SPELLED_OTHER)


def _digits(m: re.Match) -> str:
    one = _lower(m["one"] or m["of"])
    return SPELLED.get(one, one) * TIMES.get(_lower(m["times"] or ""), 1)


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Three or more digits in a row, spelled ones among them, with light separators between; doubles, triples and a plus
    before count. The text is read once."""
    start, end, many = 0, 0, 0
    for m in DIGIT.finditer(text):
        if many and BETWEEN.fullmatch(text, end, m.start()):
            end, many = m.end(), many + 1
            continue
        if many >= LEAST_RUN:
            yield start - len(BEFORE_RUN.search(text, max(0, start - 64), start)[0]), end
        start, end, many = *m.span(), 1
    if many >= LEAST_RUN:
        yield start - len(BEFORE_RUN.search(text, max(0, start - 64), start)[0]), end


def spell_out(tape: Tape) -> None:
    """Runs of three or more digits, spelled ones among them, become digits; a dot spelled between them a dot."""
    if not maybe_spelled(tape.text):
        return
    edits = []
    for run in runs(tape.text):
        words = list(SPELLED_ONE.finditer(tape.text, *run))
        if not words:
            continue
        inner = [(w.start(), w.end(), _digits(w)) for w in words]
        inner += [(w.start(), w.end(), ".") for w in SAID_DOT.finditer(tape.text, *run)]
        inner += [(w.start(), w.end(), "+") for w in SAID_PLUS.finditer(tape.text, *run)]
        # Blanks and commas between two spelled digits are part of the spelling; other commas and wide gaps are one blank.
        inner += [(a.end(), b.start(), "") for a, b in zip(words, words[1:], strict=False) if not tape.text[a.end() : b.start()].strip(" ,")]
        inner += [(w.start(), w.end(), " ") for w in WIDE_GAP.finditer(tape.text, *run)]
        inner.sort()
        edits += [e for k, e in enumerate(inner) if not k or inner[k - 1][1] <= e[0]]
    tape.rewrite(edits)


def disguised(tape: Tape, start: int, end: int, source: str) -> bool:
    """Whether a match holds a sign that joins its parts on purpose: not a lone spaced dot, or one spelled digit beside a number."""
    said = source[tape.starts[start] : tape.ends[end - 1]]
    return bool(SIGN.search(said)) or len(SPELLED_ONE.findall(said)) > 1


SIGN = re.compile(r"[\[({<][ ]*(?:at|@|arroba|arobase|chez|ät|dot|\.|punkt|point|punto)[ ]*[\])}>]|[_-](?:at|dot)[_-]|[ ]dot[ ]", re.IGNORECASE)
TRANSDUCERS: tuple[Callable[[Tape], None], ...] = (fold, undisguise, spell_out, undisguise)


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: the base ones, and those of the normalised text that touch none of their kind or go beyond."""
    base = base_spans(text)
    tape = Tape(text)
    for step in TRANSDUCERS:
        step(tape)
    if not tape.changed:
        return base, base
    every, plain = list(base), {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    for kind, start, end in base_spans(tape.text):
        s, e = tape.starts[start], tape.ends[end - 1]
        near = plain[kind]
        first = max(0, bisect_left(near, (s,)) - 1)  # plain spans of a kind are in order and apart
        touched = [x for x in near[first : bisect_left(near, (e,))] if s < x[1]]
        # One that reaches beyond a plain match is told from a chance join by having no blank in it, or a sign of disguise.
        longer = not any(a <= s and e <= b for a, b in touched)
        if not touched or longer and (not re.search(r"\s", text[s:e]) or any(s <= a and b <= e for a, b in touched) and disguised(tape, start, end, text)):
            every.append((kind, s, e))
    return base, sorted(every, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; code points, end exclusive) for every row; null: empty text.

    base holds the plain matches, spans those and the disguised ones, both by kind as listed, then start. Repeated rows
    get equal results; extra columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                both = [spans(t or "") for t in part.column("text").to_pylist()]
                rows = [[[dict(zip(("kind", "start", "end"), x, strict=True)) for x in found] for found in side] for side in zip(*both, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(r, kind) for r in rows)], ["doc_id", "base", "spans"])

    fields = "array<struct<kind: string, start: long, end: long>>"
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(work, f"doc_id long, base {fields}, spans {fields}")


def mask_text(text: str) -> str:
    """text with every span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans(text)[1], key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += (text[at:start], f"[{kind.upper()}]")
            at = end
        else:
            at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """docs with text masked in place (null stays null); all other columns as they are."""
    names, place = docs.columns, docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [None if t is None else mask_text(t) for t in part.column(place).to_pylist()]
                columns = [*part.columns[:place], pa.array(texts, pa.string()), *part.columns[place + 1 :]]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    assert names.count("text") == 1, "the text column must be unambiguous"
    return docs.mapInArrow(work, docs.schema)
