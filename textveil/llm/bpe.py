"""Byte-level BPE over Arrow batches: ids with byte and character offsets, and the way back.

The tokenizers library encodes; its byte-level model spells every byte as one printable character, and the table between
the two is built from the same rule here. Ranks come from a file of base64 tokens and ranks. A text is cut where white
space begins, which the pre-tokenisation pattern never crosses, and the ids of a piece are remembered up to a bound, so
that the library sees every spelling once.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

#: Pieces remembered in a worker's newer generation (the older holds as many), and the longest that stay.
MEMO_PIECES, MEMO_CHARS = 300_000, 64
#: Unicode's White_Space property (fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable character for each byte: itself if it prints in Latin-1, else the next free one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=4)
def tokenizer_json(ranks_path: str, pattern: str) -> str:
    """A byte-level tokenizer with the file's ranks; every split of a token into two tokens is a merge of its rank."""
    letters = byte_letters()
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    spelled = {token: "".join(map(letters.__getitem__, token)) for token in ranks}
    merges = [
        (spelled[token[:cut]], spelled[token[cut:]])
        for token in sorted(ranks, key=ranks.get)
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    own = Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    own.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    own.decoder = decoders.ByteLevel()
    return own.to_str()


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        back = {c: b for b, c in enumerate(byte_letters())}
        vocab = json.loads(spec)["model"]["vocab"]
        self.token_bytes = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, number in vocab.items():
            self.token_bytes[number] = bytes(map(back.__getitem__, token))
        self.token_width = np.array([len(t) for t in self.token_bytes])

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text, in order."""
        cut = [PIECE.findall(text) for text in texts]
        wanted = set(chain.from_iterable(cut))
        if len(self.memo) + len(wanted) > MEMO_PIECES:
            self.older, self.memo = self.memo, {}
        memo, older, fresh = self.memo, self.older, []
        for piece in wanted.difference(memo):
            if piece in older:
                memo[piece] = older[piece]
            else:
                fresh.append(piece)
        self._learn(fresh)
        try:
            for pieces in cut:
                yield list(chain.from_iterable(map(memo.__getitem__, pieces)))
        finally:
            for piece in fresh:
                if len(piece) > MEMO_CHARS:
                    del memo[piece]

    def _learn(self, fresh: list[str]) -> None:
        """Encode pieces: those that open with a blank as one long text, which the pattern cuts at each blank again."""
        row = [p for p in fresh if p[0] in " \n" and p[-1] not in " \n" and not p.isspace()]
        for at in range(0, len(row), 1000):
            part = row[at : at + 1000]
            ids = self.library.encode("".join(part), add_special_tokens=False).ids
            ends = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in part])
            cuts = np.searchsorted(np.cumsum(self.token_width[ids]), ends, "left") + 1
            start = 0
            for piece, end in zip(part, cuts.tolist(), strict=True):
                self.memo[piece] = tuple(ids[start:end])
                start = end
        rest = list(set(fresh).difference(row))
        for piece, coded in zip(rest, self.library.encode_batch(rest, add_special_tokens=False), strict=True):
            self.memo[piece] = tuple(coded.ids)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def spans(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """Start of each token in bytes, and in characters (the character that holds its first byte)."""
        starts, at = [], 0
        for number in ids:
            starts.append(at)
            at += len(self.token_bytes[number])
        raw, chars, seen, char = text.encode("utf-8", "surrogatepass"), [], 0, -1
        for start in starts:
            while seen <= start:
                char += raw[seen] & 0xC0 != 0x80
                seen += 1
            chars.append(char)
        return starts, chars

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; a character split over tokens is whole again, a part of one at either end becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec_of(spec: str) -> Codec:
    """The codec of a worker process: what it remembers outlives a task."""
    return Codec(spec)


def encode(docs: DataFrame, ranks_path: str, pattern: str, offsets: bool = True, digests: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, ids and, as asked for, byte_starts, char_starts (per token) and digests.

    digests replaces the arrays by n_tokens, ids_sha256 and decoded_sha256 (of the decoded ids). Null and empty texts
    have no ids. Extra columns are ignored; repeated rows and null ids of documents pass through.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(ranks_path, pattern))
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>" + ", byte_starts array<int>, char_starts array<int>" * offsets

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        decimal = list(map(str, range(len(codec.token_bytes))))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns: list[list] = [[], [], []]
                texts = [text or "" for text in part.column("text").to_pylist()]
                for text, ids in zip(texts, codec.encode_batch(texts), strict=True):
                    if digests:
                        listed = ",".join(map(decimal.__getitem__, ids)).encode()
                        values = (len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(codec.decode_bytes(ids)).hexdigest())
                    else:
                        values = (ids, *(codec.spans(text, ids) if offsets else ()))
                    for column, value in zip(columns, values):  # noqa: B905  fewer values than columns without offsets
                        column.append(value)
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids", *["byte_starts", "char_starts"] * offsets]
                kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32())] * len(names)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns[: len(names)], kinds)], ["doc_id", *names])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(work, fields)


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and text for rows of doc_id and ids; null ids give an empty text."""
    spec = tokens.sparkSession.sparkContext.broadcast(tokenizer_json(ranks_path, pattern))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(tokens["doc_id"].cast("long"), tokens["ids"]).mapInArrow(work, "doc_id long, text string")
