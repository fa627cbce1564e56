"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A rank file becomes a ``tokenizers`` model: each byte is a printable character of the byte table, and every
way to split a token into two tokens is a merge, in order of the token's rank. Texts are cut where no
match of the pattern crosses (before the space or white space that starts a word); each worker keeps
the ids of pieces it has met, up to a bound, so common words are encoded once.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pieces that a worker remembers the ids of (those met lately), and their longest length.
MAX_PIECES, PIECE_CHARS = 300_000, 40

#: ``' ?\S+|\s+(?!\S)|\s+'`` is what the pattern's matches are cut from.
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that libraries disagree about being white space: such texts are encoded in one piece.
_ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: From here on, versions of Unicode may differ in what is a letter: such pieces are left to the library.
LATER = "\u2000"
_MATCH = regex.compile(public_tokenizers.PATTERN)


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(spare)) for b in range(256)]


def build_tokenizer(ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> Tokenizer:
    chars = byte_characters()
    spell = lambda t: "".join(chars[b] for b in t)
    merges = [
        (spell(t[:i]), spell(t[i:]))
        for t in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    ]
    model = models.BPE({spell(t): r for t, r in ranks.items()}, merges, ignore_merges=True)
    out = Tokenizer(model)
    out.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return out


class Encoder:
    """``encode(text)`` gives little-endian 32-bit ids as bytes; ``decode(ids)`` the bytes they stand for."""

    def __init__(self, path: str = RANKS):
        ranks = read_ranks(path)
        self.tokenizer, self.chars = build_tokenizer(ranks), byte_characters()
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.table = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.table[r] = t
        self.lengths = np.array([len(t) for t in self.table], dtype=np.int64)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if max(piece) < LATER:
                matches = ["".join([self.chars[b] for b in m.encode()]) for m in _MATCH.findall(piece)]
                found = [t.id for m in matches for t in self.model.tokenize(m)]
                ids = struct.pack(f"<{len(found)}i", *found)
            else:
                ids = self.whole(piece)
        if len(piece) <= PIECE_CHARS:
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.whole(text)
        pieces = _PIECES.findall(text)
        if 2 * len(self.known) > MAX_PIECES:
            self.known, self.older = {}, self.known
        ids = list(map(self.known.get, pieces))
        if None in ids:
            ids = [self._piece(p) if i is None else i for p, i in zip(pieces, ids, strict=True)]
        return b"".join(ids)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end, in code points, of each token; tokens that share a split character all span it."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        end = np.cumsum(self.lengths[ids])
        return char[end - self.lengths[ids]], char[end - 1] + 1


@cache
def _encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def _lists(parts: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def encode(docs: DataFrame, path: str = RANKS, offsets: bool = False) -> DataFrame:
    """``doc_id, ids`` (array of int), with ``starts, ends`` (code points) if ``offsets`` are asked for.

    One row per row of ``docs`` (``doc_id, text``). A null or empty text has no ids. Every match of
    the pattern is encoded by itself, without special tokens: their strings are ordinary text.
    An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path)
        for b in _slices(batches):
            texts = [t or "" for t in b["text"].to_pylist()]
            ids = [own.encode(t) for t in texts]
            columns = {"doc_id": b["doc_id"], "ids": _lists(ids)}
            if offsets:
                both = [own.offsets(t, np.frombuffer(i, dtype="<i4")) for t, i in zip(texts, ids, strict=True)]
                columns |= {n: _lists([x[k].astype("<i4").tobytes() for x in both]) for k, n in enumerate(("starts", "ends"))}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """``encoded`` (``doc_id, ids``) with ``data``: the bytes of all ids in order, so characters that
    tokens split come whole again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path)
        for b in _slices(batches):
            data = [own.decode(np.asarray(x.values)) if x.values is not None else b"" for x in b["ids"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["ids"], pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary")
