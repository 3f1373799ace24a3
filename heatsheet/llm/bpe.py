"""Byte-level BPE by a sentencepiece model that is written from the vocabulary itself.

A rank file lists byte strings with their merge ranks. Every byte is mapped to one
character, each entry becomes a piece with the score ``-rank``, and normalisation is the
identity. Sentencepiece then merges the pair with the best score first, leftmost on ties,
which is the order of the ranks. Nothing is trained.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, map_rows, text_bytes

#: Pre-tokens of the recent half of what a task remembers.
REMEMBERED = 60_000
#: Pre-tokens longer than this are encoded anew in each chunk.
REMEMBERED_LETTERS = 64
#: Bytes of texts whose new pre-tokens are encoded together.
CHUNK = 1 << 18
UNKNOWN = "⁇unknown"


def byte_characters() -> list[str]:
    """One printable character for each byte: its own where it has one, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks of a file with one base64 entry and its rank a line."""
    return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in lines.splitlines() if line)}


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(tag: int, value: bytes | int) -> bytes:
    """A protocol buffer field: a number or a length-delimited message."""
    if isinstance(value, int):
        return _number(tag << 3) + _number(value)
    return _number(tag << 3 | 2) + _number(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a rank table; the id of a piece is its rank.

    Ranks must be 0, 1, 2, ... without a gap. The unknown piece, which a model must have,
    comes last and is never met, as all 256 bytes are pieces.
    """
    entries = sorted(ranks, key=ranks.__getitem__)
    if [ranks[e] for e in entries] != list(range(len(entries))):
        raise ValueError("ranks must be consecutive from 0")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without an entry: {missing}")
    shown = byte_characters()
    normal, unknown, bpe = 1, 2, 2  # kinds of piece and of model, as the format numbers them
    pieces = [("".join(shown[b] for b in e), -float(ranks[e]), normal) for e in entries] + [(UNKNOWN, 0.0, unknown)]
    model = bytearray()
    for text, score, kind in pieces:
        piece = _field(1, text.encode()) + _number(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind)
        model += _field(1, piece)
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(entries)) + _field(45, UNKNOWN.encode())
    trainer += b"".join(_number(tag << 3) + _number((1 << 64) - 1) for tag in (41, 42, 43))  # no begin, end, padding
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(model) + _field(2, trainer) + _field(3, normaliser)


@dataclass
class Codec:
    """Encodes and decodes inside one task.

    Pre-tokens that are not remembered are encoded together, one call for those of many
    texts. What is remembered has two ages: when the recent half is full, it becomes the
    older one, and what is met again is taken over; so the frequent ones always stay.
    """

    ranks: dict[bytes, int]
    pattern: str
    model: bytes
    recent: tuple[dict[str, str], dict[str, bytes]] = field(default_factory=lambda: ({}, {}))
    older: tuple[dict[str, str], dict[str, bytes]] = field(default_factory=lambda: ({}, {}))

    def __post_init__(self) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.split = regex.compile(self.pattern).findall
        self.shown = {b: c for b, c in enumerate(byte_characters())}
        self.bytes_of = [entry for entry, _ in sorted(self.ranks.items(), key=lambda e: e[1])]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each pre-token. A pre-token that is an entry itself is that entry."""
        raw = [piece.encode() for piece in pieces]
        out = [[rank] if (rank := self.ranks.get(r)) is not None else None for r in raw]
        open_ = [i for i, ids in enumerate(out) if ids is None]
        shown = [raw[i].decode("latin-1").translate(self.shown) for i in open_]
        for i, ids in zip(open_, self.processor.encode(shown, num_threads=1) if shown else (), strict=True):
            out[i] = ids
        return out

    def codes(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text: its ids as text, and the bytes that they decode to."""
        split = [self.split(text) for text in texts]
        (shown, raw), (old_shown, old_raw) = self.recent, self.older
        new = []
        for piece in set().union(*split).difference(shown):
            if piece in old_shown:
                shown[piece], raw[piece] = old_shown[piece], old_raw[piece]
            else:
                new.append(piece)
        for piece, ids in zip(new, self.ids_of(new), strict=True):
            shown[piece], raw[piece] = ",".join(map(str, ids)), self.decode(ids)
        for pieces in split:
            yield ",".join(map(shown.__getitem__, pieces)), b"".join(map(raw.__getitem__, pieces))
        for piece in new:
            if len(piece) > REMEMBERED_LETTERS:
                del shown[piece], raw[piece]
        if len(shown) >= REMEMBERED:
            self.recent, self.older = ({}, {}), self.recent

    def encode(self, text: str) -> list[int]:
        ((ids, _),) = self.codes([text])
        return [int(i) for i in ids.split(",")] if ids else []


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids if asked for).

    Each match of ``pattern`` is encoded by itself; nothing is a special token. A null text
    is an empty one: no ids, digests of nothing. Bytes that are not UTF-8 are replaced, as
    in any text. Repeated rows give repeated results. The vocabulary travels with the task;
    its size is that of the rank file, whatever the data.
    """
    model = serialise(ranks)
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((ranks, model))

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        table, proto = shipped.value
        codec = Codec(table, pattern, proto)
        for part in chunks(source, CHUNK):
            texts = [(raw or b"").decode("utf-8", "replace") for _, raw in part]
            for (doc_id, _), (ids, decoded) in zip(part, codec.codes(texts), strict=True):
                n = ids.count(",") + 1 if ids else 0
                out = (doc_id, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                yield (*out, [int(i) for i in ids.split(",")] if ids else []) if with_ids else out

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(text_bytes(docs, "doc_id"), rows, schema + (", ids array<int>" if with_ids else ""))


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Inverse of ``encode(..., with_ids=True)``: doc_id and text. Null ids give null."""
    shipped = tokens.sparkSession.sparkContext.broadcast({r: e for e, r in ranks.items()})

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        entry = shipped.value.__getitem__
        for doc_id, ids in source:
            yield doc_id, None if ids is None else b"".join(map(entry, ids))

    kind = tokens.schema["doc_id"].dataType.simpleString()
    made = map_rows(tokens.select("doc_id", "ids"), rows, f"doc_id {kind}, text binary")
    return made.select("doc_id", F.col("text").cast("string").alias("text"))


def public_ranks(name: str = "byte_bpe_multi_50k.tiktoken", folder: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks and split pattern of an installed vocabulary; ``folder`` overrides its place."""
    import public_tokenizers

    path = f"{folder.rstrip('/')}/{name}" if folder else public_tokenizers.path(name)
    with open(path, "rb") as file:
        return read_ranks(file.read()), public_tokenizers.PATTERN
