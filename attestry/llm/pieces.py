"""Vocabulary files in the SentencePiece model format, read without the library.

The file is a protocol buffer; only the public fields needed here are read: pieces (field 1: piece 1,
score 2, type 3), the trainer's byte fallback flag (field 2, 35) and unknown surface (field 2, 44) and the
normalizer (field 3: character map 2, dummy prefix 3, extra spaces 4, escape 5).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import cached_property

#: Piece types of the file format, and the symbol that stands for a space.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


def _fields(data: bytes):
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    types: list[int]
    byte_fallback: bool = False
    plain: bool = field(default=True)  # no character map, dummy prefix on, extra spaces kept, spaces escaped

    @cached_property
    def ids(self) -> dict[str, int]:
        """Pieces that text can be made of."""
        return {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER_DEFINED, UNUSED)}

    @cached_property
    def byte_ids(self) -> list[int]:
        at = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        return [at[f"<0x{b:02X}>"] for b in range(256)] if self.byte_fallback else []

    @cached_property
    def unk(self) -> int:
        return self.types.index(UNKNOWN)

    @cached_property
    def splits(self) -> bool:
        """True if no piece holds a space symbol after another character: then words are independent."""
        return not any(SPACE in p.lstrip(SPACE) for p in self.ids)


def parse(data: bytes) -> Vocabulary:
    pieces, scores, types, fallback, plain = [], [], [], False, True
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            pieces.append(piece)
            scores.append(score)
            types.append(kind)
        elif number == 2:
            fallback = any(n == 35 and v for n, v in _fields(value))
        elif number == 3:
            spec = dict(_fields(value))
            plain = not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1
    if not plain:
        raise ValueError("only vocabularies with an identity normalizer that keeps extra spaces are supported")
    if USER_DEFINED in types:
        raise ValueError("user-defined symbols are not supported")
    return Vocabulary(pieces, scores, types, fallback)


def escaped(text: str) -> str:
    """The text as the vocabulary sees it: dummy prefix, spaces as symbols; an empty text stays empty."""
    return (SPACE + text).replace(" ", SPACE) if text else ""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
