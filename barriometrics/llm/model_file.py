"""Reads a SentencePiece model file: the protobuf's pieces, trainer and normaliser settings."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Piece types of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, wire type, value) of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield number, data[at : at + size]
            at += size


def _float(data: bytes) -> float:
    return struct.unpack("<f", data)[0]


@dataclass
class ModelFile:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @staticmethod
    def parse(data: bytes) -> ModelFile:
        model = ModelFile()
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                model.pieces.append(piece[1].decode())
                model.scores.append(_float(piece[2]))
                model.types.append(piece[3])
            elif number == 2:
                trainer = dict(_fields(value))
                model.model_type = trainer.get(3, UNIGRAM)
                model.byte_fallback = bool(trainer.get(35, 0))
                model.unk_id = trainer.get(40, 0)
            elif number == 3:
                normaliser = dict(_fields(value))
                model.charsmap = normaliser.get(2, b"")
                model.add_dummy_prefix = bool(normaliser.get(3, 1))
                model.remove_extra_whitespaces = bool(normaliser.get(4, 1))
                model.escape_whitespaces = bool(normaliser.get(5, 1))
        return model

    @staticmethod
    def read(path: str) -> ModelFile:
        with open(path, "rb") as file:
            return ModelFile.parse(file.read())

    def normal_pieces(self) -> list[tuple[str, float]]:
        return [(p, s) for p, s, t in zip(self.pieces, self.scores, self.types, strict=True) if t == NORMAL]
