"""Vocabularies read from a SentencePiece model file. The path is a parameter; the driver reads the file and ships the
pieces (tens of thousands of short strings), so executors need no such file."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

SPACE = "▁"


def default_model() -> str:
    """The 32k model beside the installed public vocabularies, unless TOKENIZER_DIR names another folder."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")


@dataclass(frozen=True)
class Spec:
    """What a model file says of its kind and of its normaliser."""

    merges: bool
    rules: bytes
    dummy_prefix: bool
    one_space: bool
    escape: bool
    suffix: bool

    @staticmethod
    def read(model: bytes) -> Spec:
        """Fields by number: of the model, 2 the trainer's and 3 the normaliser's; of the trainer's, 3 the kind of model and
        24 spaces behind words; of the normaliser's, 2 its table of rules, 3 to 5 its settings."""
        whole = _fields(model)
        trainer, normaliser = (_fields(whole.get(k, b"")) for k in (2, 3))
        setting = lambda k: bool(normaliser.get(k, 1))
        return Spec(trainer.get(3, 1) == 2, normaliser.get(2, b""), setting(3), setting(4), setting(5), bool(trainer.get(24, 0)))

    def check(self) -> None:
        if self.rules or self.suffix or not self.merges or not self.escape:
            raise ValueError("only models of merges without a table of character rules, with spaces as U+2581 before words")


def _fields(message: bytes) -> dict[int, int | bytes]:
    """The last value of every field of a protocol buffer: numbers, and bytes that have a length."""
    out: dict[int, int | bytes] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            out[key >> 3] = number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            out[key >> 3] = message[at : at + size]
            at += size
    return out


@dataclass(frozen=True)
class Pieces:
    """Ordinary pieces with their id and score, byte pieces by value, the id for what is unknown, and the model's settings."""

    ordinary: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    unknown: int
    size: int
    texts: tuple[bytes, ...] = field(repr=False)
    spec: Spec = field(repr=False)

    @staticmethod
    def load(path: str | None = None) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        ordinary, of_byte, texts = {}, {}, []
        for k in range(model.vocab_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                of_byte[int(piece[1:-1], 16)] = k
                texts.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_unknown(k):
                texts.append(" ⁇ ".encode())
            elif model.is_control(k) or model.is_unused(k):
                texts.append(b"")
            else:
                ordinary[piece] = (k, model.get_score(k))
                texts.append(piece.replace(SPACE, " ").encode())
        return Pieces(ordinary, tuple(of_byte[b] for b in range(256)) if len(of_byte) == 256 else (), model.unk_id(), model.vocab_size(), tuple(texts), Spec.read(model.serialized_model_proto()))
