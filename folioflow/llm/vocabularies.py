"""Public tokenizers, loaded once per Python worker from the files that a path names.

The byte-level vocabulary is read from its json file and run through tiktoken, which
gives the same ids as the tokenizers library at a fourth of its time (a test compares
them). Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
# The pattern that splits a text before the merges of the byte-level vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {chr(b): b for b in plain}
    hidden = [b for b in range(256) if chr(b) not in shown]
    return shown | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def byte_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; special tokens have none."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    letters = byte_of_letter()
    vocabulary = spec["model"]["vocab"]
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, number in vocabulary.items():
        if entry not in special:
            out[number] = bytes(letters[c] for c in entry)
    return out


@lru_cache(maxsize=4)
def byte_encoder(path: str):
    """text -> ids, without special tokens."""
    import tiktoken

    ranks = {token: number for number, token in enumerate(byte_tokens(path)) if token}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=4)
def piece_encoder(path: str):
    """text -> ids of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: model.encode(text, num_threads=1)


@lru_cache(maxsize=4)
def piece_tokens(path: str) -> list[bytes]:
    """The bytes of every piece: UTF-8 with U+2581 as space, byte pieces as their byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(number) else piece.replace("▁", " ").encode("utf-8"))
    return out


def lengths(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
