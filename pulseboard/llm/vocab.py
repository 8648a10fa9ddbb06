"""Tokenizers read from files, and the bytes of their tokens."""

from __future__ import annotations

import base64
import json
import re
from functools import cache

import numpy as np

WORD_START = "▁"  # stands for a space in pieces
#: The rank file's library keeps a stack entry for each character of a white-space run; longer runs go the other way.
LONG_SPACE = re.compile(r"\s{50000}")


def byte_level() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable Latin-1 characters stand for themselves, the
    other bytes, in order, for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Ids of a byte-level vocabulary, given as the JSON of the tokenizers library and, for speed, as a rank
    file. ``plain``: the added tokens' strings in a text are ordinary text; else they stand as their ids."""

    def __init__(self, path: str, ranks: str, plain: bool):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec["added_tokens"]
        if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take in what stands beside them")
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {} if plain else {x["content"]: x["id"] for x in added}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        chars = byte_level()
        self.bytes: list[bytes] = [b""] * self.whole.get_vocab_size(with_added_tokens=True)
        for token, i in spec["model"]["vocab"].items():
            self.bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()

    def ids(self, text: str) -> np.ndarray:
        if len(text) >= 50_000 and LONG_SPACE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype(np.uint32)


class Pieces:
    """Ids of a sentence-piece model and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if m.is_byte(i) else p.replace(WORD_START, " ").encode() for i, p in enumerate(names)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@cache
def byte_bpe(path: str, ranks: str, plain: bool) -> ByteBpe:
    return ByteBpe(path, ranks, plain)


@cache
def sentence_pieces(path: str) -> Pieces:
    return Pieces(path)
