"""Ids of a byte-level vocabulary.

The vocabulary comes as a file of two libraries. The one with compiled ranks is the faster, and both agree on texts whose letters,
digits and spaces are classed alike for good, those of Latin scripts; other texts, and very long words, go to the other one.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Code points before this one have had their classes since the first versions of the standard.
_LATIN = "ɐ"
#: Bytes of a word that the compiled ranks merge quickly.
_LONG = 1000


class ByteIds:
    """``special``: whether strings of special tokens in a text are these tokens, or plain text."""

    def __init__(self, path: str = VOCABULARY, ranks: str = RANKS, special: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        with open(ranks, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()} if special else {}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens=self.specials)
        self.allowed = set(self.specials)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if max(text) < _LATIN and not self._long(text):
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def _long(text: str) -> bool:
        if len(text) < _LONG:
            return False
        return any(c * (_LONG // 2) in text for c in " \n\t") or max(map(len, text.split()), default=_LONG) >= _LONG

    def spelled(self) -> list[bytes]:
        """The bytes of each id."""
        out = [b""] * (max([*self.ranks.values(), *self.specials.values()]) + 1)
        for token, i in self.ranks.items():
            out[i] = token
        for token, i in self.specials.items():
            out[i] = token.encode()
        return out


@cache
def byte_ids(path: str = VOCABULARY, ranks: str = RANKS, special: bool = True) -> ByteIds:
    """Made once in each worker."""
    return ByteIds(path, ranks, special)
