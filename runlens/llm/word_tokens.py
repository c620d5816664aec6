"""Ids of a vocabulary whose merges end with words, by compiled ranks.

The compiled ranks of another library merge words faster than the tokenizer's own, but know neither ends of words nor its pattern. So
texts are cut into words here, many at once, and each word gets a space for its end: a byte and this space are the first of all
merges, which makes them the byte that ends a word. Every token of ``TOKENIZER`` is what its own letters merge to, so that ranks of
bytes and merges of pairs agree; of other vocabularies this is not known.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

#: Its words are 's, 't, 're, 've, 'm, 'll, 'd, runs of letters, single numbers, and runs of other signs.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
_SUFFIX = "</w>"
#: Characters whose case and class are asked of the tokenizer one by one, as neighbours do not change them: Latin, Greek and Cyrillic
#: ones, dashes, quotes and a few signs. Marks that join a letter are not among them.
_ASKED = [*range(0x250), *range(0x370, 0x530), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC, 0x2122]
_SPACE, _LETTER, _NUMBER, _OTHER, _BETWEEN, _UNKNOWN = range(6)
#: Stands between texts; no character.
_MARK = 0xFFFF
#: Bytes of text that are merged at once.
_PART = 2 << 20
_GAP = re.compile(rb"\s")


def _byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergedIds:
    """Ids of the texts that ``knows`` accepts: those of known characters without the look of a special token."""

    def __init__(self, tokenizer: Tokenizer):
        with open(TOKENIZER, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()

        def spelled(token: str) -> bytes:
            plain = token.removesuffix(_SUFFIX)
            return bytes(letters[c] for c in plain) + b" " * (plain != token)

        order = [*(c + _SUFFIX for c in letters), *letters, *("".join(pair) for pair in model["merges"])]
        ranks = {spelled(token): rank for rank, token in enumerate(order)}
        self.ids = np.array([model["vocab"][token] for token in order], np.uint32)
        self.end = ranks[b"\n"]
        self.ranks = tiktoken.Encoding("words", pat_str=r"[^ \n]+ |\n", mergeable_ranks=ranks, special_tokens={})

        normal, words = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.lower, self.kind = np.zeros(_MARK + 1, np.uint16), np.full(_MARK + 1, _UNKNOWN, np.uint8)
        for code in _ASKED:
            c = normal(chr(code))
            if len(c) == 1 and not unicodedata.combining(c):
                self.lower[code] = ord(c)
                self.kind[code] = _SPACE if c == " " else _LETTER if len(words(f"a{c}a")) == 1 else _NUMBER if len(words(c + c)) == 2 else _OTHER
        self.lower[_MARK], self.kind[_MARK] = ord("\n"), _BETWEEN
        known = "".join(map(re.escape, map(chr, np.flatnonzero(self.kind < _BETWEEN).tolist())))
        self.unknown = re.compile(f"[^{known}]")

    def knows(self, text: bytes) -> bool:
        return b"<|" not in text and (text.isascii() or not self.unknown.search(text.decode()))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. Long ones go part by part, cut at white space, which no token crosses."""
        short = [t if len(t) <= _PART else b"" for t in texts]
        found = self._merged(short)
        for row, text in enumerate(texts):
            if len(text) > _PART:
                found[row] = b"".join(self._merged([part])[0] for part in parts(text, _PART))
        return found

    def _merged(self, texts: list[bytes]) -> list[bytes]:
        found = self.ranks.encode_to_numpy(self._words(texts), disallowed_special=())
        ends = 4 * np.flatnonzero(found == self.end)
        data = self.ids[found].tobytes()
        return [data[begin:end] for begin, end in zip([0, *(ends + 4).tolist()], ends.tolist())]

    def _words(self, texts: list[bytes]) -> str:
        """The texts in lower case with a space after each word and a line feed after each text."""
        mark = chr(_MARK).encode()
        codes = np.frombuffer((mark.join(texts) + mark).decode().encode("utf-16-le"), np.uint16)
        lower, kind = self.lower[codes], self.kind[codes]
        here, after = kind[:-1], kind[1:]
        ends = (here < _BETWEEN) & (here != _SPACE) & (after != _SPACE) & ((here != after) | (here == _NUMBER))
        # An apostrophe that no other sign stands before takes the letters of a short form with it, and ends a word with them.
        at = np.flatnonzero(lower[:-1] == ord("'"))
        at = at[(at == 0) | (kind[at - 1] != _OTHER)]
        first, second = lower[at + 1], lower[np.minimum(at + 2, len(lower) - 1)]
        taken = np.isin(first, [ord(c) for c in "stmd"]).astype(np.int64)
        for a, b in ("re", "ve", "ll"):
            taken[(first == ord(a)) & (second == ord(b))] = 2
        at, taken = at[taken > 0], taken[taken > 0]
        ends[at] = False
        last = at + taken
        ends[last[kind[last + 1] != _SPACE]] = True
        return np.insert(lower, np.flatnonzero(ends) + 1, ord(" ")).tobytes().decode("utf-16-le")


def parts(text: bytes, size: int) -> list[bytes]:
    """A text in parts of about ``size``, cut after white space."""
    found, at = [], 0
    while gap := _GAP.search(text, at + size):
        found.append(text[at : gap.end()])
        at = gap.end()
    return [*found, text[at:]]
