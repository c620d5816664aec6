"""Ids by compiled ranks against the tokenizer's own library."""

import json
import random
from array import array

import pytest

from runlens.llm import packing, word_tokens

HARD = [
    "", " ", "\n", "'", "''s", "don't 'S 'tis \"'s 's's x'rex 'VE'll '", "1'1's 3.14 ½²", "a.b,,c...'d", "ÀÉ ñ ŒUVRE ŉ Ǆ ª", "Это Ёж ΣΑΣ «да»",
    "“quoted” – it’s 5€…", "a\x00b\x1cc\x85d\xa0e", "#" * 50, "no_space" * 300, "İ ﬁ J̌ 😀 中文", "a<|endoftext|>b <| c", "￿", "é ̀",
]


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(packing.TOKENIZER)


def expected(words, texts):
    return [array("I", words.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


class Silent:
    """A tokenizer that may not be asked."""

    def encode(self, *_, **__):
        raise AssertionError("a plain text went to the tokenizer")


def test_texts_of_known_characters_are_not_asked_of_the_tokenizer(words):
    texts = ["The thonoring shndings, anderwh 42 don't!", "Èonai éaieuxlepa: ünßchrift – «añb» жизнь"]
    plain, own = expected(words, texts), words.tokenizer
    words.tokenizer = Silent()
    try:
        assert words.texts([t.encode() for t in texts]) == plain and not words.words and not words.cores
    finally:
        words.tokenizer = own


def test_hard_texts(words):
    assert words.texts([t.encode() for t in HARD]) == expected(words, HARD)
    assert words.texts([]) == []


def test_any_characters(words):
    rng = random.Random(7)
    known = [chr(c) for c in word_tokens._ASKED]
    for pool in (known, "'stremdvl SAREx1 .,\n\t", "thesandingtion   ", "áèü中Σς😀  'İı<|endoftext|>"):
        texts = ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(500)]
        assert words.texts([t.encode() for t in texts]) == expected(words, texts)


def test_long_texts_are_cut_at_white_space(words, monkeypatch):
    texts = ["Don't cut the wörds 12 of this text.\n" * 40, "x", "one" * 400]
    whole = expected(words, texts)
    monkeypatch.setattr(word_tokens, "_PART", 50)
    assert words.texts([t.encode() for t in texts]) == whole
    assert max(map(len, word_tokens.parts(texts[0].encode(), 50))) < 60 and b"".join(word_tokens.parts(texts[0].encode(), 50)) == texts[0].encode()


def test_other_vocabularies_go_word_by_word(tmp_path):
    copy = tmp_path / "copy.json"
    with open(packing.TOKENIZER, "rb") as file:
        copy.write_bytes(file.read())
    words = packing.WordIds(str(copy))
    assert words.texts([b"The thonoring shndings"]) == expected(words, ["The thonoring shndings"]) and words.words


def test_each_token_is_what_its_letters_merge_to():
    """Then compiled ranks, which know tokens but no pairs, give the same ids."""
    with open(packing.TOKENIZER, encoding="utf-8") as file:
        merges = [tuple(pair) for pair in json.load(file)["model"]["merges"]]
    rank, none = {pair: i for i, pair in enumerate(merges)}, len(merges)
    for pair in merges:
        token = "".join(pair)
        parts = list(token.removesuffix("</w>"))
        if token.endswith("</w>"):
            parts[-1] += "</w>"
        while len(parts) > 1:
            best, at = min((rank.get((parts[i], parts[i + 1]), none), i) for i in range(len(parts) - 1))
            assert best < none, token
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
        assert parts == [token]
