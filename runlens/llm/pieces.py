"""SentencePiece encoding of merge-type models, and decoding.

A sequence of pieces is the encoding of a text exactly when every two neighbours, merged anew, come out as those two. So the
encoder takes the longest piece at each place (found by one Aho-Corasick pass), checks it against its left neighbour, tries the
next shorter prefix piece where the check fails, and steps back where none is left. A bit field marks places from which no way
leads on, so that none is tried twice and the work stays linear.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import groupby

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.texts import Memo, by_batch, text_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Ways to cut a text into chunks that are encoded on their own, from fine to none.
CHUNKS = (
    rf"{SPACE}*[^\W\d_]+|{SPACE}*(?:(?![^\W\d_])[^{SPACE}\n])+|{SPACE}+|\n",
    rf"{SPACE}*[^{SPACE}]+|{SPACE}+",
    r"(?s).+",
)
#: Neighbour checks a task remembers.
MOST_CHECKS = 500_000


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "\ufffd" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


class PieceCodec:
    """Encodes and decodes as the library does for a model of type BPE with byte fallback and without text normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unknown = model.unk_id()
        everything = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in everything if model.is_byte(i)}
        plain = [i for i in everything if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): i for i in plain}
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.known = {c for piece in self.pieces for c in piece if len(c) == 1 and c in self.pieces}
        self.spelled = [b""] * len(everything)
        for i in plain:
            self.spelled[i] = model.id_to_piece(i).replace(SPACE, " ").encode()
        for byte, i in self.bytes.items():
            self.spelled[i] = bytes([byte])
        self.marked = {i for i in plain if self.spelled[i].startswith(b" ")}
        self.spelled[self.unknown] = " ⁇ ".encode()
        # The finest rule whose borders no piece crosses: before spaces, at line ends, and between letters and other characters.
        self.chunk = next(re.compile(rule) for rule in CHUNKS if all(len(re.findall(rule, p)) == 1 for p in self.pieces))
        # Pieces that their own merges do not give never occur in an encoding.
        self.parts: dict[str, tuple[str, str]] = {}
        self.whole = {p: i for p, i in self.pieces.items() if self.merged(p, self.parts) == [p]}
        self.automaton = ahocorasick.Automaton()
        for piece in self.whole:
            self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.whole), None) for p in self.whole}
        self.sizes = {p: len(p) for p in self.whole}
        self.fits: dict[tuple[str, str], bool] = {}
        self.memo = Memo(self._chunk, most=500_000)

    def merged(self, text: str, last: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """The plain merge rule: always the pair of best rank, the leftmost of equal ones. ``last`` gets the last two parts of
        a text that becomes one piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, float("inf")), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == float("inf"):
                break
            if len(parts) == 2 and last is not None:
                last[text] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        if len(self.fits) >= MOST_CHECKS:
            self.fits.clear()
        # Runs of spaces are the only pieces of equal rank; they are merged anew step by step.
        apart = self.merged(left + right) == [left, right] if SPACE * 2 in left + right else self._apart(left, right)
        self.fits[left, right] = apart
        return apart

    def _apart(self, left: str, right: str) -> bool:
        """Merges both pieces anew, from their last merge back to the first: whether no merge across their border comes first."""
        rank, parts, limit, a, b = self.rank, self.parts, float("inf"), left, right
        while True:
            across = rank.get(a + b)
            if across is not None and across < limit:
                return False
            inner_a, inner_b = parts.get(a), parts.get(b)
            if inner_a is None and inner_b is None:
                return True
            # The later of the two merges is undone; of equal ones the right, as the left one came first.
            if inner_b is None or inner_a is not None and rank[a] > rank[b]:
                limit, a = rank[a], inner_a[1]
            else:
                limit, b = rank[b] + 0.5, inner_b[0]

    def _known(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        size = len(text)
        longest = [""] * size
        for end, (back, piece) in self.automaton.iter(text):
            longest[end - back] = piece  # a later match from the same place is longer
        open_, taken, fits, sizes, at = bytearray(b"\1") * (size + 1), [], self.fits, self.sizes, 0
        piece, last = longest[0], None
        while True:
            end = at + sizes[piece]
            if open_[end]:
                good = last is None or fits.get((last, piece))
                if good is None:
                    good = self._fits(last, piece)
                if good:
                    taken.append(piece)
                    if end == size:
                        whole = self.whole
                        return [whole[p] for p in taken]
                    at, last, piece = end, piece, longest[end]
                    continue
            shorter = self.shorter[piece]
            if shorter is None:
                open_[at] = 0
                piece = taken.pop()
                at -= sizes[piece]
                last = taken[-1] if taken else None
            else:
                piece = shorter

    def _chunk(self, text: str) -> bytes:
        known, ids, begin = self.known, [], 0
        if known.issuperset(text):
            return array("i", self._known(text)).tobytes()
        for at, c in enumerate(text):
            if c not in known:
                if begin < at:
                    ids += self._known(text[begin:at])
                ids += [self.bytes.get(b, self.unknown) for b in c.encode()]
                begin = at + 1
        if begin < len(text):
            ids += self._known(text[begin:])
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without begin and end ids."""
        if not text:
            return np.empty(0, np.int32)
        memo = self.memo
        return np.frombuffer(b"".join([memo[c] for c in self.chunk.findall(SPACE + text.replace(" ", SPACE))]), np.int32)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids. The space in front of a first piece belongs to the encoding, that of a byte or an unknown id does not; ids of
        no text do not count as first. Each byte of no valid character becomes U+FFFD."""
        spelled = self.spelled
        parts = [spelled[i] for i in ids]
        # An id of no text parts the bytes beside it.
        runs = [b"".join(run) for empty, run in groupby(parts, key=lambda p: not p) if not empty] if b"" in parts else [b"".join(parts)]
        text = "".join([run.decode("utf-8", "each_byte") for run in runs])
        first = next((i for i in ids if spelled[i]), self.unknown)
        return text[1:] if first in self.marked else text


@cache
def codec(path: str = MODEL) -> PieceCodec:
    """The codec of a model, made once in each worker."""
    return PieceCodec(path)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32()))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id`` and ``ids`` of each row; a null or empty text has no ids. Repeated rows stay, other columns go."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists([own.encode(t) for t in batch.column(1).to_pylist()])], ["doc_id", "ids"])

    return by_batch(docs.select("doc_id", text_of().alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds ``decoded`` to rows of ``doc_id`` and ``ids``; null ids give an empty text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, ids = codec(model), batch.column(1)
        ends, flat = ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False).tolist()
        texts = [own.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return by_batch(rows, run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: number of ids, SHA-256 of the comma-joined ids and of the decoded text."""
    rows = decode(encode(docs, model), model)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
